"""Typed settings with bounds, composed from presets and `key=value` overrides."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


class ConfigError(ValueError):
    """A setting is unknown or out of its bounds."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass
class StreamConfig:
    instance: str = "frame_folder"
    base_path: str = ""
    frame_start: int = 0
    frame_end: int = -1
    frame_skip: int = 1
    cached: bool = False

    def __post_init__(self):
        _check(self.frame_start >= 0, "streams.frame_start is from 0")
        _check(self.frame_end >= -1, "streams.frame_end is from -1")
        _check(self.frame_skip >= 1, "streams.frame_skip is from 1")


@dataclass
class AdjustConfig:
    iterations: int = 2
    damping: float = 1e-4
    ep: float = 0.1
    alpha: float = 0.001
    robust_kernel: str | None = None
    robust_threshold: float = 1.0

    def __post_init__(self):
        _check(self.iterations >= 1, "adjust.iterations is from 1")
        _check(min(self.damping, self.ep, self.alpha) >= 0, "adjust's weights are not negative")


@dataclass
class TrackConfig:
    buffer: int = 1024
    keyframe_threshold: float = 2.5
    warmup: int = 8
    most_edges: int = 48
    window: int = 25
    tracker: str = "none"
    optimise_intrinsics: bool = True
    adjust: AdjustConfig = field(default_factory=AdjustConfig)

    def __post_init__(self):
        _check(self.buffer >= 2, "track.buffer is from 2")
        _check(self.tracker in ("none", "table"), "track.tracker is none or table")


@dataclass
class OutputConfig:
    path: str = "out"
    save_artifacts: bool = True
    visualise: bool = False
    downsample: int = 4
    skip_exists: bool = False

    def __post_init__(self):
        _check(self.downsample >= 1, "output.downsample is from 1")


@dataclass
class CameraConfig:
    count: int = 6
    height: int = 512
    fovx: float = 90.0
    top: bool = True
    bottom: bool = True


@dataclass
class Config:
    pipeline: str = "default"
    depth_model: str = "intensity-l"
    camera_type: str = "PINHOLE"
    streams: StreamConfig = field(default_factory=StreamConfig)
    track: TrackConfig = field(default_factory=TrackConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    cameras: CameraConfig = field(default_factory=CameraConfig)

    def __post_init__(self):
        _check(self.pipeline in ("default", "panorama"), "pipeline is default or panorama")


#: Presets: overrides of the defaults.
PRESETS: dict[str, dict[str, Any]] = {
    "default": {},
    "wide_angle": {"camera_type": "MEI", "depth_model": "plane-l"},
    "panorama": {"pipeline": "panorama", "camera_type": "PANORAMA", "depth_model": "sphere-l", "track.buffer": 256},
    "static": {"depth_model": "plane-l"},
    "video": {"depth_model": "disparity-l"},
}


def _parsed(text: str, like: Any) -> Any:
    if text.lower() in ("null", "none"):
        return None
    if isinstance(like, bool):
        _check(text.lower() in ("true", "false"), f"{text!r} is not true or false")
        return text.lower() == "true"
    try:
        return type(like)(text) if isinstance(like, (int, float)) else text
    except ValueError as e:
        raise ConfigError(str(e)) from e


def _replaced(config: Any, path: list[str], value: Any) -> Any:
    names = {f.name for f in dataclasses.fields(config)}
    _check(path[0] in names, f"no setting {path[0]!r}")
    old = getattr(config, path[0])
    if len(path) > 1:
        _check(dataclasses.is_dataclass(old), f"{path[0]!r} has no settings")
        return dataclasses.replace(config, **{path[0]: _replaced(old, path[1:], value)})
    return dataclasses.replace(config, **{path[0]: _parsed(value, old) if isinstance(value, str) and not isinstance(old, str) else value})


def compose(preset: str = "default", overrides: list[str] | tuple[str, ...] = ()) -> Config:
    """A preset with overrides `a.b=value`; `${eq:x,y}` and `${neq:x,y}` in values are resolved."""
    _check(preset in PRESETS, f"no preset {preset!r}")
    config = Config()
    for key, value in PRESETS[preset].items():
        config = _replaced(config, key.split("."), value)
    for item in overrides:
        _check("=" in item, f"{item!r} is not key=value")
        key, value = item.split("=", 1)
        for name in ("eq", "neq"):
            if value.startswith(f"${{{name}:") and value.endswith("}"):
                a, b = value[3 + len(name) : -1].split(",")
                value = str((a.strip() == b.strip()) == (name == "eq")).lower()
        config = _replaced(config, key.split("."), value)
    return config


def primitive(config: Any) -> dict[str, Any]:
    return dataclasses.asdict(config)
