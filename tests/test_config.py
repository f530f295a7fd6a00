"""Settings: presets, overrides, bounds; the command line."""

import json

import pytest

from streamloom import cli
from streamloom.config import PRESETS, ConfigError, compose, primitive


@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_presets(preset):
    c = compose(preset)
    assert (c.pipeline == "panorama") == (preset == "panorama")
    assert primitive(c)["streams"]["frame_skip"] == 1


def test_overrides():
    c = compose("default", ["streams.frame_skip=3", "track.adjust.ep=0.5", "output.visualise=${eq:a,a}", "track.adjust.robust_kernel=huber"])
    assert (c.streams.frame_skip, c.track.adjust.ep, c.output.visualise, c.track.adjust.robust_kernel) == (3, 0.5, True, "huber")


@pytest.mark.parametrize("bad", ["streams.frame_skip=0", "track.tracker=other", "output.downsample=0", "nothing=1", "streams.nothing=1", "streams.frame_start=x", "novalue"])
def test_errors(bad):
    with pytest.raises(ConfigError):
        compose("default", [bad])


def test_command_line(capsys):
    assert cli.main(["config", "--preset", "panorama", "cameras.count=3"]) == 0
    assert json.loads(capsys.readouterr().out)["cameras"]["count"] == 3
