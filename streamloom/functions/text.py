"""Names, captions, phrases and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of artifact, with the folder (None: that of the run's own state) and the ending that each has.
ARTIFACTS = {
    "rgb": ("rgb", ".mp4"),
    "pose": ("pose", ".npz"),
    "depth": ("depth", ".zip"),
    "intrinsics": ("intrinsics", ".npz"),
    "camera": ("intrinsics", "_camera.txt"),
    "mask": ("mask", ".zip"),
    "phrases": ("mask", ".txt"),
    "info": (None, "_info.pkl"),
    "map": (None, "_slam_map.pt"),
}


def artifact_path(base: Column, name: Column, kind: str, state: str = "state") -> Column:
    """Where an artifact lies; state is the folder of the run's own state, which callers name to read files that others have written."""
    folder, ending = ARTIFACTS[kind]
    return F.concat(F.concat_ws("/", base, F.lit(folder or state), name), F.lit(ending))


def caption(text: Column) -> Column:
    """Lower case, trimmed, with a full stop at the end."""
    t = F.trim(F.lower(text))
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS.f as seconds."""
    p = F.split(text, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def format_seconds(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def version_numbers(text: Column) -> Column:
    """The leading numbers of a version, local part left out."""
    parts = F.split(F.split(text, r"\+")[0], r"\.")
    return F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))


def parse_phrases(lines: Column) -> Column:
    """Lines `id: phrase` as a map; a phrase may hold colons, blank lines don't count."""
    rows = F.filter(F.split(lines, "\n"), lambda x: F.trim(x) != "")
    return F.map_from_entries(F.transform(rows, lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]).cast("int"), F.trim(F.split(x, ":", 2)[1]))))


def phrases_above(tokens: Column, scores: Column, threshold: float) -> Column:
    """The tokens whose scores are above the threshold, joined by spaces."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), scores.alias("s")), lambda x: x["s"] > threshold)
    return F.array_join(F.transform(kept, lambda x: x["t"]), " ")


def model_name(text: Column) -> tuple[Column, Column]:
    """`name-sub` as its two parts; the second is empty where there is none."""
    p = F.split(text, "-", 2)
    return p[0], F.coalesce(F.get(p, F.lit(1)), F.lit(""))


def required(value: Column, name: str) -> Column:
    """The value; a null is an error that names it."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(value)
