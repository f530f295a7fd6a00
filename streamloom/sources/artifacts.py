"""Artifact files as DataFrames: poses, intrinsics, depth and mask archives, phrases, frame folders, manifests.

All readers start from Spark's binaryFile source, so that files may lie in any store Spark reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codecs

#: Endings of images that a frame folder is made of.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _name(df: DataFrame) -> DataFrame:
    return df.withColumn("stream_id", F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, frame_idx, pose (16 entries, camera to world) of npz files with inds and data."""

    def run(parts):
        for p in parts:
            for name, data in zip(p["stream_id"], p["content"]):
                z = codecs.npz_read(data)
                yield pd.DataFrame({"stream_id": name, "frame_idx": z["inds"].astype("int64"), "pose": list(z["data"].reshape(len(z["inds"]), 16).astype(float))})

    return _name(_files(spark, path, "*.npz")).select("stream_id", "content").mapInPandas(run, "stream_id string, frame_idx long, pose array<double>")


def read_intrinsics(spark: SparkSession, path: str, camera_path: str | None = None) -> DataFrame:
    """stream_id, frame_idx, intrinsics, camera_type; frames without a type are PINHOLE, whose intrinsics are four."""

    def run(parts):
        for p in parts:
            for name, data in zip(p["stream_id"], p["content"]):
                z = codecs.npz_read(data)
                yield pd.DataFrame({"stream_id": name, "frame_idx": z["inds"].astype("int64"), "intrinsics": list(z["data"].astype(float))})

    rows = _name(_files(spark, path, "*.npz")).select("stream_id", "content").mapInPandas(run, "stream_id string, frame_idx long, intrinsics array<double>")
    if camera_path is None:
        return rows.withColumn("camera_type", F.lit("PINHOLE"))
    text = spark.read.text(camera_path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(_camera)?\.[^./]*$", 1).alias("stream_id"), F.split("value", ":").alias("p")).where(F.size("p") > 1)
    types = text.select("stream_id", F.trim(F.col("p")[0]).cast("long").alias("frame_idx"), F.trim(F.col("p")[1]).alias("camera_type"))
    return rows.join(types, ["stream_id", "frame_idx"], "left").withColumn("camera_type", F.coalesce("camera_type", F.lit("PINHOLE")))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, frame_idx, height, width, depth of zips of EXR files; an unreadable member is a map of NaN of the last size.

    A first member that cannot be read is an error, for its size is not known.
    """

    def run(parts):
        for p in parts:
            for name, data in zip(p["stream_id"], p["content"]):
                shape = None
                for member, body in codecs.zip_members(data):
                    try:
                        depth = codecs.exr_decode(body)
                        shape = depth.shape
                    except Exception:
                        if shape is None:
                            raise
                        depth = np.full(shape, np.nan, np.float32)
                    yield pd.DataFrame({"stream_id": [name], "frame_idx": [int(member.split(".")[0])], "height": [shape[0]], "width": [shape[1]], "depth": [depth.ravel()]})

    return _name(_files(spark, path, "*.zip")).select("stream_id", "content").mapInPandas(run, "stream_id string, frame_idx long, height int, width int, depth array<float>")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, frame_idx, height, width, ids of zips of PNG files."""

    def run(parts):
        for p in parts:
            for name, data in zip(p["stream_id"], p["content"]):
                for member, body in codecs.zip_members(data):
                    image = codecs.png_decode(body)
                    yield pd.DataFrame({"stream_id": [name], "frame_idx": [int(member.split(".")[0])], "height": [image.shape[0]], "width": [image.shape[1]], "ids": [image.ravel().astype("int16")]})

    return _name(_files(spark, path, "*.zip")).select("stream_id", "content").mapInPandas(run, "stream_id string, frame_idx long, height int, width int, ids array<short>")


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, id, phrase of text files with lines `id: phrase`; a phrase may hold colons."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1).alias("stream_id"), F.split("value", ":", 2).alias("p")).where(F.size("p") == 2)
    return rows.select("stream_id", F.trim(F.col("p")[0]).cast("int").alias("id"), F.trim(F.col("p")[1]).alias("phrase"))


def frame_folder(spark: SparkSession, path: str, start: int = 0, end: int = -1, step: int = 1) -> DataFrame:
    """stream_id (the folder), raw_frame_idx, frame_idx, path of a folder's images in the order of their names (frame_10 is before frame_2)."""
    from ..operators.streams import seek

    glob = "*.{" + ",".join(x for e in IMAGE_ENDINGS for x in (e, e.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    files = files.withColumn("stream_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).distinct()
    numbered = files.withColumn("raw_frame_idx", F.row_number().over(Window.partitionBy("stream_id").orderBy("path")) - 1)
    return seek(numbered, start, end, step)


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, path of a folder's mp4 files by name; frames need a decoder passed to decode_videos."""
    return _name(_files(spark, path, "*.mp4")).select("stream_id", "path").orderBy("path")


def decode_videos(files: DataFrame, decoder, schema: str = "stream_id string, raw_frame_idx long, height int, width int, rgb binary") -> DataFrame:
    """Frames of binary video files: decoder(bytes) yields (height, width, rgb bytes) in order. No decoder comes with this library."""

    def run(parts):
        for p in parts:
            for name, data in zip(p["stream_id"], p["content"]):
                for k, (h, w, rgb) in enumerate(decoder(data)):
                    yield pd.DataFrame({"stream_id": [name], "raw_frame_idx": [k], "height": [h], "width": [w], "rgb": [rgb]})

    return files.select("stream_id", "content").mapInPandas(run, schema)


def _collected(rows: DataFrame, key: str, build, field: str = "content") -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [p[key].iloc[0]], field: [build(p)]})

    return rows.groupBy(key).applyInPandas(run, f"{key} string, {field} binary")


def pose_files(frames: DataFrame) -> DataFrame:
    """stream_id, content: an npz of each stream's non-null poses (16 entries) and frame numbers."""

    def build(p):
        p = p.sort_values("frame_idx")
        return codecs.npz_build(data=np.array(p["pose"].tolist(), np.float32).reshape(-1, 4, 4), inds=p["frame_idx"].to_numpy())

    return _collected(frames.where("pose is not null").select("stream_id", "frame_idx", "pose"), "stream_id", build)


def intrinsics_files(frames: DataFrame) -> DataFrame:
    def build(p):
        p = p.sort_values("frame_idx")
        return codecs.npz_build(data=np.array(p["intrinsics"].tolist(), np.float32), inds=p["frame_idx"].to_numpy())

    return _collected(frames.where("intrinsics is not null").select("stream_id", "frame_idx", "intrinsics"), "stream_id", build)


def depth_files(frames: DataFrame) -> DataFrame:
    """stream_id, content: a zip of %05d.exr in half precision."""

    def build(p):
        p = p.sort_values("frame_idx")
        return codecs.zip_build([(f"{i:05d}.exr", codecs.exr_encode(np.array(d, np.float32).reshape(h, w))) for i, h, w, d in zip(p["frame_idx"], p["height"], p["width"], p["depth"])])

    return _collected(frames.where("depth is not null").select("stream_id", "frame_idx", "height", "width", "depth"), "stream_id", build)


def mask_files(frames: DataFrame) -> DataFrame:
    """stream_id, content: a zip of %05d.png of instance ids."""

    def build(p):
        p = p.sort_values("frame_idx")
        return codecs.zip_build([(f"{i:05d}.png", codecs.png_encode(np.array(d, np.uint8).reshape(h, w))) for i, h, w, d in zip(p["frame_idx"], p["height"], p["width"], p["ids"])])

    return _collected(frames.where("ids is not null").select("stream_id", "frame_idx", "height", "width", "ids"), "stream_id", build)


def manifest(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The clips of each video among a dataset manifest's archives that begin with the prefix."""
    rows = spark.read.parquet(path).where(F.col("tar_name").startswith(prefix))
    return rows.groupBy("youtube_link").agg(F.sort_array(F.collect_set(F.struct("sequence", "youtube_timestamp"))).alias("clips"), F.sort_array(F.collect_set("tar_name")).alias("archives"))
