"""Helpers shared by the training-data operators: names, held-out folds, Arrow text access."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a NumPy kernel handles at a time; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none clashes (whatever the case) with a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it names none, one is made in a single process (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (sc.master or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: its lineage ends there, and any executor can read it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of what is no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def add_columns(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[np.ndarray, np.ndarray], tuple]]) -> DataFrame:
    """df with columns that a NumPy kernel computes from the text column, block by block.

    make() is called once in each task and returns kernel(bytes, offsets) -> one array per field.
    Every row and column of df passes through unchanged.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        kernel = make()
        names = None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            got = [kernel(b, o) for _, _, b, o in text_blocks(column)]
            new = [pa.array(np.concatenate([g[k] for g in got])) if got else pa.array([], pa.float64()) for k in range(len(fields))]
            names = names or [*batch.schema.names, *(n for n, _ in fields)]
            new = [a.cast(_arrow(t)) for a, (_, t) in zip(new, fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    return {T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[t]


# -- words as 64-bit fingerprints ------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POW:
        _POW.clear()
        both = []
        for base in (_ODD, pow(_ODD, -1, 2**64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _POW[size] = (both[0], both[1])
    return _POW[size]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums that window() reads fingerprints of substrings from."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def window(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the substrings [start, end)."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in UTF-8, in lower case; other bytes as they are."""
    out = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
    if len(buf) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][up] += 32
    return out


def word_spans(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, starts, ends of all words in order, words before each document); words are runs of bytes that keep marks.

    By default words are divided by ASCII white space; none reaches over the end of a document.
    """
    inside = ~_SPACE[buf] if keep is None else keep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return mix(window(prefix_hash(buf), starts, ends)), starts, ends, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all words in order, words before each document), as word_spans has them."""
    h, _, _, first = word_spans(buf, offs, keep)
    return h, first
