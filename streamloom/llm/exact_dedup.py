"""Exact copies by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets two bits for each text in one block of a Bloom filter and keeps the bits that were set
twice or more. Pass 2 tests every row against those bits: a text with a bit set only once cannot be
repeated, so its row passes straight through; only the possibly repeated rows shuffle, by the SHA-256
of their text, and are resolved exactly (false positives of the filter become groups of one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Bits in a block: what bitmap_construct_agg builds.
BLOCK_BITS = 32768
#: Filter bits for each row.
BITS_PER_ROW = 16
#: The filter of repeated bits is broadcast up to this size, and joined by its block number beyond.
BROADCAST_BYTES = 32 << 20


def _bit(bitmap, position):
    """Whether a bit of bitmap_construct_agg's output is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.lit(1) + F.floor(position / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", names: tuple[str, str, str, str] = ("keep_id", "group_size", "kept", "text_sha256"), only: list[str] | None = None) -> DataFrame:
    """Every row of docs (or its columns in only) with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; null counts as empty. Of a group the largest doc_id stays (a null
    id only where there is no other). Of rows repeated with the same text and id one stays. An empty
    table gives an empty result; of columns that clash with an output name, the output's stays.
    """
    keep, size, kept, sha = names
    cols = [c for c in (docs.columns if only is None else only) if c.lower() not in {n.lower() for n in names}]
    n = docs.count()
    blocks = max(1, -(-n * BITS_PER_ROW // BLOCK_BITS))
    block, p1, p2, bits, rn, one = fresh(docs, "bloom_block", "bloom_p1", "bloom_p2", "bloom_bits", "copy_rank", "copy_alone")
    hash64 = lambda seed: F.conv(F.substring(F.col(sha), seed, 8), 16, 10).cast("long")  # noqa: E731  32 bits of the digest
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).select(*[c for c in cols], sha)
    rows = rows.withColumns({block: F.pmod(hash64(1), F.lit(blocks)).cast("int"), p1: hash64(9) % BLOCK_BITS, p2: hash64(17) % BLOCK_BITS})
    twice = (
        rows.select(block, F.explode(F.array(p1, p2)).alias(p1))
        .groupBy(block, p1).agg(F.count(F.lit(1)).alias(one)).where(F.col(one) > 1)
        .groupBy(block).agg(F.bitmap_construct_agg(p1).alias(bits))
    )
    fits = blocks * (BLOCK_BITS // 8) <= BROADCAST_BYTES
    tested = rows.join(F.broadcast(twice) if fits else twice, block, "left")
    maybe = F.coalesce(F.col(bits).isNotNull() & _bit(F.col(bits), F.col(p1)) & _bit(F.col(bits), F.col(p2)), F.lit(False))
    plain = [F.col(c) for c in cols]
    alone = tested.where(~maybe).select(*plain, F.col(doc_id).alias(keep), F.lit(1).cast("long").alias(size), F.lit(True).alias(kept), sha)
    again = tested.where(maybe).select(*plain, sha)
    # Written, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot group's.
    groups = checkpointed(again.groupBy(sha).agg(F.max(doc_id).alias(keep), F.count(F.lit(1)).alias(size)))
    joined = again.join(groups, sha)
    # Which of the rows that repeat the kept id itself stays is settled among these alone.
    same = F.col(doc_id).eqNullSafe(F.col(keep))
    first = joined.where(same).groupBy(sha).agg(F.count(F.lit(1)).alias(rn)).where(F.col(rn) > 1).count() if n else 0
    if not first:
        again = joined.select(*plain, keep, size, same.alias(kept), sha)
    else:
        from pyspark.sql import Window

        ranked = joined.where(same).withColumn(rn, F.row_number().over(Window.partitionBy(sha).orderBy(doc_id)))
        again = joined.where(~same).select(*plain, keep, size, F.lit(False).alias(kept), sha).unionByName(ranked.select(*plain, keep, size, (F.col(rn) == 1).alias(kept), sha))
    return alone.unionByName(again)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows that mark_copies drops; its columns are unchanged."""
    names = fresh(docs, "keep_id", "group_size", "kept", "text_sha256")
    return mark_copies(docs, text, doc_id, tuple(names)).where(F.col(names[2])).select(*docs.columns)
