"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal token counts. Slot i is given to the source in whose interval of
cumulative weights the golden-ratio point frac((i + 1) / phi) falls, so that every stretch of the mix
holds the sources in their proportions. Each source's documents, in a hashed order, form a stream that
is cut into blocks of one slot's tokens, which its slots take in turn, the stream being read again from
its start when it ends. A block may begin and end inside a document. What the whole slots of a source are
above or below its target in whole words is settled between the sources, so each takes exactly that.

A source is never ranked, summed or joined in one task: prefix sums and ranks are taken in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source's target is above this many times its size.
MOST_REPEATS = 3
#: Slots of the schedule at most; slots are one token or more.
SLOTS = 1 << 20
#: Cells of [0, 1) by which slots meet the sources' intervals.
CELLS = 1 << 12
#: Buckets of each source for two-level prefix sums.
BUCKETS = 1 << 10
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000

_GOLDEN = 0.6180339887498949


def count_words(text: Column) -> Column:
    r"""Runs of anything but space and \x09-\x0D; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight, target, one row for each source; the targets add up to all sizes.

    A target is the source's share by weight, at most `most` times its size; the excess goes to the
    sources below their limit by weight, until none is above. That is min(limit, level * weight) for
    one level, found from prefix sums over the sources in the order of limit / weight.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    w = Window.orderBy(F.col(source).asc_nulls_last())
    k = (F.row_number().over(w) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), k + 1)).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "filled": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The level as if exactly the sources before this one were at their limits; the first that it leaves below its own limit has the right one.
    per = per.withColumn("try", (F.col("total") - F.col("filled")) / F.col("left"))
    per = per.withColumn("level", F.max(F.when(F.col("try") * F.col("weight") <= F.col("limit"), F.col("try"))).over(everything))
    # Past a rounding error every source may seem to be at its limit; then each is.
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return per.select(source, "source_size", "weight", target.alias("target"))


def _positions(docs: DataFrame, source: str, size: str, order: Column, out: str) -> DataFrame:
    """docs with the tokens that precede each in its source's stream, by bucket sums and sums within buckets."""
    bucket, rank = fresh(docs, "stream_bucket", "stream_rank")
    docs = docs.withColumn(rank, order)
    docs = docs.withColumn(bucket, F.pmod(F.shiftright(F.col(rank), 20), F.lit(BUCKETS)).cast("int"))
    sums = docs.groupBy(source, bucket).agg(F.sum(size).alias("bucket_sum"))
    sums = sums.withColumn("bucket_start", F.sum("bucket_sum").over(Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).select(F.col(source).alias("bucket_source"), F.col(bucket).alias("bucket_no"), F.coalesce("bucket_start", F.lit(0)).alias("bucket_start"))
    w = Window.partitionBy(source, bucket).orderBy(rank, *[c for c in ("doc_id",) if c in docs.columns]).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))
    return docs.join(sums, F.col(source).eqNullSafe(F.col("bucket_source")) & (F.col(bucket) == F.col("bucket_no"))).withColumn(out, F.col(out) + F.col("bucket_start")).drop(bucket, rank, "bucket_source", "bucket_no", "bucket_start")


def goals(targets: DataFrame, source: str = "source") -> DataFrame:
    """targets with goal: the target in whole words; the largest fractions are rounded up, so that the goals add up to what the targets do."""
    whole = F.floor("target")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("target") - whole).desc(), F.col(source).asc_nulls_last())
    spare = F.round(F.sum("target").over(everything)) - F.sum(whole).over(everything)
    return targets.select("*", (whole + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)).cast("long").alias("goal"))


def slots(targets: DataFrame, tokens: int, source: str = "source") -> tuple[DataFrame, int]:
    """(slot, source, block, begin, end), and the tokens of a slot; targets are those with goals.

    A slot takes the words from begin to end of its source's stream, which lie in that block of it. A
    source that the points give too many slots leaves some of them, evenly spaced, and of the last one
    what is above its goal; that room goes to the sources that the points give too few. So each source
    takes its goal exactly, however long a slot is.
    """
    spark = targets.sparkSession
    length = max(1, -(-tokens // SLOTS))
    n = -(-tokens // length)
    w = Window.orderBy(F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = targets.where("target > 0").select(source, "target", F.sum("target").over(w).alias("hi"), F.sum("target").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    share = share.select(F.col(source).alias("slot_source"), ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), F.when(F.col("hi") >= F.col("all"), 2.0).otherwise(F.col("hi") / F.col("all")).alias("hi"))
    share = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    point = (F.col("id") + 1) * F.lit(_GOLDEN)
    slot = spark.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    given = checkpointed(slot.join(share, "cell").where("u >= lo and u < hi").select("slot", "slot_source", F.floor(F.col("slot") / 1024).cast("int").alias("chunk")))
    counts = given.groupBy("slot_source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    have = counts.groupBy("slot_source").agg(F.sum("n").alias("have")).withColumnRenamed("slot_source", "s")
    counts = counts.select(F.col("slot_source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(Window.partitionBy("slot_source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    given = given.withColumn("inner", F.row_number().over(Window.partitionBy("slot_source", "chunk").orderBy("slot")) - 1)
    given = given.join(counts, F.col("slot_source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    given = given.select("slot", "slot_source", (F.col("before") + F.col("inner")).alias("slot_rank"))
    # What the slots of a source hold above its goal, and in how many of them that is.
    owed = targets.where("goal > 0 or target > 0").join(have, F.col(source).eqNullSafe(F.col("s")), "left").select(F.col(source).alias("owed_source"), "goal", F.coalesce("have", F.lit(0)).alias("have"))
    owed = checkpointed(owed.withColumn("above", F.col("have") * length - F.col("goal")).withColumn("leave", F.ceil(F.greatest("above", F.lit(0)) / length)))
    known = F.broadcast(owed) if owed.count() <= BROADCAST_SOURCES else owed
    left = lambda r: F.floor(r * F.col("leave") / F.col("have"))
    ranked = given.join(known, F.col("slot_source").eqNullSafe(F.col("owed_source")))
    ranked = checkpointed(ranked.select("slot", "slot_source", "slot_rank", "goal", "have", "above", "leave", left(F.col("slot_rank")).alias("left"), left(F.col("slot_rank") + 1).alias("left_after")))
    begin = (F.col("slot_rank") - F.col("left")) * length
    full = F.col("left_after") < F.col("leave")
    own = ranked.where((F.col("leave") == 0) | (F.col("left_after") == F.col("left")) | ~full)
    own = own.select("slot", "slot_source", begin.alias("begin"), F.least(begin + length, F.col("goal")).alias("end")).where("begin < end")
    room = ranked.where("left_after > left").select("slot", F.when(full, F.lit(length)).otherwise(F.col("above") - (F.col("leave") - 1) * length).alias("words"))
    need = owed.where("above < 0").select("owed_source", (F.col("have") * length).alias("first"), (-F.col("above")).alias("words"))
    # Rooms in the order of slots and needs in that of sources are laid side by side; stretches of one slot's length find them.
    placed = lambda df, order, lo, hi: df.withColumn(hi, F.sum("words").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(lo, F.col(hi) - F.col("words")).drop("words").withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / length), F.floor((F.col(hi) - 1) / length))))
    fill = placed(room, F.col("slot"), "room_lo", "room_hi").join(placed(need, F.col("owed_source").asc_nulls_last(), "need_lo", "need_hi"), "cell")
    lo = F.greatest("room_lo", "need_lo", F.col("cell") * length)
    hi = F.least("room_hi", "need_hi", (F.col("cell") + 1) * length)
    fill = fill.where(lo < hi).select("slot", F.col("owed_source").alias("slot_source"), (F.col("first") + lo - F.col("need_lo")).alias("begin"), (F.col("first") + hi - F.col("need_lo")).alias("end"))
    fill = fill.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor((F.col("end") - 1) / length))))
    fill = fill.select("slot", "slot_source", "block", F.greatest("begin", F.col("block") * length).alias("begin"), F.least("end", (F.col("block") + 1) * length).alias("end"))
    own = own.select("slot", "slot_source", F.floor(F.col("begin") / length).alias("block"), "begin", "end")
    return own.unionByName(fill), length


def plan(docs: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", weights=WEIGHTS, most: float = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(schedule, targets): for each slot the stretches of documents that it takes.

    schedule: slot, doc_id, source, epoch (how often the source was read before), from_word, words, size
    (of the document). docs needs doc_id, source and size (words) and any number of rows for a doc_id; a null source is a source of its own, documents of no words are never
    taken, an empty table gives an empty schedule.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    targets = checkpointed(goals(source_targets(base, weights=weights, most=most)))
    tokens = targets.agg(F.sum("goal")).first()[0] or 0
    known = targets.select(F.col("source").alias("target_source"), "source_size", "target", "goal")
    if targets.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    full = base.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    placed = _positions(full, "source", "size", F.xxhash64("doc_id"), "start")
    given, length = slots(targets, tokens)
    # Read again up to `most` times, the stream's copies of a document start at start + k * source_size.
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int")))).where(F.col("epoch") < F.lit(most))
    copies = copies.withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where("at < goal")
    pieces = copies.withColumn("stream_block", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("size") - 1) / length))))
    lo, hi = F.greatest("at", "begin"), F.least(F.col("at") + F.col("size"), F.col("end"))
    joined = pieces.join(given, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("stream_block") == F.col("block"))).where(lo < hi)
    return joined.select("slot", "doc_id", "source", "epoch", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("words"), "size"), targets


def taken(docs: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted) for every row.

    Rows that repeat a doc_id within a source share in proportion to their sizes, rounded down, what the
    mix takes of that id. A null size counts as 0, of which nothing is taken; an empty table gives an
    empty result.
    """
    base = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")))
    schedule, targets = plan(base, weights=weights, most=most)
    known = targets.select(F.col("source").alias("target_source"), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    per = schedule.select("doc_id", "source", F.col("words").alias("taken"), F.lit(0).cast("long").alias("whole"))
    per = per.unionByName(base.select("doc_id", "source", F.lit(0).cast("long").alias("taken"), F.col("size").alias("whole"))).groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.sum("whole").alias("whole"))
    per = checkpointed(per.select(F.col("doc_id").alias("taken_id"), F.col("source").alias("taken_source"), "taken", "whole"))
    out = base.join(known, F.col("source").eqNullSafe(F.col("target_source")), "left")
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col("taken_id")) & F.col("source").eqNullSafe(F.col("taken_source")), "left")
    own = F.when(F.col("whole") == F.col("size"), F.col("taken")).when(F.col("whole") > 0, F.floor(F.col("taken") * (F.col("size") / F.col("whole"))))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(own, F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars", weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The mix as rows of docs: one for each reading of a document, holding the words that the mix takes then.

    A document that is taken whole keeps its text as it is; of one taken in part (the last of a source's
    slots ends in it) the words taken are joined by spaces and n_chars is counted anew. Rows that repeat
    a doc_id within a source are documents of their own; null and empty texts have no words and are
    never taken; an empty table gives an empty result. Columns, whatever their names, are those of docs.
    """
    size, copy_id, copy_source, epoch, start, words, whole, tag = fresh(docs, "mix_size", "mix_id", "mix_source", "epoch", "mix_from", "mix_words", "mix_whole", "mix_tag")
    columns, key = docs.columns, doc_id
    sized = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size")))
    if not sized.groupBy("doc_id", "source").count().where("count > 1").isEmpty():
        # Numbered rows stand for ids, written with their texts so that the numbers last.
        docs, key = checkpointed(docs.withColumn(tag, F.monotonically_increasing_id())), tag
        sized = checkpointed(docs.select(F.col(tag).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size")))
    schedule, _ = plan(sized, weights=weights, most=most)
    readings = schedule.groupBy(F.col("doc_id").alias(copy_id), F.col("source").alias(copy_source), F.col("epoch").alias(epoch)).agg(F.min("from_word").alias(start), F.sum("words").alias(words), F.first("size").alias(size))
    rows = docs.join(readings, F.col(key).eqNullSafe(F.col(copy_id)) & F.col(source).eqNullSafe(F.col(copy_source)))
    rows = rows.withColumn(whole, F.col(words) == F.col(size))
    part = F.concat_ws(" ", F.slice(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.col(start).cast("int") + 1, F.col(words).cast("int")))
    out = rows.withColumn(text, F.when(F.col(whole), F.col(text)).otherwise(part))
    if n_chars in columns:
        out = out.withColumn(n_chars, F.when(F.col(whole), F.col(n_chars)).otherwise(F.length(text)).cast(dict(docs.dtypes)[n_chars]))
    return out.select(*columns)
