"""Near-duplicates by DartMinHash signatures and banded joining.

Every unit of weight of a shingle is a region in which a Poisson process throws hashed darts over time,
one in each unit of time on average; a dart has a time and a coordinate of the signature. A document
sees the darts in its shingles' regions, and each coordinate keeps its earliest. Two documents keep
the same dart with their (weighted) Jaccard similarity as probability, and a document of n shingles
and a signature of k coordinates takes about max(n, k ln k) darts, not n * k.

Documents of equal shingle sets are one from then on. Buckets of bands propose pairs with the bucket's
smallest id; pairs that the signatures don't rule out are verified on whole texts, and make components.
Where a bucket still holds several components, its members of different components are compared in
blocks, by signatures and then by whole shingle sets, in the first bucket that a pair shares (by four
bytes of the buckets' own keys). Only links that join components leave a block, so that the pairs of a group are never listed and none is passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, mix, release, text_blocks, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and coordinates in each: a pair of similarity 0.8 shares none with a probability of 5e-6.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Standard deviations of the signatures' estimate below the threshold at which a pair is ruled out.
SLACK = 4.0
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 1024

_CDF = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingles(buf: np.ndarray, offs: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of the distinct shingles, ordered by both; words are divided by ASCII white space.

    A text of one to four words has one shingle, of all its words; an empty text has none. With
    counts, the j-th repetition of a shingle is an element of its own, which makes weights of counts.
    """
    h, first = words(buf, offs)
    n = np.diff(first)
    acc = h.copy()
    for k in range(1, min(SHINGLE, len(h))):
        nxt = np.zeros(len(h), np.uint64)
        nxt[:-k] = h[k:]
        acc = mix(acc * np.uint64(5) + nxt)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - first[doc] if len(h) else np.zeros(0, np.int64)
    full = at + SHINGLE <= n[doc]
    d, s = doc[full], acc[full]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = []
        for x in short:
            a = np.array([n[x]], np.uint64)
            for w in h[first[x] : first[x + 1]]:
                a = mix(a * np.uint64(7) + w)
            own.append(a)
        d, s = np.concatenate([d, short]), np.concatenate([s, *own])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    if not counts:
        return d[new], s[new]
    run = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return d, mix(s + (np.arange(len(d)) - run).astype(np.uint64) * _C3)


def signatures(doc: np.ndarray, element: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) times of the earliest darts; rows of documents without elements are infinite."""
    sig = np.full(n * k, np.inf)
    size = np.bincount(doc, minlength=n)
    horizon = np.where(size > 0, k * (np.log(k) + 4) / np.maximum(size, 1), 0.0)
    start = np.zeros(n, np.int64)
    left = np.arange(len(doc))
    while len(left):
        d = doc[left]
        slabs = np.maximum(1, np.ceil(horizon).astype(np.int64)) - start
        for lo in range(0, len(left), 200_000):
            part = left[lo : lo + 200_000]
            per = slabs[doc[part]]
            for cut in np.array_split(np.arange(len(part)), max(1, int(per.sum()) // 1_000_000)):
                _throw(sig, doc[part[cut]], element[part[cut]], per[cut], start, horizon, k)
        bare = np.isinf(sig.reshape(n, k)).any(1) & (size > 0)
        start = np.where(bare, np.where(horizon < 1, 0, np.ceil(horizon).astype(np.int64)), start)
        horizon = np.where(bare, np.maximum(np.ceil(horizon * 1.5), horizon * 1.5), horizon)
        left = left[bare[d]]
    return sig.reshape(n, k)


def _throw(sig, doc, element, per, start, horizon, k) -> None:
    """Throw the darts of the next slabs of unit time into the elements' regions."""
    d = np.repeat(doc, per)
    slab = np.arange(len(d)) - np.repeat(np.cumsum(per) - per, per) + start[d]
    h = mix(np.repeat(element, per) + (slab.astype(np.uint64) + np.uint64(1)) * _C1)
    darts = np.searchsorted(_CDF, (h >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    d, slab, h = np.repeat(d, darts), np.repeat(slab, darts), np.repeat(h, darts)
    number = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
    g = mix(h + (number.astype(np.uint64) + np.uint64(1)) * _C2)
    time = slab + (g >> np.uint64(11)).astype(np.float64) * 2.0**-53
    early = time <= np.maximum(horizon[d], 0)
    coordinate = (mix(g + _C3)[early] % np.uint64(k)).astype(np.int64)
    np.minimum.at(sig, d[early] * k + coordinate, time[early])


def sign(docs: DataFrame, text: str, doc_id: str, counts: bool = False) -> DataFrame:
    """id, n (shingles), f1, f2 (fingerprints of the set), sketch (a byte of each coordinate), bands."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch.column(1), 1 << 19):
                doc, s = shingles(buf, offs, counts)
                n = np.bincount(doc, minlength=hi - lo)
                bits = signatures(doc, s, hi - lo).view(np.uint64)
                f1, f2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                np.add.at(f1, doc, mix(s))
                np.add.at(f2, doc, mix(s ^ _C1))
                band = np.zeros((hi - lo, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(9) + bits[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * _C2)
                sketch = (mix(bits) >> np.uint64(56)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), lists], names=["id", "n", "f1", "f2", "sketch", "bands"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, sketch binary, bands array<bigint>")


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by equal sketch bytes, corrected for chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _floor(similarity: float) -> float:
    return similarity - SLACK * np.sqrt(similarity * (1 - similarity) / COORDINATES)


def _bytes(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), COORDINATES)


def _lists(column) -> np.ndarray:
    """The keys of each row's bands."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), BANDS)


def verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float, counts: bool) -> DataFrame:
    """The pairs (a, b) of at least the similarity: those that the sketches don't rule out are compared on whole texts."""
    kind = dict(pairs.dtypes)["a"]
    least = _floor(similarity)

    def plausible(batches):
        for batch in batches:
            keep = _estimate(_bytes(batch.column(2)), _bytes(batch.column(3))) >= least if batch.num_rows else np.zeros(0, bool)
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    def exact(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                d, s, side = [], [], []
                for k in (2, 3):
                    row = 0
                    for a, b, buf, offs in text_blocks(part.column(k), 1 << 30):
                        x, y = shingles(buf, offs, counts)
                        d.append(x + row)
                        s.append(y)
                        row += b - a
                sizes = [np.bincount(x, minlength=part.num_rows) for x in d]
                doc, el = np.concatenate(d), np.concatenate(s)
                order = np.lexsort((el, doc))
                doc, el = doc[order], el[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (el[1:] == el[:-1])], minlength=part.num_rows)
                keep = both >= similarity * (sizes[0] + sizes[1] - both) - 1e-9
                part = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    side = lambda t, c, what: t.select(F.col("id").alias(c), F.col(what).alias(f"{what}_{c}"))
    got = pairs.join(side(sketches, "a", "sketch"), "a").join(side(sketches, "b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(plausible, f"a {kind}, b {kind}")
    return got.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").select("a", "b", "text_a", "text_b").mapInArrow(exact, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in edges (a, b), by large-star and small-star steps."""
    pairs = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.where("u != v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.where("u != v").join(least, "u")
        pairs = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == state:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = now


def _digests(sketches: DataFrame) -> DataFrame:
    """id, n, sketch, digest (each band's key, its halves folded into four bytes)."""
    kind = dict(sketches.dtypes)["id"]

    def run(batches):
        for batch in batches:
            keys = _lists(batch.column(3)).view(np.uint64)
            keys = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "n", "sketch", "digest"])

    return sketches.select("id", "n", "sketch", "bands").mapInArrow(run, f"id {kind}, n long, sketch binary, digest binary")


def _across(cand: DataFrame, comp: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float, counts: bool) -> DataFrame:
    """Links between members of one bucket that are in different components, compared in blocks of members.

    Members of a bucket's largest component meet the others, not each other. A group's rows carry texts,
    which near copies side by side compress far better than fingerprints of their shingles do.
    """
    kind = dict(cand.dtypes)["id"]
    least = _floor(similarity)
    known = cand.join(comp, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    each = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy("key").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components")).where("components > 1")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.col("big.component").alias("big"), parts(F.col("n") - F.col("big.n")).alias("few"), parts(F.col("big.n")).alias("many"))
    rows = known.join(mixed, "key")
    small, part = F.col("component") != F.col("big"), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # Parts of the largest component are numbered after the others'. A pairing is of two parts, the first not of the largest.
    rows = rows.withColumn("part", F.when(small, part(F.col("few"))).otherwise(F.col("few") + part(F.col("many"))))
    rows = rows.withColumn("other", F.explode(F.when(small, F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))))
    rows = rows.select("key", "band", "id", "component", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    ids = rows.select("id").distinct()
    facts = _digests(sketches.join(ids, "id", "left_semi")).join(texts.select("id", "text"), "id")
    rows = rows.join(facts, "id")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, x, part = group.column("id"), _bytes(group.column("sketch")), np.array(group.column("part"))
        n, p, q, band = np.array(group.column("n")), group.column("p")[0].as_py(), group.column("q")[0].as_py(), group.column("band")[0].as_py()
        comp = np.unique(np.array(group.column("component").to_pylist()), return_inverse=True)[1].reshape(-1)
        keys = np.frombuffer(b"".join(group.column("digest").to_pylist()), np.uint32).reshape(-1, BANDS)
        sets = []
        for lo, hi, buf, offs in text_blocks(group.column("text")):
            doc, s = shingles(buf, offs, counts)
            sets += np.split(s, np.searchsorted(doc, np.arange(1, hi - lo)))
        left, right = [], []
        A, B = np.flatnonzero(part == p), np.flatnonzero(part == q)
        for a in A:
            b = B[B > a] if p == q else B
            b = b[(comp[b] != comp[a]) & (np.minimum(n[b], n[a]) >= similarity * np.maximum(n[b], n[a]))]
            if not len(b):
                continue
            first = (keys[b] == keys[a]).argmax(1) == band
            b = b[first & (_estimate(x[b], x[a]) >= least)]
            for c in b:
                if comp[c] == comp[a]:
                    continue
                both = len(np.intersect1d(sets[a], sets[c], assume_unique=True))
                if both >= similarity * (n[a] + n[c] - both) - 1e-9:
                    left.append(a)
                    right.append(c)
                    comp[comp == comp[c]] = comp[a]
        i, j = ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))
        return pa.table([i, j], names=["a", "b"])

    return rows.groupBy("key", "p", "q").applyInArrow(compare, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, counts: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row for every row of docs.

    Classes are the connected components of documents whose shingle sets (five words) have a Jaccard
    similarity of at least `similarity` (with counts: weighted by repetitions); class_id is the
    smallest doc_id of the class, whose document is kept. A null or empty text is alike to nothing but
    other empty texts' rows of the same id, so each is a class of its own; a row without doc_id is kept
    with a null class. Rows that repeat a doc_id with other text share the id's class. Of documents that
    tie the smallest id stays; an empty table gives an empty result; other columns are left out.
    """
    name = doc_id
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nameless = docs.where("id is null").select(F.col("id").alias(name), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    docs = docs.where("id is not null")
    sig = checkpointed(sign(docs, "text", "id", counts))
    sets = checkpointed(sig.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")))
    reps = sig.where("n > 0").join(sets.select("f1", "f2", F.col("rep").alias("id")), ["f1", "f2", "id"], "left_semi").dropDuplicates(["id"])
    keyed = reps.select("id", F.posexplode("bands").alias("band", "key"))
    lead = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "lead")
    cand = checkpointed(keyed.join(lead, "key").select("key", "band", "id", "lead"))
    sketches = checkpointed(reps.select("id", "sketch", "n", "bands").join(cand.select("id").distinct(), "id", "left_semi"))
    texts = checkpointed(docs.dropDuplicates(["id"]).join(sketches.select("id"), "id", "left_semi")) if _repeats(docs) else checkpointed(docs.join(sketches.select("id"), "id", "left_semi"))
    sizes = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    star = cand.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(sizes("a"), "a").join(sizes("b"), "b").where(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")).select("a", "b")
    edges = checkpointed(verify(star, sketches, texts, similarity, counts))
    release(docs.sparkSession)
    comp = components(edges)
    more = checkpointed(_across(cand.select("key", "band", "id"), comp, sketches, texts, similarity, counts))
    del cand, sketches, texts, star
    if not more.isEmpty():
        comp = components(edges.unionByName(more))
    release(docs.sparkSession)
    members = sig.select("id", "n", "f1", "f2")
    owned = members.where("n > 0").join(sets.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep").unionByName(members.where("n = 0").select("id", F.col("id").alias("rep")))
    placed = owned.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    placed = checkpointed(placed)
    size = checkpointed(placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")))
    return placed.join(size, "class_id").select(F.col("id").alias(name), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept")).unionByName(nameless)


def _repeats(docs: DataFrame) -> bool:
    """Whether an id is repeated in docs."""
    return not docs.groupBy("id").count().where("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class of near-duplicates; columns unchanged."""
    dropped, = fresh(docs, "dropped_id")
    marked = near_duplicates(docs, text, doc_id, similarity).where(~F.col("kept")).select(F.col(doc_id).alias(dropped))
    return docs.join(marked.distinct(), F.col(doc_id) == F.col(dropped), "left_anti")
