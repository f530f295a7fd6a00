"""Repeated byte strings, found by blockwise sorting with a difference cover.

A string of LENGTH bytes is repeated when it also starts anywhere else, in the same document or another.
Whole suffixes are never sorted at once: they are dealt out to buckets, and one bucket is sorted at a
time, which bounds the memory.

1. A difference cover D modulo V holds, for any two positions i and j, an offset d < V with both i + d
   and j + d in the sample of positions that are in D modulo V. So of two equal strings of LENGTH bytes
   a pair of sample positions at the same offset starts two equal strings of CORE = LENGTH - V + 1
   bytes. The sample (6 % of all positions) is named by fingerprints of those; names met once are
   dropped, and with them every suffix that has no repeated sample name within its first V bytes.
2. The suffixes left are cut into segments, of consecutive ones whose first LENGTH bytes have their least
   GRAM-gram (by fingerprint, the leftmost of equals) at the same place. Equal strings have it at the same
   offset, so they meet in that gram's bucket, to which each segment's bytes go. A bucket names and sorts
   the strings of all its segments, compares equal names byte by byte and answers which are repeated.

Long ties are thus settled by names and bytes, not by stored ranks of the cover's sample.

Passages that documents share are also told in words, as a passage of many words may have fewer bytes:
of each PASSAGE words in a row the least RUN-word string (by fingerprint) stands for them, and one that
another document has too is counted. So a passage of PASSAGE words that two documents share always
counts, and whatever counts is RUN shared words at least.

Documents travel in blocks; a block sends each name or segment once, or twice where it holds it more
often, and a task a segment's bytes twice at most, so that copies don't add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix, powers, prefix_hash, release, text_blocks, window, words

LENGTH = 400
#: A perfect difference set modulo 16 * 16 + 16 + 1; every difference occurs once.
V = 273
COVER = (39, 59, 78, 83, 89, 91, 118, 125, 156, 166, 178, 181, 182, 199, 227, 236, 250)
CORE = LENGTH - V + 1
GRAM = 16
#: Text bytes of a block, and name bytes of a bucket, that are aimed at.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 3 << 20
#: Words of a passage that is shared, and of the strings that stand for it.
PASSAGE, RUN = 50, 40
_IN_COVER = np.zeros(V, bool)
_IN_COVER[list(COVER)] = True


def _short(names: np.ndarray) -> np.ndarray:
    """Sample names only filter, so 40 bits of them do."""
    return names >> np.uint64(24)


class Part:
    """Consecutive documents and the names in them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        self.prefix = prefix_hash(buf)
        lengths = np.diff(offs)
        self.at = np.arange(len(buf)) - np.repeat(offs[:-1], lengths)
        self.left = np.repeat(lengths, lengths) - self.at
        self.long = np.repeat(lengths >= LENGTH, lengths)

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        _, down = powers(len(self.prefix))
        return mix((self.prefix[at + width] - self.prefix[at]) * down[at])

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        p = np.flatnonzero((self.left >= CORE) & self.long & _IN_COVER[self.at % V])
        return p, _short(self.names(p, CORE))

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, name) of the strings of words that stand for the documents' passages, each once."""
        h, first = words(self.buf, self.offs)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) - first[doc] if len(h) else np.zeros(0, np.int64)
        start = np.flatnonzero(at + PASSAGE <= n[doc])
        if not len(start):
            return start, start.astype(np.uint64)
        up, down = powers(len(h) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
        runs = np.arange(len(h) - RUN + 1)
        name = mix((sums[runs + RUN] - sums[runs]) * down[runs])
        least = name[start]
        for k in range(1, PASSAGE - RUN + 1):
            np.minimum(least, name[start + k], out=least)
        owner = doc[start]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
        least, owner = least[new], owner[new]
        order = np.lexsort((least, owner))
        least, owner = least[order], owner[order]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
        return owner[new], least[new]

    def candidates(self, p: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Mask of the starts of LENGTH bytes with a hit among the samples p within their first V bytes."""
        seen = np.zeros(len(self.buf) + 1, np.int32)
        seen[p[hit] + 1] = 1
        seen = np.cumsum(seen)
        s = np.flatnonzero(self.left >= LENGTH)
        out = np.zeros(len(self.buf), bool)
        out[s[seen[s + V] > seen[s]]] = True
        return out

    def segments(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start + 1, name, bucket key) of the segments of the masked starts."""
        s = np.flatnonzero(mask)
        if not len(s):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        n, width = len(self.buf), LENGTH - GRAM + 1
        gram = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max)
        fits = np.flatnonzero(self.left >= GRAM)
        value = self.names(fits, GRAM)
        gram[fits] = (value & np.uint64(0xFFFFFFFF00000000)) | fits.astype(np.uint64)
        # Least of every `width` in a row, from prefix and suffix minima of blocks of that many.
        rows = gram.reshape(-1, width)
        before = np.minimum.accumulate(rows, 1).reshape(-1)
        after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = (np.minimum(after[s], before[s + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (s[1:] != s[:-1] + 1) | (least[1:] != least[:-1])])
        lo = s[new]
        hi = s[np.concatenate([new[1:], [True]])] + 1
        name = mix(window(self.prefix, lo, hi - 1 + LENGTH) + (hi - lo).astype(np.uint64))
        return lo, hi, name, self.names(least[new], GRAM)


def _split(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in like])[:-1])


def _flat(arrays: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def segments(parts: list[Part], sample: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of each part: (first start, last start + 1, name, bucket key) of its segments."""
    got = [p.samples() for p in parts]
    hits = _split(among(_flat([n for _, n in got]), sample), [n for _, n in got])
    return [p.segments(p.candidates(at, hit)) for p, (at, _), hit in zip(parts, got, hits)]


def covered(parts: list[Part], sample: np.ndarray, names: np.ndarray, spans: list[bytes]) -> list[np.ndarray]:
    """Of each part: the mask of the bytes in strings of LENGTH bytes that start anywhere else too.

    spans: of each segment name (sorted), pairs of a first and an end start within it that are repeated; empty if all are.
    """
    out = []
    for part, (lo, hi, name, _) in zip(parts, segments(parts, sample)):
        edge = np.zeros(len(part.buf) + 1, np.int64)
        if len(names) and len(name):
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            for i in np.flatnonzero(names[at] == name):
                pairs = (np.frombuffer(spans[at[i]], np.int32).reshape(-1, 2) if spans[at[i]] else np.array([[0, hi[i] - lo[i]]])) + lo[i]
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1] - 1 + LENGTH, -1)
        out.append(np.cumsum(edge)[:-1] > 0)
    return out


def among(names: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Whether each name is in the sorted array repeated, or twice in names."""
    out = np.zeros(len(names), bool)
    if len(repeated) and len(names):
        at = np.minimum(np.searchsorted(repeated, names), len(repeated) - 1)
        out = repeated[at] == names
    order = np.argsort(names, kind="stable")
    x = names[order]
    same = np.zeros(len(x), bool)
    same[1:] = x[1:] == x[:-1]
    same[:-1] |= same[1:]
    out[order] |= same
    return out


#: Bytes of a packed name: sample names only filter, those of passages decide.
_SHORT, _LONG = 5, 8


def _pack(names: np.ndarray, width: int = _SHORT) -> bytes:
    return np.ascontiguousarray(names).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, width: int = _SHORT) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _twice(x: np.ndarray) -> np.ndarray:
    """Of sorted values: a mask of the first two of each run."""
    keep = np.ones(len(x), bool)
    keep[2:] = (x[2:] != x[1:-1]) | (x[2:] != x[:-2])
    return keep


_NAMES = "bucket long, block long, names binary"
_SEGMENTS = "bucket long, block long, name long, many boolean, bytes binary"
_ANSWERS = "block long, name long, names binary"


def _name_table(bucket, block, names) -> dict[str, pa.Array]:
    return {"bucket": pa.array(bucket, pa.int64()), "block": pa.array(block, pa.int64()), "names": pa.array(names, pa.binary())}


def _deal_samples(names: np.ndarray, block: int, buckets: int, width: int) -> dict[str, pa.Array]:
    """Of each bucket one row with its packed names; a name met more than twice is sent twice. Buckets below 0 are those of passages."""
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((names, bucket))
    names, bucket = names[order], bucket[order]
    keep = _twice(names)
    names, bucket = names[keep], bucket[keep]
    edges = _runs(bucket)
    told = bucket[edges[:-1]] if width == _SHORT else -1 - bucket[edges[:-1]]
    return _name_table(told, [block] * (len(edges) - 1), [_pack(names[i:j], width) for i, j in zip(edges[:-1], edges[1:])])


def _sort_samples(group: pa.Table) -> pa.Table:
    """Sort one bucket's names, and send to each block those that were sent twice or more; the bucket is -1 for passages, else 0."""
    kind = -1 if group.column("bucket")[0].as_py() < 0 else 0
    width = _LONG if kind else _SHORT
    data = group.column("names").to_pylist()
    names, owner = _unpack(b"".join(data), width), np.repeat(np.array(group.column("block")), [len(x) // width for x in data])
    order = np.argsort(names, kind="stable")
    x, owner = names[order], owner[order]
    same = np.zeros(len(x), bool)
    same[1:] = x[1:] == x[:-1]
    same[:-1] |= same[1:]
    x, owner = x[same], owner[same]
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    keep = np.concatenate([[True], (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])]) if len(x) else np.zeros(0, bool)
    x, owner = x[keep], owner[keep]
    edges = _runs(owner)
    return pa.table(_name_table([kind] * (len(edges) - 1), owner[edges[:-1]], [_pack(x[i:j], width) for i, j in zip(edges[:-1], edges[1:])]))


def _equal_strings(buf: np.ndarray, start: np.ndarray, name: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at each start stand at others too, or weigh more than 1 themselves; names are equal where strings are.

    The suffixes are sorted by name, and each is compared byte by byte with the first of its name. starts
    are in ascending order.
    """
    order = np.argsort(name, kind="stable")
    edges = _runs(name[order])
    hit = np.zeros(len(start), bool)
    total = np.add.reduceat(weight[order], edges[:-1]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(edges)
    hit[order[np.repeat(total > 1, sizes)]] = True
    first = np.zeros(len(start), np.int64)
    first[order] = order[np.repeat(edges[:-1], sizes)]
    at = np.flatnonzero(first != np.arange(len(start)))
    # Where both a string and the first of its name follow on a pair that is compared, only the last byte is new.
    follows = np.zeros(len(start), bool)
    follows[1:] = (start[1:] == start[:-1] + 1) & (start[first[1:]] == start[first[:-1]] + 1) & (first[:-1] != np.arange(len(start) - 1))
    last = lambda i: buf[start[i] + LENGTH - 1]
    same = bool((last(at[follows[at]]) == last(first[at[follows[at]]])).all())
    span, odd = np.arange(LENGTH), []
    whole = at[~follows[at]] if same else at
    for i in range(0, len(whole), 8192):
        one = whole[i : i + 8192]
        odd.append(one[(buf[start[one][:, None] + span] != buf[start[first[one]][:, None] + span]).any(1)])
    if same and any(map(len, odd)):  # what follows on an unequal pair is unknown
        odd.append(at)
    if len(odd := _flat(odd, np.int64)):  # different strings of one name: settled by their bytes alone
        again = np.flatnonzero(np.isin(name, name[odd]))
        text = [buf[start[i] : start[i] + LENGTH].tobytes() for i in again]
        of: dict[bytes, int] = {}
        for i, t in zip(again, text):
            of[t] = of.get(t, 0) + int(weight[i])
        hit[again] = [of[t] > 1 for t in text]
    return hit


_seen: dict[int, dict[int, int]] = {}


def _times(names: np.ndarray) -> np.ndarray:
    """How often this task has met each of some distinct names, this time included.

    From the third time on a segment's bytes stay behind and its name is answered as repeated, so however
    many documents hold a passage, its bucket gets its bytes twice from each task at most.
    """
    task = TaskContext.get().taskAttemptId()
    if task not in _seen:
        _seen.clear()
        _seen[task] = {}
    seen = _seen[task]
    for n in names.tolist():
        seen[n] = seen.get(n, 0) + 1
    return np.array([seen[n] for n in names.tolist()], np.int64)


def _sort_segments(group: pa.Table) -> pa.Table:
    """Sort the strings of one bucket's segments; answer each segment with its repeated starts, or with nothing if all are."""
    if group.column("bucket")[0].as_py() < 0:
        return pa.table({"block": group.column("block"), "name": group.column("name"), "names": pa.array([b""] * group.num_rows, pa.binary())})
    data = group.column("bytes").to_pylist()
    buf = np.frombuffer(b"".join(data), np.uint8)
    length = np.array([len(x) for x in data])
    count = length - LENGTH + 1
    ends = np.cumsum(count)
    start = np.arange(ends[-1]) + np.repeat((LENGTH - 1) * np.arange(len(data)), count)
    parts = [Part(b, o) for _, _, b, o in text_blocks(group.column("bytes"))]
    name = _flat([p.names(np.flatnonzero(p.left >= LENGTH), LENGTH) for p in parts])
    hit = _equal_strings(buf, start, name, 1 + np.repeat(np.array(group.column("many")).astype(np.int64), count))
    del parts
    block, name, out = [], [], []
    blocks, own = group.column("block").to_pylist(), group.column("name").to_pylist()
    for i in np.flatnonzero(np.add.reduceat(hit, ends - count)):
        h = np.concatenate([[False], hit[ends[i] - count[i] : ends[i]], [False]])
        turn = np.flatnonzero(h[1:] != h[:-1]).astype(np.int32)
        block.append(blocks[i])
        name.append(own[i])
        out.append(turn.tobytes())
    return pa.table({"block": pa.array(block, pa.int64()), "name": pa.array(name, pa.int64()), "names": pa.array(out, pa.binary())})


def _repeated(told: pa.Table, kind: int = 0) -> np.ndarray:
    return np.sort(_unpack(b"".join(told.column("names").filter(pa.compute.equal(told.column("kind"), kind)).to_pylist()), _LONG if kind else _SHORT))


def _answers(told: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    own = told.filter(pa.compute.equal(told.column("kind"), 1))
    names = np.array(own.column("name")).astype(np.int64).view(np.uint64)
    order = np.argsort(names, kind="stable")
    spans = own.column("names").to_pylist()
    return names[order], [spans[i] for i in order]


def _parts(table: pa.Table) -> list[Part]:
    return [Part(buf, offs) for _, _, buf, offs in text_blocks(table.column("text"))]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passages (RUN-word strings shared with other rows), kept (binary: the remaining bytes) for every row.

    Texts are UTF-8 bytes, null counts as empty; a text below LENGTH bytes loses nothing; repeated rows
    are each other's repeats; an empty table gives an empty result. Other columns are left out.
    """
    kind = dict(docs.dtypes)[doc_id]
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total * 3 // 10 // BUCKET_BYTES))
    wide = max(1, -(-total // 2 // BUCKET_BYTES))
    rows = docs.select(F.col(doc_id).alias("id"), t.cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(doc_id), F.length(t)), F.lit(blocks)).alias("block"))

    def sample(batches):
        for batch in batches:
            owner = np.array(batch.column(1))
            for block in np.unique(owner):
                part = batch.filter(pa.array(owner == block))
                for _, _, buf, offs in text_blocks(part.column(0)):
                    one = Part(buf, offs)
                    yield pa.RecordBatch.from_pydict(_deal_samples(one.samples()[1], int(block), buckets, _SHORT))
                    yield pa.RecordBatch.from_pydict(_deal_samples(one.passages()[1], int(block), buckets, _LONG))

    def send(key, mine: pa.Table, told: pa.Table) -> pa.Table:
        parts = _parts(mine) if mine.num_rows else []
        got = segments(parts, _repeated(told))
        name, bucket = _flat([g[2] for g in got]), (_flat([g[3] for g in got]) % np.uint64(wide)).astype(np.int64)
        where = [(p, int(a), int(b)) for p, g in zip(parts, got) for a, b in zip(g[0], g[1])]
        order = np.argsort(name, kind="stable")
        edges = _runs(name[order])
        first = order[edges[:-1]]
        known = _times(name[first]) > 2
        data = [None if k else where[i][0].buf[where[i][1] : where[i][2] - 1 + LENGTH].tobytes() for i, k in zip(first, known)]
        return pa.table({"bucket": pa.array(np.where(known, -1 - bucket[first], bucket[first]), pa.int64()), "block": pa.array([key[0].as_py()] * len(first), pa.int64()), "name": pa.array(name[first].view(np.int64), pa.int64()), "many": pa.array(np.diff(edges) > 1 if len(first) else [], pa.bool_()), "bytes": pa.array(data, pa.binary())})

    def cut(mine: pa.Table, told: pa.Table) -> pa.Table:
        parts = _parts(mine) if mine.num_rows else []
        size, gone, spans, kept, shared = [], [], [], [], []
        found = [p.passages() for p in parts]
        hits = _split(among(_flat([n for _, n in found]), _repeated(told, -1)), [n for _, n in found])
        for p, (owner, _), hit in zip(parts, found, hits):
            shared += np.bincount(owner[hit], minlength=len(p.offs) - 1).tolist()
        for p, mask in zip(parts, covered(parts, _repeated(told), *_answers(told))):
            for a, b in zip(p.offs[:-1], p.offs[1:]):
                m = mask[a:b]
                size.append(b - a)
                gone.append(int(m.sum()))
                spans.append(int((m & ~np.concatenate([[False], m[:-1]])).sum()) if b > a else 0)
                kept.append(p.buf[a:b][~m].tobytes())
        return pa.table([mine.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shared, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept"])

    blank = F.lit(None).cast("long").alias("name")
    told = checkpointed(rows.select("text", "block").mapInArrow(sample, _NAMES).groupBy("bucket").applyInArrow(_sort_samples, _NAMES).select("block", blank, "names", F.col("bucket").alias("kind")))
    release(spark)
    sent = rows.groupBy("block").cogroup(told.where("kind = 0").groupBy("block")).applyInArrow(send, _SEGMENTS)
    more = checkpointed(sent.groupBy("bucket").applyInArrow(_sort_segments, _ANSWERS))
    release(spark)
    return rows.groupBy("block").cogroup(told.unionByName(more.withColumn("kind", F.lit(1).cast("long"))).groupBy("block")).applyInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, n_passages long, kept binary").withColumnRenamed("id", doc_id)


def digests(done: DataFrame) -> DataFrame:
    """The kept bytes as their SHA-256."""
    return done.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
