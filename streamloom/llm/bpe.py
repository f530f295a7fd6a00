"""Byte-level BPE by prefix dynamic programming.

The valid encoding of a byte string is unique, and so is the last token of each of its prefixes:
the one token t ending there for which (last token of the prefix before t, t) is a pair that BPE
itself would leave as it is. Storing that token for every prefix makes appends exact (the stored
prefixes stay valid) and lets an edit re-encode from the edit's start on until the old and the new
encodings agree again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a task remembers; it forgets them all when there are more, and at its end.
MEMO = 300_000
#: Pieces longer than this are not remembered.
MEMO_LENGTH = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and ranks, as tiktoken has them."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens with their ranks, and how each is merged from two others."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.split: dict[int, tuple[int, int]] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.made: dict[tuple[int, int], int] = {}
        #: Every suffix of a token: its rank if it is a token itself, else -1.
        self.suffixes = {t[i:]: ranks.get(t[i:], -1) for t in ranks for i in range(len(t))}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._merged(token, rank)):
                self.split[rank] = pair
                self.made[pair] = rank

    def _merged(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that the merges of lower rank leave of a token; None if there are not two."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)), default=(below, 0))
            if best[0] >= below:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]])

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE, given these two tokens' bytes, ends with just these two tokens."""
        known = self.valid.get((left, right))
        if known is None:
            if len(self.valid) > 2 * MEMO:
                self.valid.clear()
            known = self.valid[left, right] = self._stays(left, right)
        return known

    def _stays(self, a: int, b: int) -> bool:
        # Undo the later of the two last merges, again and again: a merge across the border that
        # BPE would have made earlier than the one undone rules the pair out.
        limit = 1 << 62
        while True:
            across = self.made.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = self.split.get(a), self.split.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]


class Prefixes:
    """A byte string with the last token of the valid encoding of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def _extend(self, start: int, old: tuple[list[int], int, int] | None = None) -> None:
        ranks, tokens, last, data = self.v.ranks, self.v.tokens, self.last, bytes(self.data)
        stays, longest = self.v.stays, self.v.longest
        agreed = 0
        for end in range(start + 1, len(data) + 1):
            found = -1
            for length in range(min(longest, end), 0, -1):
                t = ranks.get(data[end - length : end])
                if t is None:
                    continue
                if length == end or stays(last[end - length - 1], t):
                    found = t
                    break
            if found < 0:
                raise ValueError("this vocabulary has no valid encoding of the text")
            last.append(found)
            if old:  # after an edit: as soon as a longest token's worth of prefixes agree, the rest does
                was, edit_end, shift = old
                agreed = agreed + 1 if end > edit_end and was[end - 1 - shift] == found else 0
                if agreed >= longest:
                    last.extend(was[end - shift :])
                    return

    def append(self, data: bytes) -> None:
        """Add bytes at the end; what is stored of the old prefixes stays as it is."""
        start = len(self.data)
        self.data += data
        self._extend(start)

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace the bytes [start, end); prefixes before start keep their tokens."""
        was, shift = self.last, len(data) - (end - start)
        self.data[start:end] = data
        self.last = was[:start]
        self._extend(start, (was, start + len(data), shift))

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(t := self.last[end - 1])
            end -= len(self.v.tokens[t])
        return out[::-1]


class _Memo(dict):
    """Piece -> its ids as little-endian 32-bit integers; pieces share what is known of their prefixes.

    Two generations bound the memory: when the young one is full it becomes the old one, from which
    pieces that are met again move back.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.whole = {t: r.to_bytes(4, "little") for t, r in vocabulary.ranks.items()}
        self.old: dict[str, bytes] = {}
        self.last: dict[bytes, int] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            ids = self.whole.get(raw) or (self._short(raw) if len(raw) <= MEMO_LENGTH else self._packed(Prefixes(self.v, raw).tokens()))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old, self.last = {}, {}

    def _packed(self, tokens: list[int]) -> bytes:
        return b"".join(self.whole[self.v.tokens[t]] for t in tokens)

    def _short(self, raw: bytes) -> bytes:
        known, get = self.last, self.v.suffixes.get
        stays, valid = self.v.stays, self.v.valid
        n = len(raw)
        last = [0] * n
        end = n
        while end and (t := known.get(raw[:end])) is None:
            end -= 1
        for e in range(1, end + 1):
            last[e - 1] = known[raw[:e]]
        if len(known) > 2 * MEMO:
            known = self.last = {}
            for e in range(1, end + 1):
                known[raw[:e]] = last[e - 1]
        for e in range(end + 1, n + 1):
            start, ends = e - 1, []
            while start >= 0 and (t := get(raw[start:e])) is not None:
                if t >= 0:
                    ends.append((start, t))
                start -= 1
            for start, t in reversed(ends):
                if not start:
                    break
                before = last[start - 1]
                ok = valid.get((before, t))
                if ok or (ok is None and stays(before, t)):
                    break
            else:
                raise ValueError("this vocabulary has no valid encoding of the text")
            last[e - 1] = known[raw[:e]] = t
        out, e = [], n
        while e:
            out.append(self.whole[token := self.v.tokens[last[e - 1]]])
            e -= len(token)
        return b"".join(out[::-1])


class Encoder:
    """Text <-> ids: each match of the pattern is encoded separately, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.memo = _Memo(self.vocabulary)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def forget(self) -> None:
        """Drop what was remembered, but for the vocabulary."""
        self.memo.forget()
        self.vocabulary.valid.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) for every row; null counts as empty.

    An empty text has no ids; an empty table gives an empty result; repeated rows are encoded each;
    other columns of docs are left out. Every node needs the vocabulary file at the same path.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterable[pa.RecordBatch]):
        e = encoder(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [e.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([e.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])
        e.forget()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() gives, hashed where it is made."""
    kind = dict(docs.dtypes)[doc_id]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]):
        e = encoder(path, pattern)
        for batch in batches:
            counts, hashed, back = [], [], []
            for t in batch.column(1):
                ids = e.encode(t.as_py() or "")
                counts.append(len(ids) // 4)
                hashed.append(sha(ids))
                back.append(sha(e.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
