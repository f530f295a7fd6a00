"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds how often each byte followed each context of up to
ORDER bytes. A text's score under a language is its exact code length with these statistics frozen: a
byte that its longest known context has seen costs -log2(count / (total + kinds)), one that it has not
costs the escape -log2(kinds / (total + kinds)) and then its cost in the next shorter context, where
the bytes already excluded don't count; below order 0 all 256 bytes are equal. Frozen, the cost is a
function of (context node, byte), so all costs are laid out once as a table and a text is scored by
array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh, text_blocks

#: Bytes of context.
ORDER = 3
#: Labelled rows that each language is learned from: those whose hashed ids are the smallest.
ROWS_PER_LANGUAGE = 600
#: Bytes that are told apart; rarer ones share one symbol, whose cost is split evenly.
SYMBOLS = 127
#: Numbers in the cost table for each language: contexts of order 3 are kept by frequency.
CELLS = 3_000_000


@dataclass
class Model:
    """languages; rank of each byte among symbols (0: start of text, 1: any rare byte); context table; costs."""

    languages: list[str]
    rank: np.ndarray
    nodes: np.ndarray  # (symbols**3,) node of the longest kept context
    costs: np.ndarray  # (nodes, symbols, languages) bits


def count_contexts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """label, gram (ORDER + 1 bytes as an integer; 256 stands before the text), n."""

    def run(batches):
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, buf, offs in text_blocks(batch.column(0)):
                code = buf.astype(np.int64)
                gram = code.copy()
                lengths = np.diff(offs)
                at = np.arange(len(buf)) - np.repeat(offs[:-1], lengths)
                for k in range(1, ORDER + 1):
                    before = np.full(len(buf), 256, np.int64)
                    before[k:] = code[:-k] if k < len(code) else before[k:]
                    before[at < k] = 256
                    gram += before << (9 * k)
                owner = np.repeat(labels[lo:hi].astype(str), lengths)
                for one in sorted(set(labels[lo:hi])):
                    g, n = np.unique(gram[owner == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["label", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).mapInArrow(run, "label string, gram long, n long")
    return rows.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def sample(labelled: DataFrame, doc_id: str, label: str, per_label: int) -> DataFrame:
    """At most per_label rows of each label, those whose hashed ids are the smallest; the ids are found first, without the texts."""
    sid, = fresh(labelled, "sampled_id")
    w = Window.partitionBy(label).orderBy(F.xxhash64(doc_id), doc_id)
    ids = labelled.select(doc_id, label).withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= per_label).select(F.col(doc_id).alias(sid)).distinct()
    return labelled.join(F.broadcast(ids), F.col(doc_id) == F.col(sid), "left_semi")


def train(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of the rows of docs whose text and label are not null; without one it knows no language.

    Empty texts teach nothing; of rows that repeat an id all or none are sampled, and count each.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) > 0))
    counted = count_contexts(sample(labelled, doc_id, label, per_language), text, label)
    table = counted.toArrow()  # the grams of the sample, which bounds them
    names = np.array(table.column("label").to_pylist(), object)
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    return build(sorted(set(names)), names, gram, n)


def build(languages: list[str], names: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    size = max(1, len(languages))
    last = gram & 511
    seen = np.bincount(last, n, 512)[:256] if len(gram) else np.zeros(256)
    kept = [b for b in np.argsort(-seen, kind="stable")[: SYMBOLS - 2] if seen[b] > 0]
    rank = np.ones(257, np.int64)
    rank[256] = 0
    rank[np.sort(np.array(kept, np.int64))] = np.arange(2, 2 + len(kept))
    A = 2 + len(kept)
    spread = np.ones(A)
    spread[1] = max(1, 256 - len(kept))
    parts = [rank[(gram >> (9 * k)) & 511] for k in range(ORDER + 1)]  # byte, the one before, ...
    ctx3 = (parts[3] * A + parts[2]) * A + parts[1]
    total3 = np.bincount(ctx3, n, A**3) if len(gram) else np.zeros(A**3)
    room = max(16, CELLS // A - A * A - A - 1)
    deep = np.argsort(-total3, kind="stable")[:room]
    deep = np.sort(deep[total3[deep] > 1])
    # Nodes: 0 the root; 1 .. A order 1; then A*A of order 2; then the kept of order 3.
    base2, base3 = 1 + A, 1 + A + A * A
    nodes = base2 + np.arange(A**3) % (A * A)
    nodes[deep] = base3 + np.arange(len(deep))
    costs = np.zeros((base3 + len(deep), A, size), np.float32)
    for k, name in enumerate(languages):
        m = names == name
        b, p1, p2, c3, w = parts[0][m], parts[1][m], parts[2][m], ctx3[m], n[m].astype(float)
        uniform = (spread / 256.0)[None, :].copy()
        uniform[0, 0] = 0.0  # the start of a text is no byte
        zero = np.bincount(b, w, A)[None, :]
        p_root = _level(zero, uniform, np.zeros((1, A)), zero)
        one = np.zeros((A, A))
        np.add.at(one, (p1, b), w)
        p_one = _level(one, np.repeat(p_root, A, 0), np.repeat(zero, A, 0), one, uniform)
        two = np.zeros((A * A, A))
        np.add.at(two, (p2 * A + p1, b), w)
        p_two = _level(two, np.tile(p_one, (A, 1)), np.tile(one, (A, 1)), two, p_root)
        slot = np.searchsorted(deep, c3)
        hit = (slot < len(deep)) & (deep[np.minimum(slot, max(len(deep) - 1, 0))] == c3) if len(deep) else np.zeros(len(c3), bool)
        three = np.zeros((len(deep), A))
        np.add.at(three, (slot[hit], b[hit]), w[hit])
        up = deep % (A * A)
        p_three = _level(three, p_two[up], two[up], three, p_one) if len(deep) else np.zeros((0, A))
        with np.errstate(divide="ignore"):
            for start, p in ((0, p_root), (1, p_one), (base2, p_two), (base3, p_three)):
                costs[start : start + len(p), :, k] = -np.log2(np.maximum(p / spread, 1e-12))
    return Model(languages, rank[:256].astype(np.int64), nodes.astype(np.int32), costs)


def _level(count: np.ndarray, shorter: np.ndarray, below: np.ndarray, seen: np.ndarray, *_: np.ndarray) -> np.ndarray:
    """Probabilities in contexts given those of the next shorter ones, with escapes and exclusion."""
    total, kinds = count.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        here = np.where(total > 0, count / (total + kinds), 0.0)
        escape = np.where(total > 0, kinds / (total + kinds), 1.0)
        left = np.where(seen > 0, 0.0, shorter)
        rest = left.sum(1, keepdims=True)
        return here + np.where(rest > 0, escape * left / rest, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language of the least code length and its probability given the lengths of all.

    `und` with 0 for a null text, one without a letter, or a model of no language; equal lengths go to
    the first language by code point. Every row and column of docs passes through, but for columns named
    like the outputs, which are replaced; texts of any length are scored whole, and an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters, = fresh(docs, "has_letter")

    def make():
        m = shared.value
        A, L = m.costs.shape[1], max(1, len(m.languages))
        flat = m.costs.reshape(-1, L)
        rank, nodes = m.rank, m.nodes

        def kernel(buf, offs):
            s = rank[buf]
            starts = offs[:-1][offs[:-1] < offs[1:]]
            total = np.zeros((len(offs) - 1, L))
            if len(s):
                prev = []
                for k in (1, 2, 3):
                    p = np.zeros(len(s), np.int64)
                    p[k:] = s[:-k]
                    for j in range(k):
                        at = starts + j
                        p[at[at < len(s)]] = 0
                    prev.append(p)
                lengths = np.diff(offs)
                if (lengths < 3).any():  # the marks of a text of one or two bytes reach into the next
                    at = np.arange(len(s)) - np.repeat(offs[:-1], lengths)
                    for k in (1, 2, 3):
                        p = np.zeros(len(s), np.int64)
                        p[k:] = s[:-k]
                        p[at < k] = 0
                        prev[k - 1] = p
                node = nodes[(prev[2] * A + prev[1]) * A + prev[0]]
                cost = flat[node.astype(np.int64) * A + s]
                total[np.flatnonzero(lengths)] = np.add.reduceat(cost.astype(np.float64), starts, axis=0)
            best = total.argmin(1)
            p = 1 / np.exp2(np.maximum(total.min(1, keepdims=True) - total, -1000)).sum(1)
            return best.astype(np.int64), p

        return kernel

    pred, score = names
    k, p = fresh(docs, "language_no", "language_p")
    keep = [c for c in docs.columns if c.lower() not in {pred.lower(), score.lower()}]
    marked = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    out = add_columns(marked, text, [(k, T.LongType()), (p, T.DoubleType())], make)
    if not model.languages:
        return out.select(*keep, F.lit("und").alias(pred), F.lit(0.0).alias(score))
    known = F.element_at(F.array(*map(F.lit, model.languages)), (F.col(k) + 1).cast("int"))
    return out.select(*keep, F.when(F.col(letters), known).otherwise("und").alias(pred), F.when(F.col(letters), F.col(p)).otherwise(0.0).alias(score))
