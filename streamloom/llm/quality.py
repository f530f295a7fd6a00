"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its byte classes, hashed byte pairs and
word statistics; gated attention weighs the passages, and the weighted sum of their encodings gives
the document's probability. Only document labels are used: the attention learns by itself which
passages decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, text_blocks, words
from .toxicity import labelled_sample

#: Labelled rows of each class (0, 1) that the model is learned from, by all their passages.
ROWS_PER_CLASS = (2500, 2500)
#: Bytes of a passage.
PASSAGE = 400
#: Sizes of the encoding and of the attention's gate.
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-3

_PAIRS = 48


def _classes() -> np.ndarray:
    """Class of each byte: each ASCII punctuation mark, digits, cases, spaces, line ends, lead and tail bytes."""
    c = np.zeros(256, np.int64)
    c[48:58], c[65:91], c[97:123] = 1, 2, 3
    c[32], c[10], c[9] = 4, 5, 6
    c[128:192], c[192:224], c[224:] = 7, 8, 9
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[marks] = 10 + np.arange(len(marks))
    return c


_CLASS = _classes()
_KINDS = int(_CLASS.max()) + 1
_COARSE = np.minimum(_CLASS, 10)
DIM = _KINDS + _PAIRS + 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def passages(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each document); an empty text is one passage of zeros."""
    lengths = np.diff(offs)
    per = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n = int(first[-1])
    out = np.zeros((n, DIM))
    if len(buf):
        at = np.arange(len(buf)) - np.repeat(offs[:-1], lengths)
        owner = np.repeat(first[:-1], lengths) + at // PASSAGE
        size = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        out[:, :_KINDS] = np.bincount(owner * _KINDS + _CLASS[buf], minlength=n * _KINDS).reshape(n, _KINDS) / size
        two = (_COARSE[buf[:-1]] * 11 + _COARSE[buf[1:]]) * 7 % _PAIRS
        out[:, _KINDS : _KINDS + _PAIRS] = np.bincount(owner[:-1] * _PAIRS + two, minlength=n * _PAIRS).reshape(n, _PAIRS) / size
        h, f = words(buf, offs)
        if len(h):
            space = np.zeros(256, bool)
            space[[9, 10, 11, 12, 13, 32]] = True
            inside = ~space[buf]
            edge = np.zeros(len(buf), bool)
            edge[offs[:-1][offs[:-1] < len(buf)]] = True
            start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge))
            p = owner[start]
            count = np.bincount(p, minlength=n)
            order = np.lexsort((h, p))
            hs, ps = h[order], p[order]
            new = np.ones(len(hs), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (ps[1:] != ps[:-1])
            kinds = np.bincount(ps[new], minlength=n)
            same = np.concatenate([[0], ((h[1:] == h[:-1]) & (p[1:] == p[:-1])).astype(np.int64)])
            some = np.maximum(count, 1)
            k = _KINDS + _PAIRS
            out[:, k] = kinds / some
            out[:, k + 1] = np.bincount(p, same, n) / some
            out[:, k + 2] = size[:, 0] / some / 10
            out[:, k + 3] = np.minimum(count / 40, 2)
        out[:, DIM - 1] = size[:, 0] / PASSAGE
    return out, first


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (t * s) @ w["a"]
    starts = first[:-1]
    per = np.diff(first)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), per))
    a = a / np.repeat(np.add.reduceat(a, starts), per)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return h, t, s, a, z, p


def gradient(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the weighted mean log loss of some documents by the weights."""
    per = np.diff(first)
    h, t, s, a, z, p = _forward(w, x, first)
    dp = weight * (p - y) / len(y)
    dz = np.repeat(dp[:, None] * w["c"], per, axis=0)
    inner = (dz * h).sum(1)
    da = a * (inner - np.repeat(np.add.reduceat(a * inner, first[:-1]), per))
    dt, ds = da[:, None] * w["a"] * s * (1 - t * t), da[:, None] * w["a"] * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ da, "c": z.T @ dp, "d": np.array([dp.sum()])}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Gradient descent (Adam) on the weighted log loss of whole documents."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3
    x = x if x.dtype == np.float32 else x.astype(np.float32)
    x = np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -6, 6)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"E": init(DIM, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros(1)}
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        for docs in np.array_split(order := rng.permutation(len(y)), max(1, len(order) // BATCH)):
            per = first[docs + 1] - first[docs]
            f = np.concatenate([[0], np.cumsum(per)])
            rows = np.repeat(first[docs] - f[:-1], per) + np.arange(f[-1])
            xb = x[rows]
            g = gradient(w, xb, f, y[docs], weight[docs])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w[k])
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: tuple[int, int] = ROWS_PER_CLASS) -> Model:
    """A model of docs whose label is 0 or 1; with no row of either class every score is the other's share.

    Null counts as an empty text, which is one passage; rows that repeat an id each bear its label; other
    columns play no part.
    """
    sampled, have, used = labelled_sample(docs, labels, label, rows, doc_id, text)
    share = have.get(1, 0) / max(1, sum(have.values()))
    flat = Model(np.zeros(DIM), np.ones(DIM), {"E": np.zeros((DIM, HIDDEN)), "e": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)), "U": np.zeros((HIDDEN, GATE)), "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))])})
    if not (have.get(0) and have.get(1)):
        return flat

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            for lo, hi, buf, offs in text_blocks(batch.column(0)):
                x, first = passages(buf, offs)
                x = x.astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi], pa.int32()), pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["label", "x"])

    got = sampled.mapInArrow(run, "label int, x binary").toArrow()
    if not got.num_rows:
        return flat
    bags = sorted(zip(got.column("label").to_pylist(), got.column("x").to_pylist()))
    del got
    y = np.array([b[0] for b in bags], float)
    if y.min() == y.max():
        return flat
    each = [np.frombuffer(b[1], np.float32).reshape(-1, DIM) for b in bags]
    del bags
    first = np.concatenate([[0], np.cumsum([len(e) for e in each])])
    weight = np.where(y == 1, have[1] / max(1, (y == 1).sum()), have[0] / max(1, (y == 0).sum()))
    return fit(np.concatenate(each), first, y, weight / weight.mean())


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1 for every row, from all passages of its text; null counts as empty.

    Equal texts have equal scores; an empty table gives an empty result. Every row and column of docs
    passes through (one named like the score is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def kernel(buf, offs):
            x, first = passages(buf, offs)
            return (_forward(m.weights, np.clip((x - m.mean) / m.scale, -6, 6), first)[-1],)

        return kernel

    return add_columns(docs.drop(name), text, [(name, T.DoubleType())], make)
