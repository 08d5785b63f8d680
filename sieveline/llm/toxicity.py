"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios, trained on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .kernel import _LOWER, U, blocks, mix, mix_int

#: Lengths of character n-grams (code points), and bits of their hash space.
SIZES, BITS = (4, 5, 6), 20
#: Labelled rows that a fit reads at most: those with the smallest hash of id.
SAMPLE = 4000
#: Features with fewer documents than this, or a smaller weight, score nothing.
LEAST, KEEP = 5, 0.02
#: Change of a weight, as a share of the largest one, below which a fit ends.
STILL = 1e-3


def characters(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and the texts' offsets among them. A-Z are
    folded; white space and digits are classes."""
    if not (buf > 127).any():
        return _CLASS[buf].astype(U), at
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[start].astype(U)
    size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    out = np.where(size == 1, _CLASS[buf[start]], lead & (U(0xFF) >> (size + 1).astype(U)))
    for k in range(1, 4):
        m = size > k
        out[m] = out[m] << U(6) | (buf[np.minimum(start[m] + k, len(buf) - 1)] & U(0x3F))
    return out.astype(U), np.searchsorted(start, at).astype(np.int64)


def gram_hashes(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: bucket of every n-gram inside one text, and that
    text."""
    c, at = characters(buf, at)
    n = len(c)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for size in SIZES:
        if n < size:
            continue
        h = np.zeros(n - size + 1, U)
        for j in range(size):
            h += c[j : n - size + 1 + j] * U(mix_int(0x7FEB352D * (j + 1) + size) | 1)
        i = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        yield (mix(h) >> U(64 - BITS)).astype(np.int64)[i], doc[i]


_CLASS = _LOWER.copy()
_CLASS[[9, 10, 11, 12, 13]] = 32
_CLASS[48:58] = 48


class Model(NamedTuple):
    """weight per bucket (learnt weight times log-count ratio), bias, scale."""

    weight: np.ndarray
    bias: float

    def margins(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        keys = []
        used = self.weight != 0
        for h, doc in gram_hashes(buf, at):
            m = used[h]
            keys.append(doc[m] << BITS | h[m])
        k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return self.bias + np.bincount(k >> BITS, self.weight[k & ((1 << BITS) - 1)], minlength=n)

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(buf, at), -30, 30)))


def presence(texts: pa.Array) -> list[np.ndarray]:
    """Distinct buckets of each text."""
    out = []
    for _, _, buf, at in blocks(texts, 1 << 20):
        keys = []
        for h, doc in gram_hashes(buf, at):
            keys.append(doc << BITS | h)
        k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        cut = np.searchsorted(k >> BITS, np.arange(len(at)))
        out += [(k[cut[d] : cut[d + 1]] & ((1 << BITS) - 1)).astype(np.int32) for d in range(len(at) - 1)]
    return out


def fit(texts: pa.Array, labels: np.ndarray, smooth: float = 1.0, l2: float = 10.0, rounds: int = 200, odds: float | None = None) -> Model:
    """Fit on present/absent n-grams.

    The log-count ratio of a bucket is log(p / q), p and q its smoothed shares of
    toxic and of other documents. Logistic regression with an L2 penalty learns
    weights over ratio-scaled features, by gradient steps with momentum; classes
    weigh by the root of their odds. `odds` are those of toxic rows where texts
    were sampled from, if the classes were sampled at different rates: rows then
    weigh as their class does there. Weights below KEEP become zero. With one
    class only, the model is its smoothed share.
    """
    labels = np.asarray(labels, np.float64)
    n, pos = len(labels), float(labels.sum())
    size = 1 << BITS
    if n == 0 or pos == 0 or pos == n:
        share = (pos + 0.5) / (n + 1) if n else 0.05
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    odds = pos / (n - pos) if odds is None else odds
    feats = presence(texts)
    p, q = np.zeros(size), np.zeros(size)
    for f, y in zip(feats, labels):
        (p if y else q)[f] += 1
    ratio = np.log((p + smooth) / (pos + 2 * smooth)) - np.log((q + smooth) / (n - pos + 2 * smooth))
    ok = (p + q >= LEAST) & (np.abs(ratio) > 0.7)
    ids = np.flatnonzero(ok)
    where = np.full(size, -1, np.int32)
    where[ids] = np.arange(len(ids), dtype=np.int32)
    feats = [where[f] for f in feats]
    feats = [f[f >= 0] for f in feats]
    lens = np.array([len(f) for f in feats])
    col = np.concatenate(feats) if len(feats) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), lens)
    r = ratio[ids].astype(np.float32)
    # sums over rows and over columns of the 0/1 matrix, as sums of runs
    full, by_col = np.flatnonzero(lens), np.argsort(col, kind="stable")
    row_at, col_row = (np.cumsum(lens) - lens)[full], row[by_col].astype(np.int32)
    col_at = np.searchsorted(col[by_col], np.arange(len(ids)))

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.float32)
        if len(full):
            out[full] = np.add.reduceat(values[col], row_at)
        return out

    w, v, bias, vb = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32), float(np.log(odds)), 0.0
    cost = np.where(labels > 0, np.sqrt(odds) * (n - pos) / pos, 1.0)
    # step size from a bound on the curvature
    step = 1.0 / (0.25 * float((cost * (by_row(r * r) + 1)).max()) * 0.5 + l2)
    step = max(step, 1e-4)
    for _ in range(rounds):
        look_w, look_b = w + np.float32(0.9) * v, bias + 0.9 * vb
        z = look_b + by_row(r * look_w)
        g = (cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)).astype(np.float32)
        gw = np.float32(l2) * look_w
        if len(ids):
            gw += r * np.add.reduceat(g[col_row], col_at)
        v, vb = np.float32(0.9) * v - np.float32(step) * gw, 0.9 * vb - step * float(g.sum())
        w, bias = w + v, bias + vb
        if abs(vb) < STILL and float(np.abs(v).max(initial=0)) < STILL * float(np.abs(w).max(initial=0)):
            break
    weight = np.zeros(size)
    weight[ids] = w * r
    weight[np.abs(weight) < KEEP] = 0
    return Model(weight, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows, a quarter of them toxic at most:
    those of each class with the smallest hash of id, weighed by the counts of
    both classes in all labels. The driver holds only the sample. Rows without
    label or id are left out; a document with several labels has the largest, and
    rows of one id are a row each. Null and empty texts have no n-grams, very
    long ones are taken whole; without labelled rows of both classes every score
    is the share that is known, or a half. Extra columns are ignored."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    rank = F.xxhash64("id")
    # the smallest hashes of each class: top-k per class, without a shuffle of texts
    pos = lab.where("y = 1").orderBy(rank, "id").limit(sample // 4)
    neg = lab.where("y <> 1").orderBy(rank, "id").limit(sample - sample // 4)
    chosen = pos.unionByName(neg)
    of = lab.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")).first()
    odds = of["pos"] / of["neg"] if of["pos"] and of["neg"] else None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
    text = rows.column("text").combine_chunks()
    return fit(text if not isinstance(text, pa.ChunkedArray) else pa.concat_arrays(text.chunks), np.asarray(rows.column("y")), odds=odds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, by one pass. Null and empty texts
    have the model's base rate; very long ones are scored whole. Repeated rows
    score alike; null ids are carried along; no rows give no rows; extra columns,
    whatever their names, are ignored. The broadcast model has a fixed size."""
    spark = docs.sparkSession
    ship(spark)
    keep = np.flatnonzero(model.weight).astype(np.int32)
    of = spark.sparkContext.broadcast((keep, model.weight[keep], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, bias = of.value
        weight = np.zeros(1 << BITS)
        weight[ids] = values
        m = Model(weight, bias)
        for batch in batches:
            for i, j, buf, at in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(m.scores(buf, at))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
