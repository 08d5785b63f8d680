"""Toxicity on held-out rows, and its edge cases."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sieveline.llm import queries, toxicity


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    y, s = np.array([r.toxic for r in held]), np.array([r.score for r in held])
    assert ((s >= 0) & (s <= 1)).all() and auc(s, y) > 0.95
    assert (np.array([r.predicted for r in held]) == y).mean() > 0.9


def test_learns_only_from_given_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    a, b = toxicity.train(docs, seen), toxicity.train(docs, flipped)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_edges(spark):
    model = toxicity.fit(pa.array(["you idiot fool", "nice day", "you fool idiot", "good morning", "idiot fool you", "fine weather"] * 3), np.array([1, 0] * 9))
    rows = [(1, None), (2, ""), (3, "you idiot fool"), (3, "you idiot fool"), (None, "nice day"), (4, "x " * 100_000)]
    out = toxicity.score(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double"), model).collect()
    assert out[0].score == out[1].score and out[2].score == out[3].score > 0.5 > out[4].score
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), none).first().score <= 1


def test_null_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    assert not m.weight.any() and m.bias > 0


def test_capped_classes_keep_their_odds(spark, monkeypatch):
    sf, fit, calls = "/root/testdata/sf0.1", toxicity.fit, []
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **more: calls.append((texts, y, more)) or fit(texts, y, **more))
    whole, part = toxicity.train(docs, labels, sample=10**6), toxicity.train(docs, labels, sample=800)
    n, toxic = labels.count(), labels.where("toxic = 1").count()
    texts, y, more = calls[1]
    assert (y.sum(), len(y)) == (200, 800) and toxic < n / 8
    assert more["odds"] == toxic / (n - toxic)
    assert whole.bias < part.bias < fit(texts, y).bias


def brute_grams(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else "0" if "0" <= c <= "9" else c for c in text)
    return [(fold[i : i + n]) for n in toxicity.SIZES for i in range(len(fold) - n + 1)]


def test_grams_are_of_characters():
    texts = ["Idiot 12\n", "Дурак ты", "日本語です。\U0001f600x", "", "abc", "é" * 7, "дурак ТЫ идиот"]
    enc = [t.encode() for t in texts]
    buf, at = np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0, *map(len, enc)])
    got = [[] for _ in texts]
    for h, doc in toxicity.gram_hashes(buf, at):
        for x, d in zip(h.tolist(), doc.tolist()):
            got[d].append(x)
    names = {}
    for t, g in zip(texts, got):
        want = brute_grams(t)
        assert len(g) == len(want)
        for x, w in zip(g, want):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_scores_by_brute_force():
    """The model's scores, from its weights and the set of a text's n-grams."""
    texts = ["you idiot fool", "nice day", "дурак ты идиот", "good morning 123", "idiot fool you дурак"] * 4
    model = toxicity.fit(pa.array(texts), np.array([1, 0, 1, 0, 1] * 4))
    assert model.weight.any()
    for t in [*texts[:5], "", "ничего тут нет", "IDIOT"]:
        buf = np.frombuffer(t.encode(), np.uint8)
        seen = {int(h) for hs, _ in toxicity.gram_hashes(buf, np.array([0, len(buf)])) for h in hs}
        z = model.bias + sum(model.weight[h] for h in seen)
        assert abs(model.scores(buf, np.array([0, len(buf)]))[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_ratios_by_brute_force():
    """Log-count ratios say which n-grams weigh, and to which side."""
    texts = ["bad words here", "bad things", "bad luck bad", "fine things", "fine words", "fine day"] * 3
    labels = np.array([1, 1, 1, 0, 0, 0] * 3)
    model = toxicity.fit(pa.array(texts), labels, l2=1.0)
    grams = [set(brute_grams(t)) for t in texts]
    for g in set().union(*grams):
        p, q = sum(g in x for x, y in zip(grams, labels) if y), sum(g in x for x, y in zip(grams, labels) if not y)
        ratio = np.log((p + 1) / (9 + 2)) - np.log((q + 1) / (9 + 2))
        buf = np.frombuffer(g.encode(), np.uint8)
        h = next(int(hs[0]) for n, (hs, _) in zip([n for n in toxicity.SIZES if n <= len(g)], toxicity.gram_hashes(buf, np.array([0, len(buf)]))) if n == len(g))
        if p + q < toxicity.LEAST or abs(ratio) <= 0.7:
            assert model.weight[h] == 0
        elif model.weight[h]:
            assert np.sign(model.weight[h]) == np.sign(ratio)
