"""Queries whose SQL reads whole tables, as they do, on tables and small fixtures."""

import numpy as np
from oracle import assert_same, connect
from pyspark.sql import functions as F

from sieveline.operators import vectors
from sieveline.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


def test_graph_rerank_ranks_all_items(spark, sf):
    df = Q["graph_rerank"](spark, sf).cache()
    assert_same(df, SQL["graph_rerank"], connect(sf))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert items > 5 and df.select("item_id").distinct().count() == items


def test_tool_usage_counts_all_events(spark, sf, tmp_path):
    assert_same(Q["tool_usage"](spark, sf), SQL["tool_usage"], connect(sf))
    events = [(1, 7, "click"), (3, 7, "error"), (20, 7, "click"), (5, 8, "view"), (6, 9, "error"), (40, 10, "view")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in Q["tool_usage"](spark, str(tmp_path)).collect()] == [(4, 2, 4)]


def test_minimum_groups_keeps_whole_sources(spark, sf, tmp_path):
    assert_same(Q["minimum_groups"](spark, sf), SQL["minimum_groups"], connect(sf))
    docs = [(i, "thirty") for i in range(30)] + [(i, "few") for i in range(100, 129)]
    spark.createDataFrame(docs, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q["minimum_groups"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(30))


def turns(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_mask_pad_cuts_at_the_default(spark, sf, tmp_path):
    assert_same(Q["mask_pad"](spark, sf), SQL["mask_pad"], connect(sf))
    d = turns(spark, tmp_path, [(0, 0, "user", "ab " * 2100), (0, 1, "user", "abc " * 100), (1, 70, "user", "abcd " * 100)])
    got = {(r.conv_id, r.turn): r for r in Q["mask_pad"](spark, d).collect()}
    assert {k: r.n_attended for k, r in got.items()} == {(0, 0): 2048, (0, 1): 100, (1, 70): 100}
    assert got[0, 0].labels.split() == ["-100"] * 3 + ["2"] * 2045
    assert got[0, 1].ids.split() == ["3"] * 100 + ["0"] * 1948
    assert got[1, 70].labels.split() == ["-100"] * 73 + ["4"] * 27


def test_fallback_statement_cuts_at_the_default(spark, sf, tmp_path):
    assert_same(Q["fallback_statement"](spark, sf), SQL["fallback_statement"], connect(sf))
    d = turns(spark, tmp_path, [(0, 0, "user", "x" * 13000), (1, 0, "system", "y" * 500)])
    got = {r.conv_id: r.statement for r in Q["fallback_statement"](spark, d).collect()}
    assert got == {0: "user\n\n" + "x" * 11994, 1: "system\n\n" + "y" * 500}


def test_svd_embed_has_all_grams_and_dimensions(spark, sf):
    e = {r.item_id: np.array(r.embedding) for r in Q["svd_embed"](spark, sf).collect()}
    rows = vectors.tfidf(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", vectors.char_grams(F.col("text"))).collect()
    terms = {t: k for k, t in enumerate(sorted({r.term for r in rows}))}
    assert {len(t) for t in terms} == {3, 4, 5}
    ids = sorted(e)
    x = np.zeros((len(ids), len(terms)))
    for r in rows:
        x[ids.index(r.item_id), terms[r.term]] = r.weight
    got, rank = np.array([e[i] for i in ids]), min(256, len(ids) - 1)
    assert got.shape == (len(ids), 256) and not got[:, rank:].any()
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = (u * s)[:, :rank]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3
