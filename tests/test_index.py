"""The stored BM25 index against scoring all pairs."""

import random

from pyspark.sql import functions as F

from sieveline.operators import bm25_index, retrieval


def corpus(seed, n, vocabulary=60):
    """Texts with common and rare words, long and short."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(k, rng.choices(words, weights, k=rng.choice([0, 3, 10, 80]))) for k in range(n)]


def frame(spark, rows, name="doc"):
    return spark.createDataFrame(rows, f"{name} long, t array<string>")


def want(docs, queries, k):
    s = retrieval.bm25(docs, queries, [], "doc", "t", "q", "t")
    return {tuple(r) for r in retrieval.ranked(s, ["q"], "score", ["doc"], k=k).select("q", "doc", "score", "rank").collect()}


def got(spark, path, queries, k):
    return {tuple(r) for r in bm25_index.search(spark, path, queries, "q", "t", k).rows.collect()}


def test_search_equals_all_pairs_after_appends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25_index, "BLOCK", 8)
    monkeypatch.setattr(bm25_index, "SALTED", 100)
    path = f"file://{tmp_path}/ix"
    rows = corpus(1, 260)
    queries = frame(spark, [(1, ["w0", "w1", "w59"]), (2, ["w40", "w41", "w42", "w0"]), (3, ["nope"]), (4, ["w5", "w5"]), (5, []), (6, None), (7, [f"w{i}" for i in range(60)])], "q")
    for upto, k in ((60, 3), (61, 10), (260, 5)):
        docs = frame(spark, rows[:upto])
        bm25_index.append(docs, path, "doc", "t")
        assert got(spark, path, queries, k) == want(docs, queries, k)
    assert got(spark, path, queries, 1000) == want(frame(spark, rows), queries, 1000)
    assert bm25_index.append(frame(spark, rows), path, "doc", "t") == 0


def test_append_takes_each_id_once_and_nulls_never(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    q = frame(spark, [(1, ["a", "b"])], "q")
    assert got(spark, path, q, 5) == set() and bm25_index.append(frame(spark, []), path, "doc", "t") == 0
    rows = [(1, ["a"]), (1, ["a", "a"]), (1, ["a"]), (2, None), (3, []), (None, ["a"]), (4, ["b"] * 500)]
    assert bm25_index.append(frame(spark, rows), path, "doc", "t") == 4
    assert got(spark, path, q, 5) == want(frame(spark, [(1, ["a", "a"]), (2, []), (3, []), (4, ["b"] * 500)]), q, 5)


def test_an_append_that_broke_off_is_made_good(spark, tmp_path):
    import shutil

    path = f"file://{tmp_path}/ix"
    rows = corpus(2, 50)
    q = frame(spark, [(1, ["w0", "w3", "w9"])], "q")
    bm25_index.append(frame(spark, rows[:20]), path, "doc", "t")
    bm25_index.append(frame(spark, rows), path, "doc", "t")
    shutil.rmtree(tmp_path / "ix/docs/batch=2")  # postings were written, the list was not
    assert got(spark, path, q, 5) == want(frame(spark, rows[:20]), q, 5)
    assert bm25_index.append(frame(spark, rows), path, "doc", "t") == 30
    assert got(spark, path, q, 5) == want(frame(spark, rows), q, 5)


def test_search_leaves_most_pairs_out_where_words_tell(spark, tmp_path):
    """Queries of a rare word and common ones: of the common words' postings only
    the first blocks are paired."""
    rows = [(k, ["the", "of"] * (1 + k % 7) + [f"pad{k % 5}"] * (k % 50) + [f"id{k // 12}"]) for k in range(6000)]
    docs = frame(spark, rows)
    q = frame(spark, [(k, ["the", "of", f"id{k}"]) for k in range(20)], "q")
    path = f"file://{tmp_path}/ix"
    bm25_index.append(docs, path, "doc", "t")
    found = bm25_index.search(spark, path, q, "q", "t", 10)
    assert {tuple(r) for r in found.rows.collect()} == want(docs, q, 10)
    assert found.postings == 12_240 and found.pairs < 0.2 * retrieval.bm25(docs, q, [], "doc", "t", "q", "t").count()


def test_search_reads_postings_of_wanted_parts_only(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    bm25_index.append(frame(spark, corpus(3, 40)), path, "doc", "t")
    rows = bm25_index.search(spark, path, frame(spark, [(1, ["w3", "w7"])], "q"), "q", "t", 3).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert rows.select(F.max("rank")).first()[0] == 3


def clustered(n, dims, groups, seed=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    return [(i, (centre[i % groups] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_lists_find_what_all_pairs_find(spark):
    from sieveline.operators import neighbour_index as N
    from sieveline.operators import vectors as V

    rows = clustered(600, 16, 30)
    df = vectors_frame(spark, rows)
    exact = V.nearest(df, "id", "v", 5).cache()
    key = lambda d: sorted((r.id, r["rank"], r.neighbour, r.similarity) for r in d.collect())
    assert key(N.nearest_by_lists(df, "id", "v", 5, probes=12, lists=12)) == key(exact)
    found = N.nearest_by_lists(df, "id", "v", 5, lists=12)
    assert N.recall(exact, found).first().recall >= 0.9
    centre = N.fit_centroids(df, "id", "v", 12)
    assert N.probes_for(df, "id", "v", 5, centre) <= 6
    ask = df.where("id % 20 = 0")
    asked = N.nearest_by_lists(df, "id", "v", 5, 12, 12, ask=ask)
    assert key(asked) == [x for x in key(exact) if x[0] % 20 == 0]


def test_copies_and_long_lists(spark, monkeypatch):
    """A third of all rows share a vector, and a list is longer than a block."""
    from sieveline.operators import neighbour_index as N

    monkeypatch.setattr(N, "ROWS", 16)
    rows = clustered(120, 8, 6) + [(1000 + i, [1.0] + [0.0] * 7) for i in range(60)] + [(2000, [1.0, 0.001] + [0.0] * 6), (2001, [0.0] * 8), (7, None), (None, [1.0] * 8), (3, rows_of(3))]
    df = vectors_frame(spark, rows)
    got = {}
    for r in N.nearest_by_lists(df, "id", "v", 4, probes=2, lists=2).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.similarity)
    assert set(got) == {i for i, v in rows if i is not None and v is not None}
    assert [got[1005][k][0] for k in (1, 2, 3, 4)] == [1000, 1001, 1002, 1003]
    assert [got[1001][k][0] for k in (1, 2, 3, 4)] == [1000, 1002, 1003, 1004]
    assert [got[2000][k][0] for k in (1, 2, 3, 4)] == [1000, 1001, 1002, 1003]
    assert N.nearest_by_lists(df.limit(0), "id", "v", 4).count() == 0


def rows_of(i):
    return clustered(120, 8, 6)[i][1]
