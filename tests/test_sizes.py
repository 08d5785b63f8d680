"""What larger tables showed: keys past a million, work that grows faster than the input."""

import re

import duckdb
import numpy as np
import pyarrow as pa
from oracle import assert_same
from pyspark.sql import functions as F

from sieveline.operators import bm25_index, curate, graph, neighbour_index, retrieval, vectors
from sieveline.plans import registry
from sieveline.sources import readers

Q, SQL = registry.queries(), registry.oracle_sql()


def only(spark, tmp_path, **tables):
    """A folder with these tables (rows, schema), and a DuckDB that sees them."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def test_first_link_orders_lines_as_its_sql_does(spark, tmp_path):
    """Part keys past a million outweigh the line number."""
    con = only(
        spark, tmp_path,
        customer=([(1,), (2,), (3,)], "c_custkey long"),
        orders=([(10, 1, "a"), (11, 1, "b"), (20, 2, "c")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        lineitem=([(10, 1, 1_150_000), (10, 2, 40), (20, 1, 7), (20, 1, 6), (20, 3, 5)], "l_orderkey long, l_linenumber int, l_partkey long"),
    )
    df = Q["first_link"](spark, str(tmp_path))
    assert {r.c_custkey: r.l_partkey for r in df.collect()} == {1: 40, 2: 6, 3: None}
    assert_same(df, SQL["first_link"], con)


def test_nearest_copies_no_more_of_a_larger_table(spark):
    """Each row is copied once per block of the other side; blocks grow with the
    table, within bounds of bytes."""
    assert [sum(vectors.dealt(n, 64, 2048)) for n in (2_000, 100_000, 500_000)] == [2, 40, 40]
    assert 500_000 / vectors.dealt(500_000, 64, 2048)[0] * 64 * 8 <= 8 << 20
    assert vectors.dealt(1_000_000, 1024, 2048)[0] == 977 and vectors.dealt(0, 1, 2048) == (1, 1)


def test_best_is_exact_for_ties_copies_and_small_norms():
    from sieveline.operators.topk import Best

    rng = np.random.default_rng(1)
    plain = rng.normal(size=(5000, 16))
    third, same, zero = plain.copy(), np.repeat(plain[:3], 1700, 0)[:5000], plain.copy()
    third[::3], zero[5] = plain[0], 0
    for y in (plain, third, same, plain * 1e-5, zero, plain[:5]):
        x, ids = y[:200], rng.permutation(len(y))
        best = Best(x, ids[:200], y, ids, 8, 6)
        best.meet(np.arange(len(x)), np.arange(len(y)))
        got = {}
        for i, j, s in zip(*best.found()):
            got.setdefault(i, []).append((-s, ids[j]))
        s = np.round((x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None] + 1e-9), 6) + 0.0
        for i in range(len(x)):
            assert got[i] == sorted((-v, j) for v, j in zip(s[i], ids) if j != ids[i])[:8]


def test_nearest_over_many_blocks(spark, monkeypatch):
    rows = np.random.default_rng(2).integers(-2, 3, (300, 4)).astype(float)
    monkeypatch.setattr(vectors, "HELD", 2)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(rows)], "id long, v array<float>, g string")
    key = lambda d: sorted((r.id, r["rank"], r.neighbour, r.similarity) for r in d.collect())
    one = key(vectors.nearest(df, "id", "v", 4))
    assert len(one) == 1200 and key(vectors.nearest(df, "id", "v", 4, block=20)) == one
    assert key(vectors.nearest(df, "id", "v", 4, group="g", block=40)) == one


def test_pairs_of_bm25_stay_where_the_document_is(spark, monkeypatch):
    """Tokens are shuffled by document; the pairs are not."""
    docs = spark.createDataFrame([(k, [f"w{k % 7}", f"w{k % 5}", "w1"]) for k in range(60)], "doc long, t array<string>")
    queries = spark.createDataFrame([(k, [f"w{k}", "w1"]) for k in range(6)], "q long, t array<string>")
    key = lambda d: sorted(map(tuple, d.collect()))
    one = key(retrieval.bm25(docs, queries, [], "doc", "t", "q", "t"))
    monkeypatch.setattr(retrieval, "PAIRS", 40)
    many = retrieval.bm25(docs, queries, [], "doc", "t", "q", "t")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q#" not in plan and "REPARTITION_BY_NUM" in plan
    assert len(one) == 360 and key(many) == one and many.rdd.getNumPartitions() == 9


def test_files_at_forms_no_ranges_in_small_groups(spark, monkeypatch):
    """A small group's changes meet its revisions by the group alone; large groups
    go by ranges, with the same rows."""
    h = spark.createDataFrame([(k % 3, k, f"f{k % 4}", None if k % 5 == 0 else f"v{k}") for k in range(200)], "repo int, rev long, path string, body string")
    at = h.where("rev % 2 = 0 or repo = 1").select("repo", "rev")
    small = curate.files_at(h, at, ["repo"], "rev", "path", "body")
    assert "_level" not in small._jdf.queryExecution().optimizedPlan().toString()
    key = lambda d: sorted(map(tuple, d.collect()))
    one = key(small)
    last = {}
    want = []
    for k in range(200):
        last[k % 3, f"f{k % 4}"] = None if k % 5 == 0 else f"v{k}"
        if k % 2 == 0 or k % 3 == 1:
            want += [(k % 3, k, p, v) for (g, p), v in last.items() if g == k % 3 and v is not None]
    assert one == sorted(want)
    for most in (0, 66):  # all groups are large; one of them is
        monkeypatch.setattr(curate, "HOT_GROUP", most)
        assert key(curate.files_at(h, at, ["repo"], "rev", "path", "body")) == one


def test_calls_are_combined_before_they_are_resolved(spark):
    facts = [("r", "p1", "node", "a", "old", 1), ("r", "p1", "node", "a", "new", 5), ("r", "p2", "node", "a", "x", 3), ("r", "p1", "node", "b", None, 2)]
    facts += [("r", "p2", "call", "a", "b", k) for k in range(10, 400)] + [("r", "p1", "call", "a", "b", 1), ("r", "p1", "call", "b", "a", 7), ("r", "p1", "call", "b", "b", 8)]
    df = spark.createDataFrame(facts, "repo string, path string, kind string, a string, b string, no long")
    nodes, edges = graph.graph_of(df, ["repo"])
    assert sorted((r.id, r.text or "") for r in nodes.collect()) == [("a", "new"), ("b", "")]
    assert sorted((r.source, r.target, r.key) for r in edges.collect()) == [("a", "b", 0), ("b", "a", 0)]
    leaves = [x for x in edges.inputFiles() if "/uses-" in x]
    assert leaves and spark.read.parquet(*leaves).count() == 3


def test_rows_go_to_a_cell_once_however_many_lists_they_probe(spark, monkeypatch):
    """Probing all of 40 lists takes a row to 3 cells, not to 40 lists."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "id long, v array<double>")
    monkeypatch.setattr(neighbour_index, "CELLS", 3)
    monkeypatch.setattr(neighbour_index, "ROWS", 64)
    key = lambda d: sorted((r.id, r["rank"], r.neighbour, r.similarity) for r in d.collect())
    assert key(neighbour_index.nearest_by_lists(df, "id", "v", 5, 40, 40)) == key(vectors.nearest(df, "id", "v", 5))


def test_what_a_row_carries_does_not_grow_with_the_lists(spark, monkeypatch):
    """Rows that probe 150 of 200 lists are stored without them, whether the number
    of probes is given or measured; they find what these lists hold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    ask, centre = df.where("id % 20 = 0"), rng.normal(size=(200, 6))
    monkeypatch.setattr(neighbour_index, "CELLS", 3)
    monkeypatch.setattr(neighbour_index, "ROWS", 64)
    longest, stored = [], neighbour_index.stored

    def noted(d, tag):
        out = stored(d, tag)
        arrays = [c for c, kind in out.dtypes if kind.startswith("array")]
        longest.extend(out.agg(F.count("*") * 0, *[F.max(F.size(c)) for c in arrays]).first())
        return out

    monkeypatch.setattr(neighbour_index, "stored", noted)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    close, all_pairs = unit(x) @ unit(centre).T, np.round(unit(x) @ unit(x).T, 6)
    own = close.argmax(1)
    for probes in (1, 7, 150):
        got = {}
        for r in neighbour_index.nearest_by_lists(df, "id", "v", 5, probes, 200, ask, centre=unit(centre)).collect():
            got.setdefault(r.id, []).append((r["rank"], r.neighbour))
        for i in range(0, 900, 20):
            there = np.flatnonzero(np.isin(own, np.argsort(-close[i])[:probes]) & (np.arange(900) != i))
            best = there[np.lexsort((there, -all_pairs[i, there]))][:5]
            assert [j for _, j in sorted(got.get(i, []))] == best.tolist()
    neighbour_index.nearest_by_lists(df, "id", "v", 5, None, 200, ask, centre=unit(centre)).collect()
    assert max(longest) <= 6


def test_centroids_are_compared_in_bounded_pieces(spark):
    import tracemalloc

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4096, 4)))], "id long, v array<double>")
    tracemalloc.start()
    centre = neighbour_index.fit_centroids(df, "id", "v", 4000, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centre.shape == (4000, 4) and most < 64 << 20


def test_archive_members_leave_in_bounded_blocks(monkeypatch):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for k in range(30):
            m = tarfile.TarInfo(f"./m{k}")
            m.size = 100
            t.addfile(m, io.BytesIO("é".encode() * 50))
    monkeypatch.setattr(readers, "MEMBER_CHARS", 1000)
    batch = pa.RecordBatch.from_pylist([{"path": f"/x/{n}.tgz", "content": out.getvalue()} for n in "ab"])
    got = list(readers._members(7, True)(iter([batch])))
    assert max(b.num_rows for b in got) <= 5 and [r for b in got for r in b.to_pylist()] == [{"instance_id": n, "path": f"m{k}", "text": "é" * 7} for n in "ab" for k in range(30)]


def test_words_are_counted_where_their_text_lies(spark):
    docs = [(1, ["b", "a", "b", "", "a", "b"]), (2, []), (3, None), (4, ["x"]), (5, [None, "é", "é"])]
    df = retrieval.counted(spark.createDataFrame(docs, "d long, t array<string>"), "t", ["d"])
    assert sorted(map(tuple, df.collect())) == [(1, "", 1), (1, "a", 2), (1, "b", 3), (4, "x", 1), (5, "é", 2)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_the_index_stay_where_the_document_is(spark, tmp_path, monkeypatch):
    """Many pairs that bounds leave are added up by document, not shuffled one by one."""
    docs = spark.createDataFrame([(k, [f"w{k % 7}", f"w{k % 5}", "w1"]) for k in range(60)], "doc long, t array<string>")
    queries = spark.createDataFrame([(k, [f"w{k}", "w1"]) for k in range(6)], "q long, t array<string>")
    path = f"file://{tmp_path}/ix"
    bm25_index.append(docs, path, "doc", "t")
    monkeypatch.setattr(bm25_index, "BROADCAST_ROWS", 0)
    rows = bm25_index.search(spark, path, queries, "q", "t", 10).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "doc_id#" in plan and not re.search(r"hashpartitioning\(q#\d+L?, doc_id#", plan) and "REPARTITION_BY_NUM" in plan
    want = retrieval.ranked(retrieval.bm25(docs, queries, [], "doc", "t", "q", "t"), ["q"], "score", ["doc"], k=10)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.select("q", "doc", "score", "rank").collect()))


def test_neighbours_of_a_file_are_added_where_its_scores_lie(spark):
    """As rerank(), but no pair of a query and a node is shuffled."""
    docs = spark.createDataFrame([(k % 4, k, [f"w{k % 7}", f"w{k % 5}"]) for k in range(40)], "file long, node long, t array<string>")
    queries = spark.createDataFrame([(k, [f"w{k}"]) for k in range(4)], "q long, t array<string>")
    adj = retrieval.undirected(spark.createDataFrame([(k % 4, k, k + 4) for k in range(36)], "file long, source long, target long"), ["file"])
    got = retrieval.rerank_within(retrieval.bm25(docs, queries, [], "node", "t", "q", "t", within=["file"]), adj, ["q"], ["file"], "node").groupBy("q", "file").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q#" not in plan and "REPARTITION_BY_NUM" in plan
    want = retrieval.rerank(retrieval.bm25(docs, queries, [], "node", "t", "q", "t"), adj.drop("file"), ["q"], "node").withColumn("file", F.col("node") % 4).groupBy("q", "file").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() == 16
