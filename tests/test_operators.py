"""Operators over small fixtures, and golden numbers of published results."""

import ast
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import schemas
from sieveline.operators import audit, curate, embedding, graph, retrieval, stats, training, vectors
from sieveline.sources import readers, writers
from sieveline.streaming import incremental


def test_mcnemar_goldens(spark):
    df = spark.createDataFrame([(74, 140), (26, 48), (20, 12), (1, 0), (3, 8), (1, 20), (0, 0)], "b long, c long")
    got = [r.p for r in df.select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]
    want = [7.574421259e-06, 0.014079981, 0.215327150, 1.0, 0.2265625, 2.09808349609375e-05, 1.0]
    assert got == pytest.approx(want, rel=1e-6)
    sym = [r.p for r in df.select(stats.mcnemar_p(F.col("c"), F.col("b")).alias("p")).collect()]
    assert sym == pytest.approx(got)


def test_wilson_goldens(spark):
    low, high = stats.wilson(F.col("ok"), F.col("n"))
    rows = spark.createDataFrame([(4, 181), (3, 181), (0, 0)], "ok long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert [round(100 * x, 1) for r in rows[:2] for x in r] == [0.9, 5.5, 0.6, 4.8]
    assert tuple(rows[2]) == (None, None)


def test_order_percentiles(spark):
    df = spark.range(1, 21).withColumn("g", F.lit(1))
    assert stats.order_percentiles(df, ["g"], "id", {"p90": 0.9}).first().p90 == 19


def test_overlay_and_last(spark):
    a = spark.createDataFrame([("k", 1), ("l", 5)], "id string, v int")
    b = spark.createDataFrame([("k", 2)], "id string, v int")
    assert {r.id: r.v for r in curate.overlay([a, b], ["id"]).collect()} == {"k": 2, "l": 5}


def test_asof_ties(spark):
    q = spark.createDataFrame([("p", 6), ("q", 6)], "pkg string, cutoff int")
    rel = spark.createDataFrame([("p", 1, 0, "a"), ("p", 5, 1, "b"), ("p", 5, 2, "c"), ("p", 9, 3, "d")], "pkg string, t int, ordinal long, ver string")
    assert {r.pkg: r.asof_ver for r in curate.asof_latest(q, rel, ["pkg"], "cutoff", "t", "ordinal", ["ver"]).collect()} == {"p": "b", "q": None}


def test_split_sizes(spark):
    rows = [(s, f"{s}-{k}") for s, n in enumerate((1, 2, 12, 13, 73)) for k in range(n)]
    df = curate.stratified_split(spark.createDataFrame(rows, "s int, id string"), "s", "id")
    assert [r["n"] for r in df.where("split = 'test'").groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect()] == [1, 1, 2, 3, 15]
    assert df.count() == len(rows)


def test_systematic_sample(spark):
    df = spark.range(1000)
    assert sorted(r.id for r in curate.systematic_sample(df, ["id"], 250).collect()) == [int(i * 1000 / 250) for i in range(250)]
    assert curate.systematic_sample(spark.range(9), ["id"], 250).count() == 9


def test_candidates(spark):
    rows = [("r", "abcdef123", ["p"], "2021-05-01", "s", ["a.py", "tests/t.py"]), ("r", "b", ["p", "q"], "2021-05-01", "s", ["a.py", "tests/t.py"]), ("r", "c", ["p"], "2021-05-01", "s", ["a.py"])]
    out = curate.candidates(spark.createDataFrame(rows, "repo string, sha string, parents array<string>, date string, subject string, files array<string>"), "2021-01-01").collect()
    assert [(r.instance_id, r.base_commit, r.src_files, r.test_files) for r in out] == [("r_abcdef1", "p", ["a.py"], ["tests/t.py"])]


def test_enrich_and_package(spark):
    c = spark.createDataFrame([("r_1", "r", "f", "b", "Fri Apr 2 10:00:00 2021 +0000", "fix #9", ["a.py"], ["t.py"])], schemas.CANDIDATES)
    pulls = spark.createDataFrame([("f", 2, 8, "second", "x", "t2"), ("f", 1, 7, "first", "closes #5", "t1")], "sha string, ordinal int, number long, title string, body string, created_at string")
    issues = spark.createDataFrame([("r", 5, "issue", "body", False)], "repo_short string, number long, title string, body string, is_pull boolean")
    e = curate.enrich(c, pulls, issues)
    r = e.first()
    assert (r.pr_number, r.issue_number, r.issue_title, r.created_at) == (7, 5, "issue", "t1")
    p = curate.package(e.withColumns({"patch": F.lit("+a\n-b\n"), "test_patch": F.lit("+c"), "verified": F.lit(True)}), {"r": "org/r"}).first()
    assert (p.repo, p.problem_statement, p.n_patch_lines, p.n_src_files) == ("org/r", "issue\n\nbody", 2, 1)


def test_remaining(spark):
    todo, done = spark.range(4), spark.createDataFrame([(1, None), (2, "e")], "id long, error string")
    assert {r.id for r in curate.remaining(todo, done, ["id"]).collect()} == {0, 3}
    assert {r.id for r in curate.remaining(todo, done, ["id"], retry_errors=True).collect()} == {0, 2, 3}


def test_prefix_map(spark):
    n = spark.createDataFrame([("a.b.C.m",), ("z.q",)], "node string")
    f = spark.createDataFrame([("a/b.py",), ("a/b/__init__.py",)], "path string")
    assert [(r.node, r.path) for r in retrieval.prefix_file_map(n, f, [], "node", "path").collect()] == [("a.b.C.m", "a/b.py")]


def test_roll_up_keeps_zero(spark):
    s = spark.createDataFrame([("n", 1.5)], "node string, score double")
    m = spark.createDataFrame([("n", "f"), ("o", "g")], "node string, file string")
    assert {r.file: r.score for r in retrieval.roll_up(s, m, [], "node", "file").collect()} == {"f": 1.5, "g": 0.0}


SRC = '''
class A:
    def run(self):
        if True:
            def inner():
                return helper()
        return helper

def helper():
    return m.A.run
'''


def test_symbols_and_graph(spark):
    facts = list(graph.symbols("m", SRC))
    assert [f[1] for f in facts if f[0] == "node"] == ["m.A", "m.A.run", "m.A.run.inner", "m.helper"]
    assert [(f[1], f[2]) for f in facts if f[0] == "contains"] == [("m.A", "m.A.run"), ("m.A.run", "m.A.run.inner")]
    assert not list(graph.symbols("m", "def x(:"))
    ast.parse(SRC)
    files = spark.createDataFrame([("r", "m.py", SRC), ("r", "bad.py", "def ("), ("r", "x.txt", "q"), ("r", "n.py", None)], "repo string, path string, content string")
    nodes, edges = graph.graph_of(graph.extract_symbols(files, ["repo"]), ["repo"])
    assert nodes.count() == 4
    calls = {(r.source, r.target) for r in edges.where("type = 'calls'").collect()}
    assert ("m.A.run", "m.helper") in calls and ("m.A", "m.helper") in calls
    assert ("m.helper", "m.helper") not in calls


def test_resolution_is_ambiguous_by_suffix(spark):
    ids = spark.createDataFrame([("x.C.run",), ("y.C.run",), ("z.D.stop",), ("w.C",)], "id string")
    calls = spark.createDataFrame([("C.run",), ("q.stop",), ("w.C",), ("Z.run",)], "call string")
    assert {r.call: r.target for r in graph.resolve_names(calls, ids, []).collect()} == {"C.run": "x.C.run", "q.stop": "z.D.stop", "w.C": "w.C"}


def test_bfs_depth(spark):
    adj = spark.createDataFrame([(a, b) for k in range(5) for a, b in ((k, k + 1), (k + 1, k))], "node int, other int")
    out = graph.subgraph(adj, spark.createDataFrame([(0,)], "node int"), 2)
    assert {(r.node, r.depth) for r in out.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_clean_diff(spark):
    d = training.clean_diff("x\n```diff\n--- a/f\n+++ b/f\n@@ -3,9 +4,9 @@ def\n ctx\n-a\n+b\n+c\n```\n")
    assert d == "--- a/f\n+++ b/f\n@@ -3,2 +4,3 @@ def\n ctx\n-a\n+b\n+c\n"
    assert training.clean_diff("none") is None and training.clean_diff(None) is None
    n = training.hunk_counts(spark.createDataFrame([(1, d)], "id int, p string"), ["id"], "p").first()
    assert (n.n_old, n.n_new) == (2, 3)


def test_mask_and_pad(spark):
    df = spark.createDataFrame([(1, 1, [5, 6, 7], 2), (1, 2, [8], 5)], "b int, k int, ids array<int>, pl int")
    df = df.withColumn("labels", training.masked_labels(F.col("ids"), F.col("pl"), 2048))
    out = {r.k: r for r in training.padded(df, ["b"], "ids", "labels", 0).collect()}
    assert out[1].labels == [-100, -100, 7] and out[1].attention_mask == [1, 1, 1]
    assert out[2].ids == [8, 0, 0] and out[2].attention_mask == [1, 0, 0]


def test_findings(spark):
    df = spark.createDataFrame([(1, "", 0, []), (2, "x", 3, ["a"])], "id int, s string, n int, a array<string>")
    assert {(r.id, r.field) for r in audit.missing_fields(df, "id", ["s", "n", "a"]).collect()} == {(1, "s"), (1, "n"), (1, "a")}
    found = audit.findings([("error", "x", df.where("id = 1"))])
    with pytest.raises(SystemExit):
        audit.fail_on_errors(found)
    audit.fail_on_errors(found.where("false"))


def test_svd_products(spark):
    docs = spark.createDataFrame([(0, "abc abd"), (1, "abc xyz"), (2, "xyz xyw"), (3, "klm abc")], "id int, text string")
    w = vectors.tfidf(docs, "id", vectors.char_grams(F.col("text"), 3, 3))
    e = {r.id: np.array(r.embedding) for r in embedding.svd_embed(w, "id", 8).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-3 and len(v) == 8 for v in e.values())


def test_nearest_against_brute_force(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in t.collect()]
    got = {(r.id, r.rank): r.neighbour for r in vectors.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"), "vec_id", "embedding", 3, block=50).collect()}
    for i, v in rows:
        s = sorted((-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w) + 1e-9)), 6), j) for j, w in rows if j != i)
        assert [j for _, j in s[:3]] == [got[i, k] for k in (1, 2, 3)]


def test_jsonl_resume(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert readers.jsonl(spark, path, "id long, error string", missing_ok=True).count() == 0
    rows = spark.createDataFrame([(1, None), (2, "e")], "id long, error string")
    assert writers.append_new(rows, path, "id long, error string", ["id"]).count() == 2
    assert writers.append_new(rows, path, "id long, error string", ["id"]).count() == 0
    assert writers.append_new(rows, path, "id long, error string", ["id"], retry_errors=True).count() == 1


def test_results_schema_keeps_maps(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text(json.dumps({"instance_id": "a_1", "tool_hist": {"edit_file": 2}, "passed": True}) + "\n" + json.dumps({"instance_id": "b_2", "error": "x"}) + "\n")
    rows = {r.instance_id: r for r in readers.jsonl(spark, str(p), schemas.RESULTS).collect()}
    assert rows["a_1"].tool_hist == {"edit_file": 2} and rows["b_2"].tool_hist is None


def test_git_log(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("s1\x1fp1\x1fFri Apr 2 10:00:00 2021 +0000\x1ffirst\n\na.py\ntests/t.py\n\ns2\x1fp1 p2\x1fd\x1fmerge\n")
    rows = {r.sha: r for r in readers.git_log(spark, str(p), "r").collect()}
    assert rows["s1"].files == ["a.py", "tests/t.py"] and rows["s2"].parents == ["p1", "p2"] and rows["s2"].files == []


def test_archives_and_manifests(spark, tmp_path):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, text in (("./a/b.py", "x" * 10), ("./.github/x", "y")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "i_1.tgz").write_bytes(buf.getvalue())
    m = readers.archive_members(readers.binary_files(spark, str(tmp_path), "*.tgz"), with_text=True, most=4)
    assert {(r.instance_id, r.path, r.text) for r in m.collect()} == {("i_1", "a/b.py", "xxxx"), ("i_1", ".github/x", "y")}
    one = spark.createDataFrame([("# c\nNumPy>=1\n-r x\npandas\n", "[options]\ninstall_requires =\n  attrs>=1\n  six\nother = 1\n", "x('Werkzeug >= 2')", '[project]\ndependencies=["A-b>1"]\n[dependency-groups]\ntest=["pytest"]\ndocs=["sphinx"]\n')], "r string, c string, p string, t string")
    got = readers.pyproject(one, "t").select(readers.requirements_txt(F.col("r")).alias("r"), readers.setup_cfg(F.col("c")).alias("c"), readers.setup_py(F.col("p")).alias("p"), "deps").first()
    assert (got.r, got.c, got.p, got.deps) == (["numpy", "pandas"], ["attrs", "six"], ["werkzeug"], ["a_b", "pytest"])


def test_graph_files(spark, tmp_path):
    (tmp_path / "i_1.json").write_text(json.dumps({"nodes": [{"id": "a", "name": "a", "text": "t"}], "edges": [{"source": "a", "target": "a", "type": "calls", "key": 0}]}, indent=1))
    nodes, edges = readers.graphs(spark, str(tmp_path))
    assert nodes.first().instance_id == "i_1" and edges.first().type == "calls"


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    step = lambda b: b
    spark.createDataFrame([(1,), (2,), (2,)], "id long").write.parquet(src)
    incremental.run_available(spark, src, "id long", step, out, ck, key=["id"])
    spark.createDataFrame([(2,), (3,)], "id long").write.mode("append").parquet(src)
    incremental.run_available(spark, src, "id long", step, out, ck, key=["id"])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_mcnemar_of_many_pairs(spark):
    import math

    want = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c < 1000 else None
    pairs = [(0, 5), (7, 7), (300, 400), (499, 499), (1, 900)]
    df = spark.createDataFrame([*pairs, (10**12, 10**12 + 3 * 10**6)], "b long, c long")
    got = [r.p for r in df.select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got[:5] == pytest.approx([want(b, c) for b, c in pairs], rel=1e-9)
    z = (3 * 10**6 - 1) / math.sqrt(2 * 10**12)  # the normal tail, corrected for continuity
    assert got[5] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_log_gamma(spark):
    import math

    xs = [1.0, 1.5, 2.0, 7.25, 100.0, 1e6, 1e12]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def test_percentiles_of_groups_in_many_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(None if k % 9 == 0 else k % 3, rng.choice([None, *range(50)])) for k in range(2000)]
    got = {r.g: r for r in stats.order_percentiles(spark.createDataFrame(rows, "g int, v int").repartition(7), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in {r[0] for r in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert (got[g].n, got[g].max) == (len(v), v[-1])
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert got[g][name] == v[min(len(v) - 1, int(len(v) * p))]


def test_ranged_asof_is_asof(spark):
    import random

    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randrange(100), k) for k in range(400)], "pkg string, cutoff int, q int")
    rel = spark.createDataFrame([(rng.choice("abc"), rng.randrange(100), k, str(k)) for k in range(300)], "pkg string, t int, ordinal long, ver string")
    one, two = ({r.q: r.asof_ver for r in f(left, rel, ["pkg"], "cutoff", "t", "ordinal", ["ver"]).collect()} for f in (curate.asof_latest, curate.asof_ranged))
    assert one == two and len(two) == 400


def test_first_hits_are_those_of_the_ranking(spark):
    import random

    rng = random.Random(4)
    scores = spark.createDataFrame([(q, d, float(rng.randrange(8))) for q in range(12) for d in rng.sample(range(60), 25)], "q int, d int, score double")
    targets = spark.createDataFrame([(q, rng.randrange(60)) for q in range(14) for _ in range(3)], "q int, d int")
    ranks = retrieval.ranked(scores, ["q"], "score", ["d"])
    want = {r.q: (r.n_targets, r.first_rank) for r in retrieval.first_hits(ranks, targets, ["q"], "d").collect()}
    assert {r.q: (r.n_targets, r.first_rank) for r in retrieval.first_hits_of(scores, targets, ["q"], "d").collect()} == want
    assert 0 in {x for _, x in want.values()}


def test_holding(spark):
    docs = ["a b c d e f g", "xa b c d e fx", "a b  c d e f", "c", "", None, "the c a b c d e f a b c d e f"]
    items = ["a b c d e f", "b c d", "c", "zz", "", "b c d e f"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_no int, what string")
    got = {(r.item_no, r.doc) for r in retrieval.holding(d, i, "doc", "text", "item_no", "what").collect()}
    assert got == {(k, n) for k, x in enumerate(items) for n, t in enumerate(docs) if t is not None and x in t}


def test_strict_join_stops(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="k without a match"):
        curate.strict_join(a, b, ["k"]).collect()
    assert curate.strict_join(a.where("k = 1"), b, ["k"]).collect()[0].v == "x"


def test_exit_code(spark):
    found = spark.createDataFrame([("warning", "c", "1")], "severity string, check string, id string")
    assert audit.exit_code(found).first().code == 0 and audit.exit_code(found.limit(0)).first().code == 0
    bad = found.union(spark.createDataFrame([("error", "c", "1")], found.schema))
    assert audit.exit_code(bad).first().code == 1
    with pytest.raises(SystemExit):
        audit.fail_on_errors(bad)


def test_dependency_names(spark):
    toml = '[project]\ndependencies = ["Foo-Bar>=1; python_version<\'3\'", "own", "x"]\n[project.optional-dependencies]\ndev = ["baz[all]"]\n[dependency-groups]\ntest = ["tt", {include-group = "dev"}]\ndocs = ["sphinx"]\n'
    files = [("pyproject.toml", toml), ("requirements/base.txt", "req==1\n-e .\n# no\nversion\n"), ("setup.cfg", "[options]\ninstall_requires =\n  cfg>1\n\nname = z\n"), ("setup.py", "x = ['setup-dep >= 2', 'plain']"), ("other.txt", "nope"), ("requirements.txt", None)]
    df = spark.createDataFrame([(1, "Own", p, t) for p, t in files] + [(2, "o", "pyproject.toml", "not toml ["), (3, "o", "pyproject.toml", "project = 3\ndependency-groups = []")], "repo int, own string, path string, content string")
    names = lambda **k: sorted((r.repo, r.name) for r in readers.dependency_names(df, ["repo"], "own", **k).collect())
    assert names() == [(1, n) for n in ("baz", "cfg", "foo_bar", "req", "setup_dep", "tt")]
    assert names(all_groups=True) == [(1, n) for n in ("baz", "foo_bar", "setup_dep", "sphinx", "tt")]


def test_clear(spark):
    from sieveline import session

    a, b = session.stored(spark.range(3), "x"), session.bucketed(spark.range(3), "id", "y")
    assert a.count() == b.count() == 3
    files = a.inputFiles() + b.inputFiles()
    session.clear(spark)
    import os

    assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)


def test_first_hits_of_paths(spark):
    scores = spark.createDataFrame([(1, "b.py", 2.0), (1, "a.py", 2.0), (1, "c.py", 3.0), (2, "a.py", 0.5)], "q int, path string, score double")
    targets = spark.createDataFrame([(1, "b.py"), (1, "none.py"), (2, "x.py"), (3, "a.py")], "q int, path string")
    got = {r.q: (r.n_targets, r.first_rank) for r in retrieval.first_hits_of(scores, targets, ["q"], "path").collect()}
    assert got == {1: (2, 3), 2: (1, 0), 3: (1, 0)}


def test_holding_takes_short_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 7)
    d = spark.createDataFrame([(k, f"w{k} w{k + 1} end") for k in range(30)] + [(99, None)], "doc int, text string")
    i = spark.createDataFrame([(k, f"w{k}") for k in range(20)] + [(50, "w5 w6 end"), (51, None), (52, "w1 w2 end more to say")], "item_no int, what string")
    got = {(r.item_no, r.doc) for r in retrieval.holding(d, i, "doc", "text", "item_no", "what").collect()}
    rows = [(r.item_no, r.what, t.doc, t.text) for r in i.collect() for t in d.collect()]
    assert got == {(k, n) for k, x, n, t in rows if x is not None and t is not None and x in t}


def _seconds(run, *args):
    import time

    run(*args)
    took = []
    for _ in range(2):
        began = time.perf_counter()
        run(*args)
        took.append(time.perf_counter() - began)
    return min(took)


def test_long_texts_take_linear_time(spark):
    """8 times as many words or lines take at most 20 times as long; a quadratic
    pass over 32,000 words would take far more."""
    from sieveline.operators import metrics

    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_no int, what string")

    def hold(n):
        d = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k, n + k))) for k in range(4)], "doc int, text string")
        assert retrieval.holding(d, items, "doc", "text", "item_no", "what").count() == 2

    def context(n):
        text = "\n".join(f" line {i}" for i in range(n))
        d = spark.createDataFrame([(text, text.replace("\n ", "\n").strip())], "p string, s string")
        r = metrics.context_fidelity(d, F.col("p"), F.col("s")).first()
        assert (r.n_context, r.n_found) == (n, n)

    for run in (hold, context):
        assert _seconds(run, 32_000) < 20 * max(_seconds(run, 4_000), 0.1)


def test_context_fidelity_counts_repeats_and_empty_rows(spark):
    from sieveline.operators import metrics

    rows = [(1, " a\n a\n+b\n c", "a\nx"), (1, None, "a"), (2, "", ""), (2, "+x", None), (3, " q", None)]
    got = {r.g: (r.n_context, r.n_found) for r in metrics.context_fidelity(spark.createDataFrame(rows, "g int, p string, s string"), F.col("p"), F.col("s"), ["g"]).collect()}
    assert got == {1: (3, 2), 2: (0, 0), 3: (1, 0)}


def test_hunks_count_lines_that_look_like_heads(spark):
    d = "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n ctx\n--- x\n+++ y\n-z\ndiff --git a b\n--- a/g\n"
    rows = training.hunk_counts(spark.createDataFrame([(1, d)], "id int, p string"), ["id"], "p").orderBy("hunk").collect()
    assert (rows[0].n_old, rows[0].n_new) == (3, 2)
    assert "@@ -1,3 +1,2 @@" in training.clean_diff("```diff\n" + d + "```")


def test_names_with_a_last_part_that_very_many_ids_have(spark):
    ids = spark.range(100_000).selectExpr("concat('m', id % 1000, '.c', id, '.get') as id").unionByName(spark.createDataFrame([("m.only",), ("get",), ("x.y.c7.get",)], "id string"))
    calls = spark.range(3000).selectExpr("concat('c', id, '.get') as call").unionByName(spark.createDataFrame([("get",), ("only",), ("get.get",), ("nope.only",), ("nope.get",), (None,)], "call string"))
    calls = calls.unionByName(spark.createDataFrame([("only.get",)], "call string"))
    got = {r.call: r.target for r in graph.resolve_names(calls, ids.unionByName(spark.createDataFrame([("a.only.get",), ("b.only.get",), ("z.c5",), ("z.c7",)], "id string")), []).collect()}
    # the first part of a name must be some id's last part: c5 and c7 are, the other c's are not
    assert got == {"get": "get", "only": "m.only", "nope.only": "m.only", "only.get": "a.only.get", "c5.get": "m5.c5.get", "c7.get": "m7.c7.get"}


def test_dotted_suffixes(spark):
    ids = spark.createDataFrame([(1, "a.b.c"), (1, "b.c"), (1, "z.b.c"), (2, "q.c"), (2, "c"), (2, ""), (2, None), (2, "x..y")], "r int, id string")
    got = {(r.r, r.suffix): r.least for r in graph.dotted_suffixes(ids, ["r"]).collect()}
    assert got == {(1, "b.c"): "a.b.c", (1, "c"): "a.b.c", (2, "c"): "q.c", (2, ".y"): "x..y", (2, "y"): "x..y"}


def test_budgets_per_start(spark):
    """Each start has its own nodes and its own room; one that is full goes no further."""
    import random

    rng = random.Random(2)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(150)})
    adj = spark.createDataFrame([*edges, *((b, a) for a, b in edges)], "node int, other int").distinct()
    starts = spark.createDataFrame([(k, k) for k in range(0, 60, 7)] + [(99, 99)], "start int, node int")

    def brute(start, depth, most):
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        seen, front = {start: 0}, [start]
        for d in range(1, depth + 1):
            front = sorted({b for a in front for b in near.get(a, ())} - set(seen))[: most - len(seen)]
            seen |= dict.fromkeys(front, d)
        return {(start, n, d) for n, d in seen.items()}

    for most in (1, 5, 12, 1000):
        got = {(r.start, r.node, r.depth) for r in graph.subgraph(adj, starts, 3, ["start"], most).collect()}
        assert got == {x for r in starts.collect() for x in brute(r.start, 3, most)}
    one = {(r.node, r.depth) for r in graph.subgraph(adj, starts.where("start = 7").select("node"), 3, most=12).collect()}
    assert one == {x[1:] for x in brute(7, 3, 12)}


def _products(x, dims):
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    e = (u * s)[:, : min(dims, max(2, min(x.shape) - 1))]
    e = e / np.linalg.norm(e, axis=1, keepdims=True)
    return e @ e.T


def _matrix(rows, key, ids):
    terms = {t: k for k, t in enumerate(sorted({r.term for r in rows}))}
    x = np.zeros((len(ids), len(terms)))
    for r in rows:
        x[ids.index(r[key]), terms[r.term]] = r.weight
    return x


def test_svd_of_instances(spark, sf):
    """Each instance's products are those of its own matrix, features capped."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("*", "item_id % 3 as repo", "'x' as _b", "1 as q")
    w = vectors.tfidf(b, "item_id", vectors.char_grams(F.col("text")), 300, ["repo"]).cache()
    got = {}
    for r in embedding.svd_embed(w, "item_id", 64, ["repo"]).collect():
        got.setdefault(r.repo, {})[r.item_id] = np.array(r.embedding, float)
    for repo in range(3):
        rows = w.where(F.col("repo") == repo).collect()
        alone = vectors.tfidf(b.where(F.col("repo") == repo), "item_id", vectors.char_grams(F.col("text")), 300).collect()
        assert {(r.item_id, r.term, round(r.weight, 9)) for r in rows} == {(r.item_id, r.term, round(r.weight, 9)) for r in alone}
        ids = sorted(got[repo])
        e = np.array([got[repo][i] for i in ids])
        assert e.shape == (len(ids), 64) and np.abs(e @ e.T - _products(_matrix(rows, "item_id", ids), 64)).max() < 1e-5


def test_svd_with_more_rows_than_directions(spark, monkeypatch):
    """Several blocks, hot terms and subspace iteration; extra and repeated cells."""
    monkeypatch.setattr(embedding, "ROWS", 32)
    monkeypatch.setattr(embedding, "TERMS", 50)
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(150, 6)) * 2.0 ** -np.arange(6)) @ rng.normal(size=(6, 120)) + 1e-4 * rng.normal(size=(150, 120))
    cells = [(i, f"t{j}", float(x[i, j])) for i in range(150) for j in range(120)]
    df = spark.createDataFrame([*cells, (0, "t0", -99.0), (None, "t1", 1.0), (3, None, 1.0), (3, "t1", None)], "id int, term string, weight double")
    e = {r.id: np.array(r.embedding, float) for r in embedding.svd_embed(df, "id", 6, rounds=3).collect()}
    e = np.array([e[i] for i in range(150)])
    assert np.abs(e @ e.T - _products(x, 6)).max() < 1e-4
    assert embedding.svd_embed(df.limit(0), "id", 6).count() == 0


def test_points_in_spans(spark):
    import random

    rng = random.Random(3)
    spans = [(k % 3, a, a + rng.choice([0, 1, 2, 7, 64, 10**6]), k) for k, a in enumerate(rng.sample(range(0, 400), 120))] + [(0, None, 5, 900), (0, 3, None, 901), (1, 0, 2**62, 902)]
    points = [(k % 3, rng.randrange(0, 500)) for k in range(150)] + [(0, None), (1, 0), (None, 4)]
    s, p = spark.createDataFrame(spans, "g int, low long, high long, no int"), spark.createDataFrame(points, "g int, at long")
    got = sorted((r.g, r["at"], r.no) for r in curate.within_intervals(p, s, ["g"], "at", "low", "high").collect())
    assert got == sorted((g, x, no) for g, x in points for h, a, b, no in spans if g == h and None not in (x, a, b) and a <= x < b)
    assert curate.within_intervals(p.limit(0), s, ["g"], "at", "low", "high").count() == 0


def test_files_at_wanted_paths(spark):
    h = spark.createDataFrame([("r", 0, "a", "1"), ("r", 0, "b", "x"), ("r", 3, "a", "2"), ("r", 5, "a", None), ("r", 9, "a", "3"), ("q", 1, "a", "z")], "repo string, rev long, path string, body string")
    at = spark.createDataFrame([("r", k) for k in (0, 2, 3, 4, 5, 8, 9, 100)] + [("q", 0), ("q", 1), ("q", 1)], "repo string, rev long")
    every = {(r.repo, r.rev, r.path): r.body for r in curate.files_at(h, at, ["repo"], "rev", "path", "body").collect()}
    a = {("r", 0): "1", ("r", 2): "1", ("r", 3): "2", ("r", 4): "2", ("r", 9): "3", ("r", 100): "3", ("q", 1): "z"}
    assert every == {(*k, "a"): v for k, v in a.items()} | {("r", k, "b"): "x" for k in (0, 2, 3, 4, 5, 8, 9, 100)}
    assert {(r.repo, r.rev): r.body for r in curate.files_at(h, at, ["repo"], "rev", "path", "body", ["a", "setup.py"]).collect()} == a


def test_running_sum_of_one_large_group(spark):
    """A group spreads over ranges; small and null groups keep their own sums."""
    from pyspark.sql import Window

    df = spark.range(200_000).selectExpr("if(id < 199000, 'hot', if(id % 7 = 0, null, concat('g', id % 50))) as g", "id as no", "if(id % 11 = 0, null, id % 5) as v")
    got = curate.running_sum(df, ["g"], ["no"], F.col("v"), "upto")
    w = Window.partitionBy("g").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("upto", F.sum(F.coalesce("v", F.lit(0))).over(w))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 200_000
    sizes = curate._ranged(df, ["g", "no"]).groupBy("_part").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 150_000


def _tar(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))


def test_tar_source_reads_what_is_asked_for(spark, tmp_path):
    from sieveline.sources import archives

    _tar(tmp_path / "a.tgz", [("./x/one.py", b"print(1)"), ("x/two.txt", "é".encode() * 9000), ("x/bad.py", b"\xff ok")])
    (tmp_path / "sub").mkdir()
    _tar(tmp_path / "sub/b.tar", [("x/one.py", b""), ("y.py", b"y")], "w")
    _tar(tmp_path / "c.tar.gz", [])
    (tmp_path / "no.zip").write_bytes(b"nothing")
    for root in (f"file://{tmp_path}", str(tmp_path)):
        df = archives.tar_members(spark, root)
        got = {(r.instance_id, r.path): (r.size, r.text) for r in df.collect()}
        assert got == {("a", "x/one.py"): (8, "print(1)"), ("a", "x/two.txt"): (18000, "é" * 6000), ("a", "x/bad.py"): (4, "� ok"), ("b", "x/one.py"): (0, ""), ("b", "y.py"): (1, "y")}
        assert df.rdd.getNumPartitions() == 3
        assert {r.path for r in df.where("path = 'x/one.py' and size > 0").collect()} == {"x/one.py"}
        one = df.where("instance_id = 'b' and path like '%.py' and size >= 0")
        assert sorted(r.path for r in one.collect()) == ["x/one.py", "y.py"] and one.rdd.getNumPartitions() == 1
        assert df.where(F.col("path").isin("y.py", "none")).count() == 1
    listing = archives.tar_members(spark, str(tmp_path), ("instance_id", "path"))
    assert listing.columns == ["instance_id", "path"] and listing.count() == 5


def test_a_large_archive_is_read_in_little_memory(spark, tmp_path):
    """80 MB of members; the reader's own memory stays small."""
    import os
    import tracemalloc

    from pyspark.sql.datasource import InputPartition
    from pyspark.sql.types import StructType

    from sieveline.sources import archives

    big = b"0123456789" * 600 + os.urandom(2_000_000)
    _tar(tmp_path / "big.tgz", [(f"m{k}.bin", big) for k in range(40)])
    reader = archives.TarReader(str(tmp_path), StructType.fromDDL(archives.SCHEMA), 6000)
    tracemalloc.start()
    rows = sum(b.num_rows for b in reader.read(InputPartition(f"{tmp_path}/big.tgz")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 40 and peak < 8_000_000
    assert archives.tar_members(spark, f"{tmp_path}/big.tgz").where("path = 'm39.bin'").first().text == "0123456789" * 600


def test_asof_is_ranged_for_hot_keys(spark, monkeypatch):
    rel = spark.createDataFrame([(k % 3, k, k, f"v{k}") for k in range(60)], "pkg int, t int, ordinal int, ver string")
    q = spark.createDataFrame([(k % 4, k * 2) for k in range(40)], "pkg int, cutoff int")
    args = (q, rel, ["pkg"], "cutoff", "t", "ordinal", ["ver"])
    one = sorted(map(repr, curate.asof(*args).collect()))
    monkeypatch.setattr(curate, "HOT_KEY", 10)
    assert sorted(map(repr, curate.asof(*args).collect())) == one
    assert curate.asof(q.limit(0), rel.limit(0), *args[2:]).count() == 0


def test_name_sets(spark):
    df = spark.createDataFrame([(1, ["b", "a", None], ["a"]), (1, None, ["c"]), (2, None, None), (3, [], [None]), (None, ["z"], None)], "g int, x array<string>, y array<string>")
    assert {r.g: r.names for r in curate.name_sets(df, ["g"], ["x", "y"]).collect()} == {1: ["a", "b", "c"], 2: [], 3: [], None: ["z"]}
