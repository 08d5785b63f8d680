"""Queries over the steps from commits to packaged tasks, and their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome
from ..functions import text as T
from ..operators import audit, curate, graph, stats, training
from ..operators import retrieval as R
from . import retrieval
from .registry import register, table

_LINES = r"regexp_split_to_array({0}, '\r\n|\n|\r')"


@register("""
WITH c AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS sha, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +0000' AS date, o_orderdate, o_orderpriority,
  ['src/m' || o_orderkey % 7 || '.py', 'README.md', CASE o_orderkey % 4 WHEN 0 THEN 'tests/test_m.py' WHEN 1 THEN 'pkg/latest_x.py' WHEN 2 THEN 'tests/data.txt' ELSE 'pkg/m_test.py' END] AS files FROM orders),
k AS (SELECT *, list_filter(files, lambda f: f LIKE '%.py' AND NOT regexp_matches(f, 'TEST_PATH', 'i')) AS src, list_filter(files, lambda f: f LIKE '%.py' AND regexp_matches(f, 'TEST_PATH', 'i')) AS tst FROM c)
SELECT o_orderpriority || '_' || substr(sha, 1, 7) AS instance_id, sha AS fix_commit, 'p' || o_orderkey AS base_commit, date, array_to_string(src, ' ') AS src_files, array_to_string(tst, ' ') AS test_files
FROM k WHERE o_orderkey % 3 > 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND len(src) > 0 AND len(tst) > 0
""".replace("TEST_PATH", T.TEST_PATH.removeprefix("(?i)")))
def candidate_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits; every third is a merge, with two parents."""
    k = F.col("o_orderkey")
    last = F.when(k % 4 == 0, "tests/test_m.py").when(k % 4 == 1, "pkg/latest_x.py").when(k % 4 == 2, "tests/data.txt").otherwise("pkg/m_test.py")
    commits = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo"), F.md5(k.cast("string").cast("binary")).alias("sha"), F.when(k % 3 > 0, F.array(F.concat(F.lit("p"), k.cast("string")))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("parents"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss Z").alias("_"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")).alias("date"), F.lit("s").alias("subject"),
        F.array(F.concat(F.lit("src/m"), (k % 7).cast("string"), F.lit(".py")), F.lit("README.md"), last).alias("files"),
    ).drop("_")
    out = curate.candidates(commits, since="1996-01-01T00:00:00Z")
    return out.select("instance_id", "fix_commit", "base_commit", "date", F.array_join("src_files", " ").alias("src_files"), F.array_join("test_files", " ").alias("test_files"))


@register("""
WITH pr AS (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS number, arg_min(o_orderpriority, o_orderkey) AS title, arg_min('Fixes #' || o_orderkey % 50 || '.', o_orderkey) AS body, arg_min(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderkey) AS made FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey, CASE WHEN number IS NOT NULL THEN number % 50 WHEN c_custkey % 2 = 0 THEN c_custkey END AS issue, number, title, made FROM customer LEFT JOIN pr ON o_custkey = c_custkey)
SELECT c_custkey AS instance_id, number AS pr_number, title AS pr_title, issue AS issue_number, p_name AS issue_title, coalesce(made, '2020-01-01T00:00:00') AS created_at
FROM c LEFT JOIN part ON p_partkey = issue AND p_size % 5 > 0
""")
def enriched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are commits, their orders pull requests, parts issues, of which
    every fifth size is a pull request itself."""
    cands = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"), F.lit("r").alias("repo_short"), F.col("c_custkey").cast("string").alias("fix_commit"), F.lit("2020-01-01T00:00:00").alias("date"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("closes #"), F.col("c_custkey").cast("string"))).otherwise("no issue").alias("subject"))
    o = table(spark, sf_dir, "orders")
    pulls = o.select(F.col("o_custkey").cast("string").alias("sha"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("Fixes #"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".")).alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    issues = table(spark, sf_dir, "part").select(F.lit("r").alias("repo_short"), F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), F.col("p_brand").alias("body"), (F.col("p_size") % 5 == 0).alias("is_pull"))
    return curate.enrich(cands, pulls, issues).select("instance_id", "pr_number", "pr_title", "issue_number", "issue_title", "created_at")


@register(rf"""
WITH d AS (SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS mark, {_LINES.format("coalesce(text, '')")} AS l, quality FROM documents JOIN labels USING (doc_id)),
n AS (SELECT *, CASE WHEN l[-1] = '' AND len(l) > 1 THEN l[:-2] ELSE l END AS ls FROM d),
c AS (SELECT *, CAST(len(list_filter(list_transform(ls, lambda x: mark || x), lambda x: (starts_with(x, '+') OR starts_with(x, '-')) AND NOT starts_with(x, '+++') AND NOT starts_with(x, '---'))) AS BIGINT) AS n FROM n)
SELECT doc_id AS instance_id, CASE source WHEN 'web' THEN 'org/web' WHEN 'code' THEN 'org/code' ELSE source END AS repo, CASE WHEN doc_id % 2 = 0 THEN 'title' || chr(10) || chr(10) || lang ELSE 'subject' END AS problem_statement,
  n AS n_patch_lines, doc_id % 9 AS n_src_files, CAST(1 AS BIGINT) AS n_test_files, '' AS created_at, lang AS fix_date FROM c WHERE quality = 1 AND n <= 200 AND doc_id % 9 <= 6
""")
def package_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as tasks: their lines, marked, are patches; verified is
    a good label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    mark = F.when(F.col("doc_id") % 3 == 0, "-").when(F.col("doc_id") % 3 == 1, "+").otherwise(" ")
    patch = F.array_join(F.transform(T.lines(F.coalesce("text", F.lit(""))), lambda x: F.concat(mark, x)), "\n")
    even = F.col("doc_id") % 2 == 0
    rows = d.select(
        F.col("doc_id").alias("instance_id"), F.col("source").alias("repo_short"), F.lit("b").alias("base_commit"), F.lit("f").alias("fix_commit"), patch.alias("patch"), F.lit("t").alias("test_patch"), (F.col("quality") == 1).alias("verified"),
        F.array_repeat(F.lit("a.py"), (F.col("doc_id") % 9).cast("int")).alias("src_files"), F.array(F.lit("t.py")).alias("test_files"), F.when(even, "title").alias("issue_title"), F.when(even, F.col("lang")).alias("issue_body"),
        F.lit(None).cast("string").alias("pr_title"), F.lit(None).cast("string").alias("pr_body"), F.lit("subject").alias("subject"), F.lit(None).cast("string").alias("created_at"), F.col("lang").alias("date"), F.lit(None).cast("long").alias("pr_number"),
    )
    return curate.package(rows, {"web": "org/web", "code": "org/code"}).select("instance_id", "repo", "problem_statement", "n_patch_lines", "n_src_files", "n_test_files", "created_at", "fix_date")


@register("""
WITH n AS (SELECT DISTINCT p_mfgr AS grp, p_brand AS name FROM (SELECT p_size % 4 AS p_mfgr, CASE p_size % 10 WHEN 0 THEN 'version' WHEN 1 THEN 'x' WHEN 2 THEN 'own' ELSE lower(replace(p_brand, '#', '_')) END AS p_brand FROM part)),
r AS (SELECT DISTINCT p_size % 4 AS grp, lower(replace(p_brand, '#', '_')) AS name FROM part WHERE p_size % 4 < 2 AND p_retailprice > 1000),
k AS (SELECT * FROM n WHERE name NOT IN ('version', 'x', 'own'))
SELECT grp, name FROM k SEMI JOIN r USING (grp, name) UNION ALL SELECT grp, name FROM k WHERE grp NOT IN (SELECT grp FROM r)
""")
def requirement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are requirement names, sizes repositories; half of these have
    resolved names."""
    p = table(spark, sf_dir, "part").withColumns({"grp": F.col("p_size") % 4, "brand": F.lower(F.regexp_replace("p_brand", "#", "_")), "k": F.col("p_size") % 10})
    name = F.when(F.col("k") == 0, "version").when(F.col("k") == 1, "x").when(F.col("k") == 2, "own").otherwise(F.col("brand"))
    names = p.select("grp", F.lit("own").alias("own"), name.alias("name")).distinct()
    resolved = p.where("grp < 2 and p_retailprice > 1000").select("grp", F.col("brand").alias("name"))
    return curate.wanted_requirements(names, ["grp"], "own", "name", resolved).select("grp", "name")


@register("""
WITH m AS (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS f FROM lineitem WHERE l_quantity > 25), t AS (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS f FROM lineitem)
SELECT l_orderkey AS task, array_to_string(list_sort(list(f)), ' ') AS targets FROM t SEMI JOIN m USING (l_orderkey, f) GROUP BY l_orderkey
""")
def snapshot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are tasks, their parts patched files; lines of a large quantity are
    in the snapshot."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), "l_quantity")
    tasks = line.groupBy("task").agg(F.collect_set("path").alias("files"))
    return curate.in_snapshot(tasks, ["task"], "files", line.where("l_quantity > 25"), "path").select("task", F.array_join("targets", " ").alias("targets"))


@register("SELECT doc_id, lang, quality FROM labels JOIN documents USING (doc_id)")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label has a document; one without would stop the query."""
    return curate.strict_join(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"]).select("doc_id", "lang", "quality")


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT s_suppkey FROM supplier)")
def with_all_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return curate.with_assets(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], o, s)


@register("SELECT o_orderkey, 'm' AS model, TRUE AS graph, FALSE AS oracle FROM orders")
def stamped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.stamped(table(spark, sf_dir, "orders").select("o_orderkey"), model="m", graph=True, oracle=False)


@register(r"""
WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[#?].*$', '', 'g') || CASE WHEN page_id % 2 = 0 THEN '/__init__.py' ELSE '.py' END AS path FROM pages)
SELECT page_id, regexp_replace(replace(regexp_replace(path, '\.py$', ''), '/', '.'), '\.__init__$', '') AS module, regexp_replace(replace(regexp_replace(path, '\.py$', ''), '/', '.'), '\.__init__$', '') || '.C.run' AS name FROM u
""")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.regexp_replace("url", r"^[a-z]+://|[#?].*$", ""), F.when(F.col("page_id") % 2 == 0, "/__init__.py").otherwise(".py"))
    m = T.module_name(path)
    return table(spark, sf_dir, "pages").select("page_id", m.alias("module"), T.qualified(m, F.lit("C"), F.lit("run")).alias("name"))


@register(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(source || '_' || lang), '[a-z_]{2,}') AS a, regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}')[1:400] AS b FROM documents)
SELECT doc_id, CAST(len(a) + len(b) AS INTEGER) AS n, md5(array_to_string(list_concat(a, b), ' ')) AS tokens FROM t
""")
def node_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a name, then the first 400 of its text."""
    toks = T.node_tokens(F.concat_ws("_", "source", "lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(toks).alias("n"), F.md5(F.array_join(toks, " ").cast("binary")).alias("tokens"))


@register("SELECT conv_id, turn, split_part(coalesce(text, ''), '. ', 1) AS head, CASE WHEN turn % 2 = 0 AND coalesce(text, '') <> '' THEN text ELSE CAST(conv_id AS VARCHAR) END AS shown FROM conversations")
def statement_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text before a marker; text, or an id where there is none."""
    some = F.when(F.col("turn") % 2 == 0, F.col("text")).when(F.col("turn") % 4 == 1, "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.before(F.coalesce("text", F.lit("")), ". ").alias("head"), T.text_or(some, F.col("conv_id").cast("string")).alias("shown"))


@register("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS quarter FROM lineitem")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.rounded(F.col("l_quantity") / 4).alias("quarter"))


@register("SELECT doc_id, substr('stage' || doc_id % 3 || ': ' || coalesce(text, ''), 1, 300) AS error FROM documents")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.concat(F.lit("stage"), (F.col("doc_id") % 3).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", outcome.error_row(stage, F.coalesce("text", F.lit(""))).alias("error"))


@register("SELECT CAST(max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS INTEGER) AS code FROM labels")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing (zero) quality is an error; ids on one side only are warnings."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parts = [("error", "required", audit.missing_fields(lab, "doc_id", ["quality"])), ("warning", "ids", audit.id_mismatch(d, lab, ["doc_id"]).select(F.col("doc_id").alias("id")))]
    return audit.exit_code(audit.findings(parts))


_FACTS = """
WITH f AS (SELECT o_custkey % 40 AS repo, 'n' || o_orderkey % 25 AS a, o_orderkey AS no, 'p' || o_orderkey % 3 AS path, o_orderpriority AS b FROM orders),
n AS (SELECT repo, a, arg_min(b, path || lpad(CAST(1000000000 - no AS VARCHAR), 12, '0')) AS text FROM f GROUP BY ALL),
c AS (SELECT l_orderkey, o_custkey % 40 AS repo, 'n' || l_orderkey % 25 AS source, 'p' || l_orderkey % 3 AS path, 'n' || l_partkey % 60 AS call, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS no FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders define symbols, in one of three files; lines are calls."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda c, n: F.concat(F.lit("n"), (F.col(c) % n).cast("string"))
    path = F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string"))
    own = [(F.col("o_custkey") % 40).alias("repo"), path.alias("path")]
    defs = o.select(*own, F.lit("node").alias("kind"), name("o_orderkey", 25).alias("a"), F.col("o_orderpriority").alias("b"), (F.col("o_orderkey") * 10).alias("no"))
    calls = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(*own, F.lit("call").alias("kind"), name("l_orderkey", 25).alias("a"), name("l_partkey", 60).alias("b"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("no"))
    return defs.union(calls)


@register(_FACTS + "z AS (SELECT 1) SELECT repo, a AS id, text FROM n")
def duplicate_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of symbols defined again the first path's last text stands."""
    return graph.nodes_of(_facts(spark, sf_dir), ["repo"]).select("repo", "id", "text")


@register(_FACTS + """b AS (SELECT repo, a, max(path || ' ' || lpad(CAST(no AS VARCHAR), 12, '0')) AS m FROM f GROUP BY ALL),
u AS (SELECT c.* FROM c JOIN b ON b.repo = c.repo AND b.a = c.source AND split_part(m, ' ', 1) = c.path),
e AS (SELECT u.repo, source, call AS target, min(no) AS no FROM u SEMI JOIN n ON n.repo = u.repo AND n.a = u.call WHERE call <> source GROUP BY ALL)
SELECT repo, source, target, row_number() OVER (PARTITION BY repo, source ORDER BY no) - 1 AS key FROM e""")
def edge_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a symbol are those of its last path, numbered by first use."""
    return graph.graph_of(_facts(spark, sf_dir), ["repo"])[1].select("repo", "source", "target", "key")


@register(retrieval._HITS + ", b AS (SELECT *, 'r' || item_id % 4 AS repo FROM first) SELECT repo, k, count(*) AS n, count(*) FILTER (first_rank > 0 AND first_rank <= k) AS hits, round(count(*) FILTER (first_rank > 0 AND first_rank <= k) / count(*), 6) AS recall FROM b CROSS JOIN (VALUES (1), (3), (5), (10)) v(k) GROUP BY ALL")
def recall_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are dealt to four repositories."""
    first = retrieval.first_hit_rank(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), (F.col("item_id") % 4).cast("string")))
    return R.recall_at(first, [1, 3, 5, 10], ["repo"]).withColumn("recall", F.round("recall", 6))


@register(rf"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS mark, {_LINES.format("coalesce(text, '')")} AS l FROM documents),
n AS (SELECT doc_id, mark, list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: mark || x) AS ls FROM d),
k AS (SELECT doc_id, mark, len(ls) AS n FROM n)
SELECT doc_id, CAST(1 AS BIGINT) AS hunk, CASE WHEN mark = '+' THEN 0 ELSE n END AS n_old, CASE WHEN mark = '-' THEN 0 ELSE n END AS n_new FROM k WHERE n > 0
UNION ALL SELECT doc_id, CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT) FROM k
""")
def hunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hunk of a document's lines, all marked alike, and one of three lines."""
    mark = F.when(F.col("doc_id") % 3 == 0, "-").when(F.col("doc_id") % 3 == 1, "+").otherwise(" ")
    body = F.transform(T.lines(F.coalesce("text", F.lit(""))), lambda x: F.concat(mark, x))
    patch = F.array_join(F.concat(F.array(F.lit("--- a/f"), F.lit("+++ b/f"), F.lit("@@ -1 +1 @@")), body, F.array(F.lit("@@ -9 +9 @@ f"), F.lit(" c"), F.lit("+x"), F.lit("--- no"))), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", patch.alias("patch"))
    return training.hunk_counts(d, ["doc_id"], "patch").select("doc_id", F.col("hunk").cast("long").alias("hunk"), "n_old", "n_new")


@register("""
SELECT conv_id, CASE WHEN conv_id % 5 = 0 OR conv_id % 3 = 0 THEN '' ELSE '--- a/f' || conv_id || '.py' || chr(10) || '+++ b/f' || conv_id || '.py' || chr(10) || '@@ -1,2 +1,3 @@' || chr(10) || ' same' || chr(10) || '-' || conv_id || chr(10) || '+' || n || chr(10) || '+end' || chr(10) END AS patch
FROM (SELECT conv_id, 'n' || count(*) AS n FROM conversations GROUP BY conv_id)
""")
def diff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of a made-up file between two revisions; no files, and files that
    don't differ, give the empty text."""
    k = F.col("conv_id").cast("string")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("n"), F.count("*").cast("string")).alias("n"))
    before = F.concat(F.lit("same\n"), k, F.lit("\n"))
    after = F.when(F.col("conv_id") % 3 == 0, before).otherwise(F.concat(F.lit("same\n"), F.col("n"), F.lit("\nend\n")))
    one = F.array(F.struct(F.concat(F.lit("f"), k, F.lit(".py")).alias("path"), before.alias("before"), after.alias("after")))
    rows = c.select("conv_id", F.when(F.col("conv_id") % 5 > 0, one).otherwise(F.slice(one, 1, 0)).alias("files"))
    return training.unified_diffs(rows, "files").select("conv_id", "patch")


@register("""
WITH h AS (SELECT o_custkey, o_orderkey AS rev, 'f' || o_orderkey % 3 AS path, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS c FROM orders),
r AS (SELECT o_custkey, rev FROM h WHERE rev % 4 = 0),
g AS (SELECT r.o_custkey, r.rev, path, max(h.rev) AS last FROM r JOIN h ON h.o_custkey = r.o_custkey AND h.rev <= r.rev GROUP BY ALL)
SELECT g.o_custkey, g.rev, g.path, c AS content FROM g JOIN h ON h.o_custkey = g.o_custkey AND h.rev = g.last AND h.path = g.path WHERE c IS NOT NULL
""")
def files_at_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are repositories, orders revisions that each change a file, or
    delete it."""
    o = table(spark, sf_dir, "orders")
    h = o.select("o_custkey", F.col("o_orderkey").alias("rev"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("path"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("content"))
    return curate.files_at(h, h.where("rev % 4 = 0"), ["o_custkey"], "rev", "path", "content")


@register("SELECT conv_id, turn, 'role ' || role || CASE WHEN turn % 2 = 0 THEN chr(10) || 'tools: a, b' ELSE '' END || chr(10) || 'answer' AS prompt FROM conversations")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt with a block of tools for every other turn."""
    block = F.when(F.col("turn") % 2 == 0, "tools: a, b")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", training.assemble(F.concat(F.lit("role "), "role"), block, F.lit("answer")).alias("prompt"))
