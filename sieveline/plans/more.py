"""Queries over the remaining functions, filters and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome
from ..functions import text as T
from ..operators import audit, curate, metrics, training, vectors
from ..operators import retrieval as R
from . import retrieval
from .registry import register, table


@register("""
WITH r AS (SELECT event_type AS pkg, CAST(event_id AS VARCHAR) AS ver, ts, event_id FROM events),
t AS (SELECT user_id, max(ts) AS cutoff FROM events WHERE event_id % 5 = 0 GROUP BY user_id), n AS (SELECT DISTINCT user_id, event_type AS pkg FROM events WHERE event_id % 3 = 0),
w AS (SELECT user_id, pkg, max_by(ver, r.ts) AS ver FROM t JOIN n USING (user_id) JOIN r USING (pkg) WHERE r.ts <= cutoff GROUP BY ALL)
SELECT t.user_id, x.constraints FROM t LEFT JOIN (SELECT user_id, string_agg(pkg || '==' || ver, chr(10) ORDER BY pkg || '==' || ver) AS constraints FROM w GROUP BY user_id) x ON x.user_id = t.user_id
""")
def era_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are packages, events releases, users tasks."""
    e = table(spark, sf_dir, "events")
    rel = e.select(F.col("event_type").alias("pkg"), F.col("event_id").cast("string").alias("ver"), F.col("ts").alias("t"), F.col("event_id").alias("ordinal"))
    tasks = e.where("event_id % 5 = 0").groupBy("user_id").agg(F.max("ts").alias("cutoff"))
    names = e.where("event_id % 3 = 0").select("user_id", F.col("event_type").alias("pkg")).distinct()
    return curate.era_constraints(tasks, names, rel, ["user_id"], "cutoff")


@register("""
WITH d AS (SELECT doc_id, md5(text) AS base, lang FROM documents)
SELECT a.doc_id AS ours, b.doc_id AS external, a.doc_id % 3 = b.doc_id % 3 AS identical_edit_lines FROM d a JOIN d b ON a.base = b.base AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1
""")
def external_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are bases, and every document has a made-up patch."""
    patch = F.concat(F.lit("--- a/f\n+++ b/f\n-old\n+new"), (F.col("doc_id") % 3).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("base"), patch.alias("patch"))
    return curate.external_overlap(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "base", "doc_id", "doc_id", "patch")


@register("""
SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 4 = doc_id % 6) AS hits, round(count(*) FILTER (doc_id % 4 = doc_id % 6) / count(*), 6) AS share FROM documents WHERE doc_id % 7 > 0 GROUP BY lang
""")
def file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda k: F.concat(F.lit("--- a/f"), (F.col("doc_id") % k).cast("string"), F.lit(".py\n"))
    out = metrics.file_overlap(table(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 7 > 0, p(4)).otherwise(" "), p(6), ["lang"])
    return out.withColumn("share", F.round("share", 6))


@register(r"""
WITH t AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY doc_id) AS no FROM documents),
p AS (SELECT a.lang, regexp_split_to_array(b.text, '\r\n|\n|\r') AS quoted, regexp_split_to_array(a.text, '\r\n|\n|\r') AS own FROM t a JOIN t b ON b.no = CASE WHEN a.doc_id % 3 = 0 THEN greatest(a.no - 1, 1) ELSE a.no END),
l AS (SELECT lang, CASE WHEN quoted[-1] = '' THEN quoted[:-2] ELSE quoted END AS quoted, CASE WHEN own[-1] = '' THEN own[:-2] ELSE own END AS own FROM p),
c AS (SELECT lang, unnest(list_filter(quoted, lambda x, i: i % 2 = 1)) AS line, own FROM l)
SELECT lang, count(*) AS n_context, count(*) FILTER (list_contains(own, line)) AS n_found, round(count(*) FILTER (list_contains(own, line)) / count(*), 6) AS fidelity FROM c GROUP BY lang
""")
def context_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that quote every other line of a text: mostly the document's own,
    for every third id that of the document before it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    no = curate.numbered(d.select("doc_id"), ["doc_id"])
    t = d.join(no, "doc_id")
    of = F.when(F.col("doc_id") % 3 == 0, F.greatest(F.col("_no") - 1, F.lit(0))).otherwise(F.col("_no"))
    both = t.withColumn("_of", of).join(t.select(F.col("_no").alias("_of"), F.col("text").alias("quoted")), "_of")
    marked = F.transform(T.lines(F.col("quoted")), lambda x, k: F.concat(F.when(k % 2 == 0, " ").otherwise("+"), x))
    out = metrics.context_fidelity(both, F.array_join(marked, "\n"), F.col("text"), ["lang"])
    return out.withColumn("fidelity", F.round("fidelity", 6))


@register("""
WITH u AS (SELECT user_id, count(*) FILTER (event_type IN ('click', 'error')) AS c FROM events GROUP BY user_id)
SELECT count(*) AS n, count(*) FILTER (c > 0) AS n_using, CAST(sum(c) AS BIGINT) AS n_calls FROM u
""")
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("hist"))
    return metrics.tool_usage(maps, F.col("hist"), ["click", "error"])


@register("SELECT coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def hit_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.cross_tab(d, F.col("quality") == 1, F.col("toxic") == 1, ("good", "toxic"))


@register(retrieval._HITS + "SELECT n_targets > 1 AS many, k, count(*) AS n, count(*) FILTER (first_rank > 0 AND first_rank <= k) AS hits, round(count(*) FILTER (first_rank > 0 AND first_rank <= k) / count(*), 6) AS recall FROM first CROSS JOIN (VALUES (1), (5)) v(k) GROUP BY ALL")
def recall_by_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of items with one target and with several."""
    first = retrieval.first_hit_rank(spark, sf_dir).withColumn("many", F.col("n_targets") > 1)
    return R.recall_at(first, [1, 5], ["many"]).withColumn("recall", F.round("recall", 6))


@register(r"""
WITH l AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM documents))
SELECT doc_id, array_to_string(list_transform(range(2, least(3, len(l)) + 1), lambda i: i || ': ' || l[i]), chr(10)) AS shown FROM l
""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.numbered_lines(F.col("text"), 2, 3).alias("shown"))


@register("SELECT doc_id, CASE WHEN contains(text, 'the') THEN sha256(regexp_replace(text, 'the', 'THE')) END AS edited_sha256 FROM documents")
def replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = T.replace_first(F.col("text"), F.lit("the"), F.lit("THE"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))


@register(r"""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/workspace/' WHEN 1 THEN '' ELSE '../' END || regexp_replace(url, '^[a-z]+://|[#?].*$', '', 'g') AS p FROM pages)
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN regexp_replace(p, '^/workspace/', '') END AS path, reverse(string_split(reverse(replace(split_part(p, '/', 1 + CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END), '/', '')), '.')[1]) AS last FROM p
""")
def sandbox_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", r"^[a-z]+://|[#?].*$", "")
    k = F.col("page_id") % 3
    p = F.concat(F.when(k == 0, "/workspace/").when(k == 1, "").otherwise("../"), bare)
    return table(spark, sf_dir, "pages").select("page_id", T.sandboxed(p).alias("path"), T.last_part(F.substring_index(bare, "/", 1)).alias("last"))


@register("""
SELECT doc_id, substr(text, 1, 80) AS head, right(text, 30) AS tail, length(trim(text)) > 0 AS filled, source || '_' || substr(md5(text), 1, 7) AS instance_id, source AS repo FROM documents
""")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = T.instance_id(F.col("source"), F.md5("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.head(F.col("text"), 80).alias("head"), T.tail(F.col("text"), 30).alias("tail"), T.not_blank(F.col("text")).alias("filled"), i.alias("instance_id"), T.repo_of(i).alias("repo"))


@register("""
SELECT CASE WHEN event_id % 6 > 0 THEN event_id % 3 <> 0 END AS fails_before, CASE WHEN event_id % 6 > 0 AND event_id % 5 > 0 THEN event_id % 4 = 0 END AS passes_after, count(*) AS n FROM events GROUP BY 1, 2
""")
def two_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    f, p = outcome.two_phases((i % 6 == 0).cast("int"), i % 3, (i % 5 == 0).cast("int"), i % 4)
    return table(spark, sf_dir, "events").groupBy(f.alias("fails_before"), p.alias("passes_after")).agg(F.count("*").alias("n"))


@register("""
WITH m AS (SELECT source AS id, lang || CASE WHEN doc_id % 40 = 0 THEN '.py' ELSE '.txt' END AS path FROM documents)
SELECT id FROM m GROUP BY id HAVING NOT bool_or(ends_with(path, '.py'))
""")
def snapshots_without_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("lang", F.when(F.col("doc_id") % 40 == 0, ".py").otherwise(".txt"))
    return audit.without_python(table(spark, sf_dir, "documents").select("source", path.alias("path")), "source", "path")


@register("""
SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def empty_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are tasks, orders their nodes, suppliers of the same key edges."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    nodes, edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return audit.empty_graphs(nodes, edges, c, "c_custkey").distinct()


@register("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 30)")
def minimum_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.keep_mapped(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 30).select("doc_id", "source")


@register("""
SELECT conv_id, 'Fix the following issue in this repository. Output a unified diff patch.' || chr(10) || chr(10) || '## Issue' || chr(10) || min_by(text, turn) || chr(10) || chr(10) || '## Files' || chr(10)
  || string_agg('### ' || role || chr(10) || '```python' || chr(10) || text || chr(10) || '```', chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id
""")
def repair_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns are issues, all turns files."""
    rows = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("path"), "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("files"), F.min_by("text", "turn").alias("issue"))
    return c.select("conv_id", training.repair_prompt(F.col("issue"), F.col("files")).alias("prompt"))


@register("""
SELECT 'left' AS side, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 7 = 0)
UNION ALL SELECT 'both', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 7 = 0)
UNION ALL SELECT 'either', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 7 = 0)
UNION ALL SELECT 'bag', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 7 = 0)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections of users, all clicks and every seventh signup; the filter
    by id makes the second one differ from the first, it saves no work."""
    e = table(spark, sf_dir, "events")
    a, b = e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'signup' and event_id % 7 = 0").select("user_id")
    parts = {"left": a.subtract(b), "both": a.intersect(b), "either": a.union(b).distinct(), "bag": a.union(b)}
    out = None
    for k, p in parts.items():
        p = p.agg(F.lit(k).alias("side"), F.count("*").alias("n"))
        out = p if out is None else out.union(p)
    return out


@register("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS only_in FROM (SELECT doc_id FROM documents WHERE doc_id % 9 > 0) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def id_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels against a copy of the documents that lacks every ninth id, so
    that ids are missing on both sides."""
    return audit.id_mismatch(table(spark, sf_dir, "documents").where("doc_id % 9 > 0"), table(spark, sf_dir, "labels"), ["doc_id"])
