"""Queries over BM25 retrieval, roll-ups and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25_index
from ..operators import retrieval as R
from ..session import scratch
from .registry import register, table

#: Every pair of an item and a document that share a token, ranked (r).
RANKED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}')) AS token FROM benchmark),
c AS (SELECT count(*) AS n, avg(len(t)) AS av FROM d),
tf AS (SELECT doc_id, token, count(*) AS c, any_value(l) AS l FROM (SELECT doc_id, unnest(t) AS token, len(t) AS l FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.c * 2.2 / (tf.c + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN c GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""
_HITS = RANKED_SQL + r"""
, target AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
first AS (SELECT item_id, count(*) AS n_targets, CAST(coalesce(min(rank), 0) AS INTEGER) AS first_rank FROM target LEFT JOIN r USING (item_id, doc_id) GROUP BY item_id)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    q = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    return R.bm25(d, q, [], "doc_id", "t", "item_id", "t")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item verbatim."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return R.holding(table(spark, sf_dir, "documents"), b, "doc_id", "text", "item_id", "item")


@register(RANKED_SQL + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(scores(spark, sf_dir), ["item_id"], "score", ["doc_id"], k=10)


@register(RANKED_SQL + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking out of a stored index, made in two appends."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    q = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    path = scratch(spark, "bm25")
    half = d.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    bm25_index.append(d.where(F.col("doc_id") <= half), path, "doc_id", "t")
    bm25_index.append(d, path, "doc_id", "t")  # what is indexed already stays
    return bm25_index.search(spark, path, q, "item_id", "t").rows


@register(_HITS + "SELECT item_id, n_targets, first_rank FROM first")
def first_hit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_hits_of(scores(spark, sf_dir), targets(spark, sf_dir), ["item_id"], "doc_id")


@register(_HITS + "SELECT k, count(*) AS n, count(*) FILTER (first_rank > 0 AND first_rank <= k) AS hits, count(*) FILTER (first_rank > 0 AND first_rank <= k) / count(*) AS recall FROM first CROSS JOIN (VALUES (1), (3), (5), (10)) v(k) GROUP BY k")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recall_at(first_hit_rank(spark, sf_dir), [1, 3, 5, 10])


@register(r"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}'))) AS token FROM documents) GROUP BY token")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequency(table(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text")))


@register(r"""
WITH node AS (SELECT conv_id, turn, conv_id || ':' || turn AS node, regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}') AS t FROM conversations),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}'))) AS token FROM benchmark),
c AS (SELECT count(*) AS n, avg(len(t)) AS av FROM node),
tf AS (SELECT node, token, count(*) AS c, any_value(l) AS l FROM (SELECT node, unnest(t) AS token, len(t) AS l FROM node) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT item_id, node, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.c * 2.2 / (tf.c + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN c GROUP BY ALL),
e AS (SELECT a.node AS source, b.node AS target FROM node a JOIN node b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
adj AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e),
near AS (SELECT item_id, adj.node, max(score) AS near FROM adj JOIN s ON s.node = adj.other GROUP BY ALL),
g AS (SELECT item_id, node, coalesce(score, 0) + 0.5 * coalesce(near, 0) AS score FROM s FULL JOIN near USING (item_id, node)),
f AS (SELECT item_id, CAST(split_part(node, ':', 1) AS BIGINT) AS conv_id, greatest(0, max(score)) AS score FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, conv_id) AS rank FROM f)
SELECT item_id, conv_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def graph_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are nodes, adjacent turns edges, conversations files; all items are
    queries."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("node"), T.tokens(F.col("text")).alias("t"))
    q = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    s = R.bm25(c, q, [], "node", "t", "item_id", "t", within=["conv_id"])
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("node").alias("target"))
    edges = c.select("conv_id", "turn", F.col("node").alias("source")).join(nxt, ["conv_id", "turn"]).select("conv_id", "source", "target")
    g = R.rerank_within(s, R.undirected(edges, ["conv_id"]), ["item_id"], ["conv_id"], "node")
    # half of a sixth digit is often a tie at the fifth: scaled first, as SQL rounds
    top = F.round(F.greatest(F.lit(0.0), F.max("score")) * 1e5) / 1e5
    f = g.groupBy("item_id", "conv_id").agg(top.alias("score"))
    return R.ranked(f, ["item_id"], "score", ["conv_id"], k=10).select("item_id", "conv_id", "score", "rank")


_HOST = r"regexp_extract(url, '^[a-z]+://([^/#?]+)', 1)"


@register(rf"""
WITH u AS (SELECT DISTINCT {_HOST} AS host, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]+|[#?].*$', '', 'g'), '/'), lambda x: x <> '') AS seg FROM pages),
n AS (SELECT DISTINCT replace(host, '.', '_') || CASE WHEN len(seg) > 0 THEN '.' || array_to_string(seg, '.') ELSE '' END AS node FROM u),
f AS (SELECT DISTINCT replace(host, '.', '_') || '/' || seg[1] || '.py' AS path FROM u WHERE len(seg) > 0 UNION SELECT DISTINCT replace(host, '.', '_') || '/__init__.py' FROM u),
c AS (SELECT node, unnest(range(1, least(6, len(string_split(node, '.'))) + 1)) AS k FROM n),
x AS (SELECT node, array_to_string(string_split(node, '.')[1:k], '/') || s AS path, -10 * k + o AS prio FROM c CROSS JOIN (VALUES ('.py', 0), ('/__init__.py', 1)) v(s, o))
SELECT node, arg_min(path, prio) AS path FROM x JOIN f USING (path) GROUP BY node
""")
def prefix_file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host = F.translate(F.regexp_extract(url, "^[a-z]+://([^/#?]+)", 1), ".", "_")
    seg = F.filter(F.split(F.regexp_replace(url, r"^[a-z]+://[^/]+|[#?].*$", ""), "/"), lambda x: x != "")
    u = table(spark, sf_dir, "pages").select(host.alias("host"), seg.alias("seg")).distinct()
    nodes = u.select(F.concat_ws(".", "host", F.array_join("seg", ".")).alias("node")).select(F.rtrim(F.col("node"), F.lit(".")).alias("node")).distinct()
    files = u.where(F.size("seg") > 0).select(F.concat("host", F.lit("/"), F.col("seg")[0], F.lit(".py")).alias("path")).union(u.select(F.concat("host", F.lit("/__init__.py"))))
    return R.prefix_file_map(nodes, files, [], "node", "path")


@register(r"""
WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS score FROM documents),
f AS (SELECT source, CAST(greatest(0, coalesce(max(score), 0)) AS DOUBLE) AS score FROM s GROUP BY source)
SELECT source, score, CAST(row_number() OVER (ORDER BY score DESC, source) AS INTEGER) AS rank FROM f QUALIFY rank <= 3
""")
def file_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are nodes, sources files, sizes scores; every third has none."""
    d = table(spark, sf_dir, "documents")
    scored = d.where("doc_id % 3 > 0").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    f = R.roll_up(scored, d.select("doc_id", "source"), [], "doc_id", "source")
    return f.orderBy(F.desc("score"), "source").limit(3).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source")))
