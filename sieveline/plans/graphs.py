"""Queries over graphs and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from .registry import register, table

_EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem), adj AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that share a line."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).distinct()


@register(_EDGES + ", w(node, depth) AS (SELECT 'p1', 0 UNION SELECT other, depth + 1 FROM w JOIN adj ON adj.node = w.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def bfs_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1).select(F.lit("p1").alias("node"))
    return G.subgraph(R.undirected(_edges(spark, sf_dir), []), start, 2)


@register(_EDGES + """, t AS (SELECT DISTINCT 's' || s_suppkey AS start FROM supplier WHERE s_nationkey = 7), w(start, node, depth) AS (SELECT start, start, 0 FROM t UNION SELECT start, other, depth + 1 FROM w JOIN adj ON adj.node = w.node WHERE depth < 2),
d AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, node) <= 60""")
def bfs_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier of a nation as a start of its own, 60 nodes each."""
    start = table(spark, sf_dir, "supplier").where("s_nationkey = 7").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"))
    return G.subgraph(R.undirected(_edges(spark, sf_dir), []), start.withColumn("node", F.col("start")), 2, ["start"], 60)


@register("""
WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'p' || l_partkey AS source, 's' || l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'sells' END AS type FROM lineitem)
SELECT ord, CASE WHEN source = 's1' THEN '->' ELSE '<-' END AS direction, CASE WHEN source = 's1' THEN target ELSE source END AS other, type FROM e WHERE (source = 's1' OR target = 's1') AND type = 'sells' ORDER BY ord LIMIT 50
""")
def neighbors_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.when(F.col("l_returnflag") == "R", "returns").otherwise("sells").alias("type"))
    return G.neighbours(e, "s1", "ord", "sells", 50)


@register(r"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/#?]+)', 1) AS host FROM pages),
i AS (SELECT array_to_string(list_reverse(string_split(host, '.')), '.') AS id FROM h),
j AS (SELECT id, string_split(id, '.') AS p, string_split(id, '.')[-1] AS last FROM i),
c AS (SELECT DISTINCT unnest([id, last, array_to_string(p[-2:], '.'), 'nope.' || last]) AS call FROM j),
k AS (SELECT call, string_split(call, '.')[-1] AS last, string_split(call, '.')[1] AS first FROM c),
n AS (SELECT last, count(*) AS n, min(id) AS one FROM j GROUP BY last)
SELECT call, CASE WHEN EXISTS (SELECT 1 FROM i WHERE id = call) THEN call WHEN n.n = 1 THEN one
  WHEN first IN (SELECT last FROM j) THEN (SELECT min(id) FROM j WHERE j.last = k.last AND ends_with(id, '.' || call)) END AS target
FROM k JOIN n USING (last) WHERE target IS NOT NULL
""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/#?]+)", 1)
    i = table(spark, sf_dir, "pages").select(host.alias("h")).distinct().select(F.array_join(F.reverse(F.split("h", r"\.")), ".").alias("id"))
    last, two = F.substring_index("id", ".", -1), F.substring_index("id", ".", -2)
    calls = i.select(F.explode(F.array("id", last, two, F.concat(F.lit("nope."), last))).alias("call")).distinct()
    return G.resolve_names(calls, i, [])


@register("""
WITH c AS (SELECT conv_id, turn FROM conversations), e AS (SELECT conv_id, turn AS source, turn + 1 AS target FROM c)
SELECT conv_id, source, target FROM e SEMI JOIN c ON e.conv_id = c.conv_id AND e.target = c.turn
""")
def known_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    edges = c.select("conv_id", F.col("turn").alias("source"), (F.col("turn") + 1).alias("target"))
    return R.known_ends(edges, c, ["conv_id"], "turn")


@register("""
WITH k AS (SELECT page_id AS k, 'pkg.m' || page_id || '.' AS m FROM pages)
SELECT 'all' AS repo, m || 'C' || k AS source, m || 'C' || k || '.run' AS target, 'contains' AS type, CAST(0 AS BIGINT) AS key FROM k
UNION ALL SELECT 'all', m || 'C' || k || x, m || 'helper' || k, 'calls', 0 FROM k CROSS JOIN (VALUES (''), ('.run')) v(x)
UNION ALL SELECT 'all', a.m || 'helper' || a.k, b.m || 'C' || b.k || x, 'calls', y FROM k a JOIN k b ON b.k = a.k + 1 CROSS JOIN (VALUES ('.run', 0), ('', 1)) v(x, y)
""")
def symbol_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph built from made-up modules, one per page: a class whose
    method calls a function, which calls the method of the next page's class.
    SQL can't parse sources, but it knows what these hold."""
    k = F.col("page_id").cast("string")
    src = F.concat(F.lit("class C"), k, F.lit(":\n    def run(self):\n        return helper"), k, F.lit("()\n\ndef helper"), k, F.lit("():\n    return C"), (F.col("page_id") + 1).cast("string"), F.lit(".run()\n"))
    files = table(spark, sf_dir, "pages").select(F.lit("all").alias("repo"), F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("path"), src.alias("content"))
    return G.graph_of(G.extract_symbols(files, ["repo"]), ["repo"])[1]
