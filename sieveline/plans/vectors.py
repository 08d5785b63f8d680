"""Queries over embeddings and character n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, embedding, neighbour_index, stats
from ..operators import vectors as V
from .registry import register, table

_NN = r"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM e),
p AS (SELECT a.vec_id AS id, a.label, b.vec_id AS neighbour, b.label AS other, round(list_inner_product(a.v, b.v) / (a.l * b.l + 1e-9), 6) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM p QUALIFY rank <= 8),
t AS (SELECT count(*) AS n FROM e), g AS (SELECT label, count(*) AS n FROM e GROUP BY label),
lift AS (SELECT label, any_value(g.n) AS n, avg(CAST(label = other AS INTEGER)) AS same_share, (any_value(g.n) - 1) / greatest(1, any_value(t.n) - 1) AS chance FROM k JOIN g USING (label) CROSS JOIN t GROUP BY label)
"""


def _nearest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e, V.nearest(e, "vec_id", "embedding", 8)


def _lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, near = _nearest(spark, sf_dir)
    return V.neighbour_lift(e, near, "vec_id", "label")


@register(_NN + "SELECT id, neighbour, similarity, CAST(rank AS INTEGER) AS rank FROM k")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)[1]


@register(_NN + "SELECT count(*) AS n, true AS is_reached FROM k WHERE id % 20 = 0")
def knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from lists of 50 rows, as many as the measured recall asks to be
    probed, for the ids divisible by 20 against all rows: whether they hold 0.9
    of the exact ones."""
    e = table(spark, sf_dir, "embeddings")
    ask = e.where("vec_id % 20 = 0")
    some = neighbour_index.entries(e, "vec_id", "embedding", 8)
    exact = neighbour_index.nearest_by_lists(e, "vec_id", "embedding", 8, 1, 1, ask, some=some)
    lists = max(1, e.count() // 50)
    found = neighbour_index.nearest_by_lists(e, "vec_id", "embedding", 8, lists=lists, ask=ask, some=some)
    return neighbour_index.recall(exact, found).select("n", (F.col("recall") >= 0.9).alias("is_reached"))


@register(_NN + "SELECT label, n, round(same_share, 6) AS same_share, round(chance, 6) AS chance, round(same_share / (chance + 1e-9), 6) AS lift FROM lift")
def knn_label_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lift(spark, sf_dir).select("label", "n", *[F.round(c, 6).alias(c) for c in ("same_share", "chance", "lift")])


@register(_NN + ", x AS (SELECT same_share / (chance + 1e-9) AS lift FROM lift) SELECT round(quantile_cont(lift, 0.1), 6) AS p10, round(quantile_cont(lift, 0.5), 6) AS p50, round(quantile_cont(lift, 0.9), 6) AS p90, round(avg(lift), 6) AS mean, round(avg(CAST(lift > 1 AS INTEGER)), 6) AS share_over_1 FROM x")
def lift_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.linear_percentiles(_lift(spark, sf_dir), [], "lift", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register(_NN + "SELECT b.vec_id, round(list_inner_product(a.v, b.v) / (a.l * b.l + 1e-9), 6) AS similarity FROM n a JOIN n b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY similarity DESC, b.vec_id LIMIT 10")
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0, 10)


@register("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE len(embedding) <> 64")
def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.wrong_dimensions(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)


@register(r"""
WITH w AS (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM benchmark),
s AS (SELECT item_id, w, unnest([3, 4, 5]) AS n FROM w),
g AS (SELECT item_id, substr(w, i, n) AS term FROM (SELECT item_id, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i FROM s WHERE length(w) >= n OR n = 3)),
tf AS (SELECT item_id, term, count(*) AS c FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT item_id, term, c * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term)),
l AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM x GROUP BY item_id),
r AS (SELECT item_id, term, round(w / l, 6) AS weight FROM x JOIN l USING (item_id))
SELECT item_id, term, weight FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, term) <= 20
""")
def char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import ranked

    b = table(spark, sf_dir, "benchmark")
    w = V.tfidf(b, "item_id", V.char_grams(F.col("text"))).withColumn("weight", F.round("weight", 6))
    return ranked(w, ["item_id"], "weight", ["term"], k=20).drop("rank")


@register()
def svd_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations are free, so there is no SQL; tests compare the products."""
    b = table(spark, sf_dir, "benchmark")
    return embedding.svd_embed(V.tfidf(b, "item_id", V.char_grams(F.col("text"))), "item_id")


@register()
def svd_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items dealt to four instances, each with terms, weights and directions of
    its own; no SQL, as above."""
    b = table(spark, sf_dir, "benchmark").withColumn("repo", F.concat(F.lit("r"), (F.col("item_id") % 4).cast("string")))
    return embedding.svd_embed(V.tfidf(b, "item_id", V.char_grams(F.col("text")), 2000, ["repo"]), "item_id", by=["repo"])
