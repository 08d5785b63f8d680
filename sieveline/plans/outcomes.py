"""Queries over outcome statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome
from ..operators import audit, stats
from .registry import register, table


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type AS key, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY event_type
""")
def tool_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of event counts per user, summed key by key."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("hist"))
    return stats.map_sum(maps, "hist")


@register("""
SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type
""")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_common(table(spark, sf_dir, "events"), "event_type", "event_id")


_UNITS = """
WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'error') AS err, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'signup') AS signup, count(*) AS n FROM events GROUP BY ALL)
"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit per user and day, with a map of counts by type."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return e.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("hist"), F.sum("n").alias("n"))


def _saw(kind: str):
    return F.coalesce(F.element_at("hist", kind), F.lit(0)) > 0


@register(_UNITS + """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN purchase > 0 THEN 'resolved' WHEN err = 1 THEN 'harness_error' WHEN err >= 2 THEN 'llm_timeout' WHEN v = 0 AND signup > 0 AND click = 0 THEN 'empty_submit_no_edit'
  WHEN v = 0 AND click > 0 THEN 'edits_failed_to_apply' WHEN v = 0 THEN 'no_edit_attempted' ELSE 'patch_failed_tests' END AS label FROM u) GROUP BY label
""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"error": "<llm_err>", "signup": "submit_patch", "click": "edit_file"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    hist = F.transform_keys("hist", lambda k, v: F.coalesce(F.element_at(m, k), k))
    failed = F.when(F.element_at("hist", "error") == 1, "one error")
    label = outcome.taxonomy(_saw("purchase"), failed, hist, _saw("view"))
    return _units(spark, sf_dir).select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@register(_UNITS + """, a AS (SELECT 'click' AS arm, click > 0 AS patch, purchase > 0 AS pass, n FROM u UNION ALL SELECT 'purchase', purchase > 0, err > 0, n FROM u)
SELECT arm, count(*) AS n, count(*) FILTER (patch) AS n_patch, count(*) FILTER (pass) AS n_pass, round(avg(n), 6) AS mean_steps FROM a GROUP BY arm""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    a = u.select(F.lit("click").alias("arm"), _saw("click").alias("patch"), _saw("purchase").alias("pass"), F.col("n").alias("steps")).union(u.select(F.lit("purchase"), _saw("purchase"), _saw("error"), "n"))
    return _rounded(stats.arm_summary(a, "arm", F.col("patch"), F.col("pass"), F.col("steps")), "mean_steps")


@register(_UNITS + """, d AS (SELECT user_id % 3 AS g, count(*) AS n, count(*) FILTER (click > 0 AND purchase = 0) AS only_a, count(*) FILTER (click = 0 AND purchase > 0) AS only_b FROM u GROUP BY ALL),
t AS (SELECT g, exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)) AS t FROM d, LATERAL (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS i)),
s AS (SELECT g, least(1.0, 2 * sum(t)) AS p FROM t GROUP BY g)
SELECT g, n, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE p END, 8) AS p FROM d JOIN s USING (g)""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir).withColumn("g", F.col("user_id") % 3)
    return _rounded(stats.mcnemar(u, _saw("click"), _saw("purchase"), ["g"]), "p", digits=8)


@register(_UNITS + """, a AS (SELECT user_id, day, click > 0 AS x FROM u WHERE user_id % 4 <> 0), b AS (SELECT user_id, day, purchase > 0 AS x FROM u WHERE user_id % 4 <> 1), c AS (SELECT user_id, day FROM u WHERE user_id % 4 <> 2)
SELECT count(*) AS n, count(*) FILTER (a.x AND NOT b.x) AS only_a, count(*) FILTER (NOT a.x AND b.x) AS only_b FROM a JOIN b USING (user_id, day) SEMI JOIN c USING (user_id, day)""")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two arms over the keys that three arms share."""
    u, key = _units(spark, sf_dir), ["user_id", "day"]
    a, b, c = u.where("user_id % 4 <> 0").select(*key, _saw("click").alias("x")), u.where("user_id % 4 <> 1").select(*key, _saw("purchase").alias("x")), u.where("user_id % 4 <> 2")
    both = stats.paired(a, b, key, ["x"]).join(stats.common_keys([a, b, c], key), key, "left_semi")
    return stats.mcnemar(both, F.col("a_x"), F.col("b_x")).drop("p")


_RATE = "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS ok FROM documents JOIN labels USING (doc_id) GROUP BY source"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@register(f"SELECT *, round(ok / n, 6) AS rate FROM ({_RATE})")
def rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.rate_by(_labelled(spark, sf_dir), ["source"], F.col("quality") == 1), "rate")


@register(f"""WITH r AS (SELECT *, ok / n AS p, 1.959963984540054 * 1.959963984540054 AS z2 FROM ({_RATE}))
SELECT source, n, ok, round((p + z2 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS low,
  round((p + z2 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS high FROM r""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.rate_by(_labelled(spark, sf_dir), ["source"], F.col("quality") == 1)
    low, high = stats.wilson(F.col("ok"), F.col("n"))
    return r.select("source", "n", "ok", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("""SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars <= 3000 THEN 'mid' ELSE 'big' END AS bucket, count(*) AS n, count(*) FILTER (quality = 1) AS ok, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate
FROM documents JOIN labels USING (doc_id) GROUP BY bucket""")
def bucketed_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).withColumn("bucket", outcome.size_bucket(F.col("n_chars"), 500, 3000))
    return _rounded(stats.rate_by(d, ["bucket"], F.col("quality") == 1), "rate")


@register("SELECT event_type, count(*) AS n, round(avg(CASE WHEN event_id % 7 > 0 THEN value ELSE 0 END), 6) AS mean, round(max(CASE WHEN event_id % 7 > 0 THEN value ELSE 0 END), 6) AS max FROM events GROUP BY event_type")
def step_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 > 0, F.col("value")))
    return _rounded(stats.optional_stats(e, ["event_type"], "v"), "mean", "max")


@register("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def strict_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.strict_mean(table(spark, sf_dir, "events"), ["event_type"], "value"), "mean")


@register("""
WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS a, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, n, a[1 + least(n - 1, CAST(floor(n * 0.1) AS BIGINT))] AS p10, a[1 + least(n - 1, CAST(floor(n * 0.5) AS BIGINT))] AS p50, a[1 + least(n - 1, CAST(floor(n * 0.9) AS BIGINT))] AS p90, a[n] AS max FROM s
""")
def audit_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.order_percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@register("SELECT source, array_to_string(list_sort(list(doc_id)), ' ') AS ids FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source")
def conditional_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir)
    ids = stats.ids_where(d, ["source"], "doc_id", F.col("toxic") == 1)
    return ids.select("source", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@register("""
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS f, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS p FROM events)
SELECT coalesce(f, FALSE) AND coalesce(p, FALSE) AS verified, count(*) AS n FROM r GROUP BY 1
""")
def verified_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = lambda k: F.when(F.col("event_id") % k == 1, True).when(F.col("event_id") % k > 1, False)
    return table(spark, sf_dir, "events").groupBy(outcome.verified(tri(5), tri(4)).alias("verified")).agg(F.count("*").alias("n"))


@register("""
SELECT CASE WHEN event_id % 11 = 0 THEN 'no-diff' WHEN event_id % 7 = 0 THEN 'apply-fail' WHEN event_id % 5 = 0 THEN 'install-fail' WHEN event_id % 3 = 0 THEN '' ELSE 'tests rc=' || event_id % 3 END AS why, count(*) AS n FROM events GROUP BY 1
""")
def patch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    why = outcome.patch_check(F.when(i % 11 == 0, " \n").otherwise("x"), (i % 7 == 0).cast("int"), (i % 5 == 0).cast("int"), i % 3)
    return table(spark, sf_dir, "events").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


@register("SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM orders GROUP BY o_orderpriority")
def era_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.range_by(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate")


@register("""
WITH c AS (SELECT text, count(*) AS c FROM documents GROUP BY text)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, count(*) FILTER (c > 1) AS n_duplicated FROM c
""")
def audit_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.uniqueness(table(spark, sf_dir, "documents"), ["text"])


@register("SELECT doc_id, source, count(*) AS n FROM (SELECT doc_id % 300 AS doc_id, source FROM documents) GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("doc_id"), "source")
    return audit.duplicates(d, ["doc_id", "source"])


_FLAGS = """WITH f AS (SELECT doc_id, l.doc_id IS NOT NULL AS has_labels, t.doc_id IS NOT NULL AS has_toxic, c.conv_id IS NOT NULL AS has_chat FROM documents d
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t USING (doc_id) LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id)"""


@register(_FLAGS + " SELECT count(*) AS n, count(*) FILTER (has_labels) AS n_labels, count(*) FILTER (has_toxic) AS n_toxic, count(*) FILTER (has_chat) AS n_chat, count(*) FILTER (has_labels AND has_toxic AND has_chat) AS n_complete FROM f")
def asset_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    chat = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    flags = audit.completeness(table(spark, sf_dir, "documents"), {"labels": lab, "toxic": lab.where("toxic = 1"), "chat": chat}, ["doc_id"])
    return audit.completeness_counts(flags, ["labels", "toxic", "chat"])


@register("""
SELECT 'error' AS severity, 'required' AS "check", count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 0 THEN 'toxic' END], lambda x: x IS NOT NULL)) FROM labels)
UNION ALL SELECT 'warning', 'ids', count(*) FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
UNION ALL SELECT 'warning', 'duplicate', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parts = [
        ("error", "required", audit.missing_fields(lab, "doc_id", ["quality", "toxic"])),
        ("warning", "ids", audit.id_mismatch(d, lab, ["doc_id"]).select(F.col("doc_id").alias("id"))),
        ("warning", "duplicate", audit.duplicates(d, ["text"]).select(F.md5("text").alias("id"))),
    ]
    return audit.totals(audit.findings(parts))
