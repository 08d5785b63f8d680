"""Queries over text, path and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome
from ..functions import text as T
from ..operators import curate, training
from .registry import register, table


@register(r"""
WITH l AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS l, n_chars FROM (SELECT doc_id, n_chars, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM documents)),
n AS (SELECT doc_id, CAST(len(list_filter(l, lambda x: (starts_with(x, 'T') OR starts_with(x, 'A')) AND NOT starts_with(x, 'The') AND NOT starts_with(x, 'And'))) AS BIGINT) AS n_lines, CAST(len(l) AS BIGINT) AS n_all FROM l)
SELECT * FROM n WHERE n_lines <= 2 AND n_all <= 6
""")
def line_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their beginnings, and a cap; beginnings stand in for diff marks."""
    parts = T.lines(F.col("text"))
    hit = lambda x: (x.startswith("T") | x.startswith("A")) & ~x.startswith("The") & ~x.startswith("And")
    df = table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(parts, hit)).cast("long").alias("n_lines"), F.size(parts).cast("long").alias("n_all"))
    return curate.capped(df, F.col("n_lines"), F.col("n_all"), 2, 6)


@register(r"""
WITH x AS (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island, length(text) AS n FROM conversations)
SELECT conv_id, island, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_chars, string_agg(role, ',' ORDER BY turn) AS roles FROM x GROUP BY conv_id, island
""")
def hunk_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of turns, each begun by a user turn."""
    c = curate.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), ",")
    return c.groupBy("conv_id", "island").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), roles.alias("roles"))


_TEST = T.TEST_PATH.removeprefix("(?i)")


@register(rf"""
WITH f AS (SELECT page_id, [regexp_replace(url, '^[a-z]+://[^/]+/|[#?].*$', '', 'g') || x for x in ['.py', '/test_a.py', '/tests/b.txt', '_test.py']] AS files FROM pages),
s AS (SELECT page_id, list_filter(files, lambda p: regexp_matches(p, '\.py$', 'i') AND NOT regexp_matches(p, '{_TEST}', 'i')) AS src, list_filter(files, lambda p: regexp_matches(p, '\.py$', 'i') AND regexp_matches(p, '{_TEST}', 'i')) AS tst FROM f)
SELECT page_id, array_to_string(src, ' ') AS src_files, array_to_string(tst, ' ') AS test_files, len(src) > 0 AND len(tst) > 0 AS is_candidate FROM s
""")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+/|[#?].*$", "")
    files = F.array(*[F.concat(path, F.lit(x)) for x in (".py", "/test_a.py", "/tests/b.txt", "_test.py")])
    src, tst = T.split_files(F.col("files"))
    p = table(spark, sf_dir, "pages").select("page_id", files.alias("files")).select("page_id", src.alias("s"), tst.alias("t"))
    return p.select("page_id", F.array_join("s", " ").alias("src_files"), F.array_join("t", " ").alias("test_files"), (T.has_items(F.col("s")) & T.has_items(F.col("t"))).alias("is_candidate"))


@register(r"""
WITH d AS (SELECT doc_id, '--- a/src/f' || doc_id % 7 || '.py' || chr(10) || '+++ b/src/f' || doc_id % 7 || '.py' || chr(10) || '--- a/t.py' || chr(10) || text AS patch, CASE doc_id % 3 WHEN 0 THEN 'Fixes  #' || doc_id || ' closes #1' WHEN 1 THEN '' END AS body, 'resolve #' || doc_id % 10 AS subject FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(patch, '--- a/(\S+)', 1))), ' ') AS files, array_to_string(regexp_extract_all(patch, '\+\+\+ b/(\S+\.py)', 1), ' ') AS targets,
  CAST(coalesce(nullif(regexp_extract(coalesce(body, ''), '(?i)(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)', 1), ''), nullif(regexp_extract(subject, '(?i)(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)', 1), '')) AS BIGINT) AS issue FROM d
""")
def patch_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, test targets and issue references of made-up patches."""
    n = F.concat(F.lit("src/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".py"))
    patch = F.concat(F.lit("--- a/"), n, F.lit("\n+++ b/"), n, F.lit("\n--- a/t.py\n"), F.col("text"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Fixes  #"), F.col("doc_id").cast("string"), F.lit(" closes #1"))).when(F.col("doc_id") % 3 == 1, "")
    d = table(spark, sf_dir, "documents").select("doc_id", patch.alias("patch"), body.alias("body"), F.concat(F.lit("resolve #"), (F.col("doc_id") % 10).cast("string")).alias("subject"))
    return d.select("doc_id", F.array_join(F.array_sort(T.patched_files(F.col("patch"))), " ").alias("files"), F.array_join(T.test_targets(F.col("patch")), " ").alias("targets"), T.issue_reference(F.col("body"), F.col("subject")).alias("issue"))


@register(r"""SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, array_to_string(list_sort(list_distinct(l)), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def regex_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("links"))


@register(r"""
WITH s AS (SELECT p_partkey, lower(p_brand) || CASE p_partkey % 4 WHEN 0 THEN '>=1.2' WHEN 1 THEN '[extra]; x' WHEN 2 THEN ' ~= 2' ELSE '' END AS spec FROM part),
n AS (SELECT p_partkey, trim(regexp_extract(replace(spec, '#', '-'), '^([^<>=!~\[ ;]*)', 1)) AS name FROM s)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^[A-Za-z0-9_.-]+$') THEN replace(lower(name), '-', '_') END AS name FROM n
""")
def spec_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    spec = F.concat(F.lower("p_brand"), F.when(k == 0, ">=1.2").when(k == 1, "[extra]; x").when(k == 2, " ~= 2").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.requirement_name(F.translate(spec, "#", "-")).alias("name"))


@register(r"""
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events
""")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action inside prose: every fifth reply has no JSON object."""
    e = table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("I call "), F.regexp_replace("props", r"\}$", ', "tool": "t"}'), F.lit(" now"))).otherwise("nothing {")
    return e.select("event_id", F.get_json_object(T.action_json(reply), "$.k").cast("long").alias("k"))


@register(r"SELECT o_orderkey, CASE WHEN year(o_orderdate) + 24 >= 2025 THEN '3.13' WHEN year(o_orderdate) + 24 >= 2024 THEN '3.12' WHEN year(o_orderdate) + 24 >= 2022 THEN '3.11' ELSE '3.10' END AS version FROM orders")
def version_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("o_orderdate") + F.make_ym_interval(F.lit(24))
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.interpreter_version(later).alias("version"))


@register(r"""
WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS s, arg_min(text, turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, substr(CASE WHEN coalesce(s, '') <> '' THEN 'system' || chr(10) || chr(10) || s WHEN coalesce(u, '') <> '' THEN 'user' || chr(10) || chr(10) || u ELSE 'none' END, 1, 12000) AS statement, right(coalesce(u, ''), 50) AS ending FROM f
""")
def fallback_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda r: F.min_by("text", "turn") if r is None else F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    f = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("system").alias("s"), first("user").alias("u"))
    return f.select("conv_id", outcome.statement(F.lit("system"), F.col("s"), F.lit("user"), F.col("u"), F.lit("none")).alias("statement"), T.tail(F.coalesce("u", F.lit("")), 50).alias("ending"))


@register(r"SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.render_turns(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "text")


@register(r"""
WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{2,}'), lambda x: length(x)) AS ids, conv_id % 9 AS b FROM conversations),
c AS (SELECT *, ids[1:2048] AS cut, least(turn + 3, 2048) AS pl FROM t),
l AS (SELECT *, list_concat(list_transform(range(pl), lambda x: CAST(-100 AS BIGINT)), cut[pl + 1:]) AS labels, max(len(cut)) OVER (PARTITION BY b) AS m FROM c)
SELECT conv_id, turn, array_to_string(list_concat(cut, list_transform(range(m - len(cut)), lambda x: CAST(0 AS BIGINT))), ' ') AS ids,
  array_to_string(list_concat(labels, list_transform(range(m - len(cut)), lambda x: CAST(-100 AS BIGINT))), ' ') AS labels,
  CAST(len(cut) AS BIGINT) AS n_attended FROM l
""")
def mask_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lengths stand in for ids; batches are conv_id % 9."""
    c = table(spark, sf_dir, "conversations")
    ids = F.transform(T.tokens(F.col("text")), lambda x: F.length(x))
    d = c.select("conv_id", "turn", (F.col("conv_id") % 9).alias("b"), ids.alias("all_ids"), (F.col("turn") + 3).alias("pl"))
    d = d.withColumns({"ids": F.slice("all_ids", 1, training.MOST), "labels": training.masked_labels(F.col("all_ids"), F.col("pl"))})
    p = training.padded(d, ["b"], "ids", "labels", 0)
    join = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), " ").alias(n)
    return p.select("conv_id", "turn", join("ids"), join("labels"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attended"))


@register("""
SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '--- a/f' || doc_id || '.py' || chr(10) || '+++ b/f' || doc_id || '.py' || chr(10) || '@@ -1,2 +1,3 @@ def f' || chr(10) || ' ctx' || chr(10) || '-' || md5(coalesce(text, '')) || chr(10) || '+x' || chr(10) || '+y' || chr(10) END AS diff FROM documents
""")
def extract_diff_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs in made-up replies, hunk headers recounted."""
    k = F.col("doc_id").cast("string")
    reply = F.concat(F.lit("Here:\n```diff\n--- a/f"), k, F.lit(".py\n+++ b/f"), k, F.lit(".py\n@@ -1,9 +1,9 @@ def f\n ctx\n-"), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\n+x\nno line of a diff\n+y\n```\nDone"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "no diff").otherwise(reply).alias("reply"))
    return training.extract_diffs(d, "reply").select("doc_id", "diff")


@register(r"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events")
def to_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three formats, read back."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "E MMM d HH:mm:ss yyyy"), F.lit(" +0000"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")))
    iso = T.to_iso(F.col("t"))
    return e.select("event_id", text.alias("t")).select("event_id", iso.alias("iso"), F.substring(iso, 1, 10).alias("day"))
