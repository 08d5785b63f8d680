"""The jobs as registered queries: each runs twice into one new folder and gives
what stands there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.plans.retrieval import RANKED_SQL
from sieveline.streaming.incremental import scratch

from . import episode_outcomes, localization_report


def job1_localization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job1")
    for _ in range(2):
        rows = localization_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return rows


def job2_episode_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without as_of, the number of a stream's batch, which depends on how the
    table is cut into files. A stream's source is a folder or a pattern; the
    table may be one file."""
    out = scratch(spark, "job2")
    for _ in range(2):
        rows = episode_outcomes.run(spark, f"{sf_dir}/events.parque[t]", f"{out}/tables", f"{out}/checkpoint")
    return rows.drop("as_of")


JOB1_SQL = RANKED_SQL + r"""
, top AS (SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10),
target AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
first AS (SELECT item_id, count(*) AS n_targets, coalesce(min(rank), 0) AS first_rank FROM target LEFT JOIN top USING (item_id, doc_id) GROUP BY item_id)
SELECT item_id, doc_id, score, rank, target.doc_id IS NOT NULL AS is_target, coalesce(n_targets, 0) AS n_targets, coalesce(first_rank, 0) AS first_rank, lang
FROM top LEFT JOIN target USING (item_id, doc_id) LEFT JOIN first USING (item_id) JOIN documents USING (doc_id)
"""

JOB2_SQL = r"""
WITH u AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type = 'error') AS failed,
    count(*) FILTER (event_type = 'click') AS edited, count(*) FILTER (event_type = 'view') AS patched, count(*) FILTER (event_type = 'signup') AS submitted
  FROM events WHERE ts IS NOT NULL GROUP BY ALL
),
l AS (SELECT *, CASE WHEN passed > 0 THEN 'resolved' WHEN failed = 1 THEN 'harness_error' WHEN failed >= 2 THEN 'llm_timeout' WHEN patched = 0 AND submitted > 0 AND edited = 0 THEN 'empty_submit_no_edit'
  WHEN patched = 0 AND edited > 0 THEN 'edits_failed_to_apply' WHEN patched = 0 THEN 'no_edit_attempted' ELSE 'patch_failed_tests' END AS label FROM u)
SELECT strftime(day, '%Y-%m') AS month, day, label, count(*) AS n, CAST(sum(n_events) AS BIGINT) AS n_events, count(*) FILTER (passed > 0 AND failed > 0) AS n_recovered FROM l GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_localization_report, job2_episode_outcomes)}


def oracle_sql() -> dict[str, str]:
    return {"job1_localization_report": JOB1_SQL, "job2_episode_outcomes": JOB2_SQL}
