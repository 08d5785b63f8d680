"""Job: outcomes of episodes, kept up to date from a stream of event files.

    python -m jobs.episode_outcomes EVENTS OUT CHECKPOINT [CONFIG]

EVENTS is a folder of Parquet files (event_id, ts, user_id, event_type), or a
pattern of such, that grows. An episode is a user's day. Each run takes the files that are new since
the last one, as a file stream with a checkpoint, and stops. The stream's state
has a row per episode: an episode that failed may be tried again, a success
replaces an error, and later errors don't replace a success.

OUT/episodes has what each batch changed, by batch and month; the newest row of
an episode counts. OUT/report, partitioned by month, has per day and label of
the failure taxonomy: episodes (n), their events (n_events), those that
succeeded after an error (n_recovered), and as_of, the last batch that touched
the month. Only months of which OUT/episodes has a later batch than OUT/report
are written anew, by dynamic partition overwrite, so a run that broke off
between the two is made good by the next, and a run without new files changes
nothing. Events without a time belong to no day and are left out.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import outcome
from sieveline.sources.readers import parquet_or_none
from sieveline.streaming import incremental

from . import common

DEFAULTS = {"passed": "purchase", "failed": "error", "edited": "click", "patched": "view", "submitted": "signup", "files_per_batch": 4}
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
KINDS = ("passed", "failed", "edited", "patched", "submitted")
EPISODES = "user_id long, day date, event_id long, event_type string, n long, n_failed long, is_settled boolean, " + ", ".join(f"{k} long" for k in KINDS) + ", recovered boolean, batch int, month string"
REPORT = "day date, label string, n long, n_events long, n_recovered long, as_of int, month string"
KEY = ["user_id", "day"]
log = common.log("episode_outcomes")


def episodes(events: DataFrame, c: dict) -> DataFrame:
    """A row per user and day; of a stream or of a table."""
    e = events.where("ts is not null").withColumn("day", F.to_date("ts"))
    # attempts either fail or pass; the other events are steps in between
    counts = [F.count_if(F.col("event_type") == c[k]).alias(k) for k in KINDS]
    per = incremental.settled(e, KEY, "event_id", F.col("event_type") == c["failed"], ["event_id", "event_type"], counts)
    return per.withColumns({"recovered": (F.col("passed") > 0) & (F.col("failed") > 0), "month": F.date_format("day", "yyyy-MM")})


def labelled(per: DataFrame) -> DataFrame:
    hist = F.create_map(F.lit(outcome.EDITS[0]), "edited", F.lit("submit_patch"), "submitted", F.lit("<llm_err>"), "failed")
    return per.withColumn("label", outcome.taxonomy(F.col("passed") > 0, F.when(F.col("failed") == 1, "one error"), hist, F.col("patched") > 0))


def run(spark: SparkSession, events: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """One run; returns OUT/report read back."""
    c = DEFAULTS | (settings or {})
    ran = incremental.run_updates(spark, events, EVENTS, lambda df: episodes(df, c), f"{out}/episodes", checkpoint, ["month"], files_per_batch=c["files_per_batch"])
    log.info("read new files of %s in %d batches (%s)", events, len(ran), ", ".join(map(str, ran)) or "none")
    changed = parquet_or_none(spark, f"{out}/episodes", EPISODES)
    report = parquet_or_none(spark, f"{out}/report", REPORT)
    have = report.groupBy("month").agg(F.max("as_of").alias("as_of"))
    stale = changed.groupBy("month").agg(F.max("batch").alias("batch")).join(have, "month", "left").where("as_of is null or batch > as_of").select("month", F.col("batch").alias("as_of"))
    months = {r.month: r.as_of for r in stale.collect()}  # a calendar's months
    if months:
        per = labelled(incremental.current(changed.where(F.col("month").isin(list(months))), KEY))
        rows = per.groupBy("month", "day", "label").agg(F.count("*").alias("n"), F.sum("n").alias("n_events"), F.count_if("recovered").alias("n_recovered"))
        as_of = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
        rows = rows.withColumn("as_of", F.element_at(as_of, F.col("month"))).select(*[f.split()[0] for f in REPORT.split(", ")])
        rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{out}/report")
    back = parquet_or_none(spark, f"{out}/report", REPORT)
    log.info("wrote the months %s of %s/report, which has %d rows", ", ".join(sorted(months)) or "(none)", out, back.count())
    return back


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "out", "checkpoint"):
        p.add_argument(name)
    p.add_argument("config", nargs="?", help="a JSON file; jobs/episode_outcomes.json has the defaults")
    a = p.parse_args(argv)
    spark = common.session("episode_outcomes")
    try:
        run(spark, a.events, a.out, a.checkpoint, common.config(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
