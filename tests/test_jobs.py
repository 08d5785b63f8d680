"""The jobs over growing copies of the tables, against their SQL; what they leave after failures."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle import TABLES, assert_same, connect
from pyspark.sql import functions as F

from jobs import common, episode_outcomes, localization_report, queries
from sieveline import session
from sieveline.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_matches_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connect(sf))


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(f"file://{folder}")


def connected(path, **folders):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders[t] + '/*.parquet' if t in folders else f'{path}/{t}.parquet'}'")
    return c


def test_outcomes_of_growing_events(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src, out, ck = tmp_path / "events", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    # the later events first, so that keys grow in both directions; some rows twice and some without a time
    steps = [events.where("event_id >= 500"), events.where("event_id < 200"), events.where("event_id between 200 and 499").unionByName(events.where("event_id < 20")).withColumn("ts", F.when(F.col("event_id") % 50 == 7, None).otherwise(F.col("ts")))]
    for step in steps:
        add(step, src)
        back = episode_outcomes.run(spark, f"file://{src}", out, ck)
        assert_same(back.drop("as_of"), queries.JOB2_SQL, connected(sf, events=str(src)))
    before = sorted(back.collect())
    assert sorted(episode_outcomes.run(spark, f"file://{src}", out, ck).collect()) == before
    # a run that ended before the report: the next one writes the months that are behind
    months = [d for d in os.listdir(tmp_path / "out/report") if d.startswith("month=")]
    shutil.rmtree(tmp_path / "out/report" / months[0])
    assert sorted(episode_outcomes.run(spark, f"file://{src}", out, ck).collect()) == before
    # a new event touches its month only
    kept = {f for m in months for f in os.listdir(tmp_path / "out/report" / m)}
    add(events.limit(1).withColumns({"event_id": F.lit(10**6).cast("long"), "ts": F.lit("2031-05-01 01:00:00").cast("timestamp_ntz")}), src)
    episode_outcomes.run(spark, f"file://{src}", out, ck)
    assert kept <= {f for m in os.listdir(tmp_path / "out/report") if m.startswith("month=") for f in os.listdir(tmp_path / "out/report" / m)}
    assert os.path.isdir(tmp_path / "out/report/month=2031-05")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_report_of_growing_documents(spark, sf, tmp_path):
    docs, src, out = spark.read.parquet(f"{sf}/documents.parquet"), tmp_path / "documents", f"file://{tmp_path}/out"
    asked = f"file://{sf}/benchmark.parquet"
    for step in (docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))):
        add(step, src)
        back = localization_report.run(spark, f"file://{src}", asked, out)
        assert_same(back, queries.JOB1_SQL, connected(sf, documents=str(src)))
    before, files = sorted(back.collect(), key=repr), sorted(os.listdir(tmp_path / "out/index/docs"))
    assert sorted(localization_report.run(spark, f"file://{src}", asked, out).collect(), key=repr) == before
    assert sorted(os.listdir(tmp_path / "out/index/docs")) == files and len([f for f in files if f.startswith("batch=")]) == 2


def test_report_keeps_ranks_and_targets_that_it_reads_often(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(localization_report, "stored", lambda df, tag: kept.append(tag) or session.stored(df, tag), raising=False)
    spark.createDataFrame([(k, f"some words of text w{chr(97 + k)} here", "en") for k in range(20)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(7, "words of text wh here")], "item_id long, text string").write.parquet(f"{tmp_path}/q")
    back = localization_report.run(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/q", f"file://{tmp_path}/out", {"k": 2})
    assert kept == ["ranks", "targets"]
    assert sorted((r.doc_id, r["rank"], r.is_target, r.n_targets, r.first_rank, r.lang) for r in back.collect()) == [(0, 2, False, 1, 1, "en"), (7, 1, True, 1, 1, "en")]


EVENT = "k long, no long, what string"


def test_settled_keys_equal_the_batch_result(spark, tmp_path):
    """Three runs with failures, one of which breaks off while it writes."""
    rows = [[(1, 1, "error"), (2, 2, "ok"), (3, 3, "error"), (None, 4, "ok")], [(1, 5, "error"), (2, 6, "error"), (3, 7, "ok"), (4, 8, None)], [(3, 9, "ok"), (1, 10, "error"), (4, 11, "error"), (5, None, "error")]]
    src, ck = f"{tmp_path}/src", f"file://{tmp_path}/ck"
    step = lambda df: incremental.settled(df, ["k"], "no", F.col("what") == "error", ["no", "what"]).withColumn("part", F.lit("x"))
    for k, some in enumerate(rows):
        spark.createDataFrame(some, EVENT).coalesce(1).write.mode("append").parquet(src)
        if k == 1:
            with pytest.raises(Exception, match="(?i)proc|mkdirs|directory"):
                incremental.run_updates(spark, src, EVENT, step, "file:///proc/no-place", ck, ["part"])
        assert len(incremental.run_updates(spark, src, EVENT, step, f"file://{tmp_path}/out", ck, ["part"])) == 1
        assert incremental.run_updates(spark, src, EVENT, step, f"file://{tmp_path}/out", ck, ["part"]) == []
        now = incremental.current(spark.read.parquet(f"{tmp_path}/out"), ["k"]).drop("part")
        batch = step(spark.createDataFrame([r for x in rows[: k + 1] for r in x], EVENT)).drop("part")
        assert sorted(map(repr, now.select(*batch.columns).collect())) == sorted(map(repr, batch.collect()))
    last = {r.k: (r.no, r.what, r.n, r.n_failed, r.is_settled) for r in batch.collect()}
    assert last == {1: (10, "error", 3, 3, False), 2: (2, "ok", 2, 1, True), 3: (7, "ok", 3, 1, True), 4: (8, None, 2, 1, True), 5: (None, None, 1, 1, False), None: (4, "ok", 1, 0, True)}


def test_configs(spark, tmp_path):
    for job in (localization_report, episode_outcomes):
        path = f"file://{ROOT}/jobs/{job.__name__.split('.')[1]}.json"
        assert common.config(spark, path, job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "c.json").write_text('{"k": 3,\n "at": [2]}')
    assert common.config(spark, f"file://{tmp_path}/c.json", localization_report.DEFAULTS) | {} == localization_report.DEFAULTS | {"k": 3, "at": [2]}
    (tmp_path / "c.json").write_text('{"kk": 3}')
    with pytest.raises(ValueError, match="kk"):
        common.config(spark, f"file://{tmp_path}/c.json", localization_report.DEFAULTS)


def test_command_line(sf, tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    run = subprocess.run([sys.executable, "-m", "jobs.episode_outcomes", f"{sf}/events.parque[t]", f"{tmp_path}/out", f"{tmp_path}/ck", f"{ROOT}/jobs/episode_outcomes.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "in 1 batches" in run.stderr and "wrote the months 2024-" in run.stderr
    assert any(f.startswith("month=2024") for f in os.listdir(tmp_path / "out/report"))
