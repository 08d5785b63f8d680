"""What the jobs share: sessions for the command line, configs, logs."""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import SparkSession


def config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """A JSON object read by Spark, so its path may be remote; what it leaves out
    is as in `defaults`, and a name that these don't have is an error."""
    if not path:
        return dict(defaults)
    row = spark.read.option("multiLine", True).json(path).first()
    given = {k: v for k, v in (row.asDict(recursive=True) if row else {}).items() if v is not None}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def session(name: str) -> SparkSession:
    """For the command line only: the cluster's settings come from spark-submit."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark
