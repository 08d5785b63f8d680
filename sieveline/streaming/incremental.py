"""Incremental runs: what a stage has not processed yet, as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.curate import last_per
from ..session import shared_dir


def run_available(spark: SparkSession, source: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet", key: list[str] | None = None, files_per_batch: int | None = None) -> None:
    """Process all files that arrived since the last run, then stop.

    Each batch is written under its own number, so a batch that runs again after
    a failure replaces its own output. With `key`, rows whose key an earlier row
    had are left out; the keys are the stream's state, kept in the checkpoint, so
    that no batch reads what earlier ones wrote. `step` must be one that streams
    allow then.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(source)
    if key:
        rows = step(rows).dropDuplicates(key)

    def write(batch: DataFrame, no: int) -> None:
        (batch if key else step(batch)).write.mode("overwrite").parquet(f"{out}/batch={no}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settled(df: DataFrame, key: list[str], order: str, failed: Column, value: list[str], more: list[Column] | None = None) -> DataFrame:
    """What came of each key whose failed rows are tried again: the first row by
    `order` that did not fail, else the last one; n rows and n_failed of them,
    whatever aggregates `more` has, and is_settled. A null `failed` counts as not
    failed; a null `order` never is first or last.

    Every part is a sum, a minimum or a maximum, so the rows' order of arrival
    and repeated arrival of a key in later batches change nothing: the same
    function gives a batch's result and, over a stream, the state of its keys.
    A later success replaces an error, and nothing replaces a success but an
    earlier one. Over a stream use the update mode; the state is a row per key.
    """
    bad = F.coalesce(failed, F.lit(False))
    row = F.struct(*value)
    first, last = F.min_by(row, F.when(~bad, F.col(order))), F.max_by(row, F.when(bad, F.col(order)))
    out = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_failed"), F.coalesce(first, last).alias("_row"), (F.count_if(~bad) > 0).alias("is_settled"), *(more or []))
    return out.select(*key, *[F.col(f"_row.{c}").alias(c) for c in value], *[c for c in out.columns if c not in (*key, "_row")])


def run_updates(spark: SparkSession, source: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, by: list[str], fmt: str = "parquet", files_per_batch: int | None = None) -> list[int]:
    """Feed all files that arrived since the last run to a stream whose `step`
    keeps state per key, and stop; returns the batches that ran.

    Each batch writes the keys whose state changed, as they stand then, into a
    folder of its own number, partitioned by `by`; a batch that runs again after
    a failure replaces what it wrote. current() reads the newest row of each key.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ran: list[int] = []

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/batch={no}")
        ran.append(no)

    step(reader.load(source)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ran


def current(updates: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key out of what run_updates() has written."""
    return last_per(updates, key, "batch").drop("batch")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream/{name}-{uuid.uuid4().hex}"

