"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def jsonl(df: DataFrame, path: str | None) -> DataFrame:
    """Overwrite JSON lines; without a path the caller has the rows."""
    if path:
        df.write.mode("overwrite").json(path)
    return df


def append_new(df: DataFrame, path: str, schema: str, key: list[str], retry_errors: bool = False) -> DataFrame:
    """Append rows whose key the output does not hold yet; returns what was added."""
    from ..operators.curate import remaining
    from ..session import stored
    from .readers import jsonl as read

    done = read(df.sparkSession, path, schema, missing_ok=True)
    new = stored(remaining(df, done, key, retry_errors), "new")
    new.write.mode("append").json(path)
    return new


def transcripts(df: DataFrame, path: str, by: str = "instance_id") -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path + "/nodes")
    edges.write.mode("overwrite").parquet(path + "/edges")


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def constraints(df: DataFrame, path: str) -> None:
    """Text lines pkg==ver."""
    from ..operators.curate import constraints as lines

    lines(df).write.mode("overwrite").text(path)
