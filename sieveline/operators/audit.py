"""Integrity checks and audits of a packaged dataset; every finding is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def is_missing(df: DataFrame, col: str) -> Column:
    """Absent in the sense that null, "", 0, false and an empty array share."""
    kind = df.schema[col].dataType.typeName()
    c = F.col(col)
    if kind == "string":
        return F.coalesce(c, F.lit("")) == ""
    if kind in ("array", "map"):
        return F.coalesce(F.size(c), F.lit(0)) <= 0
    if kind == "boolean":
        return ~F.coalesce(c, F.lit(False))
    if kind in ("timestamp", "timestamp_ntz", "date", "struct", "binary"):
        return c.isNull()
    return F.coalesce(c, F.lit(0)) == 0


def missing_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field: one row per required field that is absent. One scan."""
    names = F.array_compact(F.array(*[F.when(is_missing(df, f), F.lit(f)) for f in fields]))
    return df.select(F.col(id_col).alias("id"), F.explode(names).alias("field"))


def findings(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Union of (severity, check, rows with id) into severity, check, id."""
    rows = [p.select(F.lit(s).alias("severity"), F.lit(c).alias("check"), F.col("id").cast("string").alias("id")) for s, c, p in parts]
    return reduce(DataFrame.unionByName, rows)


def totals(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "check").agg(F.count("*").alias("n"))


def exit_code(found: DataFrame) -> DataFrame:
    """code: 1 if any finding is an error, else 0."""
    return found.agg(F.max(F.when(F.col("severity") == "error", 1).otherwise(0)).alias("_c")).select(F.coalesce("_c", F.lit(0)).alias("code"))


def fail_on_errors(found: DataFrame) -> None:
    """For command lines: stop if there is an error row."""
    if exit_code(found).first()["code"]:
        raise SystemExit(1)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def uniqueness(df: DataFrame, key: list[str]) -> DataFrame:
    """rows, distinct keys, and keys that occur more than once; in two steps, so
    that counting distinct keys is spread over them."""
    per = df.groupBy(*key).agg(F.count("*").alias("_c"))
    return per.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"), F.count("*").alias("n_distinct"), F.count_if(F.col("_c") > 1).alias("n_duplicated"))


def range_by(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """First and last day of a timestamp per group."""
    day = F.date_format(ts, "yyyy-MM-dd")
    return df.groupBy(*by).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def id_mismatch(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one of two tables has, with the side that has it."""
    x, y = a.select(*key).distinct().withColumn("_a", F.lit(True)), b.select(*key).distinct().withColumn("_b", F.lit(True))
    both = x.join(y, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(*key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only_in"))


def completeness(tasks: DataFrame, assets: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """A flag per asset and task: has_<asset>."""
    out = tasks.select(*key)
    for name, df in assets.items():
        out = out.join(df.select(*key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def completeness_counts(flags: DataFrame, assets: list[str]) -> DataFrame:
    have = [F.count_if(F.col(f"has_{a}")).alias(f"n_{a}") for a in assets]
    every = reduce(lambda x, y: x & y, [F.col(f"has_{a}") for a in assets])
    return flags.agg(F.count("*").alias("n"), *have, F.count_if(every).alias("n_complete"))


def wrong_dimensions(df: DataFrame, id_col: str, vector: str, dims: int, first_n: int | None = None) -> DataFrame:
    """Vectors of another length (null: none). first_n checks the first ids only."""
    rows = df.orderBy(id_col).limit(first_n) if first_n else df
    return rows.where(F.coalesce(F.size(vector), F.lit(-1)) != dims).select(F.col(id_col).alias("id"), F.coalesce(F.size(vector), F.lit(-1)).alias("dims"))


def without_python(members: DataFrame, by: str, path: str) -> DataFrame:
    """Snapshots that hold no Python file."""
    return members.groupBy(by).agg(F.bool_or(F.col(path).endswith(".py")).alias("_ok")).where("not _ok").select(F.col(by).alias("id"))


def empty_graphs(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Tasks whose graph has no node or no edge."""
    f = completeness(tasks, {"nodes": nodes, "edges": edges}, [key])
    return f.where("not (has_nodes and has_edges)").select(F.col(key).alias("id"))


def member_names(members: DataFrame, path: str) -> DataFrame:
    return members.withColumn(path, T.stripped_member(F.col(path)))
