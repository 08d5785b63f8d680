"""Metrics of episodes and patches that are known by their definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def file_overlap(df: DataFrame, ours: Column, reference: Column, by: list[str] | None = None) -> DataFrame:
    """Share of non-empty patches that touch a file of the reference patch."""
    a, b = T.patched_files(ours), T.patched_files(reference)
    some = df.where(T.not_blank(ours)).select(*(by or []), F.arrays_overlap(a, b).alias("_hit"))
    out = some.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col("_hit")).alias("hits"))
    return out.withColumn("share", F.try_divide(F.col("hits").cast("double"), F.col("n")))


def context_fidelity(df: DataFrame, patch: Column, source: Column, by: list[str] | None = None) -> DataFrame:
    """Share of context lines of patches that the sources hold as lines.

    Both texts' lines leave their row marked with its number, and equal lines of
    one row meet by a sum, so time is linear in the texts and a long text spreads.
    """
    context = F.transform(F.filter(T.lines(patch), lambda x: x.startswith(" ")), lambda x: F.struct(F.substring(x, 2, 1 << 30).alias("line"), F.lit(1).alias("n")))
    have = F.transform(T.lines(source), lambda x: F.struct(x.alias("line"), F.lit(0).alias("n")))
    none = F.array().cast("array<struct<line:string,n:int>>")
    both = df.select(*(by or []), F.monotonically_increasing_id().alias("_row"), F.concat(F.coalesce(context, none), F.coalesce(have, none)).alias("_all"))
    marked = both.select(*(by or []), "_row", F.explode_outer("_all").alias("_l"))
    per = marked.groupBy(*(by or []), "_row", "_l.line").agg(F.coalesce(F.sum("_l.n"), F.lit(0)).alias("_n"), F.count_if(F.col("_l.n") == 0).alias("_have"))
    out = per.groupBy(*(by or [])).agg(F.sum("_n").alias("n_context"), F.sum(F.when(F.col("_have") > 0, F.col("_n")).otherwise(0)).alias("n_found"))
    return out.withColumn("fidelity", F.try_divide(F.col("n_found").cast("double"), F.col("n_context")))


def tool_usage(df: DataFrame, hist: Column, tools: list[str], by: list[str] | None = None) -> DataFrame:
    """Episodes that used any of the given tools, and all their calls."""
    calls = F.aggregate(F.array(*[F.coalesce(F.element_at(hist, t), F.lit(0)).cast("long") for t in tools]), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*(by or []), calls.alias("_c")).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col("_c") > 0).alias("n_using"), F.sum("_c").alias("n_calls"))


def cross_tab(df: DataFrame, a: Column, b: Column, names: tuple[str, str]) -> DataFrame:
    """Counts of the four combinations of two conditions (null: false)."""
    f = F.lit(False)
    return df.select(F.coalesce(a, f).alias(names[0]), F.coalesce(b, f).alias(names[1])).groupBy(*names).agg(F.count("*").alias("n"))
