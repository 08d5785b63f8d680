"""Aggregates over outcome tables: rates, percentiles, histograms, tests."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b)


def rate_by(df: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """n, ok and rate per group; an empty `by` gives one row."""
    agg = [F.count("*").alias("n"), F.count_if(ok).alias("ok")]
    out = (df.groupBy(*by) if by else df.groupBy()).agg(*agg)
    return out.withColumn("rate", ratio(F.col("ok"), F.col("n")))


def order_percentiles(df: DataFrame, by: list[str], col: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles by position: the value at place min(n - 1, int(n * p)) of the
    sorted values of each group, nulls left out.

    Values are counted first and the counts are ranged by value, so that a group
    of any size lies in many tasks; running counts inside a range start at what
    the ranges before it hold, one row per group and range.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    c = stored(c.repartitionByRange(*by, col).withColumn("_part", F.spark_partition_id()), "counts")
    per = c.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    per = per.withColumns({"_before": F.sum("_in").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_in"), "_all": F.sum("_in").over(Window.partitionBy(*by))})
    inside = c.withColumn("_hi", F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(col)))
    same = [F.col(f"i.{x}").eqNullSafe(F.col(f"p.{x}")) for x in by] + [F.col("i._part") == F.col("p._part")]
    upto = inside.alias("i").join(per.alias("p"), reduce(lambda x, y: x & y, same)).select("i.*", "p._all", (F.col("i._hi") + F.col("p._before")).alias("_upto"))
    place = lambda p: F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p)))
    pick = [F.min(F.when(F.col("_upto") > place(p), F.col(col))).alias(n) for n, p in ps.items()]
    return upto.groupBy(*by).agg(F.max("_all").alias("n"), *pick, F.max(col).alias("max"))


def rounded(x: Column, digits: int = 1) -> Column:
    """Rounded half to even."""
    return F.bround(x, digits)


def linear_percentiles(df: DataFrame, by: list[str], col: str, ps: dict[str, float]) -> DataFrame:
    """Interpolated percentiles, mean, and the share above 1."""
    return df.groupBy(*by).agg(*[F.percentile(col, F.lit(p)).alias(n) for n, p in ps.items()], F.avg(col).alias("mean"), F.avg((F.col(col) > 1).cast("double")).alias("share_over_1"))


def optional_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Mean and maximum where an absent value counts as 0."""
    v = F.coalesce(F.col(col), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))


def strict_mean(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Mean that stops on an absent value."""
    bad = F.count_if(F.col(col).isNull())
    return df.groupBy(*by).agg(F.when(bad == 0, F.avg(col)).otherwise(F.raise_error(F.lit(f"{col} is missing")).cast("double")).alias("mean"))


def map_sum(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Sum maps of counts key by key."""
    by = by or []
    return df.select(*by, F.explode(col).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("total"))


def most_common(df: DataFrame, col: str, order: str) -> DataFrame:
    """Values by count, the earliest first of equals."""
    return df.groupBy(col).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def ids_where(df: DataFrame, by: list[str], id_col: str, ok: Column) -> DataFrame:
    return df.where(ok).groupBy(*by).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight places up."""
    y = x + 8.0
    down = reduce(lambda a, k: a * (x + float(k)), range(1, 8), x)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(down)


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k."""
    n, k = n.cast("double"), k.cast("double")
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_fair(n: Column, k: Column) -> Column:
    """ln of the probability of k heads in n tosses of a fair coin. From 50 on
    it is written by how far k is from n / 2, so that nothing large cancels."""
    n, k = n.cast("double"), k.cast("double")
    m = n - k
    d = (m - k) / n
    rest = lambda x: 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    apart = -n / 2 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d)) + 0.5 * F.ln(n / (2 * math.pi * k * m)) + rest(n) - rest(k) - rest(m)
    return F.when(F.least(k, m) >= 50, apart).otherwise(log_choose(n, k) - n * math.log(2))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact test on discordant counts: twice the lower binomial tail
    at 1/2, at most 1; 1 without discordant pairs.

    The tail is summed from its largest term down, each from the one before.
    Terms more than 6 sqrt(n) + 60 places away are below 1e-15 of the sum and
    are not added, so the sum is short however many pairs there are.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    first = F.exp(log_fair(n, k))
    m = F.least(k, F.ceil(6 * F.sqrt(n.cast("double")) + 60).cast("long"))
    steps = F.when(m > 0, F.sequence(F.lit(0).cast("long"), m - 1)).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1.0)
    tail = F.aggregate(steps, F.struct(one.alias("t"), one.alias("s")), lambda a, j: F.struct((a["t"] * (k - j) / (n - k + j + 1)).alias("t"), (a["s"] + a["t"] * (k - j) / (n - k + j + 1)).alias("s")), lambda a: a["s"])
    return F.when(n == 0, one).otherwise(F.least(one, 2 * first * tail))


def mcnemar(pairs: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Discordant pairs of two paired booleans and the exact test."""
    out = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return out.withColumn("p", mcnemar_p(F.col("only_a"), F.col("only_b")))


def paired(a: DataFrame, b: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Rows of two arms by key, columns a_* and b_*; unpaired rows drop out."""
    x = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols])
    return x.join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in cols]), key)


def common_keys(arms: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that all given arms have; empty arms (None) don't count."""
    some = [x for x in arms if x is not None]
    out = some[0].select(*key).distinct()
    for x in some[1:]:
        out = out.join(x.select(*key), key, "left_semi")
    return out


def arm_summary(df: DataFrame, arm: str, patch: Column, passed: Column, steps: Column) -> DataFrame:
    return df.groupBy(arm).agg(F.count("*").alias("n"), F.count_if(patch).alias("n_patch"), F.count_if(passed).alias("n_pass"), F.avg(steps).alias("mean_steps"))


def wilson(ok: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a rate; null without rows."""
    p, z2 = F.try_divide(ok.cast("double"), n), z * z
    mid, half, den = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return F.when(n > 0, (mid - half) / den), F.when(n > 0, (mid + half) / den)
