"""Joins of rows to a table of groups, where a group may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rows from which a group may be hot, and the hot groups at most: the largest
#: ones. A group that isn't among them has less than one in MOST_HOT of all rows.
HOT_ROWS, MOST_HOT = 1_000, 10_000


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", wide: bool = False) -> DataFrame:
    """left.join(right, keys, how) for a table `right` of one row per group with
    its number of rows in `count`; how is inner or left.

    Rows of hot groups stay where they are: those groups' rows of `right`, a
    bounded number, are broadcast. If these are wide (payloads), only their keys
    are; a hot group's row is repeated for each HOT_ROWS rows of the group, which
    are dealt to the copies by a hash of the whole row. All others are joined by
    shuffle, so no task gets a hot group.
    """
    hot = right.where(F.col(count) > HOT_ROWS)
    hot = hot.select(*keys, F.col(count).alias("_rows")) if wide else hot
    hot = stored(hot.orderBy(F.desc("_rows" if wide else count), *keys).limit(MOST_HOT), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    names = F.broadcast(hot.select(*keys))
    if wide:
        copies = F.ceil(F.col("_rows") / HOT_ROWS).cast("int")
        some = left.join(F.broadcast(hot), keys).withColumn("_copy", F.pmod(F.xxhash64(*left.columns), copies).cast("int")).drop("_rows")
        each = right.join(F.broadcast(hot), keys).withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_rows")
        some = some.join(each, [*keys, "_copy"]).drop("_copy")
    else:
        some = left.join(F.broadcast(hot), keys)
    rest = left.join(names, keys, "left_anti").join(right.join(names, keys, "left_anti"), keys, how)
    return some.unionByName(rest)
