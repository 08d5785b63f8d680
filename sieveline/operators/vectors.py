"""Vector operators: cosine neighbours, lift, character TF-IDF, truncated SVD."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .topk import EPS, Best

#: Blocks of a table that ask, unless their rows pass this many bytes; rows that
#: are asked at once, as a multiple.
ASKING, BLOCK_BYTES, HELD = 32, 8 << 20, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def similar(df: DataFrame, id_col: str, vec: str, query_id, k: int, digits: int = 6) -> DataFrame:
    """The k rows closest to one row; its vector is the only thing broadcast."""
    one = df.where(F.col(id_col) == query_id).select(F.col(vec).alias("_q")).limit(1)
    out = df.where(F.col(id_col) != query_id).crossJoin(F.broadcast(one)).select(id_col, F.round(cosine(F.col(vec), F.col("_q")), digits).alias("similarity"))
    return out.orderBy(F.desc("similarity"), id_col).limit(k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    if one.null_count or one.flatten().null_count or pc.count_distinct(pc.list_value_length(one)).as_py() > 1:
        raise ValueError("vectors must be there and of one length")
    return one.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(one), -1)


def dealt(n: int, dims: int, block: int) -> tuple[int, int]:
    """Blocks that ask, and larger ones that are asked, for n vectors: ASKING at
    most, until rows of so many dimensions pass BLOCK_BYTES."""
    rows = min(max(1, BLOCK_BYTES // (8 * dims)), max(block, -(-n // ASKING)))
    return max(1, -(-n // rows)), max(1, -(-n // (HELD * rows)))


def nearest(df: DataFrame, id_col: str, vec: str, k: int, group: str | None = None, block: int = 2048, digits: int = 6) -> DataFrame:
    """k nearest other rows of every row by cosine, within `group` if given.

    A blocked product: rows are dealt to small blocks that ask and to large ones
    that are asked; each pair of blocks is one group of a shuffle and one product
    in its task, which keeps the k best per row (topk.Best); the few partial lists
    of a row are then merged. Work is all pairs, as an exact search needs; no row
    of the plan is a pair. Blocks grow with the table, up to a size in bytes, so
    that copies of rows don't. Ties go to the smaller id. Returns id, neighbour,
    similarity, rank.
    """
    ship(df.sparkSession)
    by = [group] if group else []
    n, dims = df.agg(F.count("*"), F.max(F.size(vec))).first()
    asking, held = dealt(n, dims or 1, block)
    part = lambda blocks: F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    base = df.select(*by, F.col(id_col).alias("id"), F.col(vec).alias("vec"), part(asking).alias("p"), part(held).alias("q"))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = base.select(*by, "id", "vec", "p", each(held).alias("q"), F.lit(0).alias("side"))
    right = base.select(*by, "id", "vec", each(asking).alias("p"), "q", F.lit(1).alias("side"))
    both = left.unionByName(right)
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([*[f"{g} {df.schema[g].dataType.simpleString()}" for g in by], f"id {kind}, neighbour {kind}, similarity double"])

    def top(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        a, b = (table.take(pa.array(np.flatnonzero(side == x))) for x in (0, 1))
        x, y = matrix(a.column("vec")), matrix(b.column("vec"))
        best = Best(x, a.column("id").to_numpy(), y, b.column("id").to_numpy(), k, digits)
        best.meet(np.arange(len(x)), np.arange(len(y)))
        i, j, s = best.found()
        out = {g: table.column(g).take(pa.array(np.zeros(len(i), np.int64))) for g in by}
        return pa.table({**out, "id": a.column("id").take(pa.array(i)), "neighbour": b.column("id").take(pa.array(j)), "similarity": pa.array(s)})

    part_best = both.groupBy(*by, "p", "q").applyInArrow(top, schema)
    w = Window.partitionBy("id", *by).orderBy(F.desc("similarity"), "neighbour")
    return part_best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_lift(df: DataFrame, near: DataFrame, id_col: str, label: str) -> DataFrame:
    """Share of a row's neighbours with its label against chance.

    chance is (rows of the label - 1) / (rows - 1). Returns label, n, same_share,
    chance, lift per label.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.count()
    a = df.select(F.col(id_col).alias("id"), F.col(label))
    b = df.select(F.col(id_col).alias("neighbour"), F.col(label).alias("_other"))
    same = near.join(a, "id").join(b, "neighbour").groupBy(label).agg(F.avg((F.col(label) == F.col("_other")).cast("double")).alias("same_share"))
    out = same.join(sizes, label).withColumn("chance", (F.col("n") - 1) / F.lit(max(1, total - 1)))
    return out.select(label, "n", "same_share", "chance", (F.col("same_share") / (F.col("chance") + EPS)).alias("lift"))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word padded by a space on both sides
    (a padded word shorter than n gives itself once)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[F.when((F.length(w) >= n) if n > low else F.lit(True), grams(w, n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)])))


def tfidf(docs: DataFrame, id_col: str, terms: Column, most_features: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Smoothed TF-IDF weights with unit rows: idf = ln((1 + n) / (1 + df)) + 1.

    With `by` each instance has its own n, df and features. most_features keeps
    an instance's terms with the largest total counts, ties by the term; terms
    are ranked in 64 parts first. Returns by, id, term, weight in long form.
    """
    by = by or []
    tf = docs.select(*by, F.col(id_col), F.explode(terms).alias("term")).groupBy(*by, id_col, "term").agg(F.count("*").alias("_c"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("_df"), F.sum("_c").alias("_total"))
    if most_features and not by:
        df = df.orderBy(F.desc("_total"), "term").limit(most_features)
    elif most_features:
        rank = lambda *more: F.row_number().over(Window.partitionBy(*by, *more).orderBy(F.desc("_total"), "term"))
        df = df.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(64))).withColumn("_no", rank("_part")).where(F.col("_no") <= most_features)
        df = df.withColumn("_no", rank()).where(F.col("_no") <= most_features).drop("_part", "_no")
    if by:
        df = df.join(docs.groupBy(*by).agg(F.count("*").alias("_n")), by)
    else:
        df = df.withColumn("_n", F.lit(docs.count()))
    w = tf.join(df, [*by, "term"]).withColumn("_w", F.col("_c") * (F.ln((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("_df"))) + 1))
    length = w.groupBy(*by, id_col).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return w.join(length, [*by, id_col]).select(*by, id_col, "term", (F.col("_w") / F.col("_l")).alias("weight"))


def keep_mapped(nodes: DataFrame, by: str, least: int = 30) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    big = nodes.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return nodes.join(big.select(by), by, "left_semi")
