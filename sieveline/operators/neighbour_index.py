"""Nearest neighbours below all pairs: lists around centroids, a few of which each row probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from .topk import EPS, Best

#: Rows that centroids are fitted on at most; rows of a list that the number of
#: lists aims at; lists at most, so that the centroids broadcast stay small
#: (64 MB at 256 dimensions); rows of a block at least.
SAMPLE, LIST, MOST_LISTS, ROWS = 20_000, 1_000, 65_536, 2_048
#: Cells that lists are dealt to at most; rows and bytes of a block of a larger table.
CELLS, MOST_ROWS, BLOCK_BYTES = 64, 16_384, 8 << 20
#: Similarities to centroids that are held at once (16 MB); what such a number may
#: differ by where it is computed again.
AT_ONCE, SLACK = 1 << 21, 1e-12
#: Share of exact neighbours to be found, and the rows on which it is measured.
REACH, ASKED = 0.95, 500


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _close(x: np.ndarray, centre: np.ndarray) -> Iterator[np.ndarray]:
    """Similarities of unit rows to all centroids, AT_ONCE at most at a time."""
    step = max(1, min(1024, AT_ONCE // len(centre)))
    for i in range(0, len(x), step):
        yield np.nan_to_num(x[i : i + step] @ centre.T, copy=False, nan=-2.0)


def fit_centroids(df: DataFrame, id_col: str, vec: str, lists: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Spherical k-means over at most SAMPLE rows, those with the smallest hash
    of their id (and vector, so that repeated ids don't crowd it)."""
    some = df.select(vec).orderBy(F.xxhash64(id_col, vec)).limit(SAMPLE).toArrow().column(0).combine_chunks()
    some = pa.concat_arrays(some.chunks) if isinstance(some, pa.ChunkedArray) else some
    x = np.unique(_unit(_vectors(some)), axis=0)
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = np.concatenate([s.argmax(1) for s in _close(x, centre)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(np.bincount(near, minlength=len(centre))[:, None] > 0, _unit(total), centre)
    return centre


def _own(centre_of):
    """Rows (id, vec) -> the list of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [s.argmax(1) for s in _close(_unit(_vectors(batch.column(1))), centre_of.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, int), *near]), pa.int32())], names=["id", "vec", "list"])

    return run


def _probed(centre_of, probes: int, n_cells: int):
    """Rows (id, vec) -> how close the last list is that each probes, and the cells
    that hold lists as close: numbers bounded by the cells, not by the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = centre_of.value
        cell = np.arange(len(centre)) % n_cells
        by_cell = np.argsort(cell, kind="stable")
        first = np.searchsorted(cell[by_cell], np.arange(n_cells))
        for batch in batches:
            reach, there = [np.zeros(0)], [np.zeros((0, n_cells), bool)]
            for s in _close(_unit(_vectors(batch.column(1))), centre):
                closest = np.maximum.reduceat(s[:, by_cell], first, axis=1)
                s.partition(len(centre) - probes, axis=1)
                reach.append(s[:, len(centre) - probes].copy())
                there.append(closest >= reach[-1][:, None])
            there = np.concatenate(there)
            ends = np.concatenate([[0], there.sum(1).cumsum()])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(there)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(reach)), cells], names=["id", "vec", "reach", "cells"])

    return run


def _best_of_blocks(k: int, digits: int, kind: pa.DataType, centre_of):
    """A block of probing rows and a block of rows of lists -> the k best of each
    probing row in the lists as close as its reach, or in all without centroids."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table({"id": pa.array([], kind), "neighbour": pa.array([], kind), "similarity": pa.array([], pa.float64())})
        one = lambda t, c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        ids = lambda t: one(t, "id").to_numpy(zero_copy_only=False)
        x, y = _vectors(one(asking, "vec")), _vectors(one(held, "vec"))
        best = Best(x, ids(asking), y, ids(held), k, digits)
        if centre_of is None:
            best.meet(np.arange(len(x)), np.arange(len(y)))
        else:
            near, reach, of = _unit(x), asking.column("reach").to_numpy() - SLACK, held.column("list").to_numpy()
            by_list = np.argsort(of, kind="stable")
            lists, first = np.unique(of[by_list], return_index=True)
            members = np.split(by_list, first[1:])
            step = max(1, AT_ONCE // len(x))
            for i in range(0, len(lists), step):
                close = np.nan_to_num(centre_of.value[lists[i : i + step]] @ near.T, copy=False, nan=-2.0)
                for s, rows in zip(close, members[i : i + step]):
                    best.meet(np.flatnonzero(s >= reach), rows)
        i, j, sim = best.found()
        return pa.table({"id": one(asking, "id").take(pa.array(i)), "neighbour": one(held, "id").take(pa.array(j)), "similarity": pa.array(sim)})

    return run


def _rows(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")


def entries(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """Equal vectors as one: vec, its smallest id, its k + 1 smallest ids (found in
    salted parts); stored, for several searches of the same k."""
    dealt = _rows(df, id_col, vec).distinct().withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = lambda d, *by: d.withColumn("_no", F.row_number().over(Window.partitionBy("vec", *by).orderBy("id"))).where(F.col("_no") <= k + 1).drop("_no")
    return stored(few(few(dealt, "_part")).groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")


def nearest_by_lists(df: DataFrame, id_col: str, vec: str, k: int, probes: int | None = None, lists: int | None = None, ask: DataFrame | None = None, digits: int = 6, reach: float = REACH, centre: np.ndarray | None = None, some: DataFrame | None = None) -> DataFrame:
    """k nearest other rows by cosine, found in the `probes` lists closest to a
    row: id, neighbour, similarity, rank, in the form of vectors.nearest().

    Every row is in one list, that of its closest centroid; `lists` of them, by
    default one per LIST rows. Without `probes` their number is measured: the
    least that finds the share `reach` of the exact neighbours of a sample (see
    probes_for). centre: centroids fitted before. ask: the rows to answer, by default
    all of df. some: entries() of df made before.
    Equal vectors are one entry that stands for its k + 1 smallest ids, so copies
    neither fill a list nor hide other neighbours. Rows with a null id or vector
    are left out; a repeated id counts once per vector; no rows give none.

    Lists are dealt to CELLS cells at most. A row goes to a cell once, with how
    close the last list is that it probes, and is compared there with the entries
    of lists as close: what is kept and shuffled of a row doesn't grow with the
    lists, and a task holds AT_ONCE similarities to centroids. Large cells are
    compared in blocks, each pair of them a task's work. What is found is exact
    but for neighbours in lists not probed; probes = lists finds all, and needs no
    centroids.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = _rows(df, id_col, vec)
    some = entries(df, id_col, vec, k) if some is None else some
    n, dims = some.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, similarity double, rank int")
    lists = lists or min(MOST_LISTS, max(1, -(-n // LIST)))
    if centre is None and (probes is None or probes < lists):
        centre = fit_centroids(some, "id", "vec", lists)
    probes = probes_for(df, id_col, vec, k, centre, reach, some) if probes is None else probes
    wanted = rows if ask is None else rows.join(ask.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    asking = some.select("id", "vec")
    if ask is not None:
        asking = asking.join(wanted.select("vec").distinct(), "vec", "left_semi").select("id", "vec")
    # lists share cells, to which a row goes once; a large cell's rows and those
    # that ask it are dealt to blocks
    centre_of = None
    if centre is None or probes >= len(centre):
        put = some.select("id", "vec", F.lit(0).alias("list"))
        n_cells, asking = 1, stored(asking.withColumn("reach", F.lit(-2.0)).withColumn("cells", F.array(F.lit(0))), "asking")
    else:
        centre_of = spark.sparkContext.broadcast(centre)
        n_cells = min(len(centre), max(1, min(CELLS, -(-n // ROWS))))
        put = stored(some.select("id", "vec").mapInArrow(_own(centre_of), f"id {kind}, vec array<double>, list int"), "assigned")
        asking = stored(asking.mapInArrow(_probed(centre_of, probes, n_cells), f"id {kind}, vec array<double>, reach double, cells array<int>"), "asking")
    right = put.select((F.col("list") % n_cells).alias("cell"), "id", "vec", "list")
    left = asking.select(F.explode("cells").alias("cell"), "id", "vec", "reach")
    rows_at = min(max(ROWS, min(MOST_ROWS, -(-n // CELLS))), max(1, BLOCK_BYTES // (8 * (dims or 1))))
    sizes = right.groupBy("cell").agg(F.count("*").alias("_held")).join(left.groupBy("cell").agg(F.count("*").alias("_asking")), "cell")
    sizes = F.broadcast(sizes.select("cell", F.ceil(F.col("_held") / (2 * rows_at)).cast("int").alias("_b"), F.ceil(F.col("_asking") / rows_at).cast("int").alias("_a")))  # a row per cell
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = left.join(sizes, "cell").select("cell", dealt("_a").alias("a"), each("_b").alias("b"), "id", "vec", "reach")
    right = right.join(sizes, "cell").select("cell", each("_a").alias("a"), dealt("_b").alias("b"), F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("list").alias("list"))
    by = ["cell", "a", "b"]
    arrow = some.select("id").limit(0).toArrow().schema.field("id").type
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best_of_blocks(k, digits, arrow, centre_of), f"id {kind}, neighbour {kind}, similarity double")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    found = found.withColumn("_no", F.row_number().over(best)).where(F.col("_no") <= k).drop("_no")
    # entries to rows: a vector's own copies, and those of the vectors found
    found = found.unionByName(asking.select("id", F.col("id").alias("neighbour"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) / (F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) + EPS), digits).alias("similarity")))
    copies = some.select(F.col("id").alias("neighbour"), F.explode("ids").alias("_copy"))
    found = found.join(copies, "neighbour").select(F.col("id").alias("_entry"), F.col("_copy").alias("neighbour"), "similarity")
    found = found.withColumn("_no", F.row_number().over(Window.partitionBy("_entry").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("_no") <= k + 1).drop("_no")
    members = wanted.distinct().join(some.select("vec", F.col("id").alias("_entry")), "vec").select("_entry", "id")
    out = members.join(found, "_entry").where("id <> neighbour").select("id", "neighbour", "similarity")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k)


def probes_for(df: DataFrame, id_col: str, vec: str, k: int, centre: np.ndarray, reach: float = REACH, some: DataFrame | None = None) -> int:
    """The least number of probes with which the share `reach` of the k exact
    neighbours is found, for ASKED rows at most (those with the smallest hash of
    their id) against all rows. A neighbour is found by p probes if its list is
    among the p closest to the row."""
    ask = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col)).limit(ASKED)
    exact = stored(nearest_by_lists(df, id_col, vec, k, 1, 1, ask, some=some).select("id", "neighbour"), "sample")
    named = exact.select(F.explode(F.array("id", "neighbour")).alias(id_col)).distinct()  # ASKED * (k + 1) at most
    vectors = df.where(F.col(vec).isNotNull()).join(F.broadcast(named), id_col, "left_semi").groupBy(id_col).agg(F.min(F.col(vec).cast("array<double>")).alias("_v"))
    of = lambda name: vectors.select(F.col(id_col).alias(name), F.col("_v").alias(f"_{name}"))
    pairs = exact.join(of("id"), "id").join(of("neighbour"), "neighbour").select("_id", "_neighbour")
    centre_of = df.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(_close(_unit(_vectors(c)), centre_of.value) for c in batch.columns)):
                own = np.take_along_axis(a, b.argmax(1)[:, None], 1)
                yield pa.RecordBatch.from_arrays([pa.array((a > own).sum(1) + 1)], names=["p"])

    found = pairs.mapInArrow(run, "p long").groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()  # a row per list at most
    share = np.cumsum([r.n for r in found]) / max(1, sum(r.n for r in found))
    return next((r.p for r, x in zip(found, share) if x >= reach), len(centre))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found: n, hits, recall."""
    hit = exact.select("id", "neighbour").join(found.select("id", "neighbour").withColumn("_hit", F.lit(1)), ["id", "neighbour"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("_hit").alias("hits")).withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("n")))
