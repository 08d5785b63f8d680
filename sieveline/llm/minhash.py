"""Near-duplicate detection: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored
from .components import components
from .joins import join_groups
from .kernel import U, Words, blocks, mix, mix_int, trim

#: Bins of a sketch, and how they are banded. A pair at similarity 0.85 shares
#: no band with probability (1 - 0.85**5)**25 < 5e-7.
BINS, ROWS, BANDS = 128, 5, 25
#: Weight of a verification unit before it is cut up: its shingles, or a sixteenth
#: of its bytes where lines repeat, and PER_SET for each set, as pairs of sets take
#: memory too. Members of a larger group meet
#: pivots first, for as many turns.
UNIT, PER_SET, TURNS = 1 << 18, 128, 2
#: Sets of a unit after which a task gives memory back.
LARGE = 256
#: Large groups up to which their list is broadcast.
MOST_LARGE = 100_000


def shingle_sets(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, with offsets.

    A text of fewer than k words has its whole sequence as one shingle; a text
    without words has none.
    """
    w = Words(buf, at)
    n = len(at) - 1
    i, h = w.windows(k)
    count = np.diff(w.ofs)
    per = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([mix_int(int(np.bitwise_xor.reduce(mix(w.key[w.ofs[d] : w.ofs[d + 1]] + np.arange(1, count[d] + 1, dtype=U) * U(0xA24BAED4963EE407)))) + int(count[d])) for d in short], U)
        h = np.insert(h, np.cumsum(per)[short] - per[short], extra)
        per[short] = 1
    ofs = np.concatenate([[0], np.cumsum(per)])
    for d in np.flatnonzero(per > 1):
        h[ofs[d] : ofs[d + 1]].sort()
    doc = np.repeat(np.arange(n), per)
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def sketch(h: np.ndarray, ofs: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of each non-empty set: a (texts, bins) array.

    Round i < bins throws every element into a random bin with value (i, random
    bits); round i >= bins puts every element into bin i - bins. The smallest
    value of a bin stays, so the second half fills whatever is still empty and
    every coordinate is filled for any set size. Once a set has no empty bin,
    later rounds can't change it and it leaves.
    """
    n = len(ofs) - 1
    none = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, none, U)
    shift = U(64 - (bins - 1).bit_length())
    size = np.diff(ofs)
    live = np.flatnonzero(size > 0)
    el, doc = h, np.repeat(np.arange(n), size)
    for i in range(2 * bins):
        x = mix(el ^ U(mix_int(0x5851F42D4C957F2D * (i + 1))))
        value = (U(i) << U(56)) | ((x << U(8)) >> U(8))
        if i < bins:
            np.minimum.at(out, doc * bins + (x >> shift).astype(np.int64), value)
        else:
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            low = np.minimum.reduceat(value, first)
            at = doc[first] * bins + (i - bins)
            out[at] = np.minimum(out[at], low)
        full = (out.reshape(n, bins)[live] != none).all(axis=1)
        if full.any():
            live = live[~full]
            if not len(live):
                break
            still = np.zeros(n, bool)
            still[live] = True
            m = still[doc]
            el, doc = el[m], doc[m]
    return out.reshape(n, bins)


def band_keys(sig: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    out = np.empty((len(sig), bands), U)
    for b in range(bands):
        part = sig[:, b * rows : (b + 1) * rows]
        out[:, b] = mix((part * np.array([mix_int(77 + j) | 1 for j in range(rows)], U)).sum(axis=1, dtype=U) + U(mix_int(b + 1)))
    return out


def _sketches(k: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            ids = batch.column(batch.schema.names.index(id_col))
            for i, j, buf, at in blocks(batch.column(batch.schema.names.index(text_col))):
                h, ofs = shingle_sets(buf, at, k)
                n = np.diff(ofs)
                sums = [np.add.reduceat(np.append(mix(h + U(c)), U(0)), ofs[:-1]) for c in (1, 2)]
                keys = band_keys(sketch(h, ofs))
                some = n > 0
                flat = pa.array(keys[some].ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(np.maximum(n, np.diff(at) >> 4)), *(pa.array(np.where(some, s, U(0)).view(np.int64)) for s in sums), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), flat)],
                    names=["doc_id", "n_shingles", "cost", "set1", "set2", "keys"],
                )
        trim()

    return run


def links(sets: list[np.ndarray], split: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs with den * intersection >= num * union.

    Intersection sizes of all pairs come exactly from products of 0/1 matrices
    over the shingles that occur at least twice. With split > 0 only pairs of
    one of the first `split` sets and one of the others count.
    """
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    m = df[col] > 1
    owner, col = owner[m], col[m]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], np.unique(col[order], return_inverse=True)[1]
    rows, cols = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    common = np.zeros((len(n[rows]), len(n[cols])), np.float32)
    width = max(64, (1 << 23) // max(1, len(sets)))
    total = int(col[-1]) + 1 if len(col) else 0
    for c in range(0, total, width):
        a, b = np.searchsorted(col, [c, c + width])
        x = np.zeros((len(sets), min(width, total - c)), np.float32)
        x[owner[a:b], col[a:b] - c] = 1
        common += x[rows] @ x[cols].T
    common = common.astype(np.int64)
    union = n[rows][:, None] + n[cols][None, :] - common
    i, j = np.nonzero((den * common >= num * union) & (common > 0))
    j = j + split
    if not split:
        m = i < j
        i, j = i[m], j[m]
    return forest(i, j, len(sets))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex of its component) for the linked ones."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    v = np.flatnonzero(label != np.arange(n))
    return v, label[v]


def _verify(k: int, num: int, den: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        ids = table.column("doc_id").to_numpy()
        sets = []
        for _, _, buf, at in blocks(table.column("text").combine_chunks()):
            h, ofs = shingle_sets(buf, at, k)
            sets += [h[ofs[d] : ofs[d + 1]] for d in range(len(ofs) - 1)]
        split = int((table.column("side").to_numpy() == 0).sum())
        if split == len(ids):
            split = 0
        elif key[2].as_py() == key[3].as_py():
            split = 0
        v, up = links(sets, split, num, den)
        del sets, table
        if len(ids) >= LARGE:
            trim()
        return pa.table({"a": pa.array(ids[up], pa.int64()), "b": pa.array(ids[v], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """Group documents whose distinct k-word shingle sets link, transitively.

    Two documents link if den * |intersection| >= num * |union|. Texts are
    lower-cased (A-Z) and split at ASCII white space. Returns one row per input
    row: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Null and wordless texts have the empty set, link with nothing and are kept.
    Repeated ids: rows of one id belong to one vertex, and texts of that id
    link separately. Null ids never occur in links and give a null component.
    Very long texts are taken whole, and weigh by their bytes as well as by their
    shingles; no rows give no rows; extra columns, whatever their names, are
    ignored.

    Plan: one pass makes sketches (25 band keys, set size and 128-bit set
    digest). Equal sets collapse to their smallest id first, so groups of
    copies never meet in a bucket. Buckets with several sets give candidate
    groups; texts of candidates meet once per group, where all pairs are
    intersected exactly and only a spanning forest leaves the task. In a group
    larger than UNIT every member first meets the pivots of its buckets; a bucket
    whose members are all linked by then is done. What is left is compared bucket
    by bucket, in pairs of blocks, without the pairs inside its largest linked
    part. So a task's memory does not follow the group, and the work on a group
    of near copies follows its size, not its square.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = stored(base.mapInArrow(_sketches(k, "doc_id", "text"), "doc_id long, n_shingles long, cost long, set1 long, set2 long, keys array<long>"), "sketches")
    some = sk.where("n_shingles > 0 and doc_id is not null")
    set_is = ["n_shingles", "set1", "set2"]
    equal = stored(some.groupBy(*set_is).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "equal")
    classes = join_groups(some.select("doc_id", *set_is), equal, set_is, "c", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    classes = stored(classes, "classes")
    reps = some.join(classes.where("doc_id = rep").select("doc_id", "n_shingles").distinct(), ["doc_id", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "set1", "set2"])
    reps = stored(reps.select("doc_id", "cost", "keys"), "reps")
    bands = reps.select("doc_id", "cost", F.explode("keys").alias("key"))
    many = stored(bands.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("low")).where("c > 1"), "shared")
    memb = stored(join_groups(bands, many, ["key"], "c").select("key", "doc_id", "cost", "low"), "buckets")
    if memb.isEmpty():
        edges = spark.createDataFrame([], "a long, b long")
    else:
        edges = _links_of(base, memb, k, num, den)
    # an id of several texts ties their sets together
    several = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_high")).where("a < _high").select("doc_id", "a")
    ties = classes.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    comp = components(edges.union(ties)).select(F.col("vertex").alias("rep"), "component")
    # only sets were labelled; their documents, which may be very many, take the label
    sizes = equal.groupBy("rep").agg(F.sum("c").alias("c"))
    known = stored(comp.join(sizes, "rep", "left").select("rep", "component", F.coalesce("c", F.lit(1)).alias("c")), "known")
    rows = join_groups(classes, known, ["rep"], "c", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component"))
    none = sk.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    also = rows.join(none.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = rows.unionByName(none.join(also, "doc_id", "left"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _links_of(base: DataFrame, memb: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between the sets that share a bucket: a forest of each unit."""
    group = components(memb.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")))
    weight = (F.col("cost") + PER_SET).alias("weight")
    each = memb.select("doc_id", weight).distinct().join(group, F.col("doc_id") == group["vertex"]).select("doc_id", "weight", F.col("component").alias("grp"))
    each = stored(each, "members")
    large = stored(each.groupBy("grp").agg(F.sum("weight").alias("size")).where(F.col("size") > UNIT), "large")
    # the large groups are few; their table is broadcast only if a count says so
    n = large.limit(MOST_LARGE + 1).count()
    texts = stored(each.join(F.broadcast(large) if n <= MOST_LARGE else large, "grp", "left").join(base, "doc_id").select("doc_id", "weight", "grp", "size", "text"), "texts")
    zero = F.lit(0)
    links = _compare(texts.where("size is null").select(zero.alias("kind"), F.col("grp").alias("unit"), zero.alias("p"), zero.alias("q"), "doc_id", zero.alias("side"), "text"), k, num, den)
    if not n:
        return links
    texts = texts.where("size is not null")
    # a bucket with the members of another is taken once
    rest = memb.select("key", "doc_id").join(texts.select("doc_id", "weight").distinct(), "doc_id")
    h = F.xxhash64("doc_id")
    marks = rest.groupBy("key").agg(F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("m1"), F.bit_xor(h).alias("m2"), F.count("*").alias("c"))
    one = marks.groupBy("m1", "m2", "c").agg(F.min("key").alias("key"))
    buckets = stored(rest.join(one.select("key"), "key", "left_semi").select("key", "doc_id", "weight"), "buckets")
    edges = None
    for turn in range(TURNS + 1):
        at = buckets.withColumn("label", F.col("doc_id"))
        if edges is not None:  # a member is known by the first pivot, in the order of turn 0, that it is linked with, and that by its own
            order = lambda c: F.xxhash64(c, F.lit(0))
            up = edges.groupBy(F.col("b").alias("doc_id")).agg(F.min_by("a", order("a")).alias("up"))
            up = up.join(up.select(F.col("doc_id").alias("up"), F.col("up").alias("top")), "up", "left").select("doc_id", F.coalesce("top", "up").alias("up"))
            at = buckets.join(up, "doc_id", "left").select("key", "doc_id", "weight", F.coalesce("up", "doc_id").alias("label"))
        at = stored(at, "labelled")
        pivot = F.min_by(F.struct("doc_id", "label"), F.xxhash64("doc_id", F.lit(turn)))
        left = stored(at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), pivot.alias("pivot")).where("low < high"), "left")
        if left.isEmpty():
            break
        units = _stars(at, left) if turn < TURNS else _blocks_of(at, left)
        more = _compare(units.join(texts.select("doc_id", "text"), "doc_id"), k, num, den)
        edges = more if edges is None else edges.union(more)
    return links if edges is None else links.union(edges)


def _compare(units: DataFrame, k: int, num: int, den: int) -> DataFrame:
    return stored(units.groupBy("kind", "unit", "p", "q").applyInArrow(_verify(k, num, den), "a long, b long"), "links")


def _stars(at: DataFrame, left: DataFrame) -> DataFrame:
    """Units of a pivot and members of its buckets that it isn't linked with.
    Rows are a few numbers each, so that a skewed join may split them."""
    pairs = at.join(left.select("key", F.col("pivot.doc_id").alias("pivot"), F.col("pivot.label").alias("with")), "key")
    pairs = stored(pairs.where("label <> with").select("pivot", "doc_id", "weight").distinct(), "pairs")
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.sum("weight") / F.lit(UNIT)).cast("int").alias("nb"))
    members = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.hash("doc_id"), "nb").alias("p"), "doc_id", F.lit(1).alias("side"))
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("p"), F.col("pivot").alias("doc_id"), F.lit(0).alias("side"))
    return members.union(pivots).select(F.lit(1).alias("kind"), F.col("pivot").alias("unit"), "p", F.lit(-1).alias("q"), "doc_id", "side")


def _blocks_of(at: DataFrame, left: DataFrame) -> DataFrame:
    """Units of two blocks of a bucket's members, or one, but for pairs of blocks
    of its largest linked part."""
    at = at.join(left.select("key"), "key", "left_semi")
    linked = at.groupBy("key", "label").agg(F.sum("weight").alias("w"))
    most = linked.groupBy("key").agg(F.max_by("label", "w").alias("most"), F.max("w").alias("in"), F.sum("w").alias("all"))
    half = F.lit(UNIT // 2)
    most = most.select("key", "most", F.ceil((F.col("all") - F.col("in")) / half).cast("int").alias("others"), F.ceil(F.col("in") / half).cast("int").alias("same"))
    rows = at.join(most, "key").withColumn("inside", F.col("label") == F.col("most"))
    part = F.when(F.col("inside"), F.col("others") + F.pmod(F.hash("doc_id"), "same")).otherwise(F.pmod(F.hash("doc_id"), "others"))
    last = F.when(F.col("inside"), F.col("others") - 1).otherwise(F.col("others") + F.col("same") - 1)
    rows = rows.select("key", "doc_id", part.alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return rows.select(F.lit(2).alias("kind"), F.col("key").alias("unit"), F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "doc_id", F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"))
