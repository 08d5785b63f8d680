"""Truncated SVD of long-form matrices, all instances in one plan, in blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored
from .vectors import EPS

#: Rows of a block, terms of a block that are dense at a time, and directions
#: beyond the wanted ones. Into how many parts an instance's blocks are dealt
#: where they meet its small matrices.
ROWS, TERMS, OVER, DEALT = 256, 4096, 10, 64
_U = np.uint64


def _signs(h: np.ndarray, n: int) -> np.ndarray:
    """n signs per 64-bit hash, the same wherever a term is met."""
    x = h.astype(_U)[:, None] + np.arange(1, -(-n // 64) + 1, dtype=_U)[None] * _U(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    bits = np.unpackbits(np.ascontiguousarray(x ^ (x >> _U(31))).view(np.uint8), axis=1)[:, :n]
    return 2.0 * bits - 1


class Block:
    """Some rows of an instance: its sparse columns and a row of q for each."""

    def __init__(self, r: dict) -> None:
        self.ids, self.terms = r["ids"], r["terms"]
        self.hash, self.at, self.row = (np.frombuffer(r[c], "<i8") for c in ("hashes", "at", "row"))
        self.val = np.frombuffer(r["val"], "<f8")
        self.q = np.frombuffer(r["q"], "<f8").reshape(len(self.ids), -1)

    def columns(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Dense columns, TERMS terms at a time."""
        for a in range(0, len(self.at) - 1, TERMS):
            b = min(a + TERMS, len(self.at) - 1)
            x = np.zeros((len(self.ids), b - a))
            lo, hi = self.at[a], self.at[b]
            x[self.row[lo:hi], np.repeat(np.arange(b - a), np.diff(self.at[a : b + 1]))] = self.val[lo:hi]
            yield a, b, x


def _pack(by: list[str], wide: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        ids, terms = t.column("id").dictionary_encode().combine_chunks(), t.column("term").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        h = t.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        # equal hashes are told apart by the term
        code = (terms if isinstance(terms, pa.Array) else pa.concat_arrays(terms.chunks)).dictionary_encode()
        order = order[np.lexsort((code.indices.to_numpy()[order], h[order]))]
        c = code.indices.to_numpy()[order]
        start = np.flatnonzero(np.diff(c, prepend=-1))
        at = np.append(start, len(c))
        row, val = ids.indices.to_numpy()[order].astype("<i8"), t.column("weight").to_numpy()[order].astype("<f8")
        r = {"ids": ids.dictionary.to_pylist(), "terms": code.dictionary.take(pa.array(c[start])).to_pylist(), "hashes": h[order][start].astype("<i8").tobytes(), "at": at.astype("<i8").tobytes(), "row": row.tobytes(), "val": val.tobytes()}
        n = min(wide, int(t.column("_n")[0].as_py()))
        block = Block(r | {"q": np.zeros((len(r["ids"]), n)).tobytes()})
        q = np.zeros((len(block.ids), n))
        for a, b, x in block.columns():
            q += x @ _signs(block.hash[a:b], n)
        r |= {"q": q.tobytes(), "_b": t.column("_b")[0].as_py()} | {g: t.column(g)[0].as_py() for g in by}
        return pa.Table.from_pylist([r], schema)

    return run


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _summed(df: DataFrame, by: list[str], of: Callable[[dict], np.ndarray], use: Callable[[np.ndarray], np.ndarray], spark_by: str, arrow_by: list[pa.Field]) -> DataFrame:
    """A matrix per instance: the sum of `of` over df's rows, then `use` of it.
    Each task adds up what it has before rows of the matrices are exchanged."""
    one = pa.schema([*arrow_by, ("i", pa.int32()), ("v", pa.binary())])
    two = pa.schema([*arrow_by, ("m", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [dict(zip(by, g)) | {"i": i, "v": v.tobytes()} for g, m in have.items() for i, v in enumerate(m)]
            have.clear()
            return pa.RecordBatch.from_pylist(rows, one)

        for r in _rows_of(batches):
            g = tuple(r[c] for c in by)
            m = of(r)
            have[g] = have[g] + m if g in have else m
            if len(have) >= 32:
                yield flush()
        if have:
            yield flush()

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x, "<f8") for x in t.column("v").to_pylist()], axis=0)
        return pa.Table.from_pylist([{c: t.column(c)[0].as_py() for c in by} | {"i": t.column("i")[0].as_py(), "v": v.tobytes()}], one)

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        m = use(np.array([np.frombuffer(x, "<f8") for x in t.column("v").to_pylist()]))
        return pa.Table.from_pylist([{c: t.column(c)[0].as_py() for c in by} | {"m": np.ascontiguousarray(m).tobytes()}], two)

    rows = df.mapInArrow(partial, f"{spark_by}i int, v binary").groupBy(*by, "i").applyInArrow(add, f"{spark_by}i int, v binary")
    return rows.groupBy(*by).applyInArrow(finish, f"{spark_by}m binary")


def _basis(gram: np.ndarray) -> np.ndarray:
    """What q is multiplied by to have orthonormal columns; directions without
    weight go."""
    s, v = np.linalg.eigh(gram)
    keep = s > max(s.max(), 0) * 1e-13 + 1e-300
    return v[:, keep] / np.sqrt(s[keep])


def svd_embed(weights: DataFrame, id_col: str, dims: int = 256, by: list[str] | None = None, rounds: int = 2) -> DataFrame:
    """Unit vectors from a truncated SVD of each instance's long-form matrix (id,
    term, weight), padded with 0 to `dims`: by, id, embedding (array of float).

    An instance is a value of `by`; without it all rows are one. The rank is
    min(dims, max(2, min(rows, terms) - 1)), and no more than the matrix has.
    Signs and rotations inside equal singular values are free. Rows and terms
    are those with a weight; null weights, ids and terms are left out; a cell
    given twice counts once, with the larger weight. No rows give none.

    The matrix lies in blocks of ROWS rows. q, a few hundred numbers per row,
    begins as the product with random signs that a term's hash determines, is
    made orthonormal by its small Gram matrix, and spans the rows' space: exactly
    where an instance has at most dims + OVER rows, and by `rounds` of subspace
    iteration else, in which terms sum the blocks' columns and send them back. No
    task has more than a block, the rows of q for one term, or one instance's
    matrix of dims + OVER columns and rows.
    """
    spark = weights.sparkSession
    ship(spark)
    by = list(by or [])
    wide = dims + OVER
    w = weights.select(*by, F.col(id_col).alias("id"), "term", F.col("weight").cast("double").alias("weight")).where("id is not null and term is not null and weight is not null")
    w = w.groupBy(*by, "id", "term").agg(F.max("weight").alias("weight")).where("weight <> 0")
    rows = w.groupBy(*by, "id").agg(F.count("*").alias("_c"))
    terms = w.select(*by, "term").distinct()
    if not by:
        w, rows, terms = (x.withColumn("_all", F.lit(0)) for x in (w, rows, terms))
        by = ["_all"]
    size = stored(rows.groupBy(*by).agg(F.count("*").alias("_n")).join(terms.groupBy(*by).agg(F.count("*").alias("_t")), by), "sizes")
    most = size.agg(F.max("_n")).first()[0] or 0
    kinds = {f.name: f.dataType.simpleString() for f in w.schema}
    spark_by = "".join(f"{c} {kinds[c]}, " for c in by)
    arrow = w.select(*by, "id").limit(0).toArrow().schema
    arrow_by = [arrow.field(c) for c in by]
    block = [*arrow_by, ("_b", pa.int64()), ("ids", pa.list_(arrow.field("id").type)), ("terms", pa.list_(pa.string())), *((c, pa.binary()) for c in ("hashes", "at", "row", "val", "q"))]
    block_sql = f"{spark_by}_b long, ids array<{kinds['id']}>, terms array<string>, hashes binary, at binary, row binary, val binary, q binary"
    schema = pa.schema(block)
    w = w.join(size, by).withColumns({"_b": F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / ROWS)).cast("long"), "h": F.xxhash64("term")})
    state = stored(w.groupBy(*by, "_b").applyInArrow(_pack(by, wide, schema), block_sql), "blocks")

    def turned(state: DataFrame, matrix: DataFrame) -> DataFrame:
        """q times the instance's matrix."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows_of(batches):
                q = np.frombuffer(r["q"], "<f8").reshape(len(r["ids"]), -1)
                m = np.frombuffer(r.pop("m"), "<f8").reshape(q.shape[1], -1)
                yield pa.RecordBatch.from_pylist([r | {"q": np.ascontiguousarray(q @ m).tobytes()}], schema)

        each = matrix.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        return state.withColumn("_p", F.pmod("_b", F.lit(DEALT)).cast("int")).join(each, [*by, "_p"]).select(*[f.name for f in schema], "m").mapInArrow(run, block_sql)

    def orthonormal(state: DataFrame) -> DataFrame:
        def gram(r: dict) -> np.ndarray:
            q = np.frombuffer(r["q"], "<f8").reshape(len(r["ids"]), -1)
            return q.T @ q

        for _ in range(2):  # the second time for what rounding left
            state = stored(turned(state, _summed(state, by, gram, _basis, spark_by, arrow_by)), "blocks")
        return state

    def term_sums(state: DataFrame) -> DataFrame:
        """Per term the sum of its weights times q."""
        out = pa.schema([*arrow_by, ("term", pa.string()), ("v", pa.binary())])

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows_of(batches):
                k = Block(r)
                for a, b, x in k.columns():
                    v = x.T @ k.q
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in by} | {"term": k.terms[i], "v": v[i - a].tobytes()} for i in range(a, b)], out)

        def add(t: pa.Table) -> pa.Table:
            v = np.sum([np.frombuffer(x, "<f8") for x in t.column("v").to_pylist()], axis=0)
            return pa.Table.from_pylist([{c: t.column(c)[0].as_py() for c in by} | {"term": t.column("term")[0].as_py(), "v": v.tobytes()}], out)

        parts = state.mapInArrow(columns, f"{spark_by}term string, v binary")
        # a term that all blocks have is summed in parts
        part = parts.withColumn("_p", F.pmod(F.monotonically_increasing_id(), F.lit(DEALT)))
        part = part.groupBy(*by, "term", "_p").applyInArrow(add, f"{spark_by}term string, v binary") if most > ROWS * DEALT else parts
        return part.groupBy(*by, "term").applyInArrow(add, f"{spark_by}term string, v binary") if most > ROWS else part

    def iterated(state: DataFrame) -> DataFrame:
        """q becomes the matrix times its transpose times q."""
        sums = stored(term_sums(state), "terms")
        asked = state.select(*by, "_b", F.explode("terms").alias("term")).join(sums, [*by, "term"]).select(*[F.col(c).alias(f"_{c}_of") for c in by], F.col("_b").alias("_of"), "term", "v")

        def run(own: pa.Table, got: pa.Table) -> pa.Table:
            r = own.to_pylist()[0]
            k, place = Block(r), {t: i for i, t in enumerate(got.column("term").to_pylist())}
            v = got.column("v")
            q = np.zeros_like(k.q)
            for a, b, x in k.columns():
                q += x @ np.array([np.frombuffer(v[place[t]].as_py(), "<f8") for t in k.terms[a:b]])
            return pa.Table.from_pylist([r | {"q": q.tobytes()}], schema)

        return stored(state.groupBy(*by, "_b").cogroup(asked.groupBy(*[f"_{c}_of" for c in by], "_of")).applyInArrow(run, block_sql), "blocks")

    state = orthonormal(state)
    for _ in range(rounds if most > wide else 0):
        state = orthonormal(iterated(state))

    def outer(r: dict) -> np.ndarray:
        v = np.frombuffer(r["v"], "<f8")
        return np.outer(v, v)

    def directions(c: np.ndarray) -> np.ndarray:
        s, v = np.linalg.eigh(c)
        order = np.argsort(-s)[:dims]
        return v[:, order] * np.sqrt(np.maximum(s[order], 0))

    done = turned(state, _summed(term_sums(state), by, outer, directions, spark_by, arrow_by)).join(size, by)
    kind = pa.schema([*arrow_by, arrow.field("id"), ("embedding", pa.list_(pa.float32()))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            q = np.frombuffer(r["q"], "<f8").reshape(len(r["ids"]), -1)
            q = q[:, : min(dims, max(2, min(r["_n"], r["_t"]) - 1))]
            q = q / (np.linalg.norm(q, axis=1, keepdims=True) + EPS)
            full = np.zeros((len(q), dims), np.float32)
            full[:, : q.shape[1]] = q
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in by} | {"id": i, "embedding": v} for i, v in zip(r["ids"], full)], kind)

    out = done.mapInArrow(vectors, f"{spark_by}id {kinds['id']}, embedding array<float>")
    return out.select(*[c for c in by if c != "_all"], F.col("id").alias(id_col), "embedding")
