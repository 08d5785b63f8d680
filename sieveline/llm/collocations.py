"""Phrase collocations: weighted n-grams of distinct pieces, counted per bucket in duckdb."""

from __future__ import annotations

import itertools
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from .kernel import U, blocks, mix, mix_int, word_array

#: Where pieces end.
ENDS = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of pieces whose n-grams a task combines before it sends them on; hash
#: buckets per shuffle partition; the memory that duckdb may use for one bucket
#: before it goes to disk.
BLOCK, BUCKETS, MEMORY = 3 << 20, 2, "128MB"
#: Parts into which a language's candidates are dealt to be ranked.
DEALT = 64
_PARTS = pa.schema([("lang", pa.string()), ("k", pa.int8()), ("phrase", pa.large_string()), ("f", pa.int64())])


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct pieces of all texts per language, and how often each occurs (m).
    Spark combines equal ones in each task before they are exchanged."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(low, ENDS)).alias("piece"))
    cut = cut.select("lang", F.trim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    return cut.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def block_ngrams(lang: pa.Array, buf: np.ndarray, at: np.ndarray, m: np.ndarray, longest: int, buckets: int) -> tuple[pa.Table, np.ndarray]:
    """The distinct n-grams of a block of pieces with their weights, of 1 to
    `longest` words, and each one's bucket, by which they are ordered. k is the
    number of words; k = 0 has the number of a language's words."""
    langs = lang.dictionary_encode()
    lang_no, lang_hash = langs.indices.to_numpy(), np.array([_hash(x.encode()) for x in langs.dictionary.to_pylist()], U)
    words, ofs = word_array(buf, at)
    coded = words.dictionary_encode()
    by_name = pc.array_sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(by_name)).cast(pa.large_string())
    number = np.empty(len(names), np.int32)
    number[by_name] = np.arange(len(names))
    code = number[coded.indices.to_numpy()]
    word_hash = np.fromiter(map(_hash, coded.dictionary.to_pylist()), U, len(names))[by_name]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(ofs))
    weight, of = m[row], lang_no[row]
    del words, coded
    totals = np.zeros(len(langs.dictionary), np.int64)
    np.add.at(totals, of, weight)
    found = [(np.arange(len(totals)), 0, pa.array([""] * len(totals), pa.large_string()), totals, lang_hash)]
    # an n-gram is numbered by its first words' number and its last word's
    pos, known = np.arange(len(code), dtype=np.int32), of
    for k in range(1, longest + 1):
        pos = pos[pos + k <= len(code)]
        pos = pos[row[pos] == row[pos + k - 1]]
        if not len(pos):
            break
        key = known[pos] * np.int64(len(names)) + code[pos + k - 1]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        start = np.flatnonzero(new)
        known = np.zeros(len(code), np.int32)
        known[pos[order]] = np.cumsum(new) - 1
        at_first = pos[order[start]]
        said = [names.take(pa.array(code[at_first + j])) for j in range(k)]
        hashed = lang_hash[of[at_first]].copy()
        for j in range(k):
            hashed += word_hash[code[at_first + j]] * U(mix_int(j + 1) | 1)
        found.append((of[at_first], k, pc.binary_join_element_wise(*said, pa.scalar(" ", pa.large_string())), np.add.reduceat(weight[pos][order], start), hashed))
    bucket = (mix(np.concatenate([x[4] for x in found])) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    take = pa.array(order)
    del row, weight, of, pos, known, code
    no = pa.array(np.concatenate([x[0] for x in found])).take(take)
    ks = np.repeat(np.array([x[1] for x in found], np.int8), [len(x[0]) for x in found])
    table = pa.table([langs.dictionary.take(no), pa.array(ks[order]), pa.chunked_array([x[2] for x in found]).take(take), pa.array(np.concatenate([x[3] for x in found])[order])], schema=_PARTS)
    return table, bucket[order]


def _ngrams(longest: int, buckets: int):
    """Pieces -> per block and bucket one row: its n-grams, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = pa.ipc.IpcWriteOptions(compression="zstd")
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for i, j, buf, at in blocks(rows.column("piece"), BLOCK):
                some = rows.slice(i, j - i)
                table, bucket = block_ngrams(some.column("lang").combine_chunks().cast(pa.string()), buf, at, some.column("m").to_numpy(), longest, buckets)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                for a, b in zip(edges.tolist(), edges[1:].tolist()):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, _PARTS, options=packing) as w:
                        w.write_table(table.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "parts"])

        size = 0
        pool = pa.default_memory_pool()
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield from flush()
                pool.release_unused()
                size = 0
        if held:
            yield from flush()

    return run


def _tally(least: int):
    """Packed n-grams, sorted by bucket -> those that occur often enough.

    Each bucket is one out-of-core aggregation in duckdb. What exceeds its memory
    goes to a scratch folder of the running task, as a sort's runs do; no other
    task reads it, and it is gone when the task ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        scratch = tempfile.mkdtemp(prefix="ngrams-")
        rows = ((b, p) for batch in batches for b, p in zip(batch.column(0).to_pylist(), batch.column(1)))
        try:
            for bucket, some in itertools.groupby(rows, lambda x: x[0]):
                with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
                    parts = pa.RecordBatchReader.from_batches(_PARTS, (b for _, p in some for b in pa.ipc.open_stream(p.as_buffer())))
                    con.register("parts", parts)
                    out = con.sql(f"SELECT lang, k, phrase, CAST(sum(f) AS BIGINT) AS f FROM parts GROUP BY lang, k, phrase HAVING k = 0 OR sum(f) >= {int(least)}")
                    for b in out.to_arrow_reader():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, bucket)), *b.columns], names=["bucket", *b.schema.names])
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return run


def ngram_counts(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """n-grams of 1 to `longest` words that occur at least `least` times within
    the pieces of a language, overlaps included: bucket, lang, k (words; 0: all
    words of the language), phrase, f."""
    spark = docs.sparkSession
    ship(spark)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = pieces(docs, text_col, lang_col).mapInArrow(_ngrams(longest, buckets), "bucket long, parts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tally(least), "bucket long, lang string, k byte, phrase string, f long")


def collocations(docs: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` collocations of each language.

    Candidates are phrases of `shortest` to `longest` words with a = f(phrase) >=
    least, f being the number of occurrences inside pieces, overlaps included.
    Cut after k words, a candidate has l = f(first part), r = f(rest) and the
    score floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts, of
    equal ones that with the smallest k. A candidate inside a longer one with
    100 * f(longer) >= inside * a goes. Returns lang, rank (from 1, by score and
    a descending, then phrase in byte order), phrase, a, l, r, n (the language's
    words), score. Counts must be below 10**16 for the arithmetic to be exact.

    A null language is `und`; null and empty texts have no words; very long texts
    and pieces are taken whole; repeated rows count as often as they occur; no
    rows give no rows; extra columns, whatever their names, are ignored.

    Plan: equal pieces combine, before and after one exchange by piece; each task
    combines the n-grams of a block of pieces and sends them by hash bucket,
    where duckdb adds them up out of core: a frequent phrase is a row per block.
    Only frequent n-grams leave. A bucket's candidates ask for their parts'
    counts once each: requests are exchanged by part, where at most a row per
    bucket asks for the same one, and answers by bucket and part.
    """
    counts = stored(ngram_counts(docs, longest, least, text_col, lang_col), "ngrams")
    cand = counts.where(F.col("k") >= shortest).withColumn("_w", F.split("phrase", " "))
    cuts = cand.select("bucket", "lang", "phrase", "_w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("bucket", "lang", "phrase", "a", "cut", F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("_w", F.col("cut") + 1, F.size("_w") - F.col("cut")), " ").alias("rest"))
    asked = cuts.select("bucket", "lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    answers = stored(asked.join(counts.where("k > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "answers")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(answers.select("bucket", "lang", F.col("part").alias(part), F.col("f").alias(name)), ["bucket", "lang", part])
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.groupBy("bucket", "lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_best"))
    best = best.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")
    within = cand.where(F.col("k") > shortest).select("lang", F.col("f").alias("longer"), "_w", "k", F.explode(F.sequence(F.lit(shortest), F.col("k") - 1)).alias("n"))
    within = within.select("lang", "longer", "_w", "n", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("i"))
    within = within.select("lang", "longer", F.array_join(F.slice("_w", F.col("i"), F.col("n")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language is ranked in parts first, whose first rows are few enough for one task
    dealt = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("_no", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_no") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
