"""A stored inverted index for BM25: built once, appended to, searched without scoring all pairs.

Layout of an index under its path:

* ``docs``: doc_id, len, in a folder per batch; a document is indexed once it is here;
* ``postings``: a row per block of at most BLOCK postings of a token, in a folder
  per batch and per ``part`` (a hash of the token), sorted by token: n, the
  largest count, the smallest length and the largest weight (at the batch's mean
  length) in the block, and its postings (doc_id, c, len). Blocks hold postings
  of like weight, so that these numbers bound well what a posting of the block
  can add to a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.readers import parquet_or_none
from .retrieval import BROADCAST_ROWS, K1, MOST_PARTS, MOST_TARGETS, PAIRS, B, counted, ranked, sized

#: Postings of a block; folders by token; documents to a salt, which bounds the
#: postings of a token that are sorted in one task.
BLOCK, PARTS, SALTED = 128, 64, 1_000_000
#: Words of new documents to a partition in which their postings are sorted.
POSTINGS = 2_000_000
#: Documents per query that are scored exactly to learn what a score must reach.
SEEDS = 4
#: Scores are compared after rounding to 6 digits: what a bound may fall short.
SLACK = 2e-6
_DOCS = "doc_id {kind}, len long, batch int"
_POSTINGS = "token string, salt int, block long, n long, most long, least long, w double, avg double, postings array<struct<doc_id:{kind},c:long,len:long>>, batch int, part int"


def _part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def _docs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = _DOCS.format(kind=kind)
    return parquet_or_none(spark, f"{path}/docs", schema)


def append(docs: DataFrame, path: str, doc_id: str, tokens: str) -> int:
    """Index the documents that the index does not hold yet; returns how many.

    Ids are compared without texts, and words are counted where their text lies.

    docs: an id and an array of tokens (null: none). Of repeated ids one row is
    taken, the one with the most tokens, ties by their order as text. Null ids
    are left out. Postings are written before the list of documents, into the
    next batch's folder, which a run that broke off before the list is written
    fills anew.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    have = _docs(spark, path, kind)
    toks = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    new = docs.select(F.col(doc_id).alias("doc_id"), toks.alias("t")).where("doc_id is not null")
    ids = stored(new.groupBy("doc_id").agg(F.count("*").alias("n")).join(have.select("doc_id"), "doc_id", "left_anti"), "new_ids")
    n, most = ids.agg(F.count("*"), F.max("n")).first()
    if not n:
        return 0
    last = have.agg(F.max("batch")).first()[0] or 0
    if last:
        new = new.join(sized(ids.select("doc_id"), MOST_TARGETS), "doc_id", "left_semi")
    if most > 1:  # only repeated ids' texts meet
        again = sized(ids.where("n > 1").select("doc_id"), MOST_TARGETS)
        best = new.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("t", F.struct(F.size("t"), F.xxhash64("t"))).alias("t"))
        new = new.join(again, "doc_id", "left_anti").unionByName(best)
    new = new.withColumn("len", F.size("t").cast("long"))
    lens = stored(new.select("doc_id", "len"), "new_docs")
    avg, words = lens.agg(F.avg("len"), F.sum("len")).first()
    batch = last + 1
    # a token's postings of a salt lie in one partition, which is all that their
    # blocks and the folders ask for: postings are shuffled once
    salts, parts = -(-n // SALTED), max(spark.sparkContext.defaultParallelism, min(MOST_PARTS, -(-words // POSTINGS)))
    c = counted(new, "t", ["doc_id", "len"])
    place = {"part": _part(F.col("token")), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"), "fold": F.pmod(F.hash("token"), F.lit(-(-parts // (PARTS * salts))))}
    c = c.withColumns(place).repartition(parts, *place)
    c = c.withColumn("_w", F.col("c") / (F.col("c") + K1 * (1 - B + B * F.col("len") / F.lit(max(avg, 1e-9)))))
    no = F.row_number().over(Window.partitionBy(*place, "token").orderBy(F.desc("_w"), "doc_id"))
    blocks = c.withColumn("block", F.floor((no - 1) / BLOCK)).groupBy(*place, "token", "block").agg(F.count("*").alias("n"), F.max("c").alias("most"), F.min("len").alias("least"), F.max("_w").alias("w"), F.collect_list(F.struct("doc_id", "c", "len")).alias("postings"))
    blocks = blocks.withColumn("avg", F.lit(float(avg))).drop("fold")
    blocks.sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings/batch={batch}")
    lens.write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
    return n


@dataclass
class Searched:
    """Ranked rows, and what the search read: blocks and postings of the queries'
    tokens, those whose pairs were formed, and the pairs scored."""

    rows: DataFrame
    blocks: int
    postings: int
    blocks_paired: int
    postings_paired: int
    pairs: int


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, tokens: str, k: int = 10, digits: int = 6, kind: str = "bigint") -> Searched:
    """The k best documents of each query by BM25, score (rounded), then doc_id:
    query_id, doc_id, score, rank. Queries without a known token have no rows; an
    empty index gives none.

    What a token can add to a score is known from its blocks' bounds. A few
    documents per query, the best by their tokens' first blocks, are scored
    exactly; the k-th of them is what a document must reach. With a query's
    tokens in a fixed order, the common ones first, a document's last token adds
    at most its block's bound, and the tokens before it at most theirs: pairs are
    formed only from blocks where this reaches far enough. Pairs whose sum and
    the closed blocks' bounds stay below it go before the rest is scored. No
    step drops a document that could be among the k best.

    Postings are shuffled by document, a row each, and pairs are formed and added
    up where they then lie. The pairs left are sent to the postings if they are
    few; else all postings of the queries' tokens are added up by document.
    """
    docs = _docs(spark, path, kind)
    corpus_n, avg, last = docs.agg(F.count("*"), F.avg("len"), F.coalesce(F.max("batch"), F.lit(0))).first()
    q = stored(queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokens)).alias("token")).where("q is not null and token is not null").distinct(), "query_tokens")
    vocab = q.select("token").distinct()
    out = spark.createDataFrame([], f"q {q.schema['q'].dataType.simpleString()}, doc_id {kind}, score double, rank int").withColumnRenamed("q", query_id)
    if not last or q.isEmpty():
        return Searched(out, 0, 0, 0, 0, 0)
    parts = [r[0] for r in vocab.select(_part(F.col("token")).alias("p")).distinct().collect()]  # PARTS numbers at most
    index = spark.read.schema(_POSTINGS.format(kind=kind)).parquet(f"{path}/postings").where((F.col("batch") <= last) & F.col("part").isin(parts))
    # what bounds need: no postings are read yet
    weight = lambda c, n: (K1 + 1) * c / (c + K1 * (1 - B + B * n / F.lit(max(avg, 1e-9))))
    # a weight grows with the mean length, at most in proportion
    then = (K1 + 1) * F.col("w") * F.greatest(F.lit(1.0), F.lit(avg) / F.col("avg"))
    bound = (F.least(weight(F.col("most"), F.col("least")), then) * F.col("idf")).alias("bound")
    block = ["token", "batch", "salt", "block"]
    meta = index.select(*block, "n", "most", "least", "w", "avg").join(sized(vocab), "token")
    df = F.col("df")
    idf = F.log1p((F.lit(corpus_n) - df + 0.5) / (df + 0.5))
    known = stored(meta.groupBy("token").agg(F.sum("n").alias("df")).select("token", "df", idf.alias("idf")), "known")
    if known.isEmpty():
        return Searched(out, 0, 0, 0, 0, 0)
    meta = stored(meta.join(sized(known), "token").select(*block, "n", "df", "idf", bound), "blocks")
    top = meta.groupBy("token").agg(F.max("bound").alias("top"), F.first("idf").alias("idf"), F.first("df").alias("df"))
    terms = stored(q.join(top, "token"), "terms")
    add = F.sum(F.col("idf") * weight(F.col("c"), F.col("len"))).alias("s")

    def exploded(blocks: DataFrame, *columns: str | Column) -> DataFrame:
        return blocks.select(*columns, F.explode("postings").alias("_p")).select(*blocks.select(*columns).columns, "_p.*")

    def asked(pairs: DataFrame) -> DataFrame:
        """The scores s of given pairs (q, doc_id)."""
        have = exploded(index.join(sized(known.select("token")), "token"), "token")
        return have.join(sized(pairs), "doc_id").join(sized(terms.select("q", "token", "idf")), ["q", "token"]).groupBy("q", "doc_id").agg(add)

    first = meta.groupBy("token").agg(F.max_by(F.struct("batch", "salt", "block"), F.struct("bound", "batch", "salt", "block")).alias("_b")).select("token", "_b.*")
    chosen = stored(terms.join(first, "token").select("q", "idf", *block), "first_blocks")
    seen = exploded(sized(chosen).join(index, block), "q", "idf").groupBy("q", "doc_id").agg(add)
    seeds = stored(ranked(seen, ["q"], "s", ["doc_id"], "no", SEEDS * k).select("q", "doc_id"), "seeds")
    reach = stored(ranked(asked(seeds), ["q"], "s", ["doc_id"], "no", k).where(F.col("no") == k).select("q", (F.col("s") - SLACK).alias("reach")), "reach")
    # a document is looked for by the last of its tokens in this order: the ones
    # before it are all that it can have besides
    before = F.sum("top").over(Window.partitionBy("q").orderBy(F.col("top") / F.col("df"), "token")) - F.col("top")
    terms = stored(terms.join(reach, "q", "left").withColumns({"before": before, "reach": F.coalesce("reach", F.lit(0.0))}), "terms")
    by_query = sized(terms.select("q", "token", "idf", "before", "reach"))
    is_open = F.col("bound") + F.col("before") >= F.col("reach")
    per = stored(meta.drop("idf", "df").join(by_query, "token").where(~is_open).groupBy("q", "token").agg(F.max("bound").alias("b")).groupBy("q").agg(F.sum("b").alias("rest")), "rest")
    # blocks that are open to some query; SLACK, as a difference may round
    some = sized(stored(terms.groupBy("token").agg(F.first("idf").alias("idf"), (F.min(F.col("reach") - F.col("before")) - SLACK).alias("least_bound")), "open"))
    # their postings meet by document, once; pairs are formed and added up there
    spread = max(spark.sparkContext.defaultParallelism, min(MOST_PARTS, -(-corpus_n * terms.select("q").distinct().count() // PAIRS)))
    posted = exploded(index.join(some, "token").withColumn("bound", bound).where("bound >= least_bound"), "token", "bound").repartition(spread, "doc_id")
    seen_pairs = Observation()
    pairs = posted.join(by_query, "token").where(is_open).groupBy("q", "doc_id").agg(add).observe(seen_pairs, F.count(F.lit(1)).alias("n"))
    able = lambda pairs, most: pairs.join(sized(reach), "q", "left").where(F.col("reach").isNull() | (most >= F.col("reach")))
    left = stored(able(pairs.join(sized(per), "q", "left"), F.col("s") + F.coalesce("rest", F.lit(0.0))).select("q", "doc_id"), "left")
    if left.count() <= BROADCAST_ROWS:
        total = asked(left)
    else:
        whole = exploded(index.join(sized(known.select("token")), "token"), "token").repartition(spread, "doc_id")
        total = able(whole.join(by_query, "token").groupBy("q", "doc_id").agg(add), F.col("s"))
    total = total.select("q", "doc_id", F.round("s", digits).alias("score"))
    rows = ranked(total, ["q"], "score", ["doc_id"], k=k).select(F.col("q").alias(query_id), "doc_id", "score", "rank")
    count = lambda d: tuple(int(x or 0) for x in d.agg(F.count("*"), F.sum("n")).first())
    return Searched(rows, *count(meta), *count(meta.drop("idf").join(some, "token").where("bound >= least_bound")), seen_pairs.get["n"])
