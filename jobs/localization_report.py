"""Job: how well BM25 finds the documents that hold given passages.

    python -m jobs.localization_report DOCUMENTS QUERIES OUT [CONFIG]

Reads two Parquet tables, keeps a BM25 index of the documents under OUT/index,
to which each run adds the documents that it does not hold yet, and writes
OUT/ranks, partitioned by the documents' group: the k best documents of every
query, whether they hold its text verbatim (is_target), how many documents do
(n_targets), and the rank of the first that does (first_rank, 0 beyond k). The
shares of queries found at given ranks are logged.

A document is indexed once and its text is not read again for the index, so an
id stands for one text: changed texts need a new OUT. A run repeated over the
same tables adds nothing and writes the same rows; one that broke off is
repeated whole. Documents with a null id aren't indexed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import bm25_index, retrieval
from sieveline.session import stored
from sieveline.sources.readers import parquet_or_none

from . import common

DEFAULTS = {"query_id": "item_id", "doc_id": "doc_id", "text": "text", "group": "lang", "k": 10, "at": [1, 3, 5, 10]}
log = common.log("localization_report")


def ranks_schema(docs: DataFrame, queries: DataFrame, c: dict) -> str:
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    return f"{c['query_id']} {kind(queries, c['query_id'])}, {c['doc_id']} {kind(docs, c['doc_id'])}, score double, rank int, is_target boolean, n_targets long, first_rank int, {c['group']} {kind(docs, c['group'])}"


def run(spark: SparkSession, documents: str, queries: str, out: str, settings: dict | None = None) -> DataFrame:
    """One run; returns OUT/ranks read back."""
    c = DEFAULTS | (settings or {})
    doc, item, text, group = c["doc_id"], c["query_id"], c["text"], c["group"]
    docs, asked = spark.read.parquet(documents), spark.read.parquet(queries)
    log.info("read %d documents of %s and %d queries of %s", docs.count(), documents, asked.count(), queries)
    added = bm25_index.append(docs.select(doc, T.tokens(F.col(text)).alias("t")), f"{out}/index", doc, "t")
    log.info("%d new documents are in the index", added)
    kind = docs.schema[doc].dataType.simpleString()
    found = bm25_index.search(spark, f"{out}/index", asked.select(item, T.tokens(F.col(text)).alias("t")), item, "t", c["k"], kind=kind)
    log.info("search: %d blocks of %d, %d postings of %d, %d pairs", found.blocks_paired, found.blocks, found.postings_paired, found.postings, found.pairs)
    # both are read several times below
    ranks = stored(found.rows.withColumnRenamed("doc_id", doc), "ranks")
    targets = stored(retrieval.holding(docs, asked.select(item, F.col(text).alias("_asked")), doc, text, item, "_asked"), "targets")
    hits = ranks.join(targets.withColumn("is_target", F.lit(True)), [item, doc], "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    first = retrieval.first_hits(ranks, targets, [item], doc)
    groups = docs.join(retrieval.sized(ranks.select(doc).distinct()), doc, "left_semi").groupBy(doc).agg(F.min(group).alias(group))
    report = hits.join(first, item, "left").join(groups, doc, "left")
    names = [f.split()[0] for f in ranks_schema(docs, asked, c).split(", ")]
    report = report.withColumns({"n_targets": F.coalesce("n_targets", F.lit(0)), "first_rank": F.coalesce("first_rank", F.lit(0))}).select(*names)
    report.write.mode("overwrite").partitionBy(group).parquet(f"{out}/ranks")
    back = parquet_or_none(spark, f"{out}/ranks", ranks_schema(docs, asked, c))
    log.info("wrote %d rows to %s/ranks", back.count(), out)
    for r in retrieval.recall_at(first, list(c["at"]), []).orderBy("k").collect():  # a row per k
        log.info("recall at %d: %s of %d queries with a target", r.k, r.hits, r.n)
    return back


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "queries", "out"):
        p.add_argument(name)
    p.add_argument("config", nargs="?", help="a JSON file; jobs/localization_report.json has the defaults")
    a = p.parse_args(argv)
    spark = common.session("localization_report")
    try:
        run(spark, a.documents, a.queries, a.out, common.config(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
