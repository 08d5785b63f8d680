"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet to the shared folder and rereads them as the next
stage's docs. All but the last return the columns of documents, whatever other
columns there are and however they are named. An empty table gives an empty one
at every stage. Stage tables stay until session.clear() removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import encode_decode
from sieveline.llm.decontaminate import uncontaminated
from sieveline.llm.minhash import near_duplicates
from sieveline.llm.quality import passing
from sieveline.llm.queries import tokenizer_path
from sieveline.llm.substring import substring_dedup
from sieveline.session import stored

#: SQL can't express the suffix-array verdict or BPE; see tests/llm.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: among them null, empty and
    short texts. Very long texts are judged whole; repeated rows alike."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the
    smallest id. Null and empty texts link with nothing and stay, and so do rows
    with a null id; repeated rows of one id stay or go together."""
    others = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; texts with cuts become
    their kept words, others stay as they are; emptied documents go, and so do
    those without a word (null and empty texts among them). Rows with a null id
    neither cut nor are cut; repeated rows of one id don't cut each other."""
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substring_dedup(docs, carry=more or ("doc_id",)).where("n_removed < n_words")
    out = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    out = out.select("doc_id", "text", *(F.col(f"extra.{c}").alias(c) for c in more))
    if "n_chars" in more:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none;
    repeated rows and null ids are judged row by row."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text: a row
    per row, null ids included; null and empty texts have no ids."""
    both = encode_decode(docs, tokenizer_path())
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring), ("decontamination", decontaminate), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs
