"""The pipeline against a version by brute force."""

import struct

from test_duplicates import brute_components, brute_cut
from test_words import brute_quality

import corpus_pipeline as P
from sieveline.llm import decontaminate, queries, quality


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    keep = {}
    for i, x in docs.items():
        q = brute_quality(x, quality.SHORTEST) if len(x) < 6000 else None
        if q is None:  # too slow by brute force; the kernel is tested elsewhere
            row = quality.quality_rules(spark.createDataFrame([(i, x)], "doc_id long, text string")).first().asDict()
            q = row
        if q["n_words"] >= 50 and 100 * q["n_repeat_words"] <= 50 * q["n_words"] and q["covered_words"] <= quality.COVERED * q["n_words"] and q["longest_repeat"] <= quality.LONGEST:
            keep[i] = x
    comp = brute_components(list(keep.items()))
    keep = {i: x for i, x in keep.items() if comp[i][1] == i}
    cut = brute_cut(list(keep.items()))
    keep = {i: (cut[i][2] if cut[i][1] else x) for i, x in keep.items() if cut[i][1] < cut[i][0]}
    leaks = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(list(keep.items()), "doc_id long, text string"), items).collect()}
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in keep.items() if i not in leaks}
    got = {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in P.run(spark, sf).collect()}
    assert got == want


def test_stage_columns_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = " ".join(f"w{i}" for i in range(80))
    odd = spark.createDataFrame([(1, None, "en", None, 0), (2, "", None, "s", 0), (3, t, "en", "s", 9), (4, t + " more", "en", "s", 9)], docs.schema)
    for k, (_, stage) in enumerate(P.STAGES):
        for df in (odd, docs.limit(0)):
            out = stage(spark, df, sf)
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            n = out.count()
            assert df is odd or n == 0
    assert len(P.STAGES) == 5


def test_stages_keep_odd_rows_apart(spark, sf):
    """Null ids, repeated rows, very long texts, and columns with the operators' names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = " ".join(f"w{i}" for i in range(80))
    long_ = " ".join(f"v{i}" for i in range(60_000))
    rows = [(3, t, "en", "s", 9), (3, t, "en", "s", 9), (None, t, None, "s", 9), (5, long_, "en", "s", 9), (6, None, None, None, None), (7, "", "en", "s", 0)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "'a' as kept", "'b' as component", "1 as n_words", "2 as key", "'c' as kept_text", "3 as cost", "4 as item_id")
    want = {"quality rules": 4, "near dedup": 6, "substring dedup": 4, "decontamination": 6}
    for name, stage in P.STAGES:
        out = stage(spark, odd, sf)
        if name == "bpe":
            assert out.count() == len(rows)
            continue
        assert out.columns == odd.columns
        got = out.collect()
        assert len(got) == want[name] and all(r.cost == 3 and r.kept == "a" and r.item_id == 4 for r in got)
        assert [r.text for r in got if r.doc_id == 5] == [long_]
