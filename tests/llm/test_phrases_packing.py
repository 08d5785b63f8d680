"""Phrase collocations against SQL and brute force; packing against the tokenizers library and bounds."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from sieveline.llm import collocations as C
from sieveline.llm import packing as K
from sieveline.llm import queries
from sieveline.llm.kernel import word_array

WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")


def buffers(texts):
    enc = [t.encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])]).astype(np.int64)


@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\né"), max_size=12), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_array(texts):
    words, ofs = word_array(*buffers(texts))
    got = [[w.decode() for w in words[a:b].to_pylist()] for a, b in itertools.pairwise(ofs.tolist())]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def brute(rows, least, top, shortest=2, longest=3):
    """Collocations by the book, of (text, lang) rows."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(C.ENDS, low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < shortest or a < least:
            continue
        bigger = [b for (g, x), b in f.items() if g == lang and len(x) > len(w) and b >= least and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if any(100 * b >= 50 * a for b in bigger):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:top], 1)}


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 as m", "2 as bucket", "'x' as phrase", "3 as f")
    out = [tuple(r) for r in C.collocations(docs, **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_collocations_match_sql(spark, sf):
    assert_same(queries.op11_phrase_collocations(spark, sf), queries.OP11_SQL, connect(sf))


def test_collocations_by_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["a", "b", "B", "çé", "x'y", "d\x0be", "\x00", "ÀB"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "!?"]) for _ in range(rng.integers(0, 60))), [None, "und", "fr", "en"][rng.integers(0, 4)]) for _ in range(60)]
    rows += [(None, "fr"), ("", None), ("A b A b " * 40, "en"), *[("same piece here, twice", "de")] * 30]
    for kw in ({"least": 10, "top": 2000}, {"least": 3, "top": 5}):
        assert found(spark, rows, **kw) == brute(rows, **kw)
    assert found(spark, rows, least=4, top=50, longest=4) == brute(rows, 4, 50, longest=4)


def test_collocations_of_nothing_and_of_one_long_piece(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None), ("", "en"), (" . ", "en")]) == set()
    got = found(spark, [("p q " * 300_000, "en")])
    assert {r[2] for r in got} == {"p q p", "q p q"} and all(r[6] == 600_000 for r in got)


def test_counts_beyond_64_bits_are_exact(spark):
    expr = "(cast(1000000 as decimal(7, 0)) * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    a, left, right = 9_000_000_000_000_001, 9_000_000_000_000_002, 9_000_000_000_000_003
    assert spark.sql(f"SELECT {expr} AS s FROM (SELECT {a}L AS a, {left}L AS l, {right}L AS r)").collect()[0].s == 1_000_000 * a * a // (left * right)


def test_buckets_are_counted_out_of_core(spark, monkeypatch):
    """A bucket that needs more memory than duckdb may use."""
    rows = pa.table({"lang": ["en"] * 600_000, "k": pa.array(np.ones(600_000, np.int8)), "phrase": pa.array([f"word {i % 300_000} of a long enough phrase to need room" for i in range(600_000)], pa.large_string()), "f": np.arange(600_000)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, C._PARTS) as w:
        w.write_table(rows.cast(C._PARTS), max_chunksize=20_000)
    monkeypatch.setattr(C, "MEMORY", "40MB")
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([sink.getvalue().to_pybytes()])], names=["bucket", "parts"])
    got = pa.Table.from_batches(list(C._tally(0)(iter([batch]))))
    assert len(got) == 300_000 and sum(got.column("f").to_pylist()) == 599_999 * 300_000 and set(got.column("bucket").to_pylist()) == {7}


# packing


def library(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    out = []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    return out


def checked(rows, out, capacity):
    """Pieces are the library's, sequences gapless and within bounds; their number."""
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(library(rows, capacity), key=key)
    seq = collections.defaultdict(list)
    for r in out:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        v.sort()
        assert [o for o, _ in v] == [0, *itertools.accumulate(n for _, n in v)][:-1] and sum(n for _, n in v) <= capacity
    return len(seq)


def test_packing_of_the_table(spark, sf):
    df = queries.op12_best_fit_packing(spark, sf)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    out = df.collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, least = checked(rows, out, 4096), -(-sum(r.length for r in out) // 4096)
    assert n <= least + 1


def test_packing_in_many_shards_is_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = K.pack(docs, WORD_BPE, capacity=1024, shard=40).collect()
    n, least = checked(rows, out, 1024), -(-sum(r.length for r in out) // 1024)
    assert n <= 1.03 * least + 2  # shards of 40 pieces leave little choice
    assert sorted(K.pack(docs, WORD_BPE, capacity=1024, shard=40).collect()) == sorted(out)


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other"), (None, "no id"), (4, "word, " * 3000), (5, "x" * 20_000), (6, " \n\t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as shard", "2 as length", "3 as island")
    out = K.pack(docs, WORD_BPE).collect()
    checked(rows, out, 4096)
    assert [r.length for r in out if r.doc_id in (1, 2, 6)] == [1, 1, 1]
    assert K.pack(docs.limit(0), WORD_BPE).collect() == []
    hot = spark.range(300).selectExpr("7L as doc_id", "'one row that all repeat' as text")
    assert len({r.sequence_id for r in K.pack(hot, WORD_BPE, capacity=16, shard=20).collect()}) <= 160


@given(st.text(alphabet=st.sampled_from("aBé'sLl 9.\n\t  Σς<|>endoftx́ǅ\x0b\x1c\x85İ")))
@settings(max_examples=300, deadline=None)
def test_words_are_encoded_as_the_whole_text(text):
    e = encoder()
    text = text.replace("[", "<|ENDOFTEXT|>")
    ids, ofs = e.encode(*buffers([text, "", text + " <|endoftext|>", "it's"]))
    want = [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in (text, "", text + " <|endoftext|>", "it's")]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(ofs.tolist())] == want


_made = []


def encoder():
    if not _made:
        _made.append(K.Encoder(open(WORD_BPE, encoding="utf-8").read()))
    return _made[0]


def test_words_known_are_bounded(monkeypatch):
    monkeypatch.setattr(K, "KNOWN_WORDS", 3)
    e = encoder()
    for t in ("one two three four", "five six", "one seven"):
        assert e.encode(*buffers([t]))[0].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError):
        K.Encoder(open(queries.tokenizer_path(), encoding="utf-8").read())


def bins(assign, size, capacity):
    fill = np.bincount(assign, size)
    assert (assign >= 0).all() and (fill > 0).all() and (fill <= capacity).all()
    return len(fill)


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 101, 200)
    a, b = (np.empty(200, np.int64) for _ in range(2))
    for x in (a, b):
        K.best_fit(size, rng.permutation(200), x, [], 100)
    for _ in range(50):
        a, b = b, K.crossover(a, b, size, 100, rng)
        bins(b, size, 100)


def test_evolution_beats_best_fit():
    """Triplets that fill a bin exactly: best fit alone wastes some; epochs with
    migrants are never worse than without."""
    rng = np.random.default_rng(5)
    gain = 0
    for seed in range(3):
        x = rng.integers(380, 490, 40)
        y = (1000 - x - rng.integers(250, 255, 40)).clip(250)
        size = np.concatenate([x, y, 1000 - x - y])
        plain = np.empty(len(size), np.int64)
        K.best_fit(size, np.argsort(-size, kind="stable"), plain, [], 1000)
        one = K.evolve(size, [], [seed], 1000, crossovers=200)
        two = K.evolve(size, one + K.evolve(size, [], [seed + 9], 1000, crossovers=200)[:1], [seed + 1], 1000, crossovers=200)
        n = [bins(m[0], size, 1000) for m in ([plain], one, two)]
        assert 40 <= n[2] <= n[1] <= n[0]
        gain += n[0] - n[2]
    assert gain > 0
