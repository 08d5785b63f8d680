"""The word kernel, quality rules, licences and decontamination against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import decontaminate, licenses, quality
from sieveline.llm.kernel import Words, blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet=st.sampled_from("ab cA\n\té#_\x00 Z"), max_size=60), min_size=1, max_size=6)


def buffers(texts):
    enc = [t.encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])]).astype(np.int64)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    buf, at = buffers(texts)
    for lower, alnum, rx in ((True, False, WORD), (False, False, WORD), (True, True, licenses._WORD)):
        w = Words(buf, at, lower=lower, alnum=alnum)
        fold = (lambda s: s.translate(licenses._FOLD)) if lower else (lambda s: s)
        want = [(d, x) for d, t in enumerate(texts) for x in rx.findall(fold(t))]
        got = [(int(d), fold(buf[a:b].tobytes().decode())) for d, a, b in zip(w.doc, w.start, w.end)]
        assert got == want
        same = collections.defaultdict(set)
        for (_, x), k in zip(want, w.key.tolist()):
            same[x].add(k)
        assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_blocks_cover_all_rows():
    col = pa.array(["a" * 50, None, "", "b" * 500, "c"])
    assert [(i, j) for i, j, _, _ in blocks(col, 60)] == [(0, 3), (3, 4), (4, 5)]
    long = "word " * 500_000  # more than a segment
    buf, at = buffers([long])
    assert len(Words(buf, at).key) == 500_000


def brute_quality(t, shortest):
    w = WORD.findall(t or "")
    n = len(w)
    out = {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t or "")}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    out["n_dup_lines"] = dup
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    out["n_repeat_words"] = len({i + k for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})
    best = [0] * n
    for a in range(n):
        for b in range(n):
            if a != b:
                k = 0
                while max(a, b) + k < n and w[a + k] == w[b + k]:
                    k += 1
                best[a] = max(best[a], k)
    out["covered_words"] = len({i + k for i in range(n) if best[i] >= shortest for k in range(best[i])})
    out["longest_repeat"] = max(best, default=0)
    return out


@given(st.lists(st.text(alphabet=st.sampled_from("ab \n#"), max_size=80), min_size=1, max_size=5))
@settings(max_examples=120, deadline=None)
def test_quality_counts(texts):
    got = quality.block_stats(*buffers(texts), 3)
    for k, t in enumerate(texts):
        assert {f: int(got[f][k]) for f in got} == brute_quality(t, 3)


def test_quality_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    long_repeat = " ".join([f"p{i}" for i in range(110)] * 2 + [f"w{i}" for i in range(400)])
    rows = [(1, clean), (2, None), (3, ""), (4, "short text"), (5, "a b c " * 60), (6, long_repeat), (1, clean), (None, clean)]
    df = spark.createDataFrame([(*r, False, 7) for r in rows], "doc_id long, text string, kept boolean, n_words int")
    out = quality.quality_rules(df).collect()
    assert [r.kept for r in out] == [True, False, False, False, False, False, True, True]
    assert out[5].base_failed is False and out[5].longest_repeat == 110
    assert quality.quality_rules(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in quality.passing(df).collect()) == ["1", "1", "None"]
    assert quality.passing(df).columns == df.columns


def test_quality_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 2500}
    for r in quality.quality_rules(docs).collect():
        if r.doc_id in texts:
            want = brute_quality(texts[r.doc_id], quality.SHORTEST)
            assert {f: r[f] for f in want} == want


def brute_licenses(t):
    w = licenses._WORD.findall((t or "").translate(licenses._FOLD))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_base_and_rules(spark, sf):
    more = [(-1, None), (-2, ""), (-3, "GNU General Public License, MIT license mit license"), (-4, "cc by-sa 4.0"), (-5, "mit der license")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(licenses.rules()) >= 200
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert rows[-4].labels == "cc-by,cc-by-sa" and rows[-5].labels == "" and rows[-3].n_base == 3
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ('Licensed under the Apache License, Version 2.0 (the "License")', "apache-2.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("GNU Lesser General Public License version 2.1", "lgpl-2.1"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("CC-BY-NC-SA 4.0", "cc-by-nc-sa"),
    ],
)
def test_signatures(text, want):
    assert {r.label for _, _, r in licenses.detect(text)} == {want}


def test_keywords_stand_in_every_match():
    for _, needs, pattern, _, _ in licenses.TEXTS:
        fixed = re.sub(r"\(\?:[^()]*\)\??", " ", pattern)
        assert set(needs.split()) <= set(re.findall("[a-z]+", fixed)), pattern


def brute_overlaps(doc, item, need, penalty):
    best = None
    for start in range(-len(item) + 1, len(doc)):
        lo, hi = max(start, 0), min(start + len(item), len(doc))
        same = np.array([doc[p] == item[p - start] for p in range(lo, hi)])
        if same.sum() >= need:
            a, b, c = decontaminate.best_segment(same, penalty)
            if c >= need:
                row = (-c, lo + a, b - a)
                best = min(best, row) if best else row
    return best


def test_decontamination_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"v{rng.integers(0, 400)}"
    items = [[word() for _ in range(n)] for n in (40, 25, 20, 9, 5, 13)]
    docs = [[word() for _ in range(120)] for _ in range(60)]
    for k in range(0, 60, 2):  # plant, with up to two substituted words
        it = list(items[k // 2 % len(items)])
        for _ in range(k % 3 if len(it) > 18 else 0):
            it[int(rng.integers(0, len(it)))] = "other"
        p = int(rng.integers(0, 100))
        docs[k][p : p + 1] = it
    rows = [(i, " ".join(d).upper() if i % 4 == 0 else ", ".join(d)) for i, d in enumerate(docs)] + [(99, None), (100, ""), (None, " ".join(items[0]))]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, item_id string, item int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (-r.n_matched, r.start_word, r.end_word - r.start_word) for r in decontaminate.contaminated(df, bench).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, it in enumerate(items):
            need = min(13, int(np.ceil(0.8 * len(it))))
            if b := brute_overlaps(d, it, need, 3):
                want[i, j] = b
    want[None, 0] = (-40, 0, 40)
    assert got == want
    clean = {r.doc_id for r in decontaminate.uncontaminated(df, bench).collect()}
    assert clean == {r[0] for r in rows} - {i for i, _ in got}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_short_items_in_every_way():
    """Items of 1 to 15 words, and documents that have any of their words."""
    for n in range(1, 16):
        ways = range(1 << n) if n < 12 else random.Random(n).sample(range(1 << n), 2500)
        need = min(13, int(np.ceil(0.8 * n)))
        item = [f"i{k}" for k in range(n)]
        docs = [["x", *(w if way >> k & 1 else "other" for k, w in enumerate(item)), "y"] for way in ways]
        docs += [["x", "y", *item[a:]] for a in range(n)] + [item[: b + 1] for b in range(n)]
        t = decontaminate.TestSet([" ".join(item)], 13, 0.8, 3)
        got = decontaminate._overlaps(t, *buffers([" ".join(d) for d in docs]), 3)
        want = {(k, 0): b for k, d in enumerate(docs) if (b := brute_overlaps(d, item, need, 3))}
        assert got == want, n


def test_masks_hit_every_long_stretch():
    for n in range(16, 23):
        ways = np.arange(1, 1 << n)
        ways = ways[(ways & 1 > 0) & (ways >> (n - 1) & 1 > 0) & (np.bitwise_count(ways) >= 13)]
        best = decontaminate.best_segments((ways[:, None] >> np.arange(n)) & 1 > 0, 3)
        left = ways[(best[2] >= 13) & (best[0] == 0) & (best[1] == n)]
        assert len(left)
        for mask in decontaminate.MASKS:
            bits = sum(1 << j for j, c in enumerate(mask) if c == "#")
            for at in range(n - len(mask) + 1):
                left = left[left & (bits << at) != bits << at]
        assert not len(left)


def test_decontamination_of_long_texts(spark):
    item = " ".join(f"q{k}" for k in range(20))
    text = "word " * 300_000 + item + " word" * 300_000
    df = spark.createDataFrame([(1, text), (2, "word " * 300_000)], "doc_id long, text string")
    assert [(r.doc_id, r.n_matched, r.start_word) for r in decontaminate.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, 20, 300_000)]


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(15))) for i in range(12)]
    docs = spark.createDataFrame([(i, "pre " + t + " post") for i, t in items], "doc_id long, text string")
    out = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, i) for i, _ in items}
    more = docs.union(spark.createDataFrame([(99, "clean text")], "doc_id long, text string"))
    assert [r.doc_id for r in decontaminate.uncontaminated(more, spark.createDataFrame(items, "item_id long, text string")).collect()] == [99]


def spellings(pattern):
    """Texts that a pattern matches: each choice and option, one for any text."""
    outs = [""]
    for op, x in pattern:
        op = str(op)
        if op == "LITERAL":
            more = [chr(x)]
        elif op == "ANY":
            more = ["x"]
        elif op == "IN":
            more = [chr(v) for _, v in x]
        elif op == "BRANCH":
            more = [t for p in x[1] for t in spellings(p)]
        elif op == "SUBPATTERN":
            more = spellings(x[-1])
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT"), op
            more = [t * x[0] for t in spellings(x[2])] + spellings(x[2])
        outs = [a + b for a in outs for b in dict.fromkeys(more)]
    return outs


def brute_resolve(found):
    """Of detections, those that no better one holds, by looking at all pairs."""
    best = lambda x: (-x[2].priority, -(x[1] - x[0]), x[2].order, x[0])
    kept = []
    for d in sorted(found, key=best):
        if not any(a <= d[0] and d[1] <= b for a, b, _ in kept):
            kept.append(d)
    return kept


def test_containment():
    rng = random.Random(6)
    rules = licenses.rules()
    for _ in range(400):
        found = [(a := rng.randrange(40), a + rng.randrange(1, 15), rng.choice(rules)) for _ in range(rng.randrange(25))]
        assert licenses.resolve(found) == brute_resolve(found)


def test_many_detections_take_linear_time():
    import time

    took = []
    for n in (4000, 32_000):
        began = time.perf_counter()
        assert len(licenses.detect("the mit license; apache license 2.0, " * n)) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0]


def test_hand_written_sentences():
    """Each stands in a text as it is written; its label comes out."""
    for line in licenses.SENTENCES.strip().splitlines():
        label, body = line.split(": ", 1)
        for text in spellings(re._parser.parse(body))[:4]:
            assert label in {r.label for _, _, r in licenses.detect(f"So, {text.upper()}. More")}, text


def test_gates_pass_every_spelling():
    n = 0
    for r in licenses.rules():
        body = r.pattern.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        for text in spellings(re._parser.parse(body)):
            assert r.pattern.fullmatch(text), (text, body)
            words = set(text.split(" "))
            assert any(words >= set(need) for need in r.needs), (text, r.needs)
            n += 1
    assert n > 1000


def test_licenses_match_all_patterns_without_gates(spark, sf):
    more = ["CreativeML OpenRAIL-M", "license: openrail", "License: Open-RAIL-M", "SPDX-License-Identifier: GPLv2.0-only", "license gpl v3.0", "license: GPL3.0", "BigCode Open RAIL license", "mulan psl license", "PHP-3.01", "the open rail"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null")
    docs = docs.union(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    rules = licenses.rules()
    for d in docs.collect():
        flat = " ".join(licenses._WORD.findall(d.text.translate(licenses._FOLD)))
        found = [(m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(flat)]
        want = sorted((r.label, flat.count(" ", 0, s), flat.count(" ", 0, e) + 1, r.score) for s, e, r in brute_resolve(found))
        assert sorted((x.label, x.start, x.end, x.score) for x in rows[d.doc_id].detections) == want
    assert [rows[-1 - k].labels for k in range(4)] == ["openrail", "openrail", "openrail", "gpl-2.0"]


def test_quality_of_very_long_texts(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    df = spark.createDataFrame([(1, text), (2, text + " " + text), (3, "one two " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert (got[1].n_words, got[1].kept) == (400_000, True)
    assert (got[2].longest_repeat, got[2].covered_words, got[2].kept) == (400_000, 800_000, False)
    assert got[3].base_failed and got[3].longest_repeat == 599_998


@pytest.mark.parametrize(
    "text, want",
    [
        ("Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("Creative Commons Attribution 3.0 Unported License", "cc-by-3.0"),
        ("Creative Commons Attribution 2.0 license", "cc-by"),
        ("LGPLv2.1", "lgpl-2.1"),
        ("Licensed under GPLv3", "gpl-3.0"),
        ("GPL v3", "gpl-3.0"),
        ("GPL version 2", "gpl-2.0"),
        ("Released under the GPL-3.0 license", "gpl-3.0"),
        ("distributed under the terms of the GNU GPL version 2 or later", "gpl-2.0"),
        ("MPL 2.0", "mpl-2.0"),
        ("the MIT licence", "mit"),
        ("the Apache Licence, version 2.0", "apache-2.0"),
    ],
)
def test_short_and_versioned_names(spark, text, want):
    assert {r.label for _, _, r in licenses.detect(text)} == {want}
    row = licenses.scan_licenses(spark.createDataFrame([(1, f"So: {text}."), (1, f"So: {text}.")], "doc_id long, text string").selectExpr("*", "'x' as labels", "0.1 as score")).collect()
    assert len(row) == 2 and all(r.labels == want for r in row)


def test_no_rule_loses_its_label_to_a_more_general_one():
    """A text of a licence's own name or identifier has its label. (mit: the
    contract's base label is the same.)"""
    for line in [*licenses.LICENSES.strip().splitlines()]:
        label, name, tag = re.split(r"(?<!\(\?): ", line)
        for body, shape in ((name, "under the {}"), (name, "{}"), (tag, "SPDX-License-Identifier: {}")):
            for text in list(spellings(re._parser.parse(body)))[:40]:
                said = shape.format(text)
                got = {r.label for _, _, r in licenses.detect(said)}
                more = {x for x in got if x.startswith(label)}
                assert label in got or more, (said, label, got)
