"""Near-duplicates and substring dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from sieveline.llm import minhash, substring
from sieveline.llm.components import components
from sieveline.llm.fm_index import FMIndex, Wavelet, code_lengths

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    p = {i: i for i, _ in rows}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, u) = sets[a], sets[b]
            if s and u and 100 * len(s & u) >= 85 * len(s | u):
                x, y = root(i), root(j)
                p[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, base = [], [[word() for _ in range(rng.randrange(5, 160))] for _ in range(40)]
    for k, b in enumerate(base):
        rows.append((10 * k, " ".join(b)))
        for j in range(1, rng.randrange(1, 7)):
            c = list(b)
            for _ in range(rng.randrange(0, 4)):
                c[rng.randrange(len(c))] = word()
            rows.append((10 * k + j, "  ".join(c).upper() if j % 2 else "\n".join(c)))
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "one"), (9005, "One"), (9006, "a b c d"), (9007, "a b c d"), (9008, "word " * 30_000)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, component_id int, kept boolean")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit, turns", [(600, 0), (600, 1), (4000, 3)])
def test_large_groups_in_blocks(spark, monkeypatch, unit, turns):
    """Pivots first, in several units, then what is left in blocks."""
    monkeypatch.setattr(minhash, "UNIT", unit)
    monkeypatch.setattr(minhash, "TURNS", turns)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for k in range(120):
        c = list(base)
        for _ in range(rng.randrange(0, 4)):
            c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(c)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_copies_take_linear_pairs(spark, monkeypatch):
    """Members that a pivot links are not compared with each other."""
    monkeypatch.setattr(minhash, "UNIT", 4000)
    kept = []
    compare = minhash._compare
    monkeypatch.setattr(minhash, "_compare", lambda units, *a: kept.append(units.count()) or compare(units, *a))
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:100], f"only{k}", *base[101:]])) for k in range(600)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(kept) == 2 and 599 <= kept[1] < 3 * 600


@pytest.mark.parametrize("most", [50_000, 1])
def test_hot_groups(spark, monkeypatch, most):
    from sieveline.llm import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    monkeypatch.setattr(joins, "MOST_HOT", most)
    rows = corpus(4) + [(20_000 + k, "one text of many copies here, that is " + "again " * 20) for k in range(40)] + [(30_000 + k, "x " * 20) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df).collect()}
    assert cut == brute_cut(rows)


def test_many_short_texts(spark):
    """Sets of few shingles, which bands bring together easily."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for k in range(700)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(3, t), (3, t), (None, t), (5, t + " end"), (4, "other words entirely for this one")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("3", "3", True), ("3", "3", True), ("4", "4", True), ("5", "3", False), ("None", "None", True)]


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 3000):
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        s = minhash.sketch(h, np.array([0, len(h)]))
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    est = []
    for _ in range(20):
        x = rng.integers(0, 2**63, 1200).astype(np.uint64)
        one, two = np.concatenate([x[:800], x[800:1000]]), np.concatenate([x[:800], x[1000:]])
        s = minhash.sketch(np.concatenate([one, two]), np.array([0, 1000, 2000]))
        est.append((s[0] == s[1]).mean())
    assert abs(np.mean(est) - 800 / 1200) < 0.03 and len(a) == 1000


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (150, 150), (None, 3), (7, None), (300, 300)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[150] == got[200] == 100 and got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    for sigma in (1, 2, 5, 300):
        s = rng.integers(0, sigma, 1000)
        w = Wavelet(s, sigma)
        c, i = rng.integers(0, sigma, 200), rng.integers(0, 1001, 200)
        assert w.rank(c, i).tolist() == [int((s[:y] == x).sum()) for x, y in zip(c, i)]


def test_huffman_codes():
    """As short as can be, and the matrix has about the entropy's bits."""
    rng = np.random.default_rng(7)
    for sigma, n in ((2, 50), (40, 3000), (3000, 60_000)):
        p = 1 / np.arange(1, sigma + 1)
        s = rng.choice(sigma, n, p=p / p.sum())
        count = np.bincount(s, minlength=sigma)
        length = code_lengths(count)
        assert (length[count == 0] == 0).all() and abs((0.5 ** length[count > 0]).sum() - 1) < 1e-9
        q = count[count > 0] / n
        entropy = -(q * np.log2(q)).sum()
        w = Wavelet(s, sigma)
        assert entropy <= (count * length).sum() / n < entropy + 1
        assert sum(x.words.size * 64 for x in w.levels) <= (count * length).sum() + 128 * len(w.levels)
    assert code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0] and code_lengths(np.array([0, 0])).tolist() == [0, 0]


def test_fm_index_matching():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(1, 5, int(rng.integers(1, 40))) for _ in range(80)]
    owner = rng.integers(0, 50, 80)
    keys = np.concatenate(pieces).astype(np.uint64) * np.uint64(7919)
    ofs = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    voc, sym = np.unique(keys, return_inverse=True)
    for window in (1, 2, 5, 6, 7, 8, 13, 15, 16, 20):
        index = FMIndex(voc, sym + 1, ofs, owner, window)
        least = {}
        for p, o in zip(pieces, owner):
            for i in range(len(p) - window + 1):
                k = tuple(p[i : i + window])
                least[k] = min(least.get(k, 10**9), int(o))
        other = [rng.integers(1, 6, 60) for _ in range(20)] + pieces
        q = np.concatenate(other).astype(np.uint64) * np.uint64(7919)
        qo = np.concatenate([[0], np.cumsum([len(p) for p in other])])
        got = index.matching(q, qo)
        for d, p in enumerate(other):
            for i in range(len(p)):
                k = tuple(p[i : i + window])
                want = least.get(k, np.iinfo(np.int64).max) if len(k) == window else np.iinfo(np.int64).max
                assert got[qo[d] + i] == want


def brute_cut(rows, window=13):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"{'the' if rng.random() < 0.3 else 'w%d' % rng.randrange(50)}"
    shared = [[word() for _ in range(n)] for n in (13, 14, 30, 60, 12)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.randrange(len(w) + 1)
            w[p:p] = rng.choice(shared)
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + k, rows[k][1]) for k in range(10)]
    rows += [(2001, None), (2002, ""), (2003, "short copy"), (2004, "short copy"), (2005, "again and again " * 20), (2006, "again and again " * 30)]
    return rows


def test_windows_of_other_lengths(spark):
    rows = passages(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 3, 6, 17):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df, window=window).collect()}
        assert got == brute_cut(rows, window), window
    with pytest.raises(ValueError):
        substring.substring_dedup(df, window=0)


def test_shared_anchors_of_any_batches():
    """Runs of anchors, cut into batches anywhere, hot or not."""
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(300):
        rows = sorted((rng.randrange(6), rng.randrange(4), k, rng.randrange(1, 4)) for k in range(rng.randrange(1, 30)))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randrange(4)))})
        names = ["anchor", "doc_id", "pos", "c"]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=names) for a, b in zip(cuts, cuts[1:])]
        out = sorted(x for b in substring._shared(12)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns)))
        by = collections.defaultdict(list)
        for r in rows:
            by[r[0]].append(r)
        hot = {a: sum(r[3] for r in x) > 12 for a, x in by.items()}
        want = sorted((r[1], -1 - r[2] if hot[a] else r[2]) for a, x in by.items() for r in x if len({y[1] for y in x}) > 1)
        single = {a for a, x in by.items() if hot[a] and len({y[1] for y in x}) == 1}
        extra = sorted(set(out) - set(want))  # hot runs of one text may pass too
        assert [x for x in out if x in set(want)] == want and all(any(r[1] == d and -1 - r[2] == p for a in single for r in by[a]) for d, p in extra)


def test_one_passage_in_all_documents(spark, monkeypatch):
    """A hot passage is one piece to its index, however many documents have it,
    and answered without a join."""
    monkeypatch.setattr(substring, "HOT_ROWS", 30)
    monkeypatch.setattr(substring, "HOT_PIECES", 20)
    p = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"a{k} {p} b{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df).collect()}
    assert got == brute_cut(rows)


@pytest.mark.parametrize("hot, size", [(50_000, 2 << 20), (3, 400)])
def test_substring_dedup(spark, monkeypatch, hot, size):
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    monkeypatch.setattr(substring, "INDEX_BYTES", size)
    rows = passages(7)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, tag string, kept_text int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df).collect()}
    assert got == brute_cut(rows)
    out = substring.substring_dedup(df, carry=("tag", "kept_text")).first()
    assert out.extra.tag == "x" and out.extra.kept_text == 1
    assert substring.substring_dedup(df.limit(0)).count() == 0


def test_substring_repeated_and_null_ids(spark):
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(2, p + " a"), (2, p + " b"), (1, "x " + p), (None, p), (3, p)]
    out = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in out) == [("1", 0, "x " + p), ("2", 20, "a"), ("2", 20, "b"), ("3", 20, ""), ("None", 0, p)]


def test_queries_match_brute_force(spark, sf):
    from sieveline.llm import queries as Q

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op8_substring_dedup(spark, sf).collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute_cut(docs).items()}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op2_minhash_near_dedup(spark, sf).collect()}
    assert near == brute_components(docs)
    assert collections.Counter(near.values())


def test_ids_of_several_texts_tie_their_sets(spark):
    """One id's rows are one vertex, whatever sets they have, empty ones too."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (7, b), (7, None), (9, c), (9, ""), (12, None), (12, ""), (4, c + " end"), (11, b), (11, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as component", "1L as rep", "2L as c", "3L as cost")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    want = {1: 1, 2: 1, 7: 1, 11: 1, 9: 1, 4: 1, 12: 12}
    sizes = {None: 0, "": 0, a: 26, b: 26, c: 26, c + " end": 27}
    assert got == sorted((i, sizes[t], want[i], want[i] == i) for i, t in rows)


def test_copies_are_not_labelled_one_by_one(spark, monkeypatch):
    """Edges are between distinct sets: 500 copies add none."""
    seen = []
    label = minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges, *a: seen.append(edges.count()) or label(edges, *a))
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(k, t) for k in range(500)] + [(1000, t + " more"), (1001, "other words of a text that is by itself")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys([*range(500), 1000], 0) | {1001: 1001}
    assert max(seen) <= minhash.BANDS  # two sets meet in a band each at most


def test_long_texts_of_few_shingles_weigh_by_their_bytes(spark, monkeypatch):
    """Repeated lines: a group's texts are cut into units by bytes."""
    monkeypatch.setattr(minhash, "UNIT", 20_000)
    rows = []
    for k in range(30):
        rows.append((k, f"own{k} words here\n" + "the same line again and again\n" * (2000 + k)))
    units = []
    compare = minhash._compare
    monkeypatch.setattr(minhash, "_compare", lambda u, *a: units.append(u.groupBy("kind", "unit", "p", "q").agg({"doc_id": "count"}).collect()) or compare(u, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert max(r[4] for x in units for r in x) < 15  # by shingles all thirty would be one unit
