"""Quality rules: repetition measured on suffix arrays, plus counts per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .kernel import _G, _VALUE, U, Words, blocks, codepoints, mix, powers, trim

#: Repeats of fewer words don't count; a text fails if repeats cover more than
#: COVERED of its words, or if one repeat is longer than LONGEST words.
SHORTEST, COVERED, LONGEST = 8, 0.45, 100
#: Bytes of texts that are worked on at once.
BLOCK = 1 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*b"#*$%&|<>"]] = True


def ranks(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Suffix array of every text of a block by prefix doubling.

    Suffixes of one text are neighbours. Only suffixes that still tie are
    sorted again, so the work follows the repetition in the texts. Returns the
    suffix array, and the common prefix of each suffix with the one before it.
    """
    n = len(key)
    ids = np.unique(key, return_inverse=True)[1].astype(np.int64)
    value = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(value, kind="stable")
    sv = value[order]
    new = np.ones(n, bool)
    new[1:] = sv[1:] != sv[:-1]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # a copy stays per level
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # rank: first place of the group
    last = np.searchsorted(doc, doc, "right")  # end of each word's text
    levels = [rank.copy()]
    step = 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    while tied.any():
        at = np.flatnonzero(tied)  # places in the suffix array that still tie
        suf = order[at]
        nxt = suf + step
        inside = nxt < last[suf]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)], -1)
        o = np.lexsort((second, rank[suf]))
        suf, second = suf[o], second[o]
        first = rank[suf]
        order[at] = suf
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[suf] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank)
        tied[at] = False
        t = ~fresh
        t[:-1] |= ~fresh[1:]
        tied[at[t]] = True
        step *= 2
    # common prefixes of neighbours, from the largest doubling level down
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        live = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b = a[live], b[live]
        got = np.zeros(len(live), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            ok = (a + got < last[a]) & (b + got < last[b])
            pa_, pb = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            same = ok & (levels[k][pa_] == levels[k][pb])
            got[same] += 1 << k
        lcp[live + 1] = got
    return order, lcp, last


def repeats(key: np.ndarray, doc: np.ndarray, texts: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by maximal repeats of at least `shortest` words, and the
    longest repeat, of each text.

    A suffix's longer common prefix with its two neighbours in the suffix array
    is the longest repeat that starts there; these are the heights of the
    LCP intervals, and their union is the union of all maximal repeats' spans.
    """
    covered, longest = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if not len(key):
        return covered, longest
    order, lcp, _ = ranks(key, doc)
    high = lcp.copy()
    high[:-1] = np.maximum(high[:-1], lcp[1:])
    length = np.empty(len(key), np.int64)
    length[order] = high
    np.maximum.at(longest, doc, length)
    s = np.flatnonzero(length >= shortest)
    change = np.zeros(len(key) + 1, np.int64)
    np.add.at(change, s, 1)
    np.add.at(change, s + length[s], -1)
    inside = np.cumsum(change)[:-1] > 0
    return np.bincount(doc[inside], minlength=texts).astype(np.int64), longest


def block_stats(buf: np.ndarray, at: np.ndarray, shortest: int = SHORTEST) -> dict[str, np.ndarray]:
    n = len(at) - 1
    w = Words(buf, at, lower=False)
    cp = codepoints(buf)
    out = {"n_words": np.diff(w.ofs)}
    chars = np.concatenate([[0], np.cumsum(cp[w.end] - cp[w.start])])
    out["word_chars"] = np.diff(chars[w.ofs])
    sym = np.concatenate([[0], np.cumsum(_SYMBOLS[buf])])
    out["n_symbols"] = np.diff(sym[at])
    # lines that hold a word and equal an earlier one of the same text; equality
    # is on bytes, by a hash over them
    edge = np.zeros(len(buf) + 1, bool)
    edge[at[:-1]] = True
    edge[1:] |= buf == 10
    ls = np.flatnonzero(edge[:-1]) if len(buf) else np.zeros(0, np.int64)
    le = np.append(ls[1:], len(buf)).astype(np.int64)
    le -= (le > ls) & (buf[np.maximum(le - 1, 0)] == 10) if len(ls) else 0
    word_at = np.searchsorted(w.start, ls)
    m = word_at < np.searchsorted(w.start, le)
    ls, le = ls[m], le[m]
    line_doc = np.searchsorted(at, ls, "right") - 1
    lh = _byte_hashes(buf, ls, le)
    o = np.lexsort((ls, lh, line_doc))
    dup = np.zeros(len(o), bool)
    dup[1:] = (lh[o][1:] == lh[o][:-1]) & (line_doc[o][1:] == line_doc[o][:-1])
    out["n_dup_lines"] = np.bincount(line_doc[o][dup], minlength=n)
    # words inside 3-word windows that occur twice or more
    i, h = w.windows(3)
    d = w.doc[i]
    o = np.lexsort((h, d))
    hs, ds = h[o], d[o]
    same = np.zeros(len(o), bool)
    eq = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    same[1:] |= eq
    same[:-1] |= eq
    hit = np.zeros(len(w.key), bool)
    for k in range(3):
        hit[i[o[same]] + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[hit], minlength=n)
    out["covered_words"], out["longest_repeat"] = repeats(w.key, w.doc, n, shortest)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _byte_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, a segment of text at a time."""
    out = np.zeros(len(start), U)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + (1 << 20), "left")))
        lo, hi = int(start[a]), int(end[a:b].max())
        up, down = powers(_G, hi - lo + 1)
        run = np.zeros(hi - lo + 1, U)
        np.cumsum(_VALUE[buf[lo:hi]] * up[: hi - lo], out=run[1:])
        out[a:b] = mix((run[end[a:b] - lo] - run[start[a:b] - lo]) * down[start[a:b] - lo])
        a = b
    return out


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("covered_words", "longest_repeat")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, shortest: int = SHORTEST, covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """Counts and a verdict for every document; one row per input row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, covered_words (words inside maximal
    repeated substrings of at least `shortest` words), longest_repeat (words).

    base_failed: fewer than min_words words, or more than half of the words in
    repeated 3-word windows. kept: not base_failed, repeats cover at most
    `covered` of the words and none is longer than `longest`. Null or empty
    texts have zero counts and fail. Texts, very long ones too, are taken whole;
    repeated rows and ids get a row each; no rows give no rows; extra columns,
    whatever their names, are ignored.

    A map-only pass: rows never move, and memory follows a block of 1 MB of
    texts or the longest single text.
    """
    ship(docs.sparkSession)
    rules = (min_words, shortest, covered, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, at in blocks(batch.column(1), BLOCK):
                s, failed, kept = _verdicts(buf, at, *rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(s[f]) for f in FIELDS), pa.array(failed), pa.array(kept), *(pa.array(s[f]) for f in MORE)], names=["doc_id", *FIELDS, "base_failed", "kept", *MORE])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, f"doc_id {kind}, {', '.join(f + ' long' for f in FIELDS)}, base_failed boolean, kept boolean, {', '.join(f + ' long' for f in MORE)}")


def _verdicts(buf: np.ndarray, at: np.ndarray, min_words: int, shortest: int, covered: float, longest: int):
    s = block_stats(buf, at, shortest)
    failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return s, failed, ~failed & (s["covered_words"] <= covered * s["n_words"]) & (s["longest_repeat"] <= longest)


def passing(docs: DataFrame, text_col: str = "text", min_words: int = 50, shortest: int = SHORTEST, covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """The rows of docs, all columns as they are, that quality_rules would keep.
    Rows are judged where they lie: no join, no shuffle. Null and empty texts
    go; null ids and repeated rows are judged like any other; no rows give none."""
    ship(docs.sparkSession)
    at_col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for i, j, buf, at in blocks(batch.column(at_col), BLOCK):
                yield batch.slice(i, j - i).filter(pa.array(_verdicts(buf, at, min_words, shortest, covered, longest)[2]))
        trim()

    return docs.mapInArrow(run, docs.schema)
