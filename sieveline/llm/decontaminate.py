"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored
from .kernel import U, Words, blocks, mix, mix_int, ragged

#: Fixed masks over word positions: # counts, - may differ.
MASKS = ("###-#--##", "##-#-##-#", "#-##--###", "##--#-#-##")
#: Items of up to this many words have further masks, where MASKS could miss them.
SHORT = 15
#: Words of a broadcast block of the test set; more items go in further blocks.
BLOCK_WORDS = 1_000_000


def _mask_hash(key: np.ndarray, mask: str) -> np.ndarray:
    """Seed of a mask at every start, whatever text the words belong to."""
    n = len(key) - len(mask) + 1
    out = np.full(n, mix_int(zlib.crc32(mask.encode()) + 101), U)
    for j, c in enumerate(mask):
        if c == "#":
            out += key[j : j + n] * U(mix_int(0x9FB21C651E98DF25 * (j + 1)) | 1)
    return mix(out)


def best_segments(match: np.ndarray, penalty: int) -> np.ndarray:
    """best_segment() of each row: starts, ends and matches."""
    rows, n = match.shape
    run = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(np.where(match, 1, -penalty), axis=1)], axis=1)
    end = np.argmax(run - np.minimum.accumulate(run, axis=1), axis=1)
    start = np.argmin(np.where(np.arange(n + 1) <= end[:, None], run, np.iinfo(np.int64).max), axis=1)
    hits = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(match, axis=1)], axis=1)
    at = np.arange(rows)
    return np.stack([start, end, hits[at, end] - hits[at, start]])


@functools.cache
def short_masks(n: int, need: int, penalty: int) -> tuple[tuple[str, int], ...]:
    """Masks, and where in an item of n words they are laid, that between them
    hit every way in which a text can agree with `need` words of it.

    All ways to agree or differ word by word are listed. MASKS come first, where
    they fit; as long as a way is left that no mask hits, the one of the fewest
    equal words becomes a mask itself, laid wherever it fits.
    """
    ways = np.arange(1, 1 << n)
    equal = (ways[:, None] >> np.arange(n)) & 1 > 0
    left = ways[best_segments(equal, penalty)[2] >= need]
    out: list[tuple[str, int]] = []

    def lay(mask: str) -> None:
        nonlocal left
        bits = sum(1 << j for j, c in enumerate(mask) if c == "#")
        for at in range(n - len(mask) + 1):
            hit = left & (bits << at) == bits << at
            if hit.any():
                out.append((mask, at))
                left = left[~hit]

    for mask in MASKS if n >= 10 else ():
        lay(mask)
    while len(left):
        way = int(left[np.argmin(np.bitwise_count(left))])
        lay("".join("#" if way >> j & 1 else "-" for j in range(n)).strip("-"))
    return tuple(out)


class TestSet:
    """Seeds of a block of test items, in a table per mask, sorted by hash."""

    def __init__(self, texts: list[str | None], min_words: int, share: float, penalty: int) -> None:
        enc = [(t or "").encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(e) for e in enc])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(enc), np.uint8), at, alnum=True)
        self.key, self.ofs = w.key, w.ofs
        size = np.diff(w.ofs)
        self.need = np.minimum(min_words, np.ceil(share * size).astype(np.int64))
        laid: dict[str, list[np.ndarray]] = {}  # words of items where a mask is laid
        for n in np.unique(size[(size > 0) & (size <= SHORT)]).tolist():
            first = w.ofs[:-1][size == n]
            need = int(min(min_words, np.ceil(share * n)))
            for mask, offset in short_masks(n, need, penalty):
                laid.setdefault(mask, []).append(first + offset)
        for mask in MASKS:
            n = len(w.key) - len(mask) + 1
            if n > 0:
                laid.setdefault(mask, []).append(np.flatnonzero((w.doc[:n] == w.doc[len(mask) - 1 :]) & (size[w.doc[:n]] > SHORT)))
        self.seeds = []  # mask, sorted hashes, item, place, first bits that occur
        for mask, words in laid.items():
            i = np.concatenate(words)
            if len(i):
                h = _mask_hash(w.key, mask)[i]
                o = np.argsort(h, kind="stable")
                near = np.zeros(1 << 18, bool)
                near[(h >> U(46)).astype(np.int64)] = True
                item = w.doc[i][o]
                self.seeds.append((mask, h[o], item, i[o] - w.ofs[item], near))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, word of the text where the item would start)."""
        found = []
        for mask, table, item, place, near in self.seeds:
            n = len(w.key) - len(mask) + 1
            if n <= 0:
                continue
            h = _mask_hash(w.key, mask)
            i = np.flatnonzero(near[(h >> U(46)).astype(np.int64)])
            i = i[w.doc[i] == w.doc[i + len(mask) - 1]]
            a, b = np.searchsorted(table, h[i], "left"), np.searchsorted(table, h[i], "right")
            m = b > a
            i, a, b = i[m], a[m], b[m]
            at = ragged(a, b - a)
            i = np.repeat(i, b - a)
            found.append(np.stack([w.doc[i], item[at], i - place[at]]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        all_ = np.concatenate(found, axis=1)
        return tuple(np.unique(all_, axis=1)) if all_.shape[1] else tuple(all_)


def best_segment(match: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the most matches less
    `penalty` times its mismatches; the first of equals."""
    run = np.concatenate([[0], np.cumsum(np.where(match, 1, -penalty))])
    low = np.minimum.accumulate(run)
    end = int(np.argmax(run - low))
    start = int(np.argmin(run[: end + 1])) if end else 0
    return start, end, int(match[start:end].sum())


def _overlaps(t: TestSet, buf: np.ndarray, at: np.ndarray, penalty: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (-matches, first word, words) of its best alignment."""
    size, need = np.diff(t.ofs), t.need
    w = Words(buf, at, alnum=True)
    doc, item, start = t.hits(w)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(doc):
        return best
    # words of the item that lie inside the text on this alignment
    lo = np.maximum(start, w.ofs[doc])
    hi = np.minimum(start + size[item], w.ofs[doc + 1])
    n = hi - lo
    rows = np.repeat(np.arange(len(doc)), n)
    same = w.key[ragged(lo, n)] == t.key[ragged(t.ofs[item] + lo - start, n)]
    enough = np.flatnonzero(np.bincount(rows[same], minlength=len(doc)) >= need[item])
    cut = np.concatenate([[0], np.cumsum(n)])
    for r in enough:
        a, b, c = best_segment(same[cut[r] : cut[r + 1]], penalty)
        if c >= need[item[r]]:
            k = (int(doc[r]), int(item[r]))
            row = (-c, int(lo[r] + a - w.ofs[doc[r]]), int(b - a))
            best[k] = min(best.get(k, row), row)
    return best


def _scan(tests, penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tests.value
        size = np.diff(t.ofs)
        for batch in batches:
            for i, j, buf, at in blocks(batch.column(1)):
                best = _overlaps(t, buf, at, penalty)
                if best:
                    d, it = (np.array(x) for x in zip(*best))
                    c, s, ln = (np.array(x) for x in zip(*best.values()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + d)), pa.array(it.astype(np.int32)), pa.array(-c), pa.array(size[it]), pa.array(s), pa.array(s + ln)], names=["doc_id", "item", "n_matched", "item_words", "start_word", "end_word"])

    return run


def _item_blocks(tests: DataFrame) -> tuple[int, Iterator[list]]:
    """The test set in blocks of bounded size, one at a time on the driver, and
    their number."""
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-int(chars) // (BLOCK_WORDS * 4)) or 1
    return parts, (tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect() for p in range(parts))


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, share: float = 0.8, penalty: int = 3) -> DataFrame:
    """The rows of docs, all columns as they are, that contaminated() has no
    pair for. Rows are judged where they lie, in one pass per block of items;
    with several blocks the rows that are left are stored after each, so that
    one block at a time is in memory.

    Null and empty texts are clean; very long ones are read whole; rows with null
    ids and repeated rows are judged each by itself; no rows give none; extra columns, whatever their names, stay as they
    are. An empty test set leaves every row.
    """
    spark = docs.sparkSession
    ship(spark)
    at_col = docs.columns.index(text_col)
    parts, every = _item_blocks(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    for rows in every:
        of = spark.sparkContext.broadcast(TestSet([r["text"] for r in rows], min_words, share, penalty))

        def run(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, buf, at in blocks(batch.column(at_col)):
                    clean = np.ones(j - i, bool)
                    clean[[d for d, _ in _overlaps(of.value, buf, at, penalty)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if parts > 1:
            docs = stored(docs, "clean")
            of.destroy()
    return docs


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, share: float = 0.8, penalty: int = 3) -> DataFrame:
    """Pairs of a document and a test item that overlap.

    Texts are lower-cased (A-Z) and split into words of ASCII letters, digits
    and non-ASCII characters. Where a spaced seed of an item and of a document
    agree, the item is laid along the document at that alignment, and the
    stretch with the most equal words less `penalty` times its unequal ones is
    taken. The pair counts if that stretch has min_words equal words, or `share`
    of an item that is shorter. Returns doc_id, item_id, n_matched, item_words,
    start_word, end_word (words of the document, end exclusive): the alignment
    with most matches per pair, the first of equals.

    With min_words, share and penalty as they are by default no pair that counts
    is missed: MASKS hit every such stretch of items longer than SHORT words (a
    test lists those of up to 22 words), and shorter items have masks derived so
    that every way to qualify is hit (see short_masks; for any parameters).

    Null or empty texts match nothing, and very long ones are taken whole.
    Repeated rows are reported row by row; ids, null ones too, are carried
    along; extra columns, whatever their names, are ignored. No documents or no
    items give no rows.

    Plan: the test set's tables are broadcast in blocks of BLOCK_WORDS words, of
    which there is one unless the test set is larger; the corpus is only
    scanned, nothing of it is shuffled. With several blocks the pairs of each
    are stored before the next is made, so that one block at a time is in
    memory.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = None
    parts, every = _item_blocks(tests)
    for rows in every:
        of = sc.broadcast(TestSet([r["text"] for r in rows], min_words, share, penalty))
        found = base.mapInArrow(_scan(of, penalty), f"doc_id {kind}, item int, n_matched long, item_words long, start_word long, end_word long")
        ids = F.array(*[F.lit(r["item_id"]).cast(tests.schema["item_id"].dataType) for r in rows]) if len(rows) <= 5000 else None
        if ids is not None and rows:
            found = found.select("doc_id", F.element_at(ids, F.col("item") + 1).alias("item_id"), "n_matched", "item_words", "start_word", "end_word")
        else:
            names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item int, item_id {tests.schema['item_id'].dataType.simpleString()}")
            found = found.join(names, "item").select("doc_id", "item_id", "n_matched", "item_words", "start_word", "end_word")
        if parts > 1:
            found = stored(found, "overlaps")
            of.destroy()
        out = found if out is None else out.union(found)
    return out
