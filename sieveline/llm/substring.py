"""Substring deduplication: repeated word windows found with FM-indexes of shards."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, ship, stored
from .fm_index import FMIndex
from .joins import join_groups
from .kernel import U, Words, blocks, mix, mix_int, ragged, runs, text_arrays

#: Words of an anchor; bytes of pieces from which an index takes no further key;
#: places of an anchor beyond which its windows are spread by their words.
ANCHOR, INDEX_BYTES, HOT_ROWS = 4, 2 << 20, 50_000
#: Texts that have a piece beyond which it may be hot; the hot pieces, those that
#: the most texts have, whose answers are sent to all tasks.
HOT_PIECES, MOST_PIECES = 1_000, 10_000
#: End of a span that takes the whole text.
_WHOLE = (1 << 31) - 1


def minimizers(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word and the place of its anchor, the run of
    k words in it with the smallest hash (leftmost of equals); and the hashes
    of all runs by place. Equal windows have equal anchors at equal offsets."""
    n = len(w.key)
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U)
    h = runs(w.key, k)
    span = window - k + 1
    low, arg, have = h, np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        a, b = low[: len(low) - step], low[step:]
        less = b < a
        arg = np.where(less, arg[step:], arg[: len(a)])
        low = np.where(less, b, a)
        have += step
    first = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    return first, arg[first], h


def _of_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """An anchor's hash in its text."""
    return h ^ mix(doc.astype(U) + U(1))


def _whole(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of n words each."""
    start = np.cumsum(n) - n
    place = np.arange(len(keys)) - np.repeat(start, n)
    mult = np.array([mix_int(0x2545F4914F6CDD1D * (x + 1)) | 1 for x in range(int(n.max()) + 1)], U)
    return mix(np.add.reduceat(keys * mult[place], start)) ^ mix(n.astype(U))


def _anchors(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, at in blocks(batch.column(1)):
                w = Words(buf, at, lower=False)
                _, arg, h = minimizers(w, window, k)
                new = np.ones(len(arg), bool)
                new[1:] = arg[1:] != arg[:-1]
                p = arg[new]
                _, one, c = np.unique(_of_text(h[p], w.doc[p]), return_index=True, return_counts=True)  # an anchor once per text
                p = p[one]
                doc = w.doc[p]
                yield pa.RecordBatch.from_arrays([pa.array(h[p].view(np.int64)), pa.array(ids[i + doc]), pa.array((p - w.ofs[doc]).astype(np.int32)), pa.array(c.astype(np.int32))], names=["anchor", "doc_id", "pos", "c"])

    return run


def _shared(most: int):
    """Rows sorted by anchor: pass on those of anchors that several documents
    have. A run is held back until it has `most` places; one with more is
    passed on as it comes, with its places marked (negative) as hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, size = None, 0

        def rest() -> list[tuple[np.ndarray, np.ndarray]]:
            r = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
            return held if len(r) and (r != r[0]).any() else []

        for batch in batches:
            if not batch.num_rows:
                continue
            a, r, p, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            end = np.append(start[1:], len(a))
            done = []
            if key is not None and a[0] != key:
                done, held, size = rest(), [], 0
            # the runs that end in this batch, but for its first, are judged at once
            s, e = start[1:-1], end[1:-1]
            first, last = slice(0, end[0]), slice(start[-1], len(a))
            held.append((r[first], p[first]))
            size += int(c[first].sum())
            if size > most:
                done += [(x, np.where(y < 0, y, -1 - y)) for x, y in held]
                held = []
            if len(start) > 1:
                done += rest()
                if len(s):
                    lo, hi, n = s[0], e[-1], e - s
                    mixed = np.maximum.reduceat(r[lo:hi], s - lo) != np.minimum.reduceat(r[lo:hi], s - lo)
                    hot = np.add.reduceat(c[lo:hi].astype(np.int64), s - lo) > most
                    m = np.repeat(mixed, n)
                    done.append((r[lo:hi][m], np.where(np.repeat(hot, n), -1 - p[lo:hi], p[lo:hi])[m]))
                held, size = [(r[last], p[last])], int(c[last].sum())
                if size > most:
                    done += [(r[last], -1 - p[last])]
                    held = []
            key = a[-1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in done]), pa.int64()), pa.array(np.concatenate([y for _, y in done]), pa.int32())], names=["doc_id", "place"])
        if done := rest():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in done]), pa.int64()), pa.array(np.concatenate([y for _, y in done]), pa.int32())], names=["doc_id", "place"])

    return run


class Pieces(NamedTuple):
    """Pieces of a block of texts, once per text: key, 128-bit identity, text,
    where in the block a piece's first copy begins and ends, and all its places
    in its text."""

    key: np.ndarray
    is1: np.ndarray
    is2: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    pos: pa.ListArray


def _of_block(buf: np.ndarray, at: np.ndarray, places: np.ndarray, at_places: np.ndarray, window: int, k: int) -> Pieces | None:
    """Texts with the places of their shared anchors -> the pieces around them,
    keyed so that equal windows meet: by their anchor, or, where that is hot
    (its place is negative), by their own words."""
    w = Words(buf, at, lower=False)
    first, arg, h = minimizers(w, window, k)
    if not len(first):
        return None
    d = np.repeat(np.arange(len(at) - 1), np.diff(at_places))
    place = np.where(places < 0, -1 - places, places)
    own = place < np.diff(w.ofs)[d] - k + 1  # places of another row of the same id may lie outside
    seen = _of_text(h[(place + w.ofs[d])[own]], d[own])
    hot_first = np.lexsort((places[own] >= 0, seen))
    seen, hot_seen = seen[hot_first], places[own][hot_first] < 0
    if not len(seen):
        return None
    # every place of a shared anchor counts, not only the one that was sent
    new = np.ones(len(arg), bool)
    new[1:] = arg[1:] != arg[:-1]
    mark = _of_text(h[arg[new]], w.doc[arg[new]])
    at_seen = np.minimum(np.searchsorted(seen, mark), len(seen) - 1)
    f = np.where(seen[at_seen] == mark, np.where(hot_seen[at_seen], 2, 1), 0)[np.cumsum(new) - 1]
    m = f > 0
    first, arg, f = first[m], arg[m], f[m]
    if not len(first):
        return None
    new = np.ones(len(first), bool)
    new[1:] = (arg[1:] != arg[:-1]) | (first[1:] != first[:-1] + 1) | (f[1:] == 2)
    s = np.flatnonzero(new)
    a, b = first[s], first[np.append(s[1:], len(first)) - 1] + window - 1
    key = h[arg[s]]
    hot = f[s] == 2
    if hot.any():
        key = np.where(hot, runs(w.key, window)[np.minimum(a, len(w.key) - window)], key)
    doc = w.doc[a]
    words = w.key[ragged(a, b - a + 1)]
    is1, is2 = _whole(words, b - a + 1), _whole(mix(words), b - a + 1)
    _, one, back = np.unique(_of_text(is1, doc), return_index=True, return_inverse=True)
    pos = (a - w.ofs[doc])[np.argsort(back, kind="stable")].astype(np.int32)
    pos = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(back))]).astype(np.int32)), pa.array(pos))
    return Pieces(key[one], is1[one], is2[one], doc[one], w.start[a[one]], w.end[b[one]], pos)


def _blocks_of(batch: pa.RecordBatch, window: int, k: int) -> Iterator[tuple[int, np.ndarray, Pieces]]:
    lists = batch.column(3)
    pv, po = lists.values.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    for i, j, buf, at in blocks(batch.column(2), 1 << 20):
        p = _of_block(buf, at, pv[po[i] : po[j]], po[i : j + 1] - po[i], window, k)
        if p:
            yield i, buf, p


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _distinct(window: int, k: int):
    """Texts with places -> the batch's distinct pieces: the smallest document of
    each, how many have it, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column(1).to_numpy(zero_copy_only=False)
            cols, texts = [], []
            for i, buf, p in _blocks_of(batch, window, k):
                _, one, back = np.unique(p.is1, return_index=True, return_inverse=True)
                owner = np.full(len(one), np.iinfo(np.int64).max)
                np.minimum.at(owner, back, doc_id[i + p.doc])
                cols.append((p.key[one], p.is1[one], p.is2[one], owner, np.bincount(back)))
                b0, size = p.start[one], p.end[one] - p.start[one]
                texts.append(pa.BinaryArray.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(buf[ragged(b0, size)])]))
            if cols:
                key, is1, is2, owner, c = (np.concatenate(x) for x in zip(*cols))
                one, owner, c = _combined(is1, owner, c)
                yield pa.RecordBatch.from_arrays([_signed(key[one]), _signed(is1[one]), _signed(is2[one]), pa.array(owner), pa.array(c), pa.concat_arrays(texts).take(pa.array(one))], names=["key", "is1", "is2", "owner", "c", "piece"])

    return run


def _combined(is1: np.ndarray, owner: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal pieces: one row's place, the smallest document, all counts."""
    _, one, back = np.unique(is1, return_index=True, return_inverse=True)
    least, total = np.full(len(one), np.iinfo(np.int64).max), np.zeros(len(one), np.int64)
    np.minimum.at(least, back, owner)
    np.add.at(total, back, c)
    return one, least, total


def _asked(window: int, k: int, hot_of):
    """Texts with places -> their pieces' identities and places. Those that very
    many texts have are answered at once, and under an identity of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, answers = hot_of.value
        for batch in batches:
            tag, doc_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, _, p in _blocks_of(batch, window, k):
                is1, is2, d = p.is1, p.is2, doc_id[i + p.doc]
                least = pa.nulls(len(is1), pa.list_(pa.int64()))
                if len(known):
                    at = np.minimum(np.searchsorted(known[:, 0], is1), len(known) - 1)
                    hit = (known[at, 0] == is1) & (known[at, 1] == is2)
                    least = answers.take(pa.array(at, mask=~hit))
                    is1, is2 = np.where(hit, mix(d.astype(U)), is1), np.where(hit, ~is1, is2)
                yield pa.RecordBatch.from_arrays([_signed(is1), _signed(is2), pa.array(d, pa.int64()), pa.array(tag[i + p.doc], pa.int32()), p.pos, least], names=["is1", "is2", "doc_id", "tag", "pos", "least"])

    return run


def _indexed(table: pa.Table, window: int) -> pa.RecordBatch:
    """The smallest document of every window of the given pieces, each once."""
    table = table.combine_chunks()
    one, owner, c = _combined(*(table.column(x).to_numpy() for x in ("is1", "owner", "c")))
    table = table.take(pa.array(one))
    buf, at = text_arrays(table.column("piece"))
    w = Words(buf, at, lower=False)
    vocabulary, symbols = np.unique(w.key, return_inverse=True)
    index = FMIndex(vocabulary, symbols.astype(np.int64) + 1, w.ofs, owner, window)
    least = index.matching(w.key, w.ofs)
    wins = np.maximum(np.diff(w.ofs) - window + 1, 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wins)]).astype(np.int32)), pa.array(least[ragged(w.ofs[:-1], wins)]))
    return pa.RecordBatch.from_arrays([*(pa.array(table.column(x).to_numpy()) for x in ("is1", "is2")), pa.array(c), lists], names=["is1", "is2", "c", "least"])


def _search(window: int, most: int):
    """Pieces sorted by key, equal ones combined: whole keys go to one index until
    it holds `most` bytes. A key has HOT_ROWS pieces of 2 * window words at most,
    or, if its anchor is hot, a single one, which comes once per batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for c in range(0, batch.num_rows, 8192):
                part = batch.slice(c, 8192)
                held.append(part)
                size += part.column(5).nbytes
                if size < most:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:  # all but the last key is complete
                    yield _indexed(table.slice(0, cut), window)
                    held = table.slice(cut).to_batches()
                    size = sum(x.column(5).nbytes for x in held)
        if held:
            yield _indexed(pa.Table.from_batches(held), window)

    return run


def _spans(window: int):
    """Texts' pieces with the smallest documents of their windows -> the words
    of a text that windows of smaller documents cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            (pos, pos_at), (least, least_at) = ((x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)) for x in (batch.column(2), batch.column(3)))
            row = np.repeat(np.arange(len(doc)), np.diff(least_at))
            j = np.arange(len(least)) - least_at[row]
            hit = least < doc[row]
            row, j = row[hit], j[hit]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)
            s = np.flatnonzero(new)
            a, b, r = j[s], j[np.append(s[1:], len(row)) - 1] if len(row) else j[s], row[s]
            places = np.diff(pos_at)[r]
            each = np.repeat(np.arange(len(r)), places)
            at = pos[ragged(pos_at[r], places)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[r][each], pa.int64()), pa.array(tag[r][each], pa.int32()), pa.array((at + a[each]).astype(np.int32)), pa.array((at + b[each] + window).astype(np.int32))], names=["doc_id", "tag", "start", "end"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut_batch(batch, window)

    return run


def _cut_batch(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    doc_id, spans = batch.column(0), batch.column(3)
    flat = spans.flatten()
    so = spans.offsets.to_numpy().astype(np.int64)
    valid = spans.is_valid().to_numpy(zero_copy_only=False)
    of, a, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
    base = int(so[0])
    tag = batch.column(1).to_numpy(zero_copy_only=False)
    for i, j, buf, at in blocks(batch.column(2)):
        w = Words(buf, at, lower=False)
        change = np.zeros(len(w.key) + 1, np.int64)
        lens = np.where(valid[i:j], np.diff(so[i : j + 1]), 0)
        at_s = ragged(so[i:j] - base, lens)
        d = np.repeat(np.arange(j - i), lens)
        own = of[at_s] == tag[i + d]  # not of another row of the same id
        n = np.diff(w.ofs)
        own &= (b[at_s] < _WHOLE) | (n[d] >= window)  # a copy without a window stays
        at_s, d = at_s[own], d[own]
        np.add.at(change, a[at_s] + w.ofs[d], 1)
        np.add.at(change, np.minimum(b[at_s], n[d]) + w.ofs[d], -1)
        gone = np.cumsum(change)[:-1] > 0
        stay = np.flatnonzero(~gone)
        s, ln = w.start[stay], w.end[stay] - w.start[stay] + 1
        data = np.append(buf, np.uint8(32))[ragged(s, ln)]
        ends = np.cumsum(ln)
        data[ends - 1] = 32
        kept = np.bincount(w.doc[stay], minlength=j - i)
        size = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])]
        # the space after a text's last word is left out
        lens_b = np.diff(size) - (kept > 0)
        text = data[ragged(size[:-1], lens_b)]
        ofs = np.concatenate([[0], np.cumsum(lens_b)])
        kind = pa.large_string() if ofs[-1] > 2**31 - 1 else pa.string()
        arr = type(pa.array([], kind)).from_buffers(len(n), pa.py_buffer(ofs.astype(np.int64 if kind == pa.large_string() else np.int32)), pa.py_buffer(np.ascontiguousarray(text)))
        cols = [doc_id.slice(i, j - i), pa.array(n), pa.array(n - kept), arr]
        if batch.num_columns > 4:
            cols += [batch.column(2).slice(i, j - i), batch.column(4).slice(i, j - i)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_text", "text", "extra"][: len(cols)])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a window of `window` consecutive words that
    also starts in a document with a smaller id.

    Windows are judged on the input, not on what is left. Returns one row per
    input row: doc_id, n_words, n_removed, kept_text (kept words joined by one
    space). Null or empty texts: 0 words and the empty text. Repeated ids count
    as one document: their rows don't remove words from each other, and rows
    that are equal are cut alike. A row with a null id neither removes nor
    loses words. Extra columns are ignored, but for those named in `carry`, which
    come along as fields of a struct `extra`, with `text`, the row's own text.

    Very long texts are taken whole; texts shorter than the window lose nothing;
    no rows give no rows. window is 1 or more.

    Plan: equal texts are found by length and 128 bits of hash; all but those
    with the smallest id go wholly. Of the rest every window is known by an
    anchor, its least 4-word run, so equal windows share it. Anchors are
    shuffled once and only those of several texts come back. The windows around
    them are pieces of text; equal pieces combine to their smallest document
    before they are shuffled to shards by anchor. A shard builds FM-indexes of
    its distinct pieces and streams them through backward search, which yields
    each window's interval and so its smallest document. The answers are joined
    to the texts that have the piece; those of pieces that very many texts have,
    a bounded number, are sent to all tasks. An anchor of over HOT_ROWS places has its windows spread by
    their own hash, where all that share a key are one piece: an index's memory
    has a bound, and no key's time follows the number of its documents.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    anchor = min(ANCHOR, window)
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("extra")] if carry else []))
    # joins are on a key without nulls
    base = base.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ref"), "doc_id", F.hash("text").alias("tag"), "text", *(["extra"] if carry else []))
    text_is = ["len", "h1", "h2"]
    marks = base.where("doc_id is not null").select("doc_id", "tag", F.length("text").alias("len"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    same = marks.groupBy(*text_is).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c")).where("low < high")
    same = stored(same, "equal")
    copies = stored(join_groups(marks, same, text_is, "c").where("doc_id > low").groupBy(F.col("doc_id").alias("ref")).agg(F.collect_set("tag").alias("copy_tags")), "copies")
    texts = base.join(copies, "ref", "left").where("doc_id is not null and (copy_tags is null or not array_contains(copy_tags, tag))")
    anchors = texts.select("doc_id", "text").mapInArrow(_anchors(window, anchor), "anchor long, doc_id long, pos int, c int")
    shared = anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared(HOT_ROWS), "doc_id long, place int")
    places = shared.groupBy(F.col("doc_id").alias("ref")).agg(F.collect_set("place").alias("places"))
    # the texts move once, into buckets that both passes over the pieces and the cut read in place
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = bucketed(base.repartition(n, "ref").join(places.repartition(n, "ref"), "ref", "left"), "ref", "texts", sort=True)
    marked = base.where("places is not null").select("tag", "doc_id", "text", "places")
    distinct = marked.mapInArrow(_distinct(window, anchor), "key long, is1 long, is2 long, owner long, c long, piece binary")
    least = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(_search(window, INDEX_BYTES), "is1 long, is2 long, c long, least array<long>")
    least = stored(least, "least")
    hot = least.where(F.col("c") > HOT_PIECES).orderBy(F.desc("c"), "is1", "is2").limit(MOST_PIECES).toArrow()  # a bounded number
    known = np.stack([hot.column(x).to_numpy().view(U) for x in ("is1", "is2")], axis=1)
    order = np.argsort(known[:, 0], kind="stable")
    hot_of = spark.sparkContext.broadcast((known[order], pa.concat_arrays(hot.column("least").chunks).take(pa.array(order)) if len(order) else None))
    asked = marked.mapInArrow(_asked(window, anchor, hot_of), "is1 long, is2 long, doc_id long, tag int, pos array<int>, least array<long>")
    both = asked.join(least.select("is1", "is2", F.col("least").alias("found")), ["is1", "is2"], "left")
    found = both.select("doc_id", "tag", "pos", F.coalesce("least", "found").alias("least")).mapInArrow(_spans(window), "doc_id long, tag int, start int, end int")
    whole = copies.select(F.col("ref").alias("doc_id"), F.explode("copy_tags").alias("tag"), F.lit(0).alias("start"), F.lit(_WHOLE).alias("end"))
    spans = found.union(whole).groupBy(F.col("doc_id").alias("ref")).agg(F.collect_list(F.struct("tag", "start", "end")).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    if carry:
        out += f", text string, extra {base.schema['extra'].dataType.simpleString()}"
    return base.join(spans, "ref", "left").select("doc_id", "tag", "text", "spans", *(["extra"] if carry else [])).mapInArrow(_cut(window), out)
