"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import itertools
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored
from .kernel import blocks, ragged, word_array

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Pieces that one island packs; islands that evolve the same pieces; epochs,
#: between which each island's best packing moves to the next island.
SHARD, ISLANDS, EPOCHS = 4000, 3, 2
#: Packings of an island, crossovers of an epoch, and packings kept for the next.
POPULATION, CROSSOVERS, KEPT = 8, 40, 3
#: The emptiest sequences of every shard are packed again together: this share
#: of them, two at least, of those that are filled to less than FILLED.
AGAIN, FILLED = 0.02, 0.98
#: Bytes of text whose words are looked up together; words and ids remembered.
BLOCK, KNOWN_WORDS, KNOWN_IDS = 8 << 20, 1 << 20, 1 << 23
#: Normalizers that neither look nor reach beyond white space.
_LOCAL = ("NFC", "Lowercase")
_PIECE = "doc_id, piece, start, length, ids_crc32"
_BYTE = np.arange(256)
_UPPER, _LOWER = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122)
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER & ~((_BYTE >= 48) & (_BYTE <= 57))


class Encoder:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    The tokenizer must take words between white space by themselves, which is
    checked: white space is dropped and no rule reaches across it. As it splits
    letters from marks and folds case, so do the words that are looked up, where
    bytes alone tell: a Latin letter before an ASCII mark ends a word, and A-Z
    before ASCII is folded. Blocks in which an added token's string may stand
    are taken as they are.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        j = json.loads(spec)
        steps = (j["normalizer"] or {}).get("normalizers", [])
        splits = (j["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        drops = splits[0].get("type") == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and splits[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        local = all(s["type"] in _LOCAL or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in j["added_tokens"])
        if not (drops and local and plain) or any(p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"] for p in splits[1:]):
            raise ValueError("only tokenizers that drop white space are supported")
        self.folds = any(s["type"] == "Lowercase" for s in steps)
        self.added = [t["content"].encode() for t in j["added_tokens"]]
        j["truncation"] = j["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(j))
        self._forget()

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {}
        # row 0 is the end of a document
        self.ids, self.at = np.array([END], "<u4"), np.array([0, 1], np.int64)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, the new ones encoded."""
        if len(self.row) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self._forget()
        new = [w for w in words if w not in self.row]
        if new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum()))
            self.row.update(zip(new, range(len(self.at) - 1, len(self.at) - 1 + len(new))))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, END after each, and where each begins (n + 1)."""
        cut, folded = None, buf
        if self.folds and len(buf):
            upper = _UPPER[buf]
            upper[:-1] &= buf[1:] < 128  # a mark that combines may follow else
            folded = buf + 32 * upper.astype(np.uint8)
            raw = folded.tobytes()
            if any(a.lower() in raw for a in self.added):
                folded = buf
            else:
                letter = _LOWER[folded] | _UPPER[folded]
                # the two bytes of U+00C0 to U+00FF, all letters but two
                letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
                cut = np.zeros(len(buf), bool)
                cut[1:] = letter[:-1] & _MARK[buf[1:]]
        words, ofs = word_array(folded, at, cut)
        coded = words.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        rows = np.insert(rows, ofs[1:], 0)
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(4 * self.at), pa.py_buffer(self.ids)])
        out = known.take(pa.array(rows))
        upto = np.frombuffer(out.buffers()[1], np.int64, len(rows) + 1) // 4
        return np.frombuffer(out.buffers()[2], "<u4", int(upto[-1])), upto[ofs + np.arange(len(ofs))]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids with END, cut into pieces of `capacity` where there
    are more: doc_id, piece, start, length, ids_crc32, and a key per row."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec_of = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if spec_of.value not in _encoders:
            _encoders.clear()
            _encoders[spec_of.value] = Encoder(spec_of.value)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, _, buf, at in blocks(batch.column(1), BLOCK):
                ids, ofs = _encoders[spec_of.value].encode(buf, at)
                size = np.diff(ofs)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                no = ragged(np.zeros_like(count), count)
                start = no * capacity
                length = np.minimum(size[doc] - start, capacity)
                first = 4 * (ofs[doc] + start)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                columns = [batch.column(0).take(pa.array(i + doc)), pa.array(no.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(key + np.arange(len(doc)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*_PIECE.split(", "), "key"])
                key += len(doc)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, key long")


def best_fit(size: np.ndarray, order: np.ndarray, assign: np.ndarray, free: list[int], capacity: int) -> int:
    """Put items, in order, where the least room is left after them; `free` has
    the room of each bin so far. Bins are opened as needed; their number then."""
    room = sorted(r << 32 | b for b, r in enumerate(free))
    n = len(free)
    for i, s in zip(order.tolist(), size[order].tolist()):
        k = bisect_left(room, s << 32)
        if k == len(room):
            left, b, n = capacity - s, n, n + 1
        else:
            slot = room.pop(k)
            left, b = (slot >> 32) - s, slot & 0xFFFFFFFF
        assign[i] = b
        insort(room, left << 32 | b)
    return n


def _worth(assign: np.ndarray, size: np.ndarray) -> tuple[int, int]:
    """Fewer bins are better; of as many, those with fuller and emptier ones.
    (The lesser pair is the better packing.)"""
    fill = np.bincount(assign, size).astype(np.int64)
    return len(fill), -int((fill * fill).sum())


def crossover(a: np.ndarray, b: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing made from a by injecting whole well-filled bins of b: a's bins
    that hold one of their items go, as do a few of its emptiest ones, and the
    items displaced are best-fitted, the largest first."""
    fill = np.bincount(b, size)
    often = rng.permutation(np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)])
    taken = np.zeros(len(fill), bool)
    taken[often[: max(1, len(fill) // 8)]] = True
    injected = taken[b]
    own = np.bincount(a, size)
    gone = np.zeros(len(own), bool)
    gone[a[injected]] = True
    gone[np.argsort(own, kind="stable")[: max(1, len(own) // 50)]] = True
    stays = ~gone[a] & ~injected
    out = np.full(len(a), -1, np.int64)
    number = np.cumsum(~gone) - 1
    out[stays] = number[a[stays]]
    kept = int((~gone).sum())
    out[injected] = kept + (np.cumsum(taken) - 1)[b[injected]]
    free = (capacity - np.bincount(out[out >= 0], size[out >= 0], minlength=kept + int(taken.sum()))).astype(np.int64)
    displaced = np.flatnonzero(out < 0)
    best_fit(size, displaced[np.argsort(-size[displaced], kind="stable")], out, free.tolist(), capacity)
    return out


def evolve(size: np.ndarray, members: list[np.ndarray], seed: list[int], capacity: int = CAPACITY, crossovers: int = CROSSOVERS) -> list[np.ndarray]:
    """An epoch of one island: its packings afterwards, the best first. Ends when
    a packing has as few bins as the sizes' sum allows."""
    rng = np.random.default_rng(seed)
    least = -(-int(size.sum()) // capacity)
    population = [(*_worth(m, size), k, m) for k, m in enumerate(members)]
    made = len(population)

    def add(assign: np.ndarray) -> None:
        nonlocal made
        insort(population, (*_worth(assign, size), made, assign), key=lambda x: x[:3])
        made += 1

    population.sort(key=lambda x: x[:3])
    while len(population) < POPULATION and not (population and population[0][0] == least):
        # the first by falling size, others by sizes that are blurred
        by = size * (1 + 0.3 * bool(made) * rng.random(len(size)))
        assign = np.empty(len(size), np.int64)
        best_fit(size, np.argsort(-by, kind="stable"), assign, [], capacity)
        add(assign)
    for _ in range(crossovers):
        if population[0][0] == least or len(population) < 2:
            break
        i, j = np.minimum(*rng.integers(0, len(population), (2, 2)))
        if i != j:
            child = crossover(population[i][3], population[j][3], size, capacity, rng)
            if _worth(child, size) not in [x[:2] for x in population]:
                add(child)
                del population[POPULATION:]
    return [x[3] for x in population[:KEPT]]


def _island(capacity: int, level: int, epoch: int):
    def run(items: pa.Table, members: pa.Table) -> pa.Table:
        if not items.num_rows:
            return _MEMBER.empty_table()
        shard, island = items.column("shard")[0].as_py(), items.column("island")[0].as_py()
        size = items.sort_by("key").column("length").to_numpy()
        came = members.sort_by([("came", "ascending"), ("rank", "ascending")]).column("genome").to_pylist()
        best = evolve(size, [np.frombuffer(g, "<i4").astype(np.int64) for g in came], [level, shard, island, epoch], capacity)
        worth = [_worth(m, size) for m in best]
        n = len(best)
        return pa.table([[shard] * n, [island] * n, range(n), [w[0] for w in worth], [w[1] for w in worth], [w[0] - -(-int(size.sum()) // capacity) for w in worth], [m.astype("<i4").tobytes() for m in best]], schema=_MEMBER)

    return run


_MEMBER = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("rank", pa.int32()), ("bins", pa.int64()), ("worth", pa.int64()), ("over", pa.int64()), ("genome", pa.binary())])
_MEMBER_SQL = "shard long, island int, rank int, bins long, worth long, over long, genome binary"


def _place(capacity: int, level: int):
    """A shard's pieces and its best packing -> sequence and offset per piece;
    `again` marks those of its emptiest sequences."""

    def run(items: pa.Table, best: pa.Table) -> pa.Table:
        items = items.sort_by("key")
        size, assign = items.column("length").to_numpy(), np.frombuffer(best.column("genome")[0].as_py(), "<i4").astype(np.int64)
        fill = np.bincount(assign, size)
        order = np.argsort(assign, kind="stable")
        upto = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(size), np.int64)
        offset[order] = upto - np.repeat(upto[np.flatnonzero(np.diff(assign[order], prepend=-1))], np.bincount(assign))
        again = np.zeros(len(fill), bool)
        again[np.argsort(fill, kind="stable")[: max(2, int(AGAIN * len(fill)))]] = True
        again &= fill < FILLED * capacity
        sequence = (level << 58) + (best.column("shard")[0].as_py() << 20) + assign
        return items.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again[assign]))

    return run


def _packed(items: DataFrame, shards: int, level: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """One level: pieces dealt to shards, each shard's best packing of all islands."""
    spark = items.sparkSession
    items = items.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)))
    sizes = items.select("shard", "key", "length").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    by = ["shard", "island"]
    came = spark.createDataFrame([], f"{_MEMBER_SQL}, came int")
    for epoch in range(epochs):
        evolved = sizes.groupBy(*by).cogroup(came.groupBy(*by)).applyInArrow(_island(capacity, level, epoch), _MEMBER_SQL)
        members = stored(evolved if not epoch else evolved.unionByName(settled), "islands")
        unsettled = members.groupBy("shard").agg(F.min("over").alias("over")).where("over > 0").select("shard")
        if epoch + 1 == epochs or unsettled.isEmpty():
            break
        settled = members.join(unsettled, "shard", "left_anti")
        # own packings stay; the best one also moves to the next island
        own = members.withColumn("came", F.lit(0))
        moved = members.where("rank = 0").withColumn("island", (F.col("island") + 1) % islands).withColumn("came", F.lit(1))
        came = own.unionByName(moved).join(unsettled, "shard", "left_semi")
        sizes = sizes.join(unsettled, "shard", "left_semi")
    order = F.struct("bins", "worth", "island", "rank")
    best = members.groupBy("shard").agg(F.min_by("genome", order).alias("genome"))
    kind = items.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, key long, sequence_id long, offset long, again boolean"
    return stored(items.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_place(capacity, level), out), "packed")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    A document is its text's ids, then END. Only longer ones are cut, into pieces
    of `capacity` tokens and a rest. Returns a row per piece: doc_id, piece (from
    0), start (ids of its document before it), length, ids_crc32 (its ids as
    little-endian unsigned 32-bit integers), sequence_id, offset (its place
    there; a sequence's pieces lie side by side from 0).

    Null and empty texts are the one token END; a very long text is encoded
    whole; repeated rows and ids are packed each by itself; null ids stay null;
    no rows give no rows; extra columns, whatever their names, are ignored.

    Plan: rows are tokenised where they lie. Pieces are dealt to shards of about
    `shard` pieces by a key of their own, so repeated rows spread. Each shard is
    evolved by `islands` tasks with seeds of their own: a grouping genetic
    algorithm, whose crossover injects whole well-filled sequences, removes
    duplicates and best-fits what it displaced. Between epochs each island's best
    packing moves to the next island. An island stops where a packing has as few
    sequences as the tokens need, and a shard whose best one has is not evolved
    further. What the shards' emptiest sequences hold, about a fiftieth, is packed
    again in new shards, until one shard does.
    """
    kept, level = [], 0
    items = stored(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    left, n = items, items.count()
    while True:
        shards = max(1, -(-n // shard))
        placed = _packed(left, shards, level, capacity, islands, epochs)
        if shards == 1:
            kept.append(placed)
            break
        again = placed.where("again")
        n, level = again.count(), level + 1
        if not n:
            kept.append(placed)
            break
        kept.append(placed.where("not again"))
        left = again.drop("sequence_id", "offset", "again")
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out.select(*_PIECE.split(", "), "sequence_id", "offset")
