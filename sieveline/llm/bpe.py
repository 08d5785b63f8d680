"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, ship
from .kernel import blocks, ragged, text_arrays, trim

#: Bytes of text in a chunk. Of each chunk's TOP most frequent words, those that
#: HOT_CHUNKS chunks or more have (and that are of LONGEST_HOT bytes at most) are
#: known everywhere: the MOST_HOT ones that the most chunks have.
CHUNK, TOP, HOT_CHUNKS, MOST_HOT, LONGEST_HOT = 16 << 20, 50_000, 3, 100_000, 64
#: Rows that a task holds to send them to their chunks together.
HELD = 1 << 19
#: Bits of a chunk's number within its partition, and of a word's in its chunk,
#: which share a long with the partition's.
SEQ_BITS, PLACE_BITS = 14, 28
#: How byte-level BPE splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes have not changed in recent Unicode versions; texts
#: with others are split by the tokenizer's own splitter, so that both agree.
SETTLED = r"[\x00-ԯ֐-ࡿऀ-౛ -₎₠-⿿　-鿿가-힣]*"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_table(spec: str) -> dict[int, bytes]:
    """Id to piece, from a tokenizer's JSON."""
    j = json.loads(spec)
    alphabet = byte_alphabet()
    out = {i: bytes(alphabet[c] for c in p) for p, i in j["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in j["added_tokens"]}


class Splitter:
    """Splits texts into words as the tokenizer does; the strings of added
    tokens are words of their own."""

    def __init__(self, spec: str) -> None:
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        j = json.loads(spec)
        pre = j["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or j["normalizer"] or j["post_processor"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]):
            raise ValueError("only plain byte-level tokenizers are supported")
        j["truncation"] = j["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(j))
        added = sorted((t["content"] for t in j["added_tokens"]), key=len, reverse=True)
        self.added = set(added)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.find = regex.compile(PATTERN).findall
        self.settled = regex.compile(SETTLED).fullmatch

    def words(self, text: str) -> list[str]:
        if self.at_added and any(a in text for a in self.added):
            return [w for part in self.at_added.split(text) if part for w in ([part] if part in self.added else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or self.settled(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


_splitters: dict[str, Splitter] = {}


def _splitter(spec: str) -> Splitter:
    if spec not in _splitters:
        _splitters.clear()
        _splitters[spec] = Splitter(spec)
    return _splitters[spec]


_zstd = pa.Codec("zstd", compression_level=7)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _zstd.compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _zstd.decompress(data[8:], n, asbytes=True) if n else b""


def _planes(codes: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their second ones, and so on."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    """Numbers for words, in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(spec_of, most: int):
    """Rows -> chunks of whole texts: their ids, how many words each has, which
    of the chunk's distinct words stands at every position, and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = _splitter(spec_of.value)
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        place, ids, counts, codes = _Numbers(), [], [], []

        def flush():
            code = np.concatenate(codes)
            if part >> 63 - SEQ_BITS - PLACE_BITS or seq >> SEQ_BITS or len(place) >> PLACE_BITS:
                raise ValueError("too many partitions, or too large ones")
            often = np.argsort(-np.bincount(code, minlength=len(place)), kind="stable")  # small numbers for frequent words
            number = np.empty(len(place), "<u4")
            number[often] = np.arange(len(place))
            one = pa.concat_arrays(ids)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", one.type)])) as w:
                w.write_batch(pa.record_batch([one], ["id"]))
            packed = [sink.getvalue().to_pybytes(), np.array(counts, "<i8").tobytes(), _planes(number[code])]
            words = pa.array(list(place), pa.string()).take(pa.array(often))
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([part << SEQ_BITS | seq], pa.int64()), *(pa.array([_pack(x)], pa.binary()) for x in packed), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["chunk", "ids", "counts", "codes", "words"])

        for batch in batches:
            for i, j, buf, at in blocks(batch.column(1)):
                ids.append(batch.column(0).slice(i, j - i))
                raw = buf.tobytes()
                for a, b in zip(at.tolist(), at[1:].tolist()):
                    words = split.words(raw[a:b].decode("utf-8", "replace"))
                    counts.append(len(words))
                    codes.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                size += len(buf) + 64 * (j - i)
                if size >= most:
                    yield flush()
                    place, ids, counts, codes = _Numbers(), [], [], []
                    seq, size = seq + 1, 0
        if ids:
            yield flush()
        del place, ids, counts, codes
        trim()

    return run


def _encode(spec_of):
    """The chunks' words, sorted by word -> a row per id of each distinct word;
    the first also says in which chunks the word is, and at which places of
    their lists (both in one number). A word is encoded where it first comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(spec_of.value)
        last, last_ids = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0).dictionary_encode()  # sorted: numbered in order
            words = runs.dictionary.to_pylist()
            again = words[0] == last
            ids = ([last_ids] if again else []) + split.encode(words[again:])
            last, last_ids = words[-1], ids[-1]
            size = np.array([len(x) for x in ids], np.int64)
            places = np.zeros(int(size.sum()) + 1, np.int32)
            places[np.cumsum(size) - size + 1] = np.bincount(runs.indices.to_numpy(), minlength=len(words))
            ofs = pa.array(np.cumsum(places).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ragged(np.zeros_like(size), size)), pa.array([i for x in ids for i in x], pa.int32()), pa.ListArray.from_arrays(ofs, batch.column(1))], names=["k", "id", "at"])
        trim()

    return run


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, each with its piece -> a row per chunk and word: the word's
    place, its ids and the bytes that they stand for."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        k, ids = (table.column(c).to_numpy() for c in ("k", "id"))
        first = np.flatnonzero(k == 0)
        if not np.array_equal(k, np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))):
            raise RuntimeError("ids came out of order")
        data, at = text_arrays(table.column("piece"))
        where = pa.concat_arrays(table.column("at").chunks)
        times = where.value_lengths().to_numpy(zero_copy_only=False)[first]
        word = pa.array(np.repeat(np.arange(len(first)), times))
        blob = lambda raw, ofs: pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ofs.astype(np.int32)), pa.py_buffer(raw)]).take(word)
        chunk, place = np.divmod(where.flatten().to_numpy(), 1 << PLACE_BITS)
        return pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(place.astype(np.int32)), blob(ids.astype("<u4"), 4 * np.append(first, len(k))), blob(np.ascontiguousarray(data), at[np.append(first, len(k))])], names=["chunk", "place", "ids", "spelt"])

    for batch in batches:
        firsts = np.flatnonzero(batch.column(0).to_numpy() == 0)
        if not len(firsts):  # a word of more ids than a batch has rows
            held.append(batch)
            continue
        cut = int(firsts[-1])
        head = [*held, batch.slice(0, cut)]
        if sum(x.num_rows for x in head):
            yield out(pa.Table.from_batches(head))
        held = [batch.slice(cut)]
    if sum(x.num_rows for x in held):
        yield out(pa.Table.from_batches(held))


def _sent(most: int):
    """_spell(), its rows packed by chunk, `most` rows or a few more at a time."""

    def pack(rows: pa.Table) -> pa.RecordBatch:
        chunk = rows.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(chunk[order]) != 0]))
        packed = []
        for a, b in zip(start, np.append(start[1:], len(order))):
            one = rows.take(pa.array(order[a:b]))
            (ids, ids_at), (text, text_at) = (text_arrays(one.column(c)) for c in ("ids", "spelt"))
            packed.append(_pack(_planes(np.array([b - a])) + _planes(np.concatenate([one.column("place").to_numpy(), np.diff(ids_at) // 4, np.diff(text_at)])) + len(ids).to_bytes(8, "little") + _planes(np.frombuffer(ids.tobytes(), "<u4")) + text.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(chunk[order][start]), pa.array(packed, pa.binary())], names=["chunk", "answers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in _spell(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))
        held = []
        trim()

    return run


def _opened(blobs: list[bytes]) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Places of words, and the bytes and offsets of their ids and pieces."""
    place, sizes, data = [], {"ids": [], "spelt": []}, {"ids": [], "spelt": []}
    for blob in blobs:
        raw = _unpack(blob)
        n = int(_from_planes(raw[:4])[0])
        numbers = _from_planes(raw[4 : 4 + 12 * n])
        size = int.from_bytes(raw[4 + 12 * n : 12 + 12 * n], "little")
        place.append(numbers[:n])
        sizes["ids"].append(4 * numbers[n : 2 * n].astype(np.int64))
        sizes["spelt"].append(numbers[2 * n :].astype(np.int64))
        data["ids"].append(_from_planes(raw[12 + 12 * n : 12 + 12 * n + size]).view(np.uint8))
        data["spelt"].append(np.frombuffer(raw, np.uint8, offset=12 + 12 * n + size))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(place or none).astype(np.int64), {c: (np.concatenate(data[c] or [np.zeros(0, np.uint8)]), np.cumsum(np.concatenate([[0], *sizes[c]]))) for c in data}


def _gather(data: np.ndarray, at: np.ndarray, order: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of word codes: the words' parts one after the other, as bytes
    and offsets. order: the part of each code, by the parts' bytes and offsets."""
    start, size = at[:-1][order], np.diff(at)[order]
    row_at = np.concatenate([[0], np.cumsum(counts)])
    step, total, sizes = 1 << 17, 0, np.zeros(len(counts), np.int64)
    # a step of words at a time: nothing of the chunk's number of words but the bytes themselves
    for c in range(0, len(codes), step):
        n = size[codes[c : c + step]]
        total += int(n.sum())
    out, done = np.empty(total, np.uint8), 0
    for c in range(0, len(codes), step):
        k = codes[c : c + step]
        n = size[k]
        got = data[ragged(start[k], n)]
        out[done : done + len(got)] = got
        done += len(got)
        first, last = np.searchsorted(row_at, [c, c + len(k)], "right")
        edges = np.clip(row_at[max(first - 1, 0) : last + 1], c, c + len(k)) - c
        upto = np.concatenate([[0], np.cumsum(n)])
        part = np.diff(upto[edges])
        sizes[max(first - 1, 0) : max(first - 1, 0) + len(part)] += part
    return out, np.concatenate([[0], np.cumsum(sizes)])


def _put_back(hot_of):
    """A chunk, and its distinct words' ids and pieces -> ids and decoded text
    of each of its rows, by the words' positions."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hot = hot_of.value
        out = []
        place, own_words = _opened(right.column("answers").to_pylist())
        for ids, counts, codes, words in zip(*(left.column(c) for c in ("ids", "counts", "codes", "words"))):
            own = pa.ipc.open_stream(_unpack(ids.as_py())).read_all().column(0).combine_chunks()
            n = np.frombuffer(_unpack(counts.as_py()), "<i8")
            code = _from_planes(_unpack(codes.as_py()))
            order = pc.fill_null(pc.index_in(words.values, hot["word"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            order[place] = len(hot["word"]) + np.arange(len(place))
            if (order < 0).any():
                raise RuntimeError("a word has no ids")
            got = []
            for part in ("ids", "spelt"):
                (d1, a1), (d2, a2) = hot[part], own_words[part]
                got.append(_gather(np.concatenate([d1, d2]), np.concatenate([a1, a1[-1] + a2[1:]]), order, code, n))
            (flat, ofs), text = got
            kind, wide = (pa.large_binary(), np.int64) if ofs[-1] > 2**31 - 1 else (pa.binary(), np.int32)
            b = type(pa.array([], kind)).from_buffers(kind, len(n), [None, pa.py_buffer(ofs.astype(wide)), pa.py_buffer(flat)])
            del code, order, got
            out.append(pa.table([own if not isinstance(own, pa.ChunkedArray) else pa.concat_arrays(own.chunks), pa.array(np.diff(ofs) // 4), b.cast(pa.binary()), _as_text(*text)], names=["doc_id", "n_tokens", "ids", "decoded"]))
        del own_words, place
        trim()
        return pa.concat_tables(out)

    return run


def spelt(words: DataFrame, spec_of, pieces: DataFrame) -> DataFrame:
    """For rows of word, chunk and place: chunk and answers, which pack the
    places, the words' ids and, joined to the ids, their pieces. Every distinct
    word is encoded once."""
    at = (F.col("chunk") * (1 << PLACE_BITS) + F.col("place")).alias("at")
    coded = words.select("word", at).repartition("word").sortWithinPartitions("word").mapInArrow(_encode(spec_of), "k long, id int, at array<long>")
    return coded.join(F.broadcast(pieces), "id").select("k", "id", "piece", "at").mapInArrow(_sent(HELD), "chunk long, answers binary")


def decode_ids(ids: np.ndarray, n: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of ids, by lookup in the id-to-piece table."""
    at = ids.astype(np.int64)
    ln = size[at]
    done = np.concatenate([[0], np.cumsum(ln)])
    ofs = done[np.concatenate([[0], np.cumsum(n)])]
    out = np.empty(int(done[-1]), np.uint8)
    for c in range(0, len(at), 1 << 20):
        s = slice(c, c + (1 << 20))
        out[done[c] : done[min(c + (1 << 20), len(at))]] = data[ragged(start[at[s]], ln[s])]
    return out, ofs


def _as_text(data: np.ndarray, ofs: np.ndarray) -> pa.Array:
    """Bytes to text; what isn't UTF-8 becomes the replacement character."""
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(ofs) - 1, [None, pa.py_buffer(ofs.astype(np.int32)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


def _pieces(spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = piece_table(spec)
    top = max(table) + 1
    size = np.array([len(table.get(i, b"")) for i in range(top)], np.int64)
    return np.frombuffer(b"".join(table.get(i, b"") for i in range(top)), np.uint8), np.cumsum(size) - size, size


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text and the text decoded from them.

    tokenizer: path of a byte-level BPE tokenizer's JSON on the driver (its
    contents, of fixed size, are broadcast). Returns one row per input row:
    doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers),
    decoded. Ids are those of the tokenizers library without special tokens
    being added, without truncation or padding; a special token's string in a
    text is that token. Null and empty texts have no ids and decode to the empty
    text; a very long text is a chunk of its own. Repeated rows and ids get a
    row each; no rows give no rows; extra columns, whatever their names, are
    ignored.

    Plan: texts are split into words once, where they lie, and kept as numbers
    of the chunk's distinct words (about 16 MB of text, or one longer text), in
    the shared folder. These words meet by word: each distinct one is encoded
    once, and its ids are joined to their pieces, a table of the vocabulary's
    fixed size. Both go back to the chunks that have the word, where they take
    the word's positions. The words that most chunks have, a bounded number, are
    encoded first and sent to all; a word is one row per chunk otherwise, and
    those are streamed.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = read_spec(tokenizer)
    spec_of = spark.sparkContext.broadcast(spec)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    cut = bucketed(base.mapInArrow(_split(spec_of, CHUNK), "chunk long, ids binary, counts binary, codes binary, words array<string>"), "chunk", "bpe_words")
    by_id = piece_table(spec)
    pieces = spark.createDataFrame(pa.table({"id": pa.array(list(by_id), pa.int32()), "piece": pa.array(list(by_id.values()), pa.binary())}))
    used = cut.select("chunk", F.posexplode("words").alias("place", "word"))
    most = used.where((F.col("place") < TOP) & (F.octet_length("word") <= LONGEST_HOT)).groupBy("word").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_CHUNKS)
    words = most.orderBy(F.desc("c"), "word").limit(MOST_HOT).select("word").toArrow().column(0)
    n = len(words)
    hot = spark.createDataFrame(pa.table({"word": words, "chunk": pa.array(np.zeros(n, np.int64)), "place": pa.array(np.arange(n, dtype=np.int32))})) if n else None
    place, known = _opened([r["answers"] for r in spelt(hot, spec_of, pieces).collect()] if n else [])
    hot_of = spark.sparkContext.broadcast({"word": pa.concat_arrays(words.chunks).take(pa.array(place)) if n else pa.array([], pa.string()), **known})
    if n:
        used = used.join(F.broadcast(hot.select("word")), "word", "left_anti")  # MOST_HOT words of LONGEST_HOT bytes at most
    answers = spelt(used, spec_of, pieces)
    return cut.select(F.col("chunk").alias("of"), "ids", "counts", "codes", "words").groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(_put_back(hot_of), f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def encode(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    return encode_decode(docs, tokenizer, **kw).drop("decoded")


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of rows of ids (binary as made by encode, or array<int>): each id
    looks up its piece in the vocabulary's table, in order. Null ids give the empty text; an id outside
    the vocabulary adds nothing; invalid UTF-8 becomes U+FFFD."""
    spark = tokens.sparkSession
    ship(spark)
    pieces_of = spark.sparkContext.broadcast(_pieces(read_spec(tokenizer)))
    array = tokens.schema[ids_col].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start, size = pieces_of.value
        for batch in batches:
            if array:
                lists = batch.column(1)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                raw, at = text_arrays(batch.column(1))
                flat, n = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), np.diff(at) // 4
            flat = np.where((flat < 0) | (flat >= len(size)), len(size), flat)
            dec, ofs = decode_ids(flat, n, data, np.append(start, 0), np.append(size, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_text(dec, ofs)], names=["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
