"""Chat formatting, WARC, BPE and HTML: round trips, SQL, held-out accuracy."""

import gzip
import hashlib
import random
import struct

import pyarrow as pa
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from sieveline.llm import bpe, chat, html_extract, queries, warc

TOKENIZER = queries.tokenizer_path()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connect(sf))


def test_chat_round_trip(spark):
    nasty = ["a\\b <|end|> </s>[INST] \\[/INST] <<|x $1", None, "x\n<|turn|>y<|sep|>", "é<s>\\", "", "<|", "\\", "<\\|end|>", "日本 \U0001f600"]
    rows = [(c, t, ("user", "assistant", "assis<|sep|>tant", None)[(c + t) % 4], x) for c in range(4) for t, x in enumerate(nasty)]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (7, None, "assistant", "first"), (None, 0, "assistant", "q")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_chat(df).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c in (0, 1, 2, 3, 7, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        r = out[c]
        assert [(x.role, x.text) for x in r.back] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.formatted == "".join(s.text for s in r.segments) and r.formatted_chars == len(r.formatted)
        assert r.formatted.count(chat.END) == len(own)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_parts(spark):
    p = "array<struct<type:string,text:string,ref:string,units:long>>"
    rows = [(1, 0, "user", [("text", "hi <|", None, None), ("Image", None, "a.png", 2), ("audio", None, "b.wav", None), None, ("tool", "q", None, None)]), (1, 1, "assistant", None), (1, 2, "user", [("document", None, "c.pdf", 3), ("image", None, "d.png", 1)])]
    r = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {p}"), parts_col="parts").first()
    assert r.segments[1].text == "hi <\\|<|image:0|><|audio:1|>[tool: q]" and r.segments[4].text == "" and r.segments[7].text == "<|document:0|><|image:1|>"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 512), (0, "audio", "b.wav", 25), (2, "document", "c.pdf", 1536), (2, "image", "d.png", 256)]
    assert r.expanded_tokens == 512 + 25 + 1536 + 256


def test_chat_runs_no_python(spark, sf):
    plan = queries.op3_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_warc(spark, tmp_path):
    big, small = "<p>" + "x" * 200, "tiny é"
    rows = [(5, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (3, "u", small), (1, "v", small), (7, "n", None), (8, "m", ""), (None, "z", big), (2, "again", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    back = warc.read_archive(spark, warc.write_archive(df)).select("*", warc.field(F.col("header"), "X-Page-ID").alias("id"), warc.field(F.col("header"), "WARC-Type").alias("type"), warc.field(F.col("header"), "X-Refers-To-Page-ID").alias("to")).collect()
    assert sorted((str(r.id), r.type, str(r.to)) for r in back) == sorted([("2", "response", "None")] * 2 + [("5", "revisit", "2"), ("9", "revisit", "2"), ("None", "revisit", "2")] + [(str(k), "response", "None") for k in (1, 3, 7, 8)])
    want = {str(i): (h or "").encode() for i, _, h in rows}
    for r in back:
        assert bytes(r.payload) == want[str(r.id)] and r.payload_digest == hashlib.sha256(r.payload).hexdigest()
    # the records' bytes are WARC: what a reader of files makes of them is the same
    data = b"".join(bytes(r.record) for r in back)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    parsed = warc.parse_warc(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(parsed) == 2 * len(rows)
    assert sorted(p.header for p in parsed) == sorted(2 * [r.header for r in back])
    assert {bytes(p.block) for p in parsed} == {big.encode(), small.encode(), b""}
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).count() == 0


def test_warc_stores_payloads_once(spark, monkeypatch):
    from sieveline.llm import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    df = spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat('y', 300) as html")
    a = warc.write_archive(df)
    assert spark.table(a.payloads).count() == 1 and spark.read.parquet(a.records).count() == 50
    more = df.union(spark.range(100, 103).selectExpr("id", "'u'", "concat(id, 'z')"))
    back = warc.read_archive(spark, warc.write_archive(more)).select(warc.field(F.col("header"), "WARC-Type").alias("t"), F.octet_length("payload").alias("n")).collect()
    assert sorted((r.t, r.n) for r in back) == [("response", 4)] * 3 + [("response", 300)] + [("revisit", 300)] * 49


EXTRA = [(-1, None), (-2, ""), (-3, "a<|endoftext|> b<|endoftext|>"), (-4, "  x\n\n  y's Don't  "), (-5, "日本語 Ṭ1 \U0001e6c5 ①２ é"), (-6, "\x00\x1c \x85 　x ҝ"), (-7, "word " * 40_000), (-8, "<|endoftext"), (-8, "<|endoftext"), (None, "x")]


def test_bpe_matches_the_library(spark, sf, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CHUNK", 1 << 18)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(EXTRA, "doc_id long, text string"))
    t = Tokenizer.from_file(TOKENIZER)
    out = bpe.encode_decode(docs.withColumn("ids", F.lit("clash")), TOKENIZER)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = list(struct.unpack(f"<{r.n_tokens}I", r.ids))
        assert ids == want[r.doc_id] and r.decoded == t.decode(ids, skip_special_tokens=False)
    texts = {r.doc_id: r.text for r in bpe.decode(out, TOKENIZER).collect()}
    assert texts == {r.doc_id: r.decoded for r in rows}
    assert bpe.encode_decode(docs.limit(0), TOKENIZER).count() == 0


def test_words_of_many_chunks(spark, monkeypatch):
    """Every word is encoded once, in whichever batches its rows come, and spelt
    out of its ids' pieces."""
    from types import SimpleNamespace

    spec = bpe.read_spec(TOKENIZER)
    words = sorted([" the"] * 9 + ["zebra"] * 2 + ["  ", "日本", "x" * 5000, "<|endoftext|>", "\x00"], key=str.encode)
    rows = pa.table({"word": words, "at": pa.array([k << bpe.PLACE_BITS | k for k in range(len(words))], pa.int64())})
    calls, encode = [], bpe.Splitter.encode
    monkeypatch.setattr(bpe.Splitter, "encode", lambda self, w: calls.extend(w) or encode(self, w))
    pieces = bpe.piece_table(spec)
    for size in (1, 2, 5, 100):
        calls.clear()
        coded = pa.Table.from_batches(bpe._encode(SimpleNamespace(value=spec))(iter(rows.to_batches(max_chunksize=size))))
        assert sorted(calls) == sorted(set(words))
        coded = coded.add_column(2, "piece", pa.array([pieces[i] for i in coded.column("id").to_pylist()], pa.binary()))
        out = pa.Table.from_batches(bpe._spell(iter(coded.combine_chunks().to_batches(max_chunksize=size)))).to_pylist()
        assert [(r["chunk"], r["place"], r["spelt"].decode()) for r in out] == [(k, k, w) for k, w in enumerate(words)]
        for r in out:
            assert list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) == encode(bpe._splitter(spec), [r["spelt"].decode()])[0]


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_bpe_of_many_chunks(spark, monkeypatch, hot):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CHUNK", 200)
    monkeypatch.setattr(bpe, "HOT_CHUNKS", hot)
    df = spark.createDataFrame([(k, f"the end of the {k}\n") for k in range(60)], "doc_id long, text string")
    t = Tokenizer.from_file(TOKENIZER)
    for r in bpe.encode_decode(df, TOKENIZER).collect():
        text = f"the end of the {r.doc_id}\n"
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == t.encode(text).ids and r.decoded == text


def test_decode_arrays(spark):
    df = spark.createDataFrame([(1, [15496, 995]), (2, None), (3, [50256, -5, 99999999]), (4, [128])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, TOKENIZER).collect()}
    assert got == {1: "Hello world", 2: "", 3: "<|endoftext|>", 4: got[4]} and got[4]


def test_words_are_encoded_once(spark):
    sp = bpe.Splitter(bpe.read_spec(TOKENIZER))
    for t in ("a  b\n c's 12 ,;", "x<|endoftext|>y"):
        assert [i for w in sp.encode(sp.words(t)) for i in w] == sp.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def crf():
    return html_extract.train()


def test_crf_on_held_out_pages(crf):
    rng = random.Random(4242)
    wrong = total = 0
    for _ in range(200):
        feats, y = html_extract.labelled(*html_extract.labelled_page(rng))
        wrong += sum(a != b for a, b in zip(crf.decode(feats), y))
        total += len(y)
    assert wrong / total < 0.03


def test_viterbi_is_the_best_path(crf):
    import itertools

    rng = random.Random(1)
    feats = [rng.sample(range(len(html_extract._NAMES)), 5) for _ in range(8)]

    def value(y):
        s = sum(crf.emit[x] for f, l in zip(feats, y) if l for x in f)
        return s + sum(crf.move[a][b] for a, b in zip(y, y[1:]))

    best = max(itertools.product((0, 1), repeat=8), key=value)
    assert value(crf.decode(feats)) == pytest.approx(value(best))
    assert crf.decode([]) == []


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("<script>var x='<p>no</p>'</script><style>p{}</style><!-- c --><p>a &amp; b&nbsp;&lt;\n c", ["a & b < c"]),
        ("<p>one<p>two<br>three<div>four</div>five", ["one", "two three", "four", "five"]),
        ("<ul><li>a<li>b <b>c</b></ul><table><tr><td>d<td>e", ["a", "b c", "d", "e"]),
        ("<h1>t &am</h1><p title='a>b'>x</p></nope>", ["t &am", "x"]),
        ("plain < text", ["plain < text"]),
        ("<textarea><p>x</textarea><p>y<unclosed", ["y<unclosed"]),
        ("<p title=\"it>one</p><p class=\"x\">two", ["one", "two"]),
        ("<p title='it>one", ["one"]),
        ("<a href=\"x\"title='y>z'>k</a> &#" + "9" * 5000 + ";", ["k \ufffd"]),
    ],
)
def test_leaf_blocks(html, want):
    assert [b.text for b in html_extract.leaf_blocks(html)] == want


def test_extract(spark, sf, crf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import html as H
    import re

    out = {r.page_id: r for r in html_extract.extract(pages, crf).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        want = "\n".join(x for s in re.split(r"</?(?:p|h1|b|br)>", body) if (x := " ".join(H.unescape(s).split())))
        assert out[p.page_id].text == want and out[p.page_id].n_chars == len(want) and out[p.page_id].url == p.url
    odd = spark.createDataFrame([(1, None, None, 0), (2, "u", "", 0), (2, "u", "<p", 0), (None, "x", "<nav>" + "<div>" * 5000, 1)], "page_id long, url string, html string, n_chars int")
    assert [r.text for r in html_extract.extract(odd, crf).collect()][:2] == ["", ""]
    assert html_extract.extract(odd.limit(0), crf).count() == 0


def test_texts_and_parts_take_one_path(spark, sf, monkeypatch):
    seen, visit = [], chat.visit
    monkeypatch.setattr(chat, "visit", lambda parts: seen.append(parts) or visit(parts))
    assert queries.op3_chat_formatting(spark, sf).count() > 0 and len(seen) == 1
    p = "array<struct<type:string,text:string,ref:string,units:long>>"
    texts = ["a <|turn|> b\\", "", None, "<|image:0|> [INST]"]
    rows = [(1, k, "user", t, [("text", t, None, None)]) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {p}")
    assert chat.format_chat(d).collect() == chat.format_chat(d, parts_col="parts").collect()


def made_page(rng):
    """A page with boxes of noise inside its article, and its article's text;
    made another way than the pages that the model learns from."""
    say = lambda n: " ".join(rng.choice("rain over hills walked slowly, then again; nobody saw him there until morning came".split()) for _ in range(n)).capitalize() + "."
    noise = [
        lambda x: f'<div class="comments"><h4>{say(2)}</h4><div class="comment-body"><p>{x}</p></div></div>',
        lambda x: f'<div class="comment"><p>{x}</p></div>',
        lambda x: f'<ol class="comment-list"><li>{x}</li><li><p>{say(8)}</p></li></ol>',
        lambda x: f'<section id="comments"><ul><li class="reply">{x}</li></ul></section>',
        lambda x: f'<div class="notice">{x}</div>',
        lambda x: f'<div class="notice notice-info"><div><p>{x}</p><p>{say(9)}</p></div></div>',
        lambda x: f'<div role="alert"><p>{x}</p></div>',
        lambda x: f'<aside><p>{x}</p></aside>',
        lambda x: f'<div id="ad-slot" class="ad"><span>{x}</span></div>',
        lambda x: f'<form action="/s"><p>{x}</p><input type=text></form>',
        lambda x: f'<footer><p>{x}</p></footer>',
        lambda x: f'<nav><a href="/1">{say(2)}</a> <a href="/2">{say(3)}</a></nav>',
        lambda x: f"<script>var x = '<p>{x}</p>';</script>",
    ]
    want, parts = [], []
    title = say(4)
    want.append(title)
    for _ in range(rng.randint(3, 9)):
        if parts and rng.random() < 0.45:
            parts.append(rng.choice(noise)(say(rng.randint(5, 30))))
        else:
            x = " ".join(say(rng.randint(4, 15)) for _ in range(rng.randint(2, 4)))
            want.append(x)
            parts.append(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>"]).format(x))
    return f"<html><body><header><a href='/'>{say(2)}</a></header><nav><ul><li><a href=/a>{say(1)}</a></ul></nav><article><h1>{title}</h1>{''.join(parts)}</article><footer>&copy; {say(3)}</footer></body></html>", "\n".join(want)


def test_noise_inside_articles(crf):
    rng = random.Random(99)
    pages = [made_page(rng) for _ in range(400)]
    wrong = [(h, w) for h, w in pages if html_extract.main_text(h, crf) != w]
    assert len(wrong) <= 4, wrong[0]


@pytest.mark.parametrize("unit", ['<a "', "<div>x", "<div>x</p></span>", '<a b="x>', "<", "<!--", "<script>", "<ul><li>a", "<table><tr><td>b", "&#9", '<i id="comment" '])
def test_pages_take_linear_time(crf, unit):
    import time

    page = (unit * 40_000)[:32_768]
    took = []
    for text in (page, page, page * 8):
        began = time.perf_counter()
        html_extract.main_text(text, crf)
        took.append(time.perf_counter() - began)
    assert took[2] < 20 * max(min(took[:2]), 0.005)


KEPT = "<h1>Title of it</h1><p>The first paragraph of the article is long enough, and it has a second sentence.</p>"
AFTER = "<p>The last paragraph says more about the matter, as last ones do.</p>"


@pytest.mark.parametrize(
    "box",
    [
        '<ol class="commentlist"><li>I liked this very much, thank you.</li><li>So did I, and I would read more.</li></ol>',
        '<div id="postcomments"><div class="body"><p>I liked this very much, thank you.</p></div></div>',
        '<ul class="blogcomments"><li class="comment"><p>So did I, and I would read more of it.</p></li></ul>',
        '<div class="newsletter"><div class="content"><p>Get the best of our stories by mail, each week.</p></div></div>',
        '<div class="subscribe"><div class="main text"><p>Get the best of our stories by mail, each week.</p></div></div>',
        "<aside><article><h3>Another story</h3><p>This is about some other thing, with a sentence or two.</p></article></aside>",
        "<footer><main><p>This is about some other thing, with a sentence or two.</p></main></footer>",
        "<button>Read more of this</button>",
        '<div class="sitefooter"><p>All rights are reserved, and more is said here.</p></div>',
    ],
)
def test_boxes_inside_articles_go(crf, box):
    page = f"<html><body><article>{KEPT}{box}{AFTER}</article></body></html>"
    want = "\n".join(b.text for b in html_extract.leaf_blocks(KEPT + AFTER))
    assert html_extract.main_text(page, crf) == want


@pytest.mark.parametrize("name", ["social-history", "footer-wars", "banner-year-1812", "commentary", "notice-of-intent-text"])
def test_a_name_alone_does_not_drop_a_paragraph(crf, name):
    page = f'<html><body><article>{KEPT}<p class="{name}">A paragraph with a name of its own, of which the text says more.</p>{AFTER}</article></body></html>'
    assert "a name of its own" in html_extract.main_text(page, crf)


def test_layout_words_around_an_article_do_not_drop_it(crf):
    page = f'<html><body><div class="layout with-sidebar"><article>{KEPT}{AFTER}</article></div></body></html>'
    assert html_extract.main_text(page, crf).count("\n") == 2


def test_parse_broken_warc(spark, tmp_path):
    one = lambda n, body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + n + b"\r\n\r\n" + body + b"\r\n\r\n"
    good, wrong, long_ = one(b"5", b"hello"), one(b"x5", b"no length"), one(b"99999", b"too long")
    bodies = lambda raw: [b for _, _, b in warc.records(raw)]
    assert bodies(good + wrong + good + long_ + good) == [b"hello", b"no length", b"hello", b"too long", b"hello"]
    assert bodies(b"junk\r\n" + good + b"WARC/1.1\r\ncut") == [b"hello"] and bodies(b"") == bodies(b"junk") == []
    assert bodies(one(b"22", b"a\r\n\r\nWARC/1.1 inside\r\n")) == [b"a\r\n\r\nWARC/1.1 inside\r\n"]
    packed = gzip.compress(good) + gzip.compress(wrong)
    assert bodies(warc.inflated(packed)) == [b"hello", b"no length"]
    assert bodies(warc.inflated(gzip.compress(good) + gzip.compress(wrong)[:12] + b"\xff" * 9))[0] == b"hello"
    files = spark.createDataFrame([("a", packed, 1), ("b", None, 2), (None, good, 3), ("a", packed, 1)], "path string, content binary, offset int")
    assert sorted((str(r.path), bytes(r.block)) for r in warc.parse_warc(files).collect()) == sorted([("a", b"hello"), ("a", b"no length")] * 2 + [("None", b"hello")])
    assert warc.parse_warc(files.limit(0)).count() == 0


def test_very_long_texts_in_chats_and_payloads(spark):
    text = "a <|end|> \\ b " * 150_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(turns).select(chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert r.loss == text and [x.text for x in r.back] == [text, text]
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text)], "page_id long, url string, html string")
    back = warc.read_archive(spark, warc.write_archive(pages)).select(F.sha2("payload", 256).alias("d")).collect()
    assert {r.d for r in back} == {hashlib.sha256(text.encode()).hexdigest()} and len(back) == 2


def test_many_parts(spark):
    p = "array<struct<type:string,text:string,ref:string,units:long>>"
    parts = [("image", None, f"{k}.png", 1) if k % 2 else ("text", f"t{k}", None, None) for k in range(4000)]
    r = chat.format_chat(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {p}"), parts_col="parts").first()
    assert r.segments[1].text == "".join(f"<|image:{k // 2}|>" if k % 2 else f"t{k}" for k in range(4000))
    assert len(r.attachments) == 2000 and r.expanded_tokens == 2000 * 256


def test_warc_of_nothing_and_of_long_payloads(spark):
    long_ = "é" * 3_000_000
    rows = [(1, "http://a/", long_), (2, "http://b/", long_), (3, None, "x" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "'h' as header", "1 as n", "2 as id", "'p' as payload")
    back = {warc_id(r.header): (len(r.payload), "revisit" in r.header) for r in warc.read_archive(spark, warc.write_archive(df)).collect()}
    assert back == {1: (6_000_000, False), 2: (6_000_000, True), 3: (99, False)}
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).count() == 0


def warc_id(header):
    import re

    return int(re.search(r"X-Page-ID: (\d+)", header)[1])


def test_bpe_of_repeated_ids_and_clashing_names(spark):
    from tokenizers import Tokenizer

    from sieveline.llm import bpe, queries

    path = queries.tokenizer_path()
    rows = [(1, "one text"), (1, "another"), (1, "one text"), (None, "one text"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "2 as chunk", "'y' as decoded", "3 as words")
    got = sorted(((r.doc_id is None, r.doc_id), list(struct.unpack(f"<{r.n_tokens}I", r.ids)), r.decoded) for r in bpe.encode_decode(df, path).collect())
    t = Tokenizer.from_file(path)
    assert got == sorted(((i is None, i), t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in rows)
