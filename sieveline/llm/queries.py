"""The registered queries of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .bpe import encode_decode
from .collocations import collocations
from .decontaminate import contaminated
from .html_extract import extract
from .licenses import scan_licenses
from .minhash import near_duplicates
from .packing import pack
from .quality import quality_rules
from .substring import substring_dedup
from .toxicity import score, train
from .warc import field, read_archive, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that overlap; clean ones have none."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    out = chat.format_chat(turns.unionByName(more))
    back = chat.read_back(F.col("formatted"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", F.size(back).cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archive(spark, write_archive(_table(spark, sf_dir, "pages")))
    h, n = F.col("header"), F.octet_length(F.encode("header", "UTF-8"))
    # a response's payload is the block of its rebuilt record, a revisit's that of the record it refers to
    block = F.substring(F.col("record"), n + 1, F.octet_length("record") - n - 4)
    back = back.withColumn("restored", F.when(field(h, "WARC-Type") == "revisit", F.col("payload")).otherwise(block))
    return back.select(field(h, "X-Page-ID").cast("long").alias("page_id"), F.octet_length("restored").cast("long").alias("payload_bytes"), F.sha2("restored", 256).alias("payload_digest"), field(h, "WARC-Type").alias("record_type"), field(h, "X-Refers-To-Page-ID").cast("long").alias("refers_to"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_spaced_seed_decontamination, op2_minhash_near_dedup, op3_chat_formatting, op4_warc_archive, op5_quality_rules, op6_toxicity, op7_bpe_encode_decode, op8_substring_dedup, op9_html_extraction, op10_license_scan, op11_phrase_collocations, op12_best_fit_packing)}


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(v, r) AS (
  SELECT DISTINCT a, a FROM both_ways
  UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
), comp AS (SELECT v, min(r) AS component FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN comp ON comp.v = s.doc_id
"""


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i+12], ' '))) AS k FROM w WHERE len(ws) >= 13
), least AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN least USING (k) WHERE low < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
cov AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS qs FROM benchmark),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM d),
q AS (SELECT item_id, unnest(qs) AS x, unnest(range(len(qs))) AS j, len(qs) AS n FROM b),
m AS (SELECT doc_id, item_id, t.i - q.j AS s, least(13, CAST(ceil(0.8 * any_value(n)) AS BIGINT)) AS need FROM t JOIN q USING (x) GROUP BY ALL HAVING count(*) >= least(13, ceil(0.8 * any_value(n)))),
span AS (SELECT m.*, ws, qs, greatest(s, 0) AS lo, least(s + len(qs), len(ws)) AS hi FROM m JOIN d USING (doc_id) JOIN b USING (item_id)),
c AS (SELECT doc_id, item_id, s, need, lo, len(qs) AS n, unnest(range(1, hi - lo + 1)) AS k, unnest(list_transform(range(lo, hi), lambda p: ws[p + 1] = qs[p - s + 1])) AS eq FROM span),
r AS (SELECT *, sum(CASE WHEN eq THEN 1 ELSE -3 END) OVER w AS run FROM c WINDOW w AS (PARTITION BY doc_id, item_id, s ORDER BY k)),
z AS (SELECT *, least(0, min(run) OVER (PARTITION BY doc_id, item_id, s ORDER BY k)) AS low FROM r),
e AS (SELECT doc_id, item_id, s, any_value(need) AS need, any_value(lo) AS lo, any_value(n) AS n, arg_min(k, (low - run) * 1000000 + k) AS last, max(run - low) AS best FROM z GROUP BY ALL),
f AS (SELECT e.*, coalesce((SELECT arg_min(k, run * 1000000 + k) FROM r WHERE r.doc_id = e.doc_id AND r.item_id = e.item_id AND r.s = e.s AND k <= last AND run < 0), 0) AS first FROM e WHERE best > 0),
g AS (SELECT f.doc_id, f.item_id, f.s, any_value(need) AS need, any_value(f.lo + first) AS start_word, any_value(f.lo + last) AS end_word, any_value(f.n) AS n, count(*) FILTER (eq) AS hits
  FROM f JOIN (SELECT doc_id, item_id, s, k, eq FROM r) r ON r.doc_id = f.doc_id AND r.item_id = f.item_id AND r.s = f.s AND k > first AND k <= last GROUP BY ALL)
SELECT doc_id, item_id, hits AS n_matched, CAST(n AS BIGINT) AS item_words, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word FROM g WHERE hits >= need
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hits DESC, start_word, end_word) = 1
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g3 AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) AS g FROM w WHERE len(ws) >= 3),
rep3 AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g3) WHERE c > 1),
n3 AS (SELECT doc_id, count(DISTINCT i) AS n FROM rep3 GROUP BY doc_id),
g8 AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS g FROM w WHERE len(ws) >= 8),
rep8 AS (SELECT doc_id, unnest(range(i, i + 8)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g8) WHERE c > 1),
n8 AS (SELECT doc_id, count(DISTINCT i) AS n FROM rep8 GROUP BY doc_id),
pair AS (SELECT a.doc_id, b.i - a.i AS d, a.i FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
isle AS (SELECT doc_id, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM pair),
longest AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, count(*) AS c FROM isle GROUP BY doc_id, d, k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(n3.n, 0) AS n_repeat_words, coalesce(n8.n, 0) AS covered_words, coalesce(longest.n, 0) AS longest_repeat
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN n3 USING (doc_id) LEFT JOIN n8 USING (doc_id) LEFT JOIN longest USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT * EXCLUDE (covered_words, longest_repeat), NOT base_failed AND covered_words <= 0.45 * n_words AND longest_repeat <= 100 AS kept, covered_words, longest_repeat FROM f
"""

OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) + length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) + count(*) * (length('<|turn|>') + length('<|sep|>') + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CAST(strlen(html) AS BIGINT) AS n, min(page_id) OVER (PARTITION BY d) AS least FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
FROM q
"""

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws, count(*) AS m FROM d GROUP BY ALL),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase, m FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), m FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), m FROM p
),
f AS (SELECT lang, k, phrase, CAST(sum(m) AS BIGINT) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, i, array_to_string(w[:i], ' ') AS first, array_to_string(w[i + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (
  SELECT lang, phrase, a, i, x.f AS l, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN (SELECT lang, phrase AS first, f FROM f) x USING (lang, first) JOIN (SELECT lang, phrase AS rest, f FROM f) y USING (lang, rest)
),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_ AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN total USING (lang) LEFT JOIN longer USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_spaced_seed_decontamination": OP1_SQL, "op5_quality_rules": OP5_SQL, "op2_minhash_near_dedup": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op4_warc_archive": OP4_SQL, "op8_substring_dedup": OP8_SQL, "op11_phrase_collocations": OP11_SQL}
