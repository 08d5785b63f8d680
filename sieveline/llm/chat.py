"""Chat formatting with typed content parts, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and what else is escaped in
#: texts because public chat templates read it as control.
TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
#: Parts that become placeholders, and the tokens a unit of them expands to
#: (an image's tiles, an audio's seconds, a document's pages).
EXPANDS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    """Put a backslash into every control string and double backslashes, so that
    a text can't hold a control string and unescape() gives it back."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(<)(\||/?s>)|(\[)(/?INST\])", r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _sql_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def visit(parts: Column) -> Column:
    """Flatten an array of typed parts into {body, refs}.

    A part is struct<type, text, ref, units>. Text parts (and those without a
    type) give their escaped text; image, audio and document parts give the
    placeholder <|type:k|>, k counting such parts of the turn from 0, and a
    reference {type, ref, units, tokens}; others give their text, escaped, in
    brackets of their type. Null parts give nothing.
    """
    known = list(EXPANDS)
    kind = lambda p: F.lower(_sql_text(p["type"]))
    some = F.filter(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,units:long>>")), lambda p: p.isNotNull())
    media = F.filter(some, lambda p: kind(p).isin(known))
    rate = F.create_map(*[x for k, v in EXPANDS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    refs = F.transform(media, lambda p: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).cast("long").alias("units"), (F.coalesce(p["units"], F.lit(1)) * rate[kind(p)]).cast("long").alias("tokens")))
    # which of the parts are media: their place in this list is their number
    at = F.filter(F.transform(some, lambda p, i: F.when(kind(p).isin(known), i)), lambda i: i.isNotNull())
    step = F.transform(
        some,
        lambda p, i: F.when(kind(p).isin(known), F.concat(F.lit("<|"), kind(p), F.lit(":"), (F.array_position(at, i) - 1).cast("string"), F.lit("|>")))
        .when(kind(p).isin("text", ""), escape(_sql_text(p["text"])))
        .otherwise(escape(F.concat(F.lit("["), kind(p), F.lit(": "), _sql_text(p["text"]), F.lit("]")))),
    )
    return F.struct(F.array_join(step, "").alias("body"), refs.alias("refs"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None, learn: str = "assistant") -> DataFrame:
    """One row per conversation, formatted by a template that can be read back.

    A turn is TURN role SEP body END; turns follow each other by turn, role and
    text. Bodies come from parts_col (array of typed parts, see visit), or from
    text_col, each text one text part. Control strings inside roles and texts are escaped. Returns
    conv_id, n_turns, formatted, segments (array of {text, loss} whose texts
    joined are `formatted`; loss marks the bodies of `learn` turns), attachments
    (array of {turn_no, type, ref, units, tokens} in order), expanded_tokens
    (their sum), formatted_chars.

    Null texts and roles are empty; repeated rows and equal turn numbers are
    turns of their own; null turn numbers come first; rows with a null
    conversation form one of their own; texts are taken whole, however long. No
    rows, no conversations. Extra columns, whatever their names, are ignored.

    Turns are rendered where they lie; one shuffle by conversation moves them.
    A conversation's turns meet in one row, as its text must.
    """
    if parts_col is not None:
        parts = F.col(parts_col)
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
    body = visit(parts)
    role = _sql_text(F.col(role_col))
    row = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), body.alias("b")).alias("t"))
    by = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    segs = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["b"]["body"].alias("text"), (t["role"] == learn).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = by.select("conv_id", F.size("ts").cast("long").alias("n_turns"), segs.alias("segments"), F.flatten(F.transform("ts", lambda t, k: F.transform(t["b"]["refs"], lambda r: F.struct(k.cast("long").alias("turn_no"), r["type"].alias("type"), r["ref"].alias("ref"), r["units"].alias("units"), r["tokens"].alias("tokens"))))).alias("attachments"))
    out = out.withColumn("formatted", F.array_join(F.col("segments.text"), ""))
    return out.withColumns({"expanded_tokens": F.aggregate("attachments", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]), "formatted_chars": F.char_length("formatted").cast("long")})


def read_back(formatted: Column) -> Column:
    """Turns {role, text} of a formatted conversation; media placeholders stay."""
    cut = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace(p, r"(?s)^.*?<\|sep\|>", ""), r"<\|end\|>$", "")).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
