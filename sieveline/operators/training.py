"""Data for fine-tuning and its evaluation: prompts, masks, padding, diffs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

IGNORED = -100
#: Fixed value: the longest sequence that is trained on.
MOST = 2048


def render_turns(df: DataFrame, by: list[str], order: list[str], role: str, text: str, sep: str = "\n") -> DataFrame:
    """Rows of a group as "role: text" lines in order, with their number."""
    t = F.struct(*order, F.col(role).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = F.sort_array(F.collect_list(t))
    return df.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.size("_rows").cast("long").alias("n_turns"), F.array_join(F.transform("_rows", lambda r: F.concat(r["_role"], F.lit(": "), r["_text"])), sep).alias("prompt"))


#: The wording of a repair prompt, and of a file in it.
REPAIR_PROMPT = "Fix the following issue in this repository. Output a unified diff patch.\n\n## Issue\n%s\n\n## Files\n%s"
REPAIR_FILE = "### %s\n```python\n%s\n```"


def repair_prompt(statement: Column, files: Column) -> Column:
    """Prompt for a patch: the issue, then files (array of {path, text})."""
    shown = F.transform(files, lambda f: F.format_string(REPAIR_FILE, f["path"], f["text"]))
    return F.format_string(REPAIR_PROMPT, statement, F.array_join(shown, "\n\n"))


def assemble(*parts: Column) -> Column:
    """Prompt from parts, null ones left out; an optional part is when(cond, text)."""
    return F.concat_ws("\n", *parts)


def masked_labels(ids: Column, prompt_len: Column, most: int = MOST) -> Column:
    """Labels of a sequence cut to `most`: the prompt's places are ignored."""
    cut = F.slice(ids, 1, most)
    n = F.least(prompt_len, F.lit(most)).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(cut, n + 1, F.greatest(F.size(cut) - n, F.lit(0))))


def padded(df: DataFrame, batch: list[str], ids: str, labels: str, pad: int) -> DataFrame:
    """Pad ids, labels and an attention mask to the longest row of each batch."""
    longest = df.groupBy(*batch).agg(F.max(F.size(ids)).alias("_m"))
    d = df.join(longest, batch)
    gap = F.greatest(F.col("_m") - F.size(ids), F.lit(0))
    return d.withColumns({"attention_mask": F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), gap)), labels: F.concat(labels, F.array_repeat(F.lit(IGNORED), gap)), ids: F.concat(ids, F.array_repeat(F.lit(pad), gap))}).drop("_m")


#: How lines of a unified diff begin.
DIFF_LINES = ("diff ", "index ", "--- ", "+++ ", "@@", "+", "-", " ")
#: Patterns of a fenced diff and of a hunk's head.
_FENCE = re.compile(r"```(?:diff|patch)?\s*\n(.*?)(?:```|\Z)", re.S)
_HUNK = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)")


def clean_diff(text: str | None) -> str | None:
    """The unified diff in a reply, its hunk headers recounted; None without one."""
    if text is None:
        return None
    m = _FENCE.search(text)
    kept = [x for x in (m.group(1) if m else text).splitlines() if x.startswith(DIFF_LINES)]
    if not any(x.startswith("---") for x in kept):
        return None
    out: list[str] = []
    header: tuple[int, re.Match] | None = None  # where the open hunk's header is
    old = new = 0

    def close():
        if header:
            at, h = header
            out[at] = f"@@ -{h[1]},{old} +{h[2]},{new} @@{h[3]}"

    for x in kept:
        if x.startswith(("@@", "diff ")):
            close()
            h = _HUNK.match(x)
            header, old, new = ((len(out), h) if h else None), 0, 0
        else:
            old += x[0] in "- "
            new += x[0] in "+ "
        out.append(x)
    close()
    return "\n".join(out) + "\n"


def extract_diffs(df: DataFrame, text: str, name: str = "diff") -> DataFrame:
    """Add the diff found in a text column, in Arrow batches."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(clean_diff, na_action="ignore")

    return df.withColumn(name, run(text))


def unified_diff(files: list | None) -> str:
    """Unified diffs of files ({path, before, after}; null: there is none), one
    after the other; without files, and where nothing differs, the empty text."""
    import difflib

    out: list[str] = []
    for f in [] if files is None else files:
        old, new = ((f[k] or "").splitlines(keepends=True) for k in ("before", "after"))
        names = ("/dev/null" if f["before"] is None else "a/" + f["path"], "/dev/null" if f["after"] is None else "b/" + f["path"])
        for line in difflib.unified_diff(old, new, *names):
            out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def unified_diffs(df: DataFrame, files: str, name: str = "patch") -> DataFrame:
    """Add the diff of an array of {path, before, after}, in Arrow batches."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(unified_diff)

    return df.withColumn(name, run(files))


def hunk_counts(df: DataFrame, by: list[str], patch: str) -> DataFrame:
    """Old and new line counts per hunk, by gaps and islands over exploded lines.
    All lines after a hunk's head and before the next head or file belong to it,
    those that begin with --- or +++ too."""
    from ..functions import text as T
    from .curate import islands

    rows = df.select(*by, F.posexplode(T.lines(F.col(patch))).alias("no", "line"))
    starts = F.col("line").startswith("@@") | F.col("line").startswith("diff ")
    rows = islands(rows, by, ["no"], starts, "hunk").withColumn("is_head", starts)
    keep = rows.where("hunk > 0 and not is_head")
    return keep.groupBy(*by, "hunk").agg(F.count_if(F.col("line").substr(1, 1).isin("-", " ")).alias("n_old"), F.count_if(F.col("line").substr(1, 1).isin("+", " ")).alias("n_new"))
