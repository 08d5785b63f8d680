"""Column functions over text, paths and patches. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a test file (searched anywhere, any case), words
#: that are never requirement names, and how texts refer to issues.
TEST_PATH = r"(?i)(^|/)(tests?|testing)/|test_.*\.py$|.*_test\.py$"
JUNK_REQUIREMENTS = ("python", "name", "version", "description", "author", "url", "license")
ISSUE_REFERENCE = r"(?i)(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)"

#: The same with file names anchored to a path component.
STRICT_TEST_PATH = r"(?i)(^|/)(tests?|testing)/|(^|/)test_[^/]*\.py$|_test\.py$"


def is_test_file(path: Column, strict: bool = False) -> Column:
    """A Python file whose path matches the test pattern. The pattern searches,
    so src/latest_api.py counts; strict anchors file names."""
    return path.rlike(r"(?i)\.py$") & path.rlike(STRICT_TEST_PATH if strict else TEST_PATH)


def is_source_file(path: Column, strict: bool = False) -> Column:
    return path.rlike(r"(?i)\.py$") & ~is_test_file(path, strict)


def split_files(files: Column) -> tuple[Column, Column]:
    """Source files and test files of an array of paths, in order."""
    return F.filter(files, lambda f: is_source_file(f)), F.filter(files, lambda f: is_test_file(f))


def has_items(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def not_blank(text: Column) -> Column:
    """Holds something that isn't white space; null doesn't."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def instance_id(repo: Column, sha: Column) -> Column:
    return F.concat_ws("_", repo, F.substring(sha, 1, 7))


def repo_of(instance: Column) -> Column:
    """Everything before the last underscore."""
    return F.regexp_replace(instance, "_[^_]*$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_]{2,}"), 0)


def node_tokens(name: Column, text: Column, most: int = 400) -> Column:
    """Tokens of a name and the first `most` tokens of its text."""
    return F.concat(tokens(name), F.slice(tokens(text), 1, most))


def text_or(text: Column, other: Column) -> Column:
    """The text, or another value where it is null or empty."""
    return F.when(present(text), text).otherwise(other)


def before(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def patched_files(patch: Column) -> Column:
    """Distinct files that a unified diff changes, by its old side."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"--- a/(\S+)"), 1))


def test_targets(patch: Column) -> Column:
    """Python files on the new side of a diff, or ["tests"]."""
    found = F.array_distinct(F.regexp_extract_all(patch, F.lit(r"\+\+\+ b/(\S+\.py)"), 1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("tests")))


def issue_reference(body: Column, subject: Column) -> Column:
    """Number of the first issue that a text says it fixes, the body first."""
    first = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), ISSUE_REFERENCE, 1), F.lit(""))
    return F.coalesce(first(body), first(subject)).cast("long")


def lines(text: Column) -> Column:
    """Lines ended by CRLF, LF or CR; an empty last one is dropped."""
    parts = F.split(text, r"\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def changed_lines(patch: Column) -> Column:
    """Added and removed lines of a diff, without file headers."""
    return F.size(F.filter(lines(patch), lambda x: (x.startswith("+") | x.startswith("-")) & ~x.startswith("+++") & ~x.startswith("---"))).cast("long")


def requirement_name(spec: Column) -> Column:
    """Normalised name of a requirement line, null where it isn't one."""
    name = F.trim(F.regexp_extract(spec, r"^([^<>=!~\[ ;]*)", 1))
    return F.when(name.rlike(r"^[A-Za-z0-9_.-]+$"), F.translate(F.lower(name), "-", "_"))


def keep_requirement(name: Column, own: Column) -> Column:
    """Not junk, not the package itself, more than one character."""
    return name.isNotNull() & ~F.lower(name).isin(*JUNK_REQUIREMENTS) & (name != own) & (F.length(name) > 1)


def to_timestamp_any(text: Column) -> Column:
    """ISO dates, git's default format (its weekday is dropped) and its ISO-like one."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")),
        F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM d HH:mm:ss yyyy Z")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")),
    )


def to_iso(text: Column) -> Column:
    """ISO form of a date in a known format; others stay as they are."""
    return F.coalesce(F.date_format(to_timestamp_any(text), "yyyy-MM-dd'T'HH:mm:ss"), text)


def module_name(path: Column) -> Column:
    """Dotted module of a Python file; a package's is its folder."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.py$", ""), "/", "."), r"\.__init__$", "")


def qualified(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def first_part(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def action_json(text: Column) -> Column:
    """The text from the first { to the last }, if it is a JSON object with a tool."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(found, "$.tool").isNotNull(), found)


def numbered_lines(text: Column, first: int, last: int) -> Column:
    """Lines first..last with their numbers, one per line of the result."""
    numbered = F.transform(lines(text), lambda x, k: F.concat((k + 1).cast("string"), F.lit(": "), x))
    return F.array_join(F.slice(numbered, max(1, first), max(0, last - max(1, first) + 1)), "\n")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first place where `old` stands; null where it doesn't."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def sandboxed(path: Column) -> Column:
    """A path inside the workspace, normalised; null if it leads out of it."""
    p = F.regexp_replace(F.regexp_replace(path, "^/+", ""), "^workspace/", "")
    p = F.regexp_replace(F.regexp_replace(p, r"/(\./)+|/+", "/"), r"^\./", "")
    return F.when(~p.rlike(r"(^|/)\.\.(/|$)"), p)


def stripped_member(path: Column) -> Column:
    """An archive member's name without a leading ./ (the prefix, not characters)."""
    return F.regexp_replace(path, r"^(\./)+", "")
