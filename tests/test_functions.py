"""Micro-fixtures for the semantic edges of text and outcome functions."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import outcome as O
from sieveline.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, want, strict",
    [
        ("src/click/testing.py", False, False),
        ("src/_pytest/python.py", False, False),
        ("src/latest_api.py", True, False),
        ("contest_x.py", True, False),
        ("sympy/testing/runtests.py", True, True),
        ("Tests/x.py", True, True),
        ("tests/a.txt", False, False),
    ],
)
def test_test_files(spark, path, want, strict):
    assert one(spark, T.is_test_file(F.col("p")), p=(path, "string")) == want
    assert one(spark, T.is_test_file(F.col("p"), strict=True), p=(path, "string")) == strict


def test_changed_lines(spark):
    assert one(spark, T.changed_lines(F.col("p")), p=("a\n+b\n+++ c\n-d\n--- e\n", "string")) == 2


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("p")), p=("Foo_bar ouè x T1est", "string")) == ["foo_bar", "ou", "est"]
    assert one(spark, T.tokens(F.col("p")), p=(None, "string")) == []


def test_dates(spark):
    for s, want in [("Fri Apr 2 10:00:00 2021 +0000", "2021-04-02T10:00:00"), ("2021-04-02 10:00:00 +0000", "2021-04-02T10:00:00"), ("2021-04-02T10:00:00Z", "2021-04-02T10:00:00"), ("soon", "soon")]:
        assert one(spark, T.to_iso(F.col("p")), p=(s, "string")) == want


def test_issue_reference(spark):
    e = T.issue_reference(F.col("b"), F.col("s"))
    assert one(spark, e, b=("Fixes  #12, closes #3", "string"), s=("", "string")) == 12
    assert one(spark, e, b=("see #4", "string"), s=("resolved #7", "string")) == 7
    assert one(spark, e, b=(None, "string"), s=("none", "string")) is None


def test_requirement_names(spark):
    for s, want in [("Foo-Bar>=1", "foo_bar"), ("x[y]", "x"), ("a b", "a"), ("!bad", None), ("z ; python_version<'3'", "z")]:
        assert one(spark, T.requirement_name(F.col("p")), p=(s, "string")) == want
    keep = T.keep_requirement(F.col("n"), F.lit("own"))
    assert [one(spark, keep, n=(x, "string")) for x in ("numpy", "python", "own", "x", None)] == [True, False, False, False, False]


def test_paths(spark):
    assert one(spark, T.sandboxed(F.col("p")), p=("/workspace/a/./b.py", "string")) == "a/b.py"
    assert one(spark, T.sandboxed(F.col("p")), p=("a/../../b", "string")) is None
    assert one(spark, T.stripped_member(F.col("p")), p=("./.github/x", "string")) == ".github/x"
    assert one(spark, T.module_name(F.col("p")), p=("a/b/__init__.py", "string")) == "a.b"
    assert one(spark, T.repo_of(F.col("p")), p=("my_repo_abc1234", "string")) == "my_repo"


def test_actions_and_edits(spark):
    assert one(spark, T.action_json(F.col("p")), p=('x {"tool": "a", "k": {"z": 1}} y', "string")) == '{"tool": "a", "k": {"z": 1}}'
    assert one(spark, T.action_json(F.col("p")), p=("{oops", "string")) is None
    assert one(spark, T.replace_first(F.col("p"), F.lit("a"), F.lit("X")), p=("bab a", "string")) == "bXb a"
    assert one(spark, T.replace_first(F.col("p"), F.lit("q"), F.lit("X")), p=("bab", "string")) is None
    assert one(spark, T.numbered_lines(F.col("p"), 2, 3), p=("a\nb\r\nc\nd\n", "string")) == "2: b\n3: c"


@pytest.mark.parametrize("f", [True, False, None])
@pytest.mark.parametrize("p", [True, False, None])
def test_verified(spark, f, p):
    assert one(spark, O.verified(F.col("f"), F.col("p")), f=(f, "boolean"), p=(p, "boolean")) == (f is True and p is True)


def test_taxonomy(spark):
    def label(hist, has_patch, passed=None, error=None):
        return one(spark, O.taxonomy(F.col("p"), F.col("e"), F.col("h"), F.col("a")), p=(passed, "boolean"), e=(error, "string"), h=(hist, "map<string,bigint>"), a=(has_patch, "boolean"))

    assert label({}, False, passed=True, error="x") == "resolved"
    assert label({}, False, error="x") == "harness_error"
    assert label({"<llm_err>": 2}, False) == label({"<llm_err>": 2}, True) == "llm_timeout"
    assert label({"submit_patch": 1}, False) == "empty_submit_no_edit"
    assert label({"submit_patch": 1, "edit_file": 1}, False) == "edits_failed_to_apply"
    assert label({"read_file": 1}, False) == label(None, None) == "no_edit_attempted"
    assert label({"edit_file": 1}, True) == "patch_failed_tests"


def test_buckets_and_versions(spark):
    assert [one(spark, O.size_bucket(F.col("n")), n=(n, "int")) for n in (29, 30, 120, 121)] == ["small", "mid", "mid", "big"]
    v = O.interpreter_version(F.try_to_timestamp("d"))
    assert [one(spark, v, d=(f"{y}-01-01", "string")) for y in (2021, 2022, 2023, 2024, 2025, "x")] == ["3.10", "3.11", "3.11", "3.12", "3.13", "3.11"]


def test_statement(spark):
    e = O.statement(F.lit("i"), F.col("b"), F.lit("t"), F.col("p"), F.lit("s"))
    assert one(spark, e, b=("", "string"), p=("b", "string")) == "t\n\nb"
    assert one(spark, e, b=(None, "string"), p=(None, "string")) == "s"


def test_two_phases(spark):
    f, p = O.two_phases(F.col("b"), F.col("x"), F.col("a"), F.col("y"))
    e = F.struct(f.alias("f"), p.alias("p"))
    got = lambda *v: tuple(one(spark, e, **{k: (x, "int") for k, x in zip("bxay", v)}))
    assert got(1, None, None, None) == (None, None)
    assert got(0, 124, 0, 0) == (True, True)
    assert got(0, 1, 1, None) == (True, None)
    assert got(0, 0, 0, 1) == (False, False)
