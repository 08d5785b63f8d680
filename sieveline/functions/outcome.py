"""Column functions over outcomes of tasks and episodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tools that edit, and the labels of the taxonomy in their order.
EDITS = ("edit_file", "write_file")
LABELS = ("resolved", "harness_error", "llm_timeout", "empty_submit_no_edit", "edits_failed_to_apply", "no_edit_attempted", "patch_failed_tests")


def taxonomy(passed: Column, error: Column, hist: Column, has_patch: Column) -> Column:
    """First label that fits. hist: map of tool to count; null is empty."""
    used = lambda t: F.coalesce(F.element_at(hist, t), F.lit(0)) > 0
    edited = used(EDITS[0]) | used(EDITS[1])
    return (
        F.when(F.coalesce(passed, F.lit(False)), LABELS[0])
        .when(error.isNotNull(), LABELS[1])
        .when(F.coalesce(F.element_at(hist, "<llm_err>"), F.lit(0)) >= 2, LABELS[2])
        .when(~F.coalesce(has_patch, F.lit(False)) & used("submit_patch") & ~edited, LABELS[3])
        .when(~F.coalesce(has_patch, F.lit(False)) & edited, LABELS[4])
        .when(~F.coalesce(has_patch, F.lit(False)), LABELS[5])
        .otherwise(LABELS[6])
    )


def size_bucket(n: Column, small: int = 30, big: int = 120) -> Column:
    """small under `small`, big over `big`, mid between (both included)."""
    return F.when(n < small, "small").when(n <= big, "mid").otherwise("big")


def interpreter_version(ts: Column) -> Column:
    """Interpreter for the year of a date; unknown dates count as 2023."""
    year = F.coalesce(F.year(ts), F.lit(2023))
    return F.when(year >= 2025, "3.13").when(year >= 2024, "3.12").when(year >= 2022, "3.11").otherwise("3.10")


def verified(f2p: Column, p2p: Column) -> Column:
    """Both phases true; null counts as not."""
    return F.coalesce(f2p, F.lit(False)) & F.coalesce(p2p, F.lit(False))


def two_phases(build_rc: Column, before_rc: Column, patch_rc: Column, after_rc: Column) -> tuple[Column, Column]:
    """Fail-before and pass-after from return codes. A build or test patch that
    fails leaves both unknown; a fix that doesn't apply leaves the second
    unknown. A run that times out or collects nothing counts as failing."""
    built = F.coalesce(build_rc == 0, F.lit(False))
    return F.when(built & before_rc.isNotNull(), before_rc != 0), F.when(built & F.coalesce(patch_rc == 0, F.lit(False)) & after_rc.isNotNull(), after_rc == 0)


def patch_check(diff: Column, apply_rc: Column, install_rc: Column, test_rc: Column) -> Column:
    """Why a generated patch did not pass; empty if it did."""
    return (
        F.when(~F.coalesce(diff.rlike(r"\S"), F.lit(False)), "no-diff")
        .when(F.coalesce(apply_rc != 0, F.lit(True)), "apply-fail")
        .when(F.coalesce(install_rc != 0, F.lit(True)), "install-fail")
        .when(test_rc == 0, "")
        .otherwise(F.concat(F.lit("tests rc="), F.coalesce(test_rc.cast("string"), F.lit("?"))))
    )


def statement(title: Column, body: Column, alt_title: Column, alt_body: Column, subject: Column, most: int = 12000) -> Column:
    """Title and body of the issue, else of the change, else the subject; cut."""
    two = lambda a, b: F.when(F.coalesce(b, F.lit("")) != "", F.concat(F.coalesce(a, F.lit("")), F.lit("\n\n"), b))
    return F.substring(F.coalesce(two(title, body), two(alt_title, alt_body), subject, F.lit("")), 1, most)


def error_row(stage: Column, message: Column, most: int = 300) -> Column:
    return F.substring(F.concat_ws(": ", stage, message), 1, most)
