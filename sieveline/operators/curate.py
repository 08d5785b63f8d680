"""Curation: incremental selection, joins of side tables, samples and splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import outcome
from ..functions import text as T
from ..session import ship, stored


def candidates(commits: DataFrame, since: str | None = None) -> DataFrame:
    """Commits with one parent that change sources and tests.

    In: repo, sha, parents, date, subject, files. Out: instance_id, repo_short,
    fix_commit, base_commit, date, subject, src_files, test_files.
    """
    src, tst = T.split_files(F.col("files"))
    df = commits.where(F.size("parents") == 1)
    if since:
        df = df.where(T.to_timestamp_any(F.col("date")) >= F.lit(since).cast("timestamp"))
    out = df.select(T.instance_id(F.col("repo"), F.col("sha")).alias("instance_id"), F.col("repo").alias("repo_short"), F.col("sha").alias("fix_commit"), F.element_at("parents", 1).alias("base_commit"), "date", "subject", src.alias("src_files"), tst.alias("test_files"))
    return out.where(T.has_items(F.col("src_files")) & T.has_items(F.col("test_files")))


def enrich(cands: DataFrame, pulls: DataFrame, issues: DataFrame, most: int = 8000) -> DataFrame:
    """Join each commit's first pull request and the issue it refers to.

    pulls: sha, ordinal, number, title, body, created_at; issues: repo_short,
    number, title, body, is_pull. Without either the fields are null; created_at
    falls back to the commit's date.
    """
    first = first_per(pulls, ["sha"], [F.col("ordinal")]).select(F.col("sha").alias("fix_commit"), F.col("number").alias("pr_number"), F.col("title").alias("pr_title"), T.head(F.col("body"), most).alias("pr_body"), F.col("created_at").alias("_at"))
    out = cands.join(first, "fix_commit", "left").withColumn("issue_number", T.issue_reference(F.col("pr_body"), F.col("subject")))
    real = issues.where(~F.coalesce("is_pull", F.lit(False))).select("repo_short", F.col("number").alias("issue_number"), F.col("title").alias("issue_title"), T.head(F.col("body"), most).alias("issue_body"))
    out = out.join(real, ["repo_short", "issue_number"], "left")
    return out.withColumn("created_at", F.coalesce("_at", T.to_iso(F.col("date")))).drop("_at")


def with_patches(df: DataFrame) -> DataFrame:
    return df.where(T.not_blank(F.col("patch")) & T.not_blank(F.col("test_patch")))


def package(df: DataFrame, names: dict[str, str], most_lines: int = 200, most_files: int = 6) -> DataFrame:
    """Verified tasks under the size caps, in their final shape."""
    full = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    n = T.changed_lines(F.col("patch"))
    ok = df.where(F.coalesce("verified", F.lit(False))).withColumn("n_patch_lines", n).where((F.col("n_patch_lines") <= most_lines) & (F.size("src_files") <= most_files))
    text = outcome.statement(F.col("issue_title"), F.col("issue_body"), F.col("pr_title"), F.col("pr_body"), F.col("subject"))
    return ok.select(
        "instance_id", F.coalesce(F.element_at(full, F.col("repo_short")), F.col("repo_short")).alias("repo"), "base_commit", "fix_commit", text.alias("problem_statement"), F.lit("").alias("hints_text"), "patch", "test_patch",
        F.coalesce("created_at", F.lit("")).alias("created_at"), F.coalesce("date", F.lit("")).alias("fix_date"), "pr_number", F.coalesce("test_files", F.array().cast("array<string>")).alias("test_files"), F.size("src_files").cast("long").alias("n_src_files"), "n_patch_lines", F.size("test_files").cast("long").alias("n_test_files"),
    )


def capped(df: DataFrame, lines: Column, files: Column, most_lines: int, most_files: int) -> DataFrame:
    return df.where((lines <= most_lines) & (files <= most_files))


def kept_and_skipped(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped"))


def remaining(todo: DataFrame, done: DataFrame, key: list[str], retry_errors: bool = False, error_col: str = "error", limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows whose key is not done yet. With retry_errors, rows that ended in an
    error are not done. A limit takes the first rows by `order`."""
    if retry_errors:
        done = done.where(F.col(error_col).isNull())
    out = todo.join(done.select(*key), key, "left_anti")
    return out.orderBy(*(order or key)).limit(limit) if limit is not None else out


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keep-last per key by a unique order: an aggregate with map-side combine,
    not a window, so hot keys shrink before the shuffle."""
    cols = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*cols), F.col(order)).alias("_r")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*df.columns)


def overlay(shards: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of shards; of rows with one key that of the latest shard stays."""
    ranked = None
    for k, s in enumerate(shards):
        s = s.withColumn("_shard", F.lit(k))
        ranked = s if ranked is None else ranked.unionByName(s, allowMissingColumns=True)
    return last_per(ranked, key, "_shard").drop("_shard")


def asof_latest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, ordinal: str, value: list[str]) -> DataFrame:
    """For each left row the latest right row of its key that is not after it;
    the smallest ordinal of equals. Rows without one have nulls.

    Both sides go into one stream per key, ordered by time, and the last right
    row is carried forward, so a key's pairs are never formed. The running
    aggregate holds one row.
    """
    left, right = left.withColumns({"_side": F.lit(1), "_t": F.col(left_ts), "_o": F.lit(0).cast("long")}), right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), (-F.col(ordinal)).cast("long").alias("_o"), F.struct(*value).alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("_v", ignorenulls=True).over(w)
    out = both.withColumn("_v", carried).where("_side = 1")
    return out.select(*[c for c in left.columns if not c.startswith("_")], *[F.col(f"_v.{c}").alias(f"asof_{c}") for c in value])


#: Rows of one key from which an as-of join is ranged by time.
HOT_KEY = 1_000_000


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, ordinal: str, value: list[str]) -> DataFrame:
    """asof_latest(), or asof_ranged() if any key has HOT_KEY rows or more, which
    a count per key tells first."""
    both = left.select(*by).unionByName(right.select(*by))
    most = both.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    return (asof_ranged if most >= HOT_KEY else asof_latest)(left, right, by, left_ts, right_ts, ordinal, value)


def asof_ranged(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, ordinal: str, value: list[str]) -> DataFrame:
    """asof_latest() for few keys with very many rows each.

    The stream of both sides is cut into ranges of key and time. A range carries
    its own rows forward; what it begins with is the last right row of the
    ranges before it, of which there is one per key and range.
    """
    left, right = left.withColumns({"_side": F.lit(1), "_t": F.col(left_ts), "_o": F.lit(0).cast("long")}), right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), (-F.col(ordinal)).cast("long").alias("_o"), F.struct(*value).alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = stored(both.repartitionByRange(*by, "_t", "_side", "_o").withColumn("_part", F.spark_partition_id()), "ranges")
    ends = both.where("_side = 0").groupBy(*by, "_part").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_last"))
    every = both.select(*by, "_part").distinct().join(ends, [*by, "_part"], "left")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = every.withColumn("_begin", F.last("_last", ignorenulls=True).over(earlier)).select(*by, "_part", "_begin")
    w = Window.partitionBy(*by, "_part").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").join(begins, [*by, "_part"], "left").withColumn("_v", F.coalesce("_v", "_begin"))
    return out.select(*[c for c in left.columns if not c.startswith("_")], *[F.col(f"_v.{c}").alias(f"asof_{c}") for c in value])


def _dyadic(low: Column, high: Column, levels: int) -> Column:
    """The fewest aligned ranges of 2**level numbers that make up low to high - 1,
    as structs of level and bucket: two per level at most, none twice."""
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    piece = lambda level, x: F.array(F.struct(level.cast("int").alias("level"), x.alias("bucket")))

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        more = lo < hi
        at_lo, at_hi = more & (lo % 2 == 1), more & (hi % 2 == 1) & (lo + lo % 2 < hi)
        out = F.concat(acc["out"], F.when(at_lo, piece(level, lo)).otherwise(none), F.when(at_hi, piece(level, hi - 1)).otherwise(none))
        return F.struct(F.floor((lo + 1) / 2).cast("long").alias("lo"), F.floor(hi / 2).cast("long").alias("hi"), out.alias("out"))

    start = F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])


def within_intervals(points: DataFrame, spans: DataFrame, by: list[str], point: str, low: str, high: str) -> DataFrame:
    """Inner join of points with the spans of their key that hold them (low <=
    point < high); numbers from 0. A null in any of these matches nothing.

    A span is cut into aligned ranges, two per power of two at most, and a point
    looks for the one of each power that it lies in: an equality join that forms
    no other rows than those that come out.
    """
    most = points.agg(F.max(point)).first()[0]
    levels = max(int(most or 0), 1).bit_length()
    capped = F.least(F.col(high), F.lit(int(most or 0) + 1))
    s = spans.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("_d", F.explode(_dyadic(F.greatest(F.col(low), F.lit(0)), capped, levels)))
    s = s.withColumns({"_level": F.col("_d.level"), "_bucket": F.col("_d.bucket")}).drop("_d")
    p = points.where(F.col(point) >= 0).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_bucket", F.expr(f"shiftright(cast(`{point}` as bigint), _level)"))
    return p.join(s, [*by, "_level", "_bucket"]).drop("_level", "_bucket")


#: Changes or revisions of a group from which files are found by aligned ranges.
HOT_GROUP = 1_000


def files_at(history: DataFrame, revisions: DataFrame, by: list[str], rev: str, path: str, content: str, wanted: list[str] | None = None) -> DataFrame:
    """Files as they are at given revisions: by, rev, path, content.

    history: by, rev (a growing number from 0), path, content of files that a
    revision changes, null where it deletes one; revisions: by, rev. A path's
    last change up to the revision counts. wanted: the only paths to look for.

    A change holds from its revision to the path's next one; revisions join the
    spans that hold them. Both sides are shuffled once, by group, and a group's
    spans are tested against its revisions. Groups with more than HOT_GROUP
    changes or revisions, which a count tells, join by aligned ranges instead
    (within_intervals), where a path that is not there costs nothing.
    """
    sizes = lambda df: df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_GROUP).select(*by)
    hot = stored(sizes(history).union(sizes(revisions)).distinct(), "hot_groups")
    if not hot.isEmpty():
        of = lambda how: (history.join(hot, by, how), revisions.join(hot, by, how))
        (few, few_at), (many, many_at) = of("left_anti"), of("left_semi")
        return _files_at(few, few_at, by, rev, path, content, wanted, False).unionByName(_files_at(many, many_at, by, rev, path, content, wanted, True))
    return _files_at(history, revisions, by, rev, path, content, wanted, False)


def _files_at(history: DataFrame, revisions: DataFrame, by: list[str], rev: str, path: str, content: str, wanted: list[str] | None, hot: bool) -> DataFrame:
    h = history.select(*by, path, F.col(rev).alias("_from"), F.col(content).alias(content))
    if wanted is not None:
        h = h.where(F.col(path).isin(wanted))
    if not hot:
        h, revisions = h.repartition(*by), revisions.select(*by, rev).repartition(*by)
    until = F.coalesce(F.lead("_from").over(Window.partitionBy(*by, path).orderBy("_from")), F.lit(2**62))
    spans = h.withColumn("_until", until).where(F.col(content).isNotNull())
    at = revisions.select(*by, rev).distinct()
    if hot:
        got = within_intervals(at, spans, by, rev, "_from", "_until")
    else:
        got = at.where(F.col(rev) >= 0).join(spans, by).where((F.col("_from") <= F.col(rev)) & (F.col(rev) < F.col("_until")))
    return got.select(*by, rev, path, content)


def rank_hash(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def stratified_split(df: DataFrame, stratum: str, id_col: str, share: float = 0.2, seed: str = "7") -> DataFrame:
    """Split each stratum: max(1, round half to even of n * share) rows, by a
    seeded hash of the id, are test.

    Every row's rank is needed only up to the cut. Ranks come from counts of
    hash prefixes: a prefix counts rows per (stratum, prefix), prefixes are
    summed in order, and only rows in one prefix are ordered among themselves,
    so a stratum with most of the rows is not sorted in one task.
    """
    h = df.withColumn("_h", rank_hash(seed, id_col)).withColumn("_p", F.substring("_h", 1, 3))
    per = h.groupBy(stratum, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(stratum).orderBy("_p")
    per = per.withColumns({"_before": F.sum("_c").over(w) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(stratum))})
    inside = h.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", id_col)))
    cond = (F.col("i." + stratum).eqNullSafe(F.col("p." + stratum))) & (F.col("i._p") == F.col("p._p"))
    both = inside.alias("i").join(per.drop("_c").alias("p"), cond).select("i.*", "p._before", "p._n")
    cut = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("long"))
    return both.withColumn("split", F.when(F.col("_before") + F.col("_r") <= cut, "test").otherwise("train")).drop("_h", "_p", "_r", "_before", "_n")


def numbered(df: DataFrame, order: list[str], name: str = "_no") -> DataFrame:
    """Global row numbers from 0 in a total order, without one task that sorts all.

    Rows are range partitioned and stored with their range, as both branches
    must see the same ranges; counts per range, one row each, give the offsets.
    """
    parts = _ranged(df, order)
    w = Window.partitionBy("_part").orderBy(*order)
    inside = parts.withColumn(name, F.row_number().over(w) - 1)
    counts = inside.groupBy("_part").agg(F.count("*").alias("_c"))
    offs = counts.withColumn("_off", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).drop("_c")
    return inside.join(F.broadcast(offs), "_part").withColumn(name, (F.col(name) + F.col("_off")).cast("long")).drop("_part", "_off")


def systematic_sample(df: DataFrame, order: list[str], cap: int = 250) -> DataFrame:
    """Rows int(i * n / cap) of the ordered table for i < cap; all if n <= cap."""
    n = df.count()
    if n <= cap:
        return df
    at = df.sparkSession.range(cap).select(F.floor(F.col("id") * F.lit(n) / F.lit(cap)).cast("long").alias("_no"))
    return numbered(df, order).join(F.broadcast(at), "_no", "left_semi").drop("_no")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: str = "0", by: list[str] | None = None) -> DataFrame:
    """n rows by a seeded hash, per group if `by` is given."""
    h = df.withColumn("_h", rank_hash(seed, id_col))
    if not by:
        return h.orderBy("_h", id_col).limit(n).drop("_h")
    w = Window.partitionBy(*by).orderBy("_h", id_col)
    return h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of `value` (null: 0) over a group's rows up to each row, in a total order.

    Rows are cut into ranges of group and order, whatever the groups' sizes. A
    range adds up its own rows; what it begins with is the sum of the group's
    ranges before it, one row per group and range. No task sorts a whole group.
    """
    parts = _ranged(df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), [*by, *order])
    per = parts.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = per.select(*by, "_part", before.alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]])
    out = parts.withColumn("_inside", inside).alias("r").join(begins.alias("b"), same)
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._inside") + F.col("b._before")).cast("long").alias(name))


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range partitioned and stored with their range's number, so that all
    that read them see the same ranges."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows that begin at rows where `starts` holds; rows before
    the first have 0. `order` must be total within a group."""
    return running_sum(df, by, order, F.when(starts, 1).otherwise(0), name)


def wanted_requirements(names: DataFrame, by: list[str], own: str, name: str, resolved: DataFrame | None = None) -> DataFrame:
    """Requirement names that are kept: no junk, not the package itself, and, for
    groups with any resolved names (by, name), one of these."""
    out = names.where(T.keep_requirement(F.col(name), F.col(own)))
    if resolved is None:
        return out
    have = resolved.select(*by, name).distinct()
    known = out.join(have, [*by, name], "left_semi")
    return known.unionByName(out.join(have.select(*by), by, "left_anti"))


def in_snapshot(tasks: DataFrame, key: list[str], files: str, members: DataFrame, path: str) -> DataFrame:
    """Tasks with those of their patched files (an array) that the snapshot holds;
    tasks without any are skipped. members: key, path."""
    each = tasks.select(*key, F.explode(F.array_distinct(files)).alias("_f")).join(members.select(*key, F.col(path).alias("_f")).distinct(), [*key, "_f"], "left_semi")
    return each.groupBy(*key).agg(F.array_sort(F.collect_list("_f")).alias("targets"))


def with_assets(df: DataFrame, key: list[str], *assets: DataFrame) -> DataFrame:
    """Rows whose key every one of the asset tables has."""
    for a in assets:
        df = df.join(a.select(*key), key, "left_semi")
    return df


def strict_join(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that stops if a key of df is not in `other`."""
    names = ", ".join(key)
    out = df.join(other.withColumn("_found", F.lit(True)), key, "left")
    ok = F.when(F.col("_found"), True).otherwise(F.raise_error(F.lit(f"{names} without a match")).cast("boolean"))
    return out.where(ok).drop("_found")


def stamped(df: DataFrame, **values: object) -> DataFrame:
    """The same value of a column in every row, as runs stamp their settings."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def constraints(df: DataFrame, pkg: str = "pkg", ver: str = "ver") -> DataFrame:
    """Lines pkg==ver."""
    return df.where(F.col(ver).isNotNull()).select(F.concat_ws("==", pkg, ver).alias("value"))


def name_sets(df: DataFrame, by: list[str], arrays: list[str]) -> DataFrame:
    """Sorted union of arrays of names per group; null names are left out, and a
    group without names has none. Names are made distinct before they meet."""
    every = F.concat(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])
    names = df.select(*by, F.explode_outer(every).alias("_name")).distinct()
    return names.groupBy(*by).agg(F.sort_array(F.collect_list("_name")).alias("names"))


def era_constraints(tasks: DataFrame, names: DataFrame, releases: DataFrame, key: list[str], cutoff: str) -> DataFrame:
    """Lines pkg==ver per task: each wanted package at its latest release that is
    not after the task's cutoff. Null for tasks without names or releases.

    names: key, pkg; releases: pkg, ver, t, ordinal. Packages are few and each
    may hold most rows, so the join is ranged by time.
    """
    want = tasks.join(names, key).select(*key, "pkg", cutoff)
    got = asof_ranged(want, releases, ["pkg"], cutoff, "t", "ordinal", ["ver"]).where("asof_ver is not null")
    lines = got.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("==", "pkg", "asof_ver"))), "\n").alias("constraints"))
    return tasks.select(*key).join(lines, key, "left")


def external_overlap(ours: DataFrame, theirs: DataFrame, base: str, our_id: str, their_id: str, patch: str) -> DataFrame:
    """Tasks of two collections with one base, and whether their patches add and
    remove the same lines."""
    edits = lambda c: F.array_sort(F.array_distinct(F.filter(T.lines(c), lambda x: x.rlike(r"^[+-](?!\+\+|--)"))))
    a = ours.select(base, F.col(our_id).alias("ours"), edits(F.col(patch)).alias("_a"))
    b = theirs.select(base, F.col(their_id).alias("external"), edits(F.col(patch)).alias("_b"))
    return a.join(b, base).select("ours", "external", (F.col("_a") == F.col("_b")).alias("identical_edit_lines"))


def asset_status(tasks: DataFrame, id_col: str, steps: list[tuple[str, Callable]]) -> DataFrame:
    """Run a job per row and say how it ended: id, status.

    Steps are (name, function) in order; the first gets the row as a dict, each
    other one the row and what the step before it returned. The status is
    "<name>-fail" of the first that raises, or "ok".
    """
    ship(tasks.sparkSession)

    def one(row: dict) -> str:
        got: tuple = ()
        for name, step in steps:
            try:
                got = (step(row, *got),)
            except Exception:  # noqa: BLE001
                return f"{name}-fail"
        return "ok"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({id_col: pdf[id_col], "status": [one(r) for r in pdf.to_dict("records")]})

    return tasks.mapInPandas(run, f"{id_col} {tasks.schema[id_col].dataType.simpleString()}, status string")
