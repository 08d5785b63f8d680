"""Sources: JSON lines, git logs, graphs, archives, manifests, releases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..session import ship


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def jsonl(spark: SparkSession, paths: str | list[str], schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; absent fields are null. Missing files are
    an error, or no rows."""
    many = [paths] if isinstance(paths, str) else paths
    if missing_ok:
        many = [p for p in many if exists(spark, p)]
    return spark.read.schema(schema).json(many) if many else spark.createDataFrame([], schema)


def parquet_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet with a fixed schema; a path that is not there yet has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def git_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    r"""Commits from `git log --format=%H%x1f%P%x1f%ad%x1f%s --name-only` text:
    repo, sha, parents, date, subject, files.

    Header lines hold \x1f; the lines up to the next are its files. A file is
    one log and its order matters, so each file is numbered on its own, in
    ranges of its lines: a long log is many tasks' work.
    """
    from ..operators.curate import islands

    lines = spark.read.text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("no"), "value")
    head = F.instr("value", "\x1f") > 0
    g = islands(lines, ["f"], ["no"], head, "commit").withColumn("head", head).where("commit > 0 and trim(value) <> ''")
    per = g.groupBy("f", "commit").agg(F.max(F.when(F.col("head"), F.col("value"))).alias("h"), F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("no", F.trim("value").alias("v"))))).alias("files"))
    part = F.split("h", "\x1f")
    return per.select(F.lit(repo).alias("repo"), part[0].alias("sha"), F.filter(F.split(part[1], " "), lambda x: x != "").alias("parents"), part[2].alias("date"), part[3].alias("subject"), F.col("files.v").alias("files"))


def graphs(spark: SparkSession, path: str, name: str = r"([^/]+)\.json$") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON files; `name` finds a graph's instance
    in its file's path, by default <instance>.json."""
    df = spark.read.schema(schemas.GRAPH_FILE).option("multiLine", True).json(path).withColumn("instance_id", F.regexp_extract(F.input_file_name(), name, 1))
    nodes = df.select("instance_id", F.posexplode("nodes").alias("ord", "n")).select("instance_id", "n.id", "n.name", "n.text", F.col("ord").cast("long").alias("ord"))
    edges = df.select("instance_id", F.posexplode("edges").alias("ord", "e")).select("instance_id", "e.source", "e.target", "e.type", "e.key", F.col("ord").cast("long").alias("ord"))
    return nodes, edges


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Assets below a folder, one per file: kind (the folder's name) and
    instance_id (the file's name without its ending); contents aren't read."""
    part = F.split(F.col("path"), "/")
    name = F.element_at(part, -1)
    return binary_files(spark, root).select(F.element_at(part, -2).alias("kind"), F.regexp_replace(name, r"\.(json|npz|tgz|tar\.gz|jsonl|parquet)$", "").alias("instance_id"))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Python files below a folder: path relative to it, content."""
    df = binary_files(spark, root, "*.py")
    return df.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").split(":")[-1].lstrip("/") + "/", "").alias("path"), "content")


def archive_members(archives: DataFrame, wanted: str | None = None, most: int = 6000, with_text: bool = False) -> DataFrame:
    """Members of tar archives (rows of binaryFile): instance_id, path and, with
    with_text, the first `most` characters. wanted: a column of arrays of paths
    to read; the rest of an archive is skipped."""
    ship(archives.sparkSession)
    cols = ["path", "content", *([wanted] if wanted else [])]
    return archives.select(*cols).mapInArrow(_members(most, with_text), "instance_id string, path string, text string")


#: Characters of members that leave a task at once.
MEMBER_CHARS = 4 << 20


def _members(most: int, with_text: bool):
    """Archives (path, content, paths wanted) -> their members. One archive at a
    time is opened, as it lies in its batch, and of a text no more than its first
    characters is read; members leave in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tarfile

        schema = pa.schema([(c, pa.string()) for c in ("instance_id", "path", "text")])
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                want = batch.column(2)[k].as_py() if batch.num_columns > 2 else None
                want = set(want) if want is not None else None
                name = path.rsplit("/", 1)[-1].removesuffix(".tgz").removesuffix(".tar.gz").removesuffix(".tar")
                with tarfile.open(fileobj=pa.BufferReader(batch.column(1)[k].as_buffer())) as t:
                    for m in t:
                        p = m.name.removeprefix("./")
                        if not m.isfile() or want is not None and p not in want:
                            continue
                        text = t.extractfile(m).read(4 * most).decode("utf-8", "replace")[:most] if with_text else None
                        rows.append({"instance_id": name, "path": p, "text": text})
                        held += 200 + len(text or "")
                        if held > MEMBER_CHARS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def releases(index: DataFrame) -> DataFrame:
    """First upload per version from index documents: pkg, releases
    (map<version, array<struct<upload_time_iso_8601, upload_time>>>)."""
    each = index.select("pkg", F.posexplode(F.map_entries("releases")).alias("ordinal", "e"))
    times = F.filter(F.transform("e.value", lambda f: F.coalesce(f["upload_time_iso_8601"], f["upload_time"])), lambda t: T.present(t))
    return each.select("pkg", F.col("e.key").alias("ver"), F.get(times, 0).alias("upload_time"), F.col("ordinal").cast("long").alias("ordinal")).where("upload_time is not null")


def requirements_txt(text: Column) -> Column:
    """Names in requirement files; comments and options are skipped."""
    rows = F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(rows, T.requirement_name), lambda x: x.isNotNull())))


def setup_cfg(text: Column) -> Column:
    """Names in the indented block after install_requires =."""
    block = F.regexp_extract(F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n")), r"\n[ \t]*install_requires[ \t]*=[^\n]*\n((?:[ \t]+\S[^\n]*\n)*)", 1)
    return requirements_txt(block)


#: Fixed value: what counts as a requirement in a setup script.
SETUP_ENTRY = r"""['"]([A-Za-z0-9_.-]+)\s*[<>=!~]"""
#: Dependency groups that are for tests.
TEST_GROUPS = frozenset({"test", "tests", "testing"})


def setup_py(text: Column) -> Column:
    """Names in quoted requirement entries with a version."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SETUP_ENTRY), 1), T.requirement_name)))


def _strings(x: object) -> list[str]:
    return [v for v in x if isinstance(v, str)] if isinstance(x, list) else []


def _tables(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _declared(text: str | None, groups: frozenset[str] | None) -> list[str]:
    """Requirement strings of a pyproject.toml: tables of the packaging
    specifications, wherever they have the shape that these ask for."""
    import tomllib

    try:
        top = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return []
    project = _tables(top.get("project"))
    lists = {"": project.get("dependencies")} | {f"extra {k}": v for k, v in _tables(project.get("optional-dependencies")).items()}
    lists |= {f"group {k}": v for k, v in _tables(top.get("dependency-groups")).items() if groups is None or k.lower() in groups}
    return [spec.strip() for v in lists.values() for spec in _strings(v)]


def pyproject(df: DataFrame, text: str, name: str = "deps", all_groups: bool = False) -> DataFrame:
    """Add names declared in pyproject.toml: dependencies, extras, and test
    groups (or all groups). Text that isn't TOML has none."""
    ship(df.sparkSession)
    groups = None if all_groups else TEST_GROUPS

    @F.pandas_udf("array<string>")
    def specs(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _declared(t, groups))

    names = F.filter(F.transform("_specs", T.requirement_name), lambda n: n.isNotNull())
    return df.withColumn("_specs", specs(text)).withColumn(name, F.array_sort(F.array_distinct(names))).drop("_specs")


#: Manifests of a source tree, by the parser that reads them.
REQUIREMENT_FILES = ("requirements.txt", "requirements/main.txt", "requirements/base.txt")


def dependency_names(files: DataFrame, by: list[str], own: str, path: str = "path", text: str = "content", all_groups: bool = False) -> DataFrame:
    """Names that the manifests of a source tree declare: by, name.

    files: by, own (the package's own name), path and text of files. Names are
    normalised; junk words, the package itself and single letters are left out.
    With all_groups only pyproject.toml and setup.py are read, with every group.
    """
    f = files.select(*by, own, F.col(path).alias("_p"), F.col(text).alias("_t"))
    toml = pyproject(f.where("_p = 'pyproject.toml'"), "_t", "_names", all_groups).select(*by, own, "_names")
    rest = {"setup.py": setup_py} if all_groups else {"setup.py": setup_py, "setup.cfg": setup_cfg} | dict.fromkeys(REQUIREMENT_FILES, requirements_txt)
    parsed = F.coalesce(*[F.when(F.col("_p") == p, parse(F.col("_t"))) for p, parse in rest.items()])
    flat = toml.unionByName(f.where(F.col("_p").isin(*rest)).select(*by, own, parsed.alias("_names"))).select(*by, own, F.explode("_names").alias("name"))
    return flat.where(T.keep_requirement(F.col("name"), F.translate(F.lower(own), "-", "_"))).select(*by, "name").distinct()


def npz_vectors(files: DataFrame) -> DataFrame:
    """Vectors of .npz files (rows of binaryFile): instance_id, id, embedding."""
    ship(files.sparkSession)

    def run(parts: Iterator) -> Iterator:
        import io

        import numpy as np

        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"instance_id": path.rsplit("/", 1)[-1].removesuffix(".npz"), "id": list(z.files), "embedding": [z[k].astype(np.float32) for k in z.files]})

    return files.select("path", "content").mapInPandas(run, "instance_id string, id string, embedding array<float>")
