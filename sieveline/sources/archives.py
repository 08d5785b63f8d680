"""Tar archives as a data source: a task per archive, read as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..session import ship

ENDINGS = (".tar", ".tgz", ".tar.gz")
SCHEMA = "instance_id string, path string, size long, text string"
#: Filters that are applied while an archive is read.
_TESTS = {
    EqualTo: lambda x, f: x == f.value,
    In: lambda x, f: x in f.value,
    StringStartsWith: lambda x, f: x.startswith(f.value),
    StringEndsWith: lambda x, f: x.endswith(f.value),
    StringContains: lambda x, f: f.value in x,
}


def _files(root: str) -> list[str]:
    """Archives below a folder, or one archive; any store that Arrow can read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    if store.get_file_info(path).type == fs.FileType.File:
        return [root]
    head = root[: len(root) - len(path)] if root.endswith(path) else ""
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ENDINGS))


def _instance(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return next((name.removesuffix(e) for e in ENDINGS if name.endswith(e)), name)


class TarReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType, most: int) -> None:
        self.root, self.columns, self.most = root, schema.names, most
        self.schema = schema
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests of paths and instances are done here; the others are Spark's."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("instance_id",)):
                self.filters.append((f.attribute[0], f))
            else:
                yield f

    def _fits(self, column: str, value: str) -> bool:
        return all(_TESTS[type(f)](value, f) for c, f in self.filters if c == column)

    def partitions(self) -> Sequence[InputPartition]:
        """An archive each; those of other instances aren't opened."""
        return [InputPartition(p) for p in _files(self.root) if self._fits("instance_id", _instance(p))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Members in the archive's order. What is not asked for is passed over,
        and of a text no more than its first characters is held."""
        import tarfile

        from pyarrow import fs

        where = partition.value
        store, path = fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)
        schema = pa.schema([(c, pa.int64() if c == "size" else pa.string()) for c in self.columns])
        rows, held = [], 0
        with store.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for m in tar:
                tar.members = []  # else the stream's members pile up
                name = m.name.removeprefix("./")
                if not m.isfile() or not self._fits("path", name):
                    continue
                row = {"instance_id": _instance(where), "path": name, "size": m.size}
                if "text" in self.columns:
                    row["text"] = tar.extractfile(m).read(4 * self.most).decode("utf-8", "replace")[: self.most]
                rows.append(row)
                held += 200 + len(row.get("text", ""))
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class TarSource(DataSource):
    """spark.read.format("tar").load(folder); options: most (characters of a text)."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options["path"], schema, int(self.options.get("most", 6000)))


def tar_members(spark: SparkSession, path: str, columns: Sequence[str] = ("instance_id", "path", "size", "text"), most: int = 6000) -> DataFrame:
    """Members of the tar archives below a folder, compressed or not: instance_id
    (the archive's name), path, size, and the first `most` characters of text.

    Each archive is a task that reads it as a stream: an archive may be larger
    than an executor's memory. Columns not asked for aren't read. Comparisons of
    path and instance_id with constants are applied before a member is read, for
    which this turns on the session's filter push-down for Python sources. Paths
    are those that Arrow's file systems reach; for archives in other stores there
    is readers.archive_members(), which has a whole archive in a row. An empty
    folder has no rows; one that isn't there is an error.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarSource)
    kinds = dict(f.split() for f in SCHEMA.split(", "))
    return spark.read.format("tar").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("most", most).load(path)
