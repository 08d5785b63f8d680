"""Session helpers shared by every operator: shared storage and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: What has been stored: ("path" or "table", its name).
_made: list[tuple[str, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Arrow functions are pickled by reference, so Python workers must be able
    to import the package even where it is not installed on the nodes.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(top)
    out = os.path.join(tempfile.mkdtemp(prefix="pkg-"), f"sieveline_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, root))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where the session names none, a
    temporary one on a single machine, and an error on a cluster."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    have = jsc.getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir("file://" + made)
    return "file://" + made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder; clear() removes it."""
    path = f"{shared_dir(spark)}/stored/{name}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a result to the shared folder as Parquet and read it back.

    This cuts the lineage at a place that every executor can reread, so a lost
    executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored/{tag}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, tag: str, path: str | None = None, sort: bool = False, name: str | None = None) -> DataFrame:
    """Write a result to the shared folder in as many buckets as the shuffle has
    partitions, so that joins by that column find it in place."""
    spark = df.sparkSession
    name = name or f"{tag}_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/stored/{name}"
    _made.append(("table", name))
    w = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
    (w.sortBy(by) if sort else w).option("compression", "zstd").option("path", path).saveAsTable(name)
    _made.append(("path", path))
    return spark.table(name)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by stored() once nothing reads it any more."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/stored/" in f:
            _delete(spark, f)


def clear(spark: SparkSession) -> None:
    """Delete all that stored() and bucketed() have made. Results that were not
    written elsewhere can't be read any more."""
    while _made:
        kind, name = _made.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            _delete(spark, name)
