"""Queries that go through sources and sinks: what is written is read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate, tools
from ..sources import readers, writers
from ..streaming.incremental import scratch
from .registry import register, table

_CHAT = "conv_id long, turn long, role string, text string"


@register("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE turn = 0")
def jsonl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of JSON lines and one that isn't there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a, b = scratch(spark, "jsonl"), scratch(spark, "jsonl")
    writers.jsonl(c, a)
    writers.jsonl(writers.jsonl(c.where("turn = 0"), None), b)
    return readers.jsonl(spark, [a, b, scratch(spark, "missing")], _CHAT, missing_ok=True)


@register("SELECT conv_id, turn, role FROM conversations WHERE NOT (turn = 1 AND conv_id % 2 = 0) UNION ALL SELECT conv_id, turn, 'again' FROM conversations WHERE turn = 1 AND conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, 'error' FROM conversations WHERE turn = 1 AND conv_id % 2 = 0")
def append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns are done, some of the second ones failed; a second run adds
    what is left and the failed ones, and a third finds nothing to do."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    failed = (F.col("turn") == 1) & (F.col("conv_id") % 2 == 0)
    schema, path, key = "conv_id long, turn long, role string, error string", scratch(spark, "resume"), ["conv_id", "turn"]
    rows = c.withColumn("error", F.lit(None).cast("string"))
    writers.append_new(rows.where("turn < 2").withColumns({"role": F.when(failed, "error").otherwise(F.col("role")), "error": F.when(failed, "x")}), path, schema, key)
    for _ in range(2):
        writers.append_new(rows.withColumn("role", F.when(failed, "again").otherwise(F.col("role"))), path, schema, key, retry_errors=True)
    return readers.jsonl(spark, path, schema).drop("error")


@register("SELECT 'c' || conv_id // 20 AS instance_id, conv_id, turn FROM conversations")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON per instance; the instance comes back from its name."""
    path = scratch(spark, "transcripts")
    writers.transcripts(table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.floor(F.col("conv_id") / 20).cast("string")).alias("instance_id"), "conv_id", "turn"), path)
    return spark.read.schema("conv_id long, turn long, instance_id string").json(path).select("instance_id", "conv_id", "turn")


@register("SELECT 'node' AS kind, n_nationkey AS a, CAST(n_regionkey AS VARCHAR) AS b FROM nation UNION ALL SELECT 'edge', n_nationkey, 'r' || n_regionkey FROM nation")
def graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    path = scratch(spark, "graph")
    writers.graph(n.select("n_nationkey", "n_regionkey"), n.select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to")), path)
    nodes, edges = spark.read.parquet(path + "/nodes"), spark.read.parquet(path + "/edges")
    return nodes.select(F.lit("node").alias("kind"), F.col("n_nationkey").alias("a"), F.col("n_regionkey").cast("string").alias("b")).union(edges.select(F.lit("edge"), "n_nationkey", "to"))


@register("""SELECT CAST(n_regionkey AS VARCHAR) AS instance_id, 'node' AS kind, n_name AS a, 'text of ' || n_name AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 'edge', n_name, 'hub', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 FROM nation""")
def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node-link JSON of a graph per region; the partition folder names it."""
    n = table(spark, sf_dir, "nation")
    rows = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    node = lambda x: F.struct(x["n_name"].alias("id"), x["n_name"].alias("name"), F.concat(F.lit("text of "), x["n_name"]).alias("text"))
    edge = lambda x: F.struct(x["n_name"].alias("source"), F.lit("hub").alias("target"), F.lit("in").alias("type"), F.lit(0).cast("long").alias("key"))
    path = scratch(spark, "graphs")
    rows.select("n_regionkey", F.transform("r", node).alias("nodes"), F.transform("r", edge).alias("edges")).write.partitionBy("n_regionkey").json(path)
    nodes, edges = readers.graphs(spark, path, r"n_regionkey=([^/]+)/")
    return nodes.select("instance_id", F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("text").alias("b"), "ord").union(edges.select("instance_id", F.lit("edge"), "source", "target", "ord"))


@register("SELECT vec_id, label, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "vectors")
    writers.vectors(table(spark, sf_dir, "embeddings"), path)
    return spark.read.parquet(path).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@register("SELECT CAST(vec_id // 50 AS VARCHAR) AS instance_id, CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def vector_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of fifty arrays each, made up in memory, then scanned."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        import numpy as np

        out = io.BytesIO()
        np.savez(out, **{str(i): np.array(v, np.float32) for i, v in zip(pdf.vec_id, pdf.embedding)})
        return pd.DataFrame({"path": [f"/v/{pdf.g.iloc[0]}.npz"], "content": [out.getvalue()]})

    files = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 50).alias("g")).groupBy("g").applyInPandas(pack, "path string, content binary")
    return readers.npz_vectors(files).select("instance_id", "id", F.size("embedding").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


def _tars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of twenty texts each, with what to read from them."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import tarfile

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for i, text in sorted(zip(pdf.page_id, pdf.html)):
                data = (text or "").encode()
                m = tarfile.TarInfo(f"./pages/{i}.html")
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
        return pd.DataFrame({"path": [f"/t/{pdf.g.iloc[0]}.tgz"], "content": [out.getvalue()], "wanted": [[f"pages/{i}.html" for i in pdf.page_id if i % 3 == 0]]})

    p = table(spark, sf_dir, "pages").select("page_id", "html", F.floor(F.col("page_id") / 20).alias("g"))
    return p.groupBy("g").applyInPandas(pack, "path string, content binary, wanted array<string>")


@register("SELECT CAST(page_id // 20 AS VARCHAR) AS instance_id, 'pages/' || page_id || '.html' AS path FROM pages")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.archive_members(_tars(spark, sf_dir)).select("instance_id", "path")


@register("SELECT CAST(page_id // 20 AS VARCHAR) AS instance_id, 'pages/' || page_id || '.html' AS path, substr(coalesce(html, ''), 1, 6000) AS text FROM pages WHERE page_id % 3 = 0")
def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the members that each archive is asked for, cut at 6000 characters."""
    return readers.archive_members(_tars(spark, sf_dir), "wanted", with_text=True)


@register("""SELECT 'r' AS repo, md5(CAST(o_orderkey AS VARCHAR)) AS sha, 'p' || o_orderkey AS parents, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS subject, 'src/a' || o_orderkey || '.py tests/t.py' AS files FROM orders""")
def git_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""A log per customer, in git's order of lines."""
    o = table(spark, sf_dir, "orders")
    head = F.concat_ws("\x1f", F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority")
    entry = F.concat(head, F.lit("\n\nsrc/a"), F.col("o_orderkey").cast("string"), F.lit(".py\ntests/t.py\n"))
    path = scratch(spark, "log")
    o.groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), "\n").alias("value")).select("value").write.text(path)
    return readers.git_log(spark, path, "r").select("repo", "sha", F.array_join("parents", " ").alias("parents"), "date", "subject", F.array_join("files", " ").alias("files"))


@register("SELECT p_partkey // 40 || '-' || p_brand AS pkg, CAST(p_partkey AS VARCHAR) AS ver, 'at ' || p_size AS upload_time FROM part WHERE p_partkey % 4 > 0")
def release_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and their first upload; a version without files has none."""
    f = F.when(F.col("p_partkey") % 4 > 0, F.array(F.struct(F.lit(None).cast("string").alias("upload_time_iso_8601"), F.concat(F.lit("at "), F.col("p_size").cast("string")).alias("upload_time")))).otherwise(F.array().cast("array<struct<upload_time_iso_8601:string,upload_time:string>>"))
    p = table(spark, sf_dir, "part").groupBy(F.concat(F.floor(F.col("p_partkey") / 40).cast("string"), F.lit("-"), "p_brand").alias("pkg")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), f))).alias("releases"))
    return readers.releases(p).select("pkg", "ver", "upload_time")


@register("""
WITH p AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '_')) AS b, p_size AS s FROM part)
SELECT DISTINCT k % 20 AS repo, unnest(CASE k % 5 WHEN 0 THEN ['dep_' || b, 'extra_' || s, 'test_dep_' || s] WHEN 1 THEN ['req_' || b, 'no'] WHEN 2 THEN ['cfg_' || b, 'more'] WHEN 3 THEN ['set_' || s] ELSE [] END) AS name FROM p
""")
def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_names(spark, sf_dir)


@register("""
WITH p AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '_')) AS b, p_size AS s FROM part)
SELECT DISTINCT k % 20 AS repo, unnest(CASE k % 5 WHEN 0 THEN ['dep_' || b, 'extra_' || s, 'test_dep_' || s, 'sphinx'] WHEN 3 THEN ['set_' || s] ELSE [] END) AS name FROM p
""")
def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same manifests as a tree has them: all groups of pyproject.toml, and
    setup.py, but no requirements or setup.cfg."""
    return _manifest_names(spark, sf_dir, all_groups=True)


def _manifest_names(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
    """Parts are manifests: TOML, requirements, setup.cfg, setup.py and another
    file; junk words and the package's own name are in all."""
    k, b, s = F.col("p_partkey"), F.regexp_replace("p_brand", "#", "-"), F.col("p_size").cast("string")
    toml = F.concat(F.lit('[project]\ndependencies = ["Dep-'), b, F.lit(' >= 1; x", "python", "own-pkg"]\n[project.optional-dependencies]\nx = ["extra.'), s, F.lit('", "z"]\n[dependency-groups]\ntest = ["test-dep-'), s, F.lit('", {include-group = "x"}]\ndocs = ["sphinx"]\n'))
    toml = F.regexp_replace(toml, r"extra\.", "extra_")
    req = F.concat(F.lit("# names\n-r other.txt\nReq-"), b, F.lit("==1.0\nversion\n\nno name!\n"))
    cfg = F.concat(F.lit("[options]\ninstall_requires =\n    Cfg-"), b, F.lit(">=2\n    more[x]\nzip_safe = no\n    hidden\n"))
    setup = F.concat(F.lit("setup(name='own_pkg', install_requires=['Set-"), s, F.lit(" >= 1', 'bare'])"))
    kind = k % 5
    path = F.when(kind == 0, "pyproject.toml").when(kind == 1, "requirements/main.txt").when(kind == 2, "setup.cfg").when(kind == 3, "setup.py").otherwise("README.md")
    text = F.when(kind == 0, toml).when(kind == 1, req).when(kind == 2, cfg).when(kind == 3, setup).otherwise("x>=1")
    files = table(spark, sf_dir, "part").select((k % 20).alias("repo"), F.lit("Own-Pkg").alias("own"), path.alias("path"), text.alias("content"))
    return readers.dependency_names(files, ["repo"], "own", **how)


@register("SELECT tool, n FROM (SELECT 'count_rows' AS tool, CAST(count(*) AS VARCHAR) AS n FROM region UNION ALL SELECT 'first_name', min(n_name) FROM nation UNION ALL SELECT 'nope', 'unknown tool nope' UNION ALL SELECT 'broken', 'error: no such table')")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools by name; one that isn't there, and one that fails, say so."""

    def broken(df: DataFrame) -> DataFrame:
        raise ValueError("no such table")

    known = tools.Tools({"count_rows": lambda df: df.agg(F.count("*").cast("string").alias("n")), "first_name": lambda df, col: df.agg(F.min(col).alias("n")), "broken": broken})
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    calls = [("count_rows", {"df": region}), ("first_name", {"df": nation, "col": "n_name"}), ("nope", {}), ("broken", {"df": region})]
    out = None
    for name, args in calls:
        r = known.run(name, args)
        r = (r if isinstance(r, DataFrame) else spark.range(1).select(F.lit(r).alias("n"))).select(F.lit(name).alias("tool"), "n")
        out = r if out is None else out.union(r)
    return out


@register("SELECT DISTINCT 'assets=' || n_regionkey AS kind, 'part' AS name FROM nation")
def asset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder, by the folder they lie in; names end in numbers of
    the writer's, which are cut."""
    path = scratch(spark, "assets")
    n = table(spark, sf_dir, "nation")
    n.select("n_nationkey", F.col("n_regionkey").alias("assets")).write.partitionBy("assets").json(path)
    return readers.inventory(spark, path).select("kind", F.substring_index("instance_id", "-", 1).alias("name")).distinct()


@register("SELECT 'nation=' || c_nationkey AS package, 'def c' || c_custkey || '(): return ' || c_nationkey AS line FROM customer")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the Python files below a folder, by package; the folder has other
    files as well."""
    root = scratch(spark, "tree")
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.lit("def c"), F.col("c_custkey").cast("string"), F.lit("(): return "), F.col("c_nationkey").cast("string"))
    c.select(line.alias("line"), F.col("c_nationkey").alias("nation")).write.partitionBy("nation").option("extension", "py").csv(root)
    c.select("c_name", F.col("c_nationkey").alias("nation")).write.mode("append").partitionBy("nation").json(root)
    files = readers.source_tree(spark, root)
    return files.select(F.substring_index("path", "/", 1).alias("package"), F.explode(T.lines(F.decode("content", "UTF-8"))).alias("line"))


@register("SELECT page_id AS instance_id, CASE page_id % 4 WHEN 0 THEN 'graph-fail' WHEN 1 THEN 'embed-fail' ELSE 'ok' END AS status FROM pages WHERE page_id % 7 > 0")
def asset_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without assets get a graph, then vectors; sources that don't parse
    have no graph, and functions without a body's worth of names no vectors."""

    def to_graph(row: dict) -> list[str]:
        import ast

        return [n.name for n in ast.walk(ast.parse(row["source"])) if isinstance(n, ast.FunctionDef)]

    def to_vectors(row: dict, names: list[str]) -> dict[str, float]:
        return {n: 1 / max(0, len(n) - 1) for n in names}

    source = F.when(F.col("page_id") % 4 == 0, "def broken(").when(F.col("page_id") % 4 == 1, "def f(): pass").otherwise("def name(): pass")
    tasks = table(spark, sf_dir, "pages").select(F.col("page_id").alias("instance_id"), source.alias("source"))
    done = tasks.where("instance_id % 7 = 0")
    return curate.asset_status(curate.remaining(tasks, done, ["instance_id"]), "instance_id", [("graph", to_graph), ("embed", to_vectors)])
