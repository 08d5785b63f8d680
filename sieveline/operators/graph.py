"""Code graphs: symbols from sources, name resolution, neighbourhoods."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship, stored
from .retrieval import sized

_DEFS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of attributes; the part after anything else."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.insert(0, node.id)
    return ".".join(parts) or None


def symbols(module: str, source: str) -> Iterator[tuple[str, str, str | None, int]]:
    """Facts about a module: ("node", id, text), ("contains", parent, child) and
    ("call", id, name used), each with a running number. A source that doesn't
    parse has none. A bare name counts as a use, and a class uses what its
    methods use."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    no = 0
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, inside = todo.pop()
        if isinstance(node, _DEFS):
            own = ".".join(x for x in (inside or module, node.name) if x)
            yield "node", own, ast.get_source_segment(source, node) or "", (no := no + 1)
            if inside:
                yield "contains", inside, own, (no := no + 1)
            for sub in ast.walk(node):
                used = _dotted(sub.func) if isinstance(sub, ast.Call) else sub.id if isinstance(sub, ast.Name) else None
                if used:
                    yield "call", own, used, (no := no + 1)
            inside = own
        todo += [(child, inside) for child in reversed(list(ast.iter_child_nodes(node)))]


def extract_symbols(files: DataFrame, by: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """Facts of Python files: by, path, kind, a, b, no. Files are text or bytes;
    null ones have no facts."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                *keys, p, mod, src = r
                if src is None:
                    continue
                text = src.decode("utf-8", "replace") if isinstance(src, bytes | bytearray) else src
                rows += [(*keys, p, *fact) for fact in symbols(mod, text)]
            yield pd.DataFrame(rows, columns=[*by, "path", "kind", "a", "b", "no"])

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in by)
    src = files.where(F.col(path).endswith(".py")).select(*by, F.col(path).alias("path"), T.module_name(F.col(path)).alias("module"), content)
    return src.mapInPandas(run, kinds + "path string, kind string, a string, b string, no long")


def graph_of(facts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes (by, id, name, text) and edges (by, source, target, type, key).

    Of a symbol defined again in its file the last text stands, of one defined
    in several files that of the first path; its calls are those of the last
    definition's file. Containment edges all have key 0 and may repeat; calls of
    a source are numbered by first use.
    """
    nodes = nodes_of(facts, by)
    inside = facts.where("kind = 'contains'").select(*by, F.col("a").alias("source"), F.col("b").alias("target"), F.lit("contains").alias("type"), F.lit(0).cast("long").alias("key"))
    body = facts.where("kind = 'node'").groupBy(*by, "a").agg(F.max(F.struct("path", "no")).alias("m")).select(*by, "a", F.col("m.path").alias("path"))
    uses = facts.where("kind = 'call'").join(sized(stored(body, "bodies")), [*by, "a", "path"], "left_semi").select(*by, F.col("a").alias("source"), F.col("b").alias("call"), "no")
    return nodes, inside.unionByName(call_edges(uses, nodes, by))


def nodes_of(facts: DataFrame, by: list[str]) -> DataFrame:
    """The nodes of graph_of(), by an aggregate that combines where facts lie."""
    first = F.min_by(F.struct("b"), F.struct("path", -F.col("no"))).alias("_b")
    node = facts.where("kind = 'node'").groupBy(*by, "a").agg(first)
    return node.select(*by, F.col("a").alias("id"), F.col("a").alias("name"), F.col("_b.b").alias("text"))


def dotted_suffixes(ids: DataFrame, by: list[str], node: str = "id") -> DataFrame:
    """The least id per dotted ending: `c` and `b.c` of a.b.c (not the whole id).
    A row per part of each id, combined where it lies."""
    parts = F.split(F.col(node), r"\.")
    ends = ids.select(*by, F.col(node).alias("_id"), F.explode(F.array(parts)).alias("_p")).where(F.size("_p") > 1)
    ends = ends.select(*by, "_id", F.explode(F.transform(F.sequence(F.lit(2), F.size("_p")), lambda k: F.array_join(F.slice("_p", k, F.size("_p")), "."))).alias("suffix"))
    return ends.groupBy(*by, "suffix").agg(F.min("_id").alias("least"))


def resolve_names(calls: DataFrame, ids: DataFrame, by: list[str], call: str = "call", node: str = "id") -> DataFrame:
    """Resolve dotted names against ids: the exact id; else the only id with the
    same last part; else, if the name's first part is some id's last part, the
    smallest id that ends with "." + name.

    All three are joins by equality to a table of one row per key: the ids, the
    last parts, and the least id per dotted ending, so a last part that very many
    ids have forms no pairs. Names without a match drop out.
    """
    i = ids.select(*by, F.col(node).alias("_id")).distinct().withColumn("_last", T.last_part(F.col("_id")))
    names = calls.select(*by, F.col(call).alias("_call")).distinct().withColumns({"_last": T.last_part(F.col("_call")), "_first": T.first_part(F.col("_call"))})
    exact = names.join(i.select(*by, F.col("_id").alias("_call")), [*by, "_call"], "left_semi").select(*by, "_call", F.col("_call").alias("target"))
    rest = names.join(i.select(*by, F.col("_id").alias("_call")), [*by, "_call"], "left_anti")
    count = i.groupBy(*by, "_last").agg(F.count("*").alias("_n"), F.min("_id").alias("_only"))
    one = rest.join(count.where("_n = 1"), [*by, "_last"]).select(*by, "_call", F.col("_only").alias("target"))
    known = count.select(*by, F.col("_last").alias("_first"))
    many = rest.join(known, [*by, "_first"], "left_semi").join(count.where("_n > 1").select(*by, "_last"), [*by, "_last"], "left_semi")
    ends = many.join(dotted_suffixes(i.withColumnRenamed("_id", "id"), by).select(*by, F.col("suffix").alias("_call"), F.col("least").alias("target")), [*by, "_call"]).select(*by, "_call", "target")
    return exact.unionByName(one).unionByName(ends).withColumnRenamed("_call", call)


def call_edges(uses: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Edges of resolved calls. Of a source's uses of a name the first counts:
    they are combined where they lie, once, and only names are resolved."""
    uses = stored(uses.groupBy(*by, "source", "call").agg(F.min("no").alias("no")), "uses")
    to = resolve_names(uses, nodes, by)
    e = uses.join(to, [*by, "call"]).where("target <> source").groupBy(*by, "source", "target").agg(F.min("no").alias("no"))
    w = Window.partitionBy(*by, "source").orderBy("no")
    return e.select(*by, "source", "target", F.lit("calls").alias("type"), (F.row_number().over(w) - 1).cast("long").alias("key"))


def neighbours(edges: DataFrame, node: str | Column, order: str, edge_type: str | None = None, most: int = 50) -> DataFrame:
    """Edges at a node in edge order: direction, other, type; at most `most`."""
    n = F.lit(node) if isinstance(node, str) else node
    df = edges.where((F.col("source") == n) | (F.col("target") == n))
    if edge_type:
        df = df.where(F.col("type") == edge_type)
    out = F.col("source") == n
    return df.select(order, F.when(out, "->").otherwise("<-").alias("direction"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("other"), "type").orderBy(order).limit(most)


def subgraph(adjacency: DataFrame, start: DataFrame, depth: int = 2, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Nodes within `depth` steps of the start nodes: by, node, depth.

    A frontier joined with the adjacency (node, other) per step, less what has
    been seen; each step is kept in the shared folder. `most` keeps the first
    nodes of each `by` by depth and name: a traversal whose nodes fill it stops
    there, and the others go on. To follow many starts each by itself, name a
    column of the start in `by` that the adjacency does not have.
    """
    by = by or []
    on = [c for c in by if c in adjacency.columns]
    seen = start.select(*by, "node").distinct().withColumn("depth", F.lit(0))
    seen = _within(seen, by, most)
    front = seen.select(*by, "node")
    for d in range(1, depth + 1):
        step = adjacency.join(front, [*on, "node"]).select(*by, F.col("other").alias("node")).distinct()
        new = step.join(seen.select(*by, "node"), [*by, "node"], "left_anti").withColumn("depth", F.lit(d))
        if most:
            # of what a step finds, no more than the room that its traversal has left
            room = seen.groupBy(*by).agg((F.lit(most) - F.count("*")).alias("_room"))
            new = new.join(room, by) if by else new.crossJoin(F.broadcast(room))
            new = _within(new.where("_room > 0"), by, F.col("_room")).drop("_room")
        new = stored(new, "frontier")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        front = new.select(*by, "node")
    return seen


def _within(df: DataFrame, by: list[str], most: int | Column | None) -> DataFrame:
    """The first `most` nodes of each `by` by depth and name. Nodes are ranked in
    64 parts first, so that no more than 64 times as many meet in a task."""
    if most is None:
        return df
    most = F.lit(most) if isinstance(most, int) else most
    rank = lambda *more: F.row_number().over(Window.partitionBy(*by, *more).orderBy("depth", "node"))
    part = df.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(64))).withColumn("_no", rank("_part")).where(F.col("_no") <= most)
    return part.withColumn("_no", rank()).where(F.col("_no") <= most).drop("_part", "_no")
