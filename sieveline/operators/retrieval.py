"""Lexical retrieval: BM25, roll-ups to files, re-ranking over a graph, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: BM25 parameters and the weight of a neighbour's score.
K1, B, NEIGHBOUR = 1.2, 0.75, 0.5
#: Rows and bytes up to which a counted side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: The same for targets, whose rows are two short columns.
MOST_TARGETS = 1_000_000
#: Pairs of a query and a document to a partition at most; partitions at most.
PAIRS, MOST_PARTS = 500_000, 20_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table only if its rows and bytes, counted up to the limit, are
    few; else leave it to joins by shuffle."""
    row = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def document_frequency(docs: DataFrame, id_col: str, toks: Column) -> DataFrame:
    """Documents per token. Tokens are made distinct where the text lies."""
    return docs.select(F.col(id_col), F.explode(F.array_distinct(toks)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def counted(docs: DataFrame, tokens: str, keep: list[str]) -> DataFrame:
    """A row (keep, token, c) per distinct token of a document, counted where its
    text lies: tokens are sorted in the row, and counts are the distances between
    the places where a new one begins. No row leaves its partition for that."""
    # behind generators, else each step would be repeated in every expression over it
    s = docs.select(*keep, F.explode(F.array(F.sort_array(F.array_compact(tokens)))).alias("_s")).where(F.size("_s") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2)))
    s = s.select(*keep, "_s", F.explode(F.array(starts)).alias("_b"))
    runs = F.transform("_b", lambda p, i: F.struct(F.get("_s", p - 1).alias("token"), (F.coalesce(F.get("_b", i + 1), F.size("_s") + 1) - p).cast("long").alias("c")))
    return s.select(*keep, F.explode(runs).alias("_r")).select(*keep, "_r.*")


def bm25(docs: DataFrame, queries: DataFrame, by: list[str], doc_id: str, doc_tokens: str, query_id: str, query_tokens: str, digits: int = 6, within: list[str] | None = None) -> DataFrame:
    """Scores of all (query, document) pairs that share a token, within `by`.

    docs: by, doc_id, array of tokens; queries likewise; a query's distinct
    tokens count once. Returns by, query_id, doc_id, score, rounded.

    Only tokens of queries leave the scan: the vocabulary of the queries is
    joined, by broadcast if it is counted to be small, before the tokens are
    shuffled, once, by document; the number of documents and their mean length
    come from a separate aggregate over sizes. If the weights are broadcast, a
    document's pairs are formed and added up where its tokens lie and leave it
    nowhere: the result is partitioned by document, PAIRS pairs to a partition.
    `within` names columns of docs, such as a document's file, that the result
    keeps and is partitioned by instead, so that what belongs together meets.
    """
    own = [*(within or []), doc_id]
    q = queries.select(*by, query_id, F.explode(F.array_distinct(query_tokens)).alias("token"))
    # neither the vocabulary nor the weights have more rows than the queries' tokens,
    # or more than the weights' few numbers beside each
    n, size = q.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.octet_length("token") + 64)).first()
    hint = F.broadcast if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else lambda df: df
    vocab = hint(q.select(*by, "token").distinct())
    d = docs.select(*by, *own, doc_tokens, F.size(doc_tokens).alias("_len"))
    corpus = d.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, -(-docs.count() * queries.count() // PAIRS)))
    tf = d.select(*by, *own, "_len", F.explode(doc_tokens).alias("token")).join(vocab, [*by, "token"]).repartition(parts, *by, *(within or [doc_id]))
    tf = tf.groupBy(*by, *own, "token").agg(F.count("*").alias("_c"), F.first("_len").alias("_len"))
    df = tf.groupBy(*by, "token").agg(F.count("*").alias("_df"))
    weights = q.join(df, [*by, "token"])
    weights = (weights.join(corpus, by) if by else weights.crossJoin(F.broadcast(corpus))).withColumn("_idf", F.log1p((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    part = F.col("_idf") * F.col("_c") * (K1 + 1) / (F.col("_c") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return tf.join(hint(weights), [*by, "token"]).groupBy(*by, query_id, *own).agg(F.round(F.sum(part), digits).alias("score"))


def ranked(df: DataFrame, by: list[str], score: str, tie: list[str], name: str = "rank", k: int | None = None) -> DataFrame:
    """Rank by falling score and a total tie-break; the first k if given."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *tie)))
    return out.where(F.col(name) <= k) if k else out


def undirected(edges: DataFrame, by: list[str], src: str = "source", dst: str = "target") -> DataFrame:
    """Distinct (node, other) pairs in both directions."""
    return edges.select(*by, F.col(src).alias("node"), F.col(dst).alias("other")).union(edges.select(*by, F.col(dst).alias("node"), F.col(src).alias("other"))).distinct()


def known_ends(edges: DataFrame, nodes: DataFrame, by: list[str], node: str, src: str = "source", dst: str = "target") -> DataFrame:
    """Edges both of whose ends are nodes."""
    n = nodes.select(*by, node)
    return edges.join(n.withColumnRenamed(node, src), [*by, src], "left_semi").join(n.withColumnRenamed(node, dst), [*by, dst], "left_semi").select(*edges.columns)


def rerank(scores: DataFrame, adjacency: DataFrame, by: list[str], node: str, score: str = "score", weight: float = NEIGHBOUR) -> DataFrame:
    """score + weight * the largest score of a neighbour (0 without one)."""
    around = adjacency.select(*[c for c in by if c in adjacency.columns], F.col("node").alias(node), F.col("other"))
    near = around.join(scores.select(*by, F.col(node).alias("other"), F.col(score).alias("_s")), [*[c for c in by if c in adjacency.columns], "other"]).groupBy(*by, node).agg(F.max("_s").alias("_near"))
    out = scores.join(near, [*by, node], "full_outer")
    return out.withColumn(score, F.coalesce(score, F.lit(0.0)) + weight * F.coalesce("_near", F.lit(0.0))).drop("_near")


def rerank_within(scores: DataFrame, adjacency: DataFrame, by: list[str], within: list[str], node: str, score: str = "score", weight: float = NEIGHBOUR) -> DataFrame:
    """rerank() for scores that are partitioned by `within` (see bm25) and edges
    that don't leave it: adjacency has within, node, other.

    A score goes, beside its node, to the node's neighbours, whose list it has
    been given by a broadcast or one join; what a node gets is added up where it
    lies. No pair of a query and a node is shuffled."""
    lists = sized(stored(adjacency.groupBy(*within, F.col("node").alias(node)).agg(F.collect_list("other").alias("_others")), "neighbours"), MOST_TARGETS)
    near = F.transform(F.coalesce("_others", F.array().cast(lists.schema["_others"].dataType)), lambda o: F.struct(o.alias("to"), F.lit(None).cast("double").alias("own"), F.col(score).alias("near")))
    sent = F.concat(F.array(F.struct(F.col(node).alias("to"), F.col(score).alias("own"), F.lit(None).cast("double").alias("near"))), near)
    got = scores.join(lists, [*within, node], "left").select(*by, *within, F.explode(sent).alias("_g")).select(*by, *within, F.col("_g.to").alias(node), "_g.own", "_g.near")
    out = got.groupBy(*by, *within, node).agg(F.max("own").alias("own"), F.max("near").alias("near"))
    return out.select(*by, *within, node, (F.coalesce("own", F.lit(0.0)) + weight * F.coalesce("near", F.lit(0.0))).alias(score))


def prefix_file_map(nodes: DataFrame, files: DataFrame, by: list[str], node: str, path: str, most: int = 6, sep: str = ".", suffixes: tuple[str, ...] = (".py", "/__init__.py")) -> DataFrame:
    """The file of a dotted name: its longest prefix (of at most `most` parts)
    that is a file, a module before a package. Candidates are made per node and
    joined by equality."""
    parts = F.slice(F.split(F.col(node), "[" + sep + "]"), 1, most)
    cands = F.flatten(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array(*[F.struct((n * -10 + k).alias("prio"), F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit(s)).alias("cand")) for k, s in enumerate(suffixes)])))
    c = nodes.select(*by, node, F.explode(cands).alias("_c")).select(*by, node, "_c.prio", F.col("_c.cand").alias(path))
    return c.join(files.select(*by, path).distinct(), [*by, path]).groupBy(*by, node).agg(F.min_by(path, "prio").alias(path))


def roll_up(scores: DataFrame, mapping: DataFrame, by: list[str], node: str, file: str, extra: list[str] | None = None) -> DataFrame:
    """Largest score of a file's nodes, at least 0; files without scored nodes stay."""
    extra = extra or []
    s = mapping.join(scores.select(*by, *extra, node, "score"), [*by, node], "left")
    return s.groupBy(*by, *extra, file).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("score"), F.lit(0.0))).alias("score"))


def first_hits(ranks: DataFrame, targets: DataFrame, query: list[str], item: str, rank: str = "rank") -> DataFrame:
    """Rank of a query's first target; 0 if none was ever ranked."""
    hit = targets.select(*query, item).distinct().join(ranks.select(*query, item, rank), [*query, item], "left")
    return hit.groupBy(*query).agg(F.count("*").alias("n_targets"), F.coalesce(F.min(rank), F.lit(0)).cast("int").alias("first_rank"))


def first_hits_of(scores: DataFrame, targets: DataFrame, query: list[str], item: str, score: str = "score") -> DataFrame:
    """first_hits() of the ranking by falling score and item, from the scores.

    A query's best target is known by joining; its rank is one more than the
    number of rows that come before it, which are counted where they lie. No row
    is ranked and nothing is sorted. The scores are read twice, and so computed
    once and kept in the shared folder; where the targets are few enough to be
    broadcast, no score is shuffled. Items may be of any type that has an order.
    """
    scores = stored(scores.select(*query, item, score), "scores")
    t = stored(targets.select(*query, item).distinct(), "targets")
    hit = scores.join(sized(t, MOST_TARGETS), [*query, item])
    place = F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))
    best = hit.where(F.col(score).isNotNull()).groupBy(*query).agg(F.min(place).alias("_best"))
    some = sized(stored(best, "best"))
    ahead = scores.join(some, query).groupBy(*query).agg(F.count_if(place < F.col("_best")).alias("_ahead"))
    out = t.groupBy(*query).agg(F.count("*").alias("n_targets")).join(ahead, query, "left")
    return out.select(*query, "n_targets", F.coalesce(F.col("_ahead") + 1, F.lit(0)).cast("int").alias("first_rank"))


def _words(df: DataFrame, text: str, name: str = "_w") -> DataFrame:
    """The text's space-separated words as a column of its own, behind a
    generator: else the split would be repeated in every expression over it."""
    return df.withColumn(name, F.explode(F.array(F.split(F.col(text), " "))))


def holding(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item: str, size: int = 3) -> DataFrame:
    """Pairs (item_id, doc_id) of documents whose text holds an item's verbatim.

    An item is looked for by one run of `size` space-separated words from its
    inside: where the item stands, these words stand whole, so the join is by
    equality, and holding is tested on the pairs that it yields. Of an item's
    runs the one that the fewest documents have is taken. Items too short for
    that, of at most `size` + 1 words, are tested on every text, a block of
    items of bounded size at a time.
    """
    runs = F.when(F.size("_w") >= size, F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), lambda i: F.xxhash64(F.slice("_w", i, size)))).otherwise(F.array().cast("array<bigint>"))
    inner = _words(items.select(item_id, item), item).withColumn("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))))
    of_items = stored(inner.select(item_id, F.explode_outer(F.array_distinct(runs)).alias("_key")), "runs")
    known = sized(of_items.select("_key").where("_key is not null").distinct())
    of_docs = stored(_words(docs.select(doc_id, text), text).select(doc_id, F.explode(F.array_distinct(runs)).alias("_key")).join(known, "_key", "left_semi"), "hits")
    rare = of_docs.groupBy("_key").agg(F.count("*").alias("_n"))
    key = of_items.join(rare, "_key").groupBy(item_id).agg(F.count("*").alias("_found"), F.min_by("_key", F.struct("_n", "_key")).alias("_key"))
    # an item some run of which no document has is held by none
    whole = of_items.where("_key is not null").groupBy(item_id).agg(F.count("*").alias("_runs"))
    key = key.join(whole, item_id).where("_found = _runs").select(item_id, "_key")
    pairs = stored(of_docs.join(sized(key), "_key").select(item_id, doc_id).distinct(), "pairs")
    texts = docs.select(doc_id, text)
    holds = F.contains(F.col(text), F.col(item))
    found = texts.join(sized(pairs), doc_id).join(sized(items.select(item_id, item)), item_id).where(holds).select(item_id, doc_id)
    short = stored(items.join(of_items.where("_key is null").select(item_id).distinct(), item_id, "left_semi").select(item_id, item), "short")
    n, held = short.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(item)), F.lit(0))).first()
    blocks = max(-(-n // BROADCAST_ROWS), -(-held // BROADCAST_BYTES))
    for b in range(blocks):
        some = short.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        found = found.union(texts.join(F.broadcast(some), holds).select(item_id, doc_id))
    return found.distinct()


def recall_at(first: DataFrame, ks: list[int], by: list[str] | None = None, rank: str = "first_rank") -> DataFrame:
    """Share of queries whose first target is within k, for each k."""
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    hit = (F.col(rank) > 0) & (F.col(rank) <= F.col("k"))
    out = first.select(*(by or []), rank, k).groupBy(*(by or []), "k").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("n")))
