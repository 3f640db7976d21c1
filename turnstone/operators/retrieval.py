"""Retrieval: chunks, rare-term keyword search, vector top-k, entity graph, fusion, context packs.

Every search takes a set of queries and is one plan for all of them. The query side is a
stated set; documents are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..functions import vector as V
from ..functions.grams import count_grams, find_grams
from ..session import scratch_path, ship_code

# Defaults of the retriever, entity patterns, sentence-initial words that name nothing.
CHUNK_LINES, OVERLAP = 20, 4
TOP_K, CANDIDATES, MIN_COSINE, MIN_FUSED = 5, 20, 0.15, 0.0
#: Queries of one block of a vector search, and those scored at once in a task.
MAX_QUERIES, AT_ONCE = 10_000, 500
#: Grams of a query set up to which they travel to the chunks; more are joined by a shuffle.
BROADCAST_GRAMS = 500_000
MAX_DF, MAX_DF_FRACTION, RRF_K, KEYWORD_WEIGHT, MAX_ENTITIES = 3, 0.2, 60, 1.5, 40
BACKTICK = r"`([^`\n]{1,80})`"
# Repeated groups are possessive: Java matches those in a loop, others by a call a repeat, so that a long run of names would overflow the stack.
CAPITALS = r"(?U)\b[A-Z][A-Za-z0-9]*+\b(?:[ \t]++[A-Z][A-Za-z0-9]*+\b)*+"
SNAKE = r"(?U)\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b"
CAMEL = r"(?U)\b[a-z]+[A-Z][A-Za-z0-9]*\b|\b[A-Z][a-z0-9]++(?:[A-Z][a-z0-9]++)++\b"
DOTTED = r"(?U)\b[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+\b)++"
CAPITAL_STOP = (
    "A An The This That These Those It Its If In On At To For From By With As And Or But Not No Yes We You They He She I Is Are Was Were Be Do Does Did "
    "Has Have Had Can Could Should Would Will May Might Must When Where What Which Who Why How Then So Each Every All Some Any Here There Note See Also Use "
    "Run Set Get New Only Such"
).split()


def chunk_lines(docs: DataFrame, lines: int = CHUNK_LINES, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Overlapping windows of lines: chunk_id, document_id, start_line, end_line, text. Blank windows are left out; null texts have none."""
    if lines <= 0:
        raise ValueError("lines must be positive")
    if overlap < 0 or overlap >= lines:
        raise ValueError("overlap must be at least 0 and less than lines")
    step = lines - overlap
    # The lines are split once a document, whatever reads them.
    found = X.once(lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x), X.lines(F.col(text_col)))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("document_id"), found.alias("l"))
    n = F.size("l")
    last = F.greatest(F.ceil((n - lines) / step), F.lit(0)).cast("int")
    starts = rows.select("document_id", "l", F.explode(F.when(n > 0, F.sequence(F.lit(0), last))).alias("k"))
    start = F.col("k") * step
    cut = starts.select("document_id", (start + 1).alias("start_line"), F.least(start + lines, n).alias("end_line"), F.array_join(F.slice("l", start + 1, F.lit(lines)), "\n").alias("text"))
    cut = cut.where(F.col("text").rlike(r"(?U)\S"))
    return cut.select(F.concat(F.col("document_id"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("chunk_id"), "document_id", "start_line", "end_line", "text")


def postings(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id), each once."""
    return chunks.select("chunk_id", F.explode(F.array_distinct(X.grams(F.col("text")))).alias("gram"))


def gram_frequencies(chunks: DataFrame) -> DataFrame:
    """(gram, df, n): chunks that have each gram, of n chunks, in one pass.

    Grams are counted inside the tasks, before any row of them is made. A task's grams differ
    from each other, so they are dealt as they are and met with other tasks' only then.
    """
    ship_code(chunks.sparkSession)
    path = scratch_path(chunks.sparkSession, "gram-counts")
    counted = chunks.select("text").mapInArrow(count_grams, "gram string, n long")
    counted.repartition("gram").groupBy("gram").agg(F.sum("n").alias("df")).write.parquet(path)
    df = chunks.sparkSession.read.schema("gram string, df long").parquet(path)
    return df.where("gram is not null").withColumn("n", F.coalesce(df.where("gram is null").agg(F.max("df")).scalar(), F.lit(0)))


def count_of(df: DataFrame) -> Column:
    """The number of rows, as a scalar subquery."""
    return df.agg(F.count("*")).scalar()


def rare_postings(chunks: DataFrame, queries: DataFrame, max_df: int = MAX_DF, fraction: float = MAX_DF_FRACTION) -> DataFrame:
    """(query_id, gram, chunk_id, df, n): matches of the queries' rare and informative grams.

    Only grams of the query set leave the chunks, and each gram's document frequency is
    counted before any pair is made; a gram in more chunks than the limit makes none. The
    query set's grams travel to the chunks, which are read once; more of them than
    BROADCAST_GRAMS are joined by a shuffle.
    """
    spark = chunks.sparkSession
    ship_code(spark)
    path = scratch_path(spark, "gram-hits")
    asked = queries.select("query_id", F.explode(F.array_distinct(X.grams(F.col("text")))).alias("gram")).where(X.informative(F.col("gram")))
    asked.write.parquet(f"{path}/asked")
    asked = spark.read.schema(asked.schema).parquet(f"{path}/asked")
    some = asked.select("gram").distinct().limit(BROADCAST_GRAMS + 1).collect()
    if len(some) <= BROADCAST_GRAMS:
        wanted = spark.sparkContext.broadcast(frozenset(r.gram for r in some))
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        chunks.select("chunk_id", "text").mapInArrow(find_grams(wanted), f"id {kind}, gram string").write.parquet(f"{path}/hits")
        hits = spark.read.schema(f"id {kind}, gram string").parquet(f"{path}/hits").withColumnRenamed("id", "chunk_id")
        held, n = hits.where("gram is not null"), count_of(hits.where("gram is null"))
    else:
        # Repeats go after the semi-join, when few rows are left; both uses below share that shuffle.
        every = chunks.select("chunk_id", F.explode(X.grams(F.col("text"))).alias("gram"))
        held, n = every.join(asked.select("gram").distinct(), "gram", "left_semi").distinct(), count_of(chunks)
    limit = F.greatest(F.lit(1), F.least(F.lit(max_df), F.floor(F.col("n") * fraction)))
    df = held.groupBy("gram").agg(F.count("*").alias("df")).withColumn("n", n).where(F.col("df") <= limit)
    return asked.join(df, "gram").join(held, "gram")


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES, max_df: int = MAX_DF, fraction: float = MAX_DF_FRACTION) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best by summed idf, pairs of words counting double."""
    return keyword_ranking(rare_postings(chunks, queries, max_df, fraction), k)


def keyword_ranking(matches: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best of each query from its matches (query_id, gram, chunk_id, df, n)."""
    weight = F.when(F.contains("gram", F.lit(" ")), 2.0).otherwise(1.0)
    scored = matches.groupBy("query_id", "chunk_id").agg(F.sum(weight * F.ln(1.0 + F.col("n") / F.col("df"))).alias("score"))
    return ranked(scored, F.round("score", 9).desc(), "chunk_id", k)


def ranked(rows: DataFrame, score: Column, id_col: str, k: int | None) -> DataFrame:
    """Adds rank by score within query, ids breaking ties; with k, only the first k (cut per task before the shuffle)."""
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(score, F.col(id_col).asc())))
    return out if k is None else out.where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): exhaustive cosine top-k for a set of queries.

    Blocks of at most MAX_QUERIES queries travel to the tasks as one matrix each; a batch of
    vectors meets a block in one product, and only its k best a query go on to the shuffle.
    A vector of another dimension raises; one without length scores 0.
    """
    src = queries.select("query_id", "embedding")
    first = src.limit(MAX_QUERIES + 1).collect()
    blocks = [first] if len(first) <= MAX_QUERIES else batched(src.toLocalIterator(), MAX_QUERIES)
    scored = None
    for asked in blocks:
        part = _scores(vectors, asked, queries.schema["query_id"], k, id_col)
        scored = part if scored is None else scored.unionByName(part)
    return ranked(scored, F.round("score", 9).desc(), id_col, k)


def _scores(vectors: DataFrame, asked: Sequence[Row], query_id: T.StructField, k: int, id_col: str) -> DataFrame:
    """(query_id, id, score): of each batch of vectors the k best for each query of a block."""
    src = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    schema = T.StructType([query_id, src.schema["id"], T.StructField("score", T.DoubleType())])
    matrix = np.array([r.embedding for r in asked], float).reshape(len(asked), len(asked[0].embedding) if asked else 0)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
    names = [r.query_id for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            found = batch.column(1)
            if (np.diff(found.offsets.to_numpy()) != matrix.shape[1]).any():
                raise ValueError("vectors differ in dimension")
            v = found.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
            ids = np.array(batch.column(0).to_pylist())
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(names), AT_ONCE):
                scores = v @ matrix[at : at + AT_ONCE].T
                rows: list[tuple] = []
                for q, name in enumerate(names[at : at + AT_ONCE]):
                    best = order[np.argsort(-np.round(scores[order, q], 9), kind="stable")[:k]]
                    rows += [(name, ids[b].item(), float(scores[b, q])) for b in best]
                table = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, to_arrow_schema(schema).types, strict=True)], names=["query_id", "id", "score"])

    return src.mapInArrow(run, T.StructType([T.StructField("query_id", schema[0].dataType), T.StructField("id", schema[1].dataType), schema[2]])).withColumnRenamed("id", id_col)


def cosine_spread(hits: DataFrame) -> DataFrame:
    """Of each query: hits, the first and last cosine, and their distance."""
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("score", -F.col("rank")).alias("first"), F.max_by("score", "rank").alias("last")).withColumn("spread", F.col("first") - F.col("last"))


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, sources, rank) of rankings with query_id, chunk_id, rank."""
    weights = weights or {}
    out = None
    for name, r in rankings.items():
        part = r.select("query_id", "chunk_id", (F.lit(weights.get(name, 1.0)) / (F.lit(k) + F.col("rank"))).alias("s"), F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return ranked(fused, F.round("score", 12).desc(), "chunk_id", None)


def entity_key(name: Column) -> Column:
    return F.concat(F.lit("ent:"), F.array_join(X.words(F.lower(name)), " "))


def entities(text: Column) -> Column:
    """Names in a text, each once: in backticks, capitalised (without leading grammar words), snake, camel and dotted."""
    every = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    ticks = F.filter(F.transform(every(BACKTICK, 1), X.strip), lambda t: (F.length(t) >= 2) & ~F.contains(t, F.lit(" ")))
    leading = r"^(?:(?:" + "|".join(CAPITAL_STOP) + r")(?:[ \t]+|$))++"
    capital = F.transform(every(CAPITALS), lambda p: F.regexp_replace(F.regexp_replace(p, leading, ""), r"[ \t]+", " "))
    tokens = F.filter(F.concat(every(SNAKE), every(CAMEL), every(DOTTED)), lambda t: ~F.lower(t).isin("e.g", "i.e", "etc"))
    return F.array_distinct(F.concat(ticks, F.filter(capital, lambda p: F.length(p) >= 2), tokens))


def mentions(chunks: DataFrame, limit: int = MAX_ENTITIES) -> DataFrame:
    """(chunk_id, key, name): a chunk's first entities by key; of several surface forms the first.

    A chunk is one row, so its names are keyed, sorted, merged and capped inside the row.
    """
    pairs = F.array_sort(F.transform(entities(F.col("text")), lambda n: F.struct(entity_key(n).alias("key"), n.alias("name"))))
    first = X.once(lambda s: F.filter(s, lambda x, i: (i == 0) | (x["key"] != F.get(s, i - 1)["key"])), pairs)
    return chunks.select("chunk_id", F.explode(F.slice(first, 1, limit)).alias("m")).select("chunk_id", "m.key", "m.name")


def graph_nodes(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(key, label, name): chunks and entities, each key once, the largest name of several."""
    a = chunks.select(F.concat(F.lit("chunk:"), F.col("chunk_id")).alias("key"), F.lit("Chunk").alias("label"), F.lit(None).cast("string").alias("name"))
    return a.unionByName(found.groupBy("key").agg(F.lit("Entity").alias("label"), F.max("name").alias("name")))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def nodes_with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def graph_edges(found: DataFrame) -> DataFrame:
    """(src, dst, rel, chunk_id): mentions, and entities of one chunk together; a pair in several chunks keeps the last.

    Pairs are made inside a chunk's bounded list of entities, never by joining on the chunk.
    """
    a = found.select(F.concat(F.lit("chunk:"), F.col("chunk_id")).alias("src"), F.col("key").alias("dst"), F.lit("mentions").alias("rel"), F.lit(None).cast("string").alias("chunk_id")).distinct()
    lists = found.groupBy("chunk_id").agg(F.array_sort(F.collect_set("key")).alias("ks"))
    i = lists.select("chunk_id", "ks", F.posexplode("ks").alias("i", "src"))
    pairs = i.select("chunk_id", "src", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("dst"))
    b = pairs.groupBy("src", "dst").agg(F.lit("cooccurs").alias("rel"), F.max("chunk_id").alias("chunk_id"))
    return a.unionByName(b)


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, rel: str | None = None, node: str = "key") -> DataFrame:
    """(start, key, depth): nodes within ``depth`` hops of each start node, either way along edges, without the start.

    Each hop joins the frontier, not the paths: a node is kept once a start, at its least depth.
    """
    e = edges if rel is None else edges.where(F.col("rel") == rel)
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = start.select(F.col(node).alias("start")).distinct().select("start", F.col("start").alias("key"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, F.col("key") == F.col("a")).select("start", F.col("b").alias("key")).distinct()
        front = step.join(seen.select("start", "key"), ["start", "key"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def subgraph(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with these keys, and the edges between them."""
    wanted = nodes.join(keys.select("key").distinct(), "key", "left_semi")
    k = wanted.select("key")
    inside = edges.join(k.withColumnRenamed("key", "src"), "src", "left_semi").join(k.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return wanted, inside


def remove_document(chunks: DataFrame, found: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and mentions without a document; the graph is made anew from what is left."""
    gone = chunks.where(F.col("document_id") == document_id).select("chunk_id")
    return chunks.where(F.col("document_id") != document_id), found.join(gone, "chunk_id", "left_anti")


def graph_expand(found: DataFrame, queries: DataFrame, seeds: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, hits, rank): chunks that mention entities of the query or of its seed chunks, seeds left out."""
    own = queries.select("query_id", F.explode(entities(F.col("text"))).alias("name")).select("query_id", entity_key(F.col("name")).alias("key")).distinct()
    via = seeds.select("query_id", "chunk_id").join(found.select("chunk_id", "key"), "chunk_id").select("query_id", "key")
    keys = own.unionByName(via).distinct()
    hits = keys.join(found.select("chunk_id", "key").distinct(), "key").join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    counted = hits.groupBy("query_id", "chunk_id").agg(F.count("*").alias("hits"))
    return ranked(counted, F.col("hits").desc(), "chunk_id", k)


def hybrid_retrieve(
    chunks: DataFrame, found: DataFrame, queries: DataFrame, *, k: int = TOP_K, candidates: int = CANDIDATES, min_cosine: float = MIN_COSINE, min_fused: float = MIN_FUSED,
    max_df: int = MAX_DF, fraction: float = MAX_DF_FRACTION, rrf_k: int = RRF_K, keyword_weight: float = KEYWORD_WEIGHT, keyword: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, path, cosine, rank, floored): keyword, vector and graph hits, fused, above the floor.

    ``chunks`` and ``queries`` have embeddings. A chunk stays if it is a keyword hit or its
    cosine reaches the floor, and its fused score does; ``floored`` counts what was passed
    over before the k-th that stays. ``path`` is its only source, or 'fused'. Blank queries find nothing.
    ``keyword`` is a keyword ranking made elsewhere, such as by an index.
    """
    queries = queries.where(X.strip(F.col("text")) != "")
    keyword = keyword_search(chunks, queries, candidates, max_df, fraction) if keyword is None else keyword
    vector = vector_search(chunks, queries, candidates).where("score > 0")
    seeds = keyword.where(F.col("rank") <= k).select("query_id", "chunk_id").unionByName(vector.where(F.col("rank") <= k).select("query_id", "chunk_id")).distinct()
    graph = graph_expand(found, queries, seeds, candidates)
    fused = reciprocal_rank_fusion({"keyword": keyword, "vector": vector, "graph": graph}, rrf_k, {"keyword": keyword_weight}).withColumnRenamed("rank", "at")
    cosine = V.cosine(F.col("q"), F.col("v"))
    judged = fused.join(chunks.select("chunk_id", F.col("embedding").alias("v")), "chunk_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").withColumn("cosine", cosine).drop("q", "v")
    stays = (F.array_contains("sources", F.lit("keyword")) | (F.col("cosine") >= min_cosine)) & (F.col("score") >= min_fused)
    run = W.partitionBy("query_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    judged = judged.withColumn("stays", stays).withColumn("rank", F.count_if("stays").over(run)).withColumn("passed", F.count_if(~F.col("stays")).over(run))
    kept = judged.where(F.col("stays") & (F.col("rank") <= k))
    # What was examined ends at the k-th that stays; with fewer than k, everything was.
    totals = judged.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("stays") & (F.col("rank") == k), F.col("passed"))), F.max("passed")).alias("floored"))
    path = F.when(F.size("sources") > 1, "fused").otherwise(F.col("sources")[0])
    return kept.join(totals, "query_id").select("query_id", "chunk_id", "score", path.alias("path"), "cosine", "rank", "floored")


def context_pack(hits: DataFrame, max_chars: int = 2000) -> DataFrame:
    """(query_id, context) of hits with query_id, rank, document_id, start_line, end_line and text.

    Blocks of a header and plain text, two line feeds apart, up to ``max_chars``; the block
    that overflows is cut at a word and ends the pack.
    """
    head = F.concat(F.lit("From "), F.col("document_id"), F.lit(", lines "), F.col("start_line").cast("string"), F.lit(" to "), F.col("end_line").cast("string"), F.lit("."))
    rows = hits.select("query_id", "rank", head.alias("head"), X.strip_markdown_retrieval(F.col("text")).alias("body")).withColumn("size", F.length("head") + 1 + F.length("body"))
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.col("size") + 2).over(before), F.lit(0))).withColumn("over", F.col("used") + F.col("size") > max_chars)
    rows = rows.withColumn("late", F.coalesce(F.max(F.col("over").cast("int")).over(before), F.lit(0)))
    room = F.lit(max_chars) - F.col("used") - F.length("head") - 1
    cut = F.substring("body", F.lit(1), room.cast("int"))
    cut = F.regexp_replace(F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut), r"(?U)\s+$", "")
    block = F.when(~F.col("over"), F.concat_ws("\n", "head", "body")).when(room > 0, F.concat(F.col("head"), F.lit("\n"), cut))
    blocks = rows.where("late = 0").select("query_id", "rank", block.alias("block")).where("block is not null")
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("context"))
