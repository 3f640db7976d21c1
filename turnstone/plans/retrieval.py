"""Queries of retrieval, graphs, registry and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..functions.udfs import hashing_embedder
from ..operators import registry as G
from ..operators import retrieval as R
from ..session import scratch_path
from ..sources.index import DocumentIndex
from .catalog import query, tidy
from .tables import epoch, load

_CHUNKS = """
l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, string_split(text, chr(10)) AS raw FROM documents),
m AS (SELECT document_id, CASE WHEN raw[-1] = '' THEN raw[:-2] ELSE raw END AS ls FROM l),
k AS (SELECT document_id, ls, len(ls) AS n, unnest(range(0, greatest(CAST(ceil((len(ls) - 20) / 16.0) AS BIGINT), 0) + 1)) * 16 AS i FROM m WHERE len(ls) > 0),
c AS (SELECT document_id || ':' || (i + 1) || '-' || least(i + 20, n) AS chunk_id, document_id, i + 1 AS start_line, least(i + 20, n) AS end_line, array_to_string(ls[i + 1:i + 20], chr(10)) AS text FROM k)
"""
_GRAMS = """
tok AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM c),
post AS (SELECT DISTINCT chunk_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM tok)
"""
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_ASKED = f"""
qt AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM benchmark),
asked AS (SELECT DISTINCT query_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM qt),
inf AS (SELECT * FROM asked WHERE len(list_filter(string_split(gram, ' '), lambda w: w NOT IN ({_STOP}))) > 0),
dfs AS (SELECT gram, count(*) AS df, (SELECT count(*) FROM c) AS n FROM post SEMI JOIN inf USING (gram) GROUP BY gram),
rare AS (SELECT inf.query_id, inf.gram, df, n FROM inf JOIN dfs USING (gram) WHERE df <= greatest(1, least(3, CAST(floor(n * 0.2) AS BIGINT)))),
kw AS (SELECT query_id, chunk_id, sum(CASE WHEN contains(gram, ' ') THEN 2.0::DOUBLE ELSE 1.0 END * ln(1 + n / df::DOUBLE)) AS score FROM rare JOIN post USING (gram) GROUP BY query_id, chunk_id),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM kw)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_lines(load(spark, sf_dir, "documents"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as the query set."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("WITH " + _CHUNKS + " SELECT chunk_id, document_id, start_line, end_line, md5(text) AS text_md5 FROM c")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(chunks(spark, sf_dir).withColumn("text_md5", F.md5("text")).drop("text"))


@query("WITH " + _CHUNKS + " SELECT document_id, count(*) AS n FROM c GROUP BY document_id")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"))


@query("WITH " + _CHUNKS + "," + _GRAMS + " SELECT gram, count(*) AS df, round(ln(1 + (SELECT count(*) FROM c) / count(*)::DOUBLE), 6) AS idf FROM post GROUP BY gram")
def grams_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every gram."""
    return R.gram_frequencies(chunks(spark, sf_dir)).select("gram", "df", F.round(F.ln(1 + F.col("n") / F.col("df")), 6).alias("idf"))


@query("WITH " + _CHUNKS + "," + _GRAMS + "," + _ASKED + " SELECT DISTINCT query_id, gram, df FROM rare")
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rare_postings(chunks(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "gram", "df").distinct()


@query("WITH " + _CHUNKS + "," + _GRAMS + "," + _ASKED + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kr WHERE rank <= 20")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.keyword_search(chunks(spark, sf_dir), asked(spark, sf_dir)))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every hundredth as the query set."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return e, e.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


_VEC = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs)
"""


@query("WITH " + _VEC + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return tidy(R.vector_search(v, q, 5))


@query("WITH " + _VEC + " SELECT query_id, count(*) AS n, round(max(score), 6) AS first, round(min(score), 6) AS last, round(max(score) - min(score), 6) AS spread FROM vr WHERE rank <= 20 GROUP BY query_id")
def cosine_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return tidy(R.cosine_spread(R.vector_search(v, q, 20)))


@query(
    "WITH "
    + _VEC
    + """, lab AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0),
f AS (SELECT query_id, chunk_id, sum(s) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM (
  SELECT query_id, chunk_id, 1.5::DOUBLE / (60 + rank) AS s, 'label' AS src FROM lab WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), 'vector' FROM vr WHERE rank <= 20) GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, round(score, 9) AS score, sources, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f"""
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits fused with vectors of the same label, in id order."""
    v, q = _vectors(spark, sf_dir)
    e = load(spark, sf_dir, "embeddings")
    # A label's first vectors are the same for all of its queries: they are ranked once, and no query meets a whole label.
    first = e.where("label is not null").select(F.col("vec_id").alias("chunk_id"), "label", F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("rank")).where("rank <= 20")
    label = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(first, "label").select("query_id", "chunk_id", "rank")
    fused = R.reciprocal_rank_fusion({"vector": R.vector_search(v, q, 20), "label": label}, weights={"label": 1.5})
    return tidy(fused.withColumn("sources", F.array_join("sources", ",")), digits=9)


@query()
def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's embedding: its non-zero entries and length."""
    c = chunks(spark, sf_dir).withColumn("e", hashing_embedder()("text"))
    return tidy(c.select("chunk_id", F.size(F.filter("e", lambda x: x != 0)).alias("nonzero"), V.norm(F.col("e")).alias("norm")))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    embed = hashing_embedder()
    # An index is built once, written, and read by three searches.
    path = scratch_path(spark, "document-index")
    chunks(spark, sf_dir).withColumn("embedding", embed("text")).write.parquet(f"{path}/chunks")
    c = spark.read.parquet(f"{path}/chunks")
    R.mentions(c).write.parquet(f"{path}/mentions")
    return c, spark.read.parquet(f"{path}/mentions"), asked(spark, sf_dir).withColumn("embedding", embed("text"))


#: Documents after the last change of the index queries: every eleventh is gone, the others read as in the table.
_LEFT = _CHUNKS.replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 0)")


_kept: dict[tuple[str, str], str] = {}


def _kept_up(spark: SparkSession, sf_dir: str) -> DocumentIndex:
    """An index that went through additions, changes, removals, a merge and a vacuum, and was opened again; made once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _kept:
        return DocumentIndex(spark, _kept[key])
    root = scratch_path(spark, "kept-index")
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text")
    index = DocumentIndex(spark, root)
    index.refresh(d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("older first line\n"), "text")).otherwise(F.col("text"))))
    index.add(d.where("doc_id % 5 = 0 AND doc_id % 2 = 0"))
    index.remove(d.where("doc_id % 13 = 0"))
    index.merge()
    index.vacuum()
    DocumentIndex(spark, root).refresh(d.where("doc_id % 11 <> 0"))
    _kept[key] = root
    return DocumentIndex(spark, root)


@query("WITH " + _LEFT + "," + _GRAMS + "," + _ASKED + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kr WHERE rank <= 20")
def index_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search of an index that was kept up; the SQL searches the documents that are left."""
    return tidy(_kept_up(spark, sf_dir).keyword_search(asked(spark, sf_dir)))


@query("WITH " + _LEFT + ", n AS (SELECT document_id, count(*) AS chunks FROM c GROUP BY document_id) SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS sha, coalesce(chunks, 0) AS chunks FROM documents LEFT JOIN n ON document_id = CAST(doc_id AS VARCHAR) WHERE doc_id % 11 <> 0")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index that was kept up holds."""
    return _kept_up(spark, sf_dir).table("documents")


@query("WITH " + _LEFT + "," + _GRAMS + " SELECT gram, count(*) AS df FROM post GROUP BY gram")
def index_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies that an index kept by addition and subtraction."""
    return _kept_up(spark, sf_dir).frequencies()


@query()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.hybrid_retrieve(*_index(spark, sf_dir)))


@query()
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best keyword hits of each query as one text."""
    c = chunks(spark, sf_dir)
    hits = R.keyword_search(c, asked(spark, sf_dir), 5).join(c, "chunk_id")
    return R.context_pack(hits)


_NAMES = """
names AS (SELECT DISTINCT c.chunk_id, w AS name FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM c) c WHERE regexp_matches(w, '^[A-Z]{4,}$'))
"""


@query()
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mentions(chunks(spark, sf_dir))


@query("WITH " + _CHUNKS + "," + _NAMES + " SELECT 'chunk:' || chunk_id AS key, 'Chunk' AS label FROM c UNION ALL SELECT DISTINCT 'ent:' || lower(name), 'Entity' FROM names")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, and words in capitals as entities."""
    c = chunks(spark, sf_dir)
    return R.graph_nodes(c, _capitals(c)).select("key", "label")


def _capitals(c: DataFrame) -> DataFrame:
    words = c.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name")).where(F.col("name").rlike("^[A-Z]{4,}$")).distinct()
    return words.select("chunk_id", R.entity_key(F.col("name")).alias("key"), "name")


_EDGES = """
ment AS (SELECT DISTINCT 'chunk:' || chunk_id AS src, 'ent:' || lower(name) AS dst, chunk_id FROM names),
edge AS (SELECT src, dst, 'mentions' AS rel, NULL::VARCHAR AS chunk_id FROM ment UNION ALL
  SELECT a.dst, b.dst, 'cooccurs', max(a.chunk_id) FROM ment a JOIN ment b ON a.chunk_id = b.chunk_id AND a.dst < b.dst GROUP BY 1, 2)
"""


@query("WITH " + _CHUNKS + "," + _NAMES + "," + _EDGES + " SELECT src, dst, rel, chunk_id FROM edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graph_edges(_capitals(chunks(spark, sf_dir)))


_NATION_EDGES = "ne AS (SELECT DISTINCT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), both_ AS (SELECT a, b FROM ne UNION SELECT b, a FROM ne)"


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return c.unionByName(n).withColumn("rel", F.lit("in"))


@query(
    "WITH "
    + _NATION_EDGES
    + """, h1 AS (SELECT s.a AS start, e.b AS key, 1 AS depth FROM (SELECT DISTINCT a FROM both_ WHERE a LIKE 'r%') s JOIN both_ e ON s.a = e.a),
h2 AS (SELECT DISTINCT h1.start, e.b AS key FROM h1 JOIN both_ e ON h1.key = e.a)
SELECT start, key, CAST(1 AS BIGINT) AS depth FROM h1 UNION ALL SELECT start, key, 2 FROM h2 WHERE key <> start AND (start, key) NOT IN (SELECT start, key FROM h1)"""
)
def neighbors_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two hops of each region in the graph of customers, nations and regions."""
    e = _nation_edges(spark, sf_dir)
    start = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"))
    return tidy(R.neighbours(e, start, 2))


@query("WITH " + _NATION_EDGES + " SELECT a AS src, b AS dst FROM ne WHERE b IN ('n1', 'n2', 'r1') AND (a LIKE 'c%' OR a IN ('n1', 'n2'))")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among two nations, a region and all customers."""
    e = _nation_edges(spark, sf_dir)
    keys = e.select(F.col("src").alias("key")).where("key like 'c%'").unionByName(spark.createDataFrame([("n1",), ("n2",), ("r1",)], "key string")).distinct()
    return R.subgraph(keys, e, keys)[1].select("src", "dst")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    old = d.where("doc_id % 7 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("sha", F.lit("x")), 256)).otherwise(F.col("sha")))
    return old, d.where("doc_id % 11 <> 0")


_STATUS = "CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END"


@query(f"SELECT doc_id, {_STATUS} AS status FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an older state of them: every seventh is new, every fifth changed, every eleventh gone."""
    return G.diff(*_versions(spark, sf_dir), "doc_id", "sha")


@query(
    f"WITH s AS (SELECT {_STATUS} AS status, strlen(text) AS size FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0) "
    "SELECT count(CASE WHEN status = 'added' THEN 1 END) AS added, count(CASE WHEN status = 'changed' THEN 1 END) AS changed, count(CASE WHEN status = 'removed' THEN 1 END) AS removed, "
    "count(CASE WHEN status = 'unchanged' THEN 1 END) AS unchanged, CAST(sum(CASE WHEN status IN ('added', 'changed') THEN size ELSE 0 END) AS BIGINT) AS download_bytes FROM s"
)
def bundle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bundle_update(G.diff(*_versions(spark, sf_dir), "doc_id", "sha", "size"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 11 = 0 THEN 'listed file missing' WHEN doc_id % 7 = 0 THEN 'unlisted file' ELSE 'checksum mismatch' END AS problem FROM documents WHERE (doc_id % 7 <> 0 OR doc_id % 11 <> 0) AND (doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0)")
def bundle_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, listing = (v.select(F.col("doc_id").cast("string").alias("path"), F.col("sha").alias("sha256"), "size") for v in _versions(spark, sf_dir))
    return G.verify_files(manifest, listing)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A promotion history: each order is a version of its customer's model, and is staged and released in turn."""
    o = load(spark, sf_dir, "orders")
    stages = F.posexplode(F.array(*[F.lit(s) for s in ("candidate", "staging", "production")])).alias("i", "to")
    named = o.select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("version"), "o_orderkey", stages)
    return named.select("name", "version", "to", (F.col("o_orderkey") * 3 + F.col("i")).alias("seq"))


@query(
    """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderkey FROM orders)
SELECT name, CAST(o_orderkey AS VARCHAR) AS version, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY name) THEN 'production' ELSE 'retired' END AS stage FROM o
"""
)
def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version's stage after the history: the last of a name is in production, the others were retired by it."""
    return G.current_stage(G.registry_log(_requests(spark, sf_dir))).select("name", "version", "stage")


#: How many order keys after its own an order's model asks to be retired: before or after its successor is released.
_RETIRE_AFTER = 3000


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history with requests that are early, repeated, unknown, or come when the next version has retired theirs already."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("k"))
    k = F.col("k")
    asked = [("candidate", 0, k % 13 > 0), ("staging", 1, k % 3 > 0), ("staging", 2, k % 4 == 0), ("production", 3, k % 5 > 0), ("archived", 4, k % 7 == 0), ("candidate", 5, k % 6 == 0), ("retired", _RETIRE_AFTER * 10 + 6, k % 2 == 0)]
    moves = F.filter(F.array(*[F.when(on, F.struct(F.lit(to).alias("to"), (k * 10 + at).alias("seq"))) for to, at, on in asked]), lambda m: m.isNotNull())
    return o.select("name", k.cast("string").alias("version"), F.explode(moves).alias("m")).select("name", "version", "m.to", "m.seq")


_HISTORY = f"""
RECURSIVE asked AS (
  SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(o_orderkey AS VARCHAR) AS version, m.t AS "to", o_orderkey * 10 + m.at AS seq
  FROM (SELECT o_custkey, o_orderkey, unnest(list_filter([
    CASE WHEN o_orderkey % 13 > 0 THEN {{'t': 'candidate', 'at': 0}} END, CASE WHEN o_orderkey % 3 > 0 THEN {{'t': 'staging', 'at': 1}} END, CASE WHEN o_orderkey % 4 = 0 THEN {{'t': 'staging', 'at': 2}} END,
    CASE WHEN o_orderkey % 5 > 0 THEN {{'t': 'production', 'at': 3}} END, CASE WHEN o_orderkey % 7 = 0 THEN {{'t': 'archived', 'at': 4}} END, CASE WHEN o_orderkey % 6 = 0 THEN {{'t': 'candidate', 'at': 5}} END,
    CASE WHEN o_orderkey % 2 = 0 THEN {{'t': 'retired', 'at': {_RETIRE_AFTER * 10 + 6}}} END], lambda x: x IS NOT NULL)) AS m FROM orders)),
turn AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS k FROM asked),
-- The stages of all versions of a name, one request after another.
state AS (
  SELECT DISTINCT name, 0::BIGINT AS k, version, NULL::VARCHAR AS stage, NULL::VARCHAR AS was, NULL::BIGINT AS seq FROM asked
  UNION ALL
  SELECT name, k, version,
    CASE WHEN ok AND version = asking THEN t WHEN ok AND t = 'production' AND stage = 'production' THEN 'retired' ELSE stage END, stage, seq
  FROM (SELECT *, max(CASE WHEN version = asking AND ((stage IS NULL AND t = 'candidate') OR (stage = 'candidate' AND t IN ('staging', 'retired')) OR (stage = 'staging' AND t IN ('production', 'retired')) OR (stage = 'production' AND t = 'retired')) THEN 1 ELSE 0 END) OVER (PARTITION BY name) = 1 AS ok
        FROM (SELECT s.name, q.k, s.version, s.stage, q.version AS asking, q."to" AS t, q.seq FROM state s JOIN turn q ON q.name = s.name AND q.k = s.k + 1))),
"""


@query(
    "WITH "
    + _HISTORY
    + """
decided AS (SELECT q.*, s.was, s.stage FROM turn q JOIN state s ON s.name = q.name AND s.k = q.k AND s.version = q.version)
SELECT name, version, "to", seq, CASE WHEN stage = "to" AND stage IS DISTINCT FROM was THEN NULL WHEN "to" = 'archived' THEN 'unknown' WHEN was IS NULL THEN 'not allowed' WHEN was = 'retired' THEN 'terminal' WHEN was = "to" THEN 'same' ELSE 'not allowed' END AS problem FROM decided"""
)
def registry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request of the history with why it was refused; the SQL replays it request by request."""
    return G.audit(_history(spark, sf_dir)).select("name", "version", "to", "seq", "problem")


@query(
    "WITH "
    + _HISTORY
    + """
moved AS (SELECT s.name, s.version, s.seq, s.was AS "from", s.stage AS "to", CASE WHEN s.version <> q.version THEN 'replaced by ' || q.version END AS reason FROM state s JOIN turn q ON q.name = s.name AND q.k = s.k WHERE s.stage IS DISTINCT FROM s.was)
SELECT * FROM moved"""
)
def registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of the history: what was followed, and the retirements that releases brought."""
    return G.registry_log(_history(spark, sf_dir))


@query("SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(o_orderkey AS VARCHAR) AS version, row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)) - 1 AS rank FROM orders")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, newest first."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("version"), epoch(F.col("o_orderdate")).alias("created_at"))
    return G.newest_first(o).select("name", "version", "rank")


@query(
    "SELECT page_id, kind, CASE kind WHEN 'network' THEN CASE WHEN page_id % 3 = 0 THEN 'offline only' WHEN host = 'example.org' OR ends_with(host, '.example.org') OR host = 'm.therou.example.com' THEN NULL ELSE 'host not allowed' END "
    "WHEN 'cloud_fallback' THEN CASE WHEN page_id % 3 = 0 THEN 'offline only' WHEN page_id % 2 = 0 THEN NULL ELSE 'fallback is not cloud' END ELSE CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'audio is not kept' END END AS refused "
    "FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(['network', 'cloud_fallback', 'store_audio']) AS kind FROM pages)"
)
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of edge devices, one of each kind a page, under policies that vary with the page."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.explode(F.array(*[F.lit(k) for k in ("network", "cloud_fallback", "store_audio")])).alias("kind"))
    allowed = F.array(F.lit("*.example.org"), F.lit("example.org"), F.lit("m.therou.example.com"))
    refused = G.policy_decision(F.col("kind"), F.col("host"), F.col("page_id") % 3 == 0, allowed, F.when(F.col("page_id") % 2 == 0, "cloud").otherwise("degrade"), F.when(F.col("page_id") % 5 == 0, "local").otherwise("none"))
    return p.select("page_id", "kind", refused.alias("refused"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS name, arg_max(CAST(n_nationkey AS VARCHAR), n_nationkey) AS version, CAST(max(n_nationkey) AS DOUBLE) AS created_at FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def latest_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest nation of each region among those in a stage."""
    n = load(spark, sf_dir, "nation")
    a = n.select(F.col("n_regionkey").cast("string").alias("name"), F.col("n_nationkey").cast("string").alias("version"), F.when(F.col("n_nationkey") % 2 == 0, "production").otherwise("staging").alias("stage"), F.col("n_nationkey").cast("double").alias("created_at"))
    return G.latest_by_stage(a, "production")
