"""Queries of readers, writers, streams and the smaller row operators: what is written, read again and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import speech as V
from ..functions import text as X
from ..functions import udfs as U
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import features as O
from ..operators import registry as G
from ..operators import retrieval as R
from ..operators import trace as T
from ..operators.positions import zip_rows
from ..session import scratch_path
from ..sources import bundle as B
from ..sources import files as S
from ..sources.events import read_events
from ..sources.replay import replay
from ..streaming import sessions as L
from ..streaming.tables import OnlineTable, trace_sink
from . import features as _features_first  # noqa: F401  (its SQL is used here)
from .catalog import ORACLE, query, tidy
from .tables import TRACE_SQL, events, load, trace

_TURNS = "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations"


@query(_TURNS)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as JSON lines, appended in two parts, and read with a schema."""
    path = scratch_path(spark, "jsonl")
    c = load(spark, sf_dir, "conversations")
    S.write_jsonl(c.where("turn % 2 = 0"), path)
    S.write_jsonl(c.where("turn % 2 <> 0"), path, "append")
    rows = S.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE turn % 3 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'not an object' ELSE 'none' END AS problem FROM conversations) GROUP BY problem")
def jsonl_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of good, cut and non-object lines: every bad line is reported, none stops the scan."""
    path = scratch_path(spark, "lines")
    good = F.to_json(F.struct("conv_id", "turn"))
    bad = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('{"conv_id": '), F.col("conv_id"))).when(F.col("turn") % 3 == 2, F.concat(F.lit("["), F.col("turn"), F.lit("]")))
    load(spark, sf_dir, "conversations").select(F.coalesce(bad, good).alias("value")).write.text(path)
    found = S.read_jsonl_checked(spark, path, "conv_id long, turn long")
    return found.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("WITH" + TRACE_SQL + "SELECT seq AS event_id, session, turn, event, round(ts, 6) AS ts, round(response_ms, 6) AS response_ms, intent FROM trace")
def trace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows as JSON lines with a payload, read with the payload's fields as columns."""
    path = scratch_path(spark, "trace")
    t = trace(spark, sf_dir)
    payload = F.to_json(F.struct("response_ms", "intent", "accent", "error"))
    S.write_jsonl(t.select("ts", "session", F.col("turn").cast("int").alias("turn"), "event", F.col("_seq").cast("int").alias("seq"), "ms", payload.alias("payload")), path)
    return tidy(S.read_trace(spark, path).withColumnRenamed("seq", "event_id"), "event_id", "session", "turn", "event", "ts", "response_ms", "intent")


_FEATURES = "SELECT CAST(user_id AS VARCHAR) AS entity_id, round(epoch(ts), 6) AS event_ts, round(value, 6) AS value, event_type AS kind FROM events WHERE epoch(ts) BETWEEN 1704499200 AND 1705363200"
_VIEW = O.view("user", 86400, ("value", "float"), ("kind", "str"))


def _features(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    path = scratch_path(spark, f"features-{fmt}")
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("entity_id"), F.col("sec").alias("event_ts"), "value", F.col("event_type").alias("kind"))
    for half in (0, 1):
        S.append_features(rows.where(F.pmod("event_ts", F.lit(2)).cast("int") == half), path, _VIEW, fmt)
    return tidy(S.read_features(spark, path, _VIEW, 1704499200, 1705363200, fmt))


@query(_FEATURES)
def feature_files_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features appended twice as Parquet, a closed time range read back."""
    return _features(spark, sf_dir, "parquet")


@query(_FEATURES)
def feature_files_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "json")


@query("SELECT round(value, 6) AS value, count(*) AS n FROM events GROUP BY 1")
def number_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers between white space, several a line."""
    path = scratch_path(spark, "numbers")
    e = load(spark, sf_dir, "events")
    e.groupBy("user_id").agg(F.concat_ws("  ", F.collect_list(F.col("value").cast("string"))).alias("value")).select("value").write.text(path)
    return tidy(S.read_numbers(spark, path).groupBy(F.round("value", 6).alias("value")).agg(F.count("*").alias("n")))


@query("SELECT n_name AS name, sha256(n_name || chr(10) || n_nationkey || chr(10)) AS sha, CAST(2 AS BIGINT) AS lines FROM nation")
def text_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files, read as documents with hash, size and lines."""
    path = scratch_path(spark, "folder")
    n = load(spark, sf_dir, "nation")
    n.select("n_name", F.concat_ws("\n", "n_name", F.col("n_nationkey").cast("string")).alias("value")).write.partitionBy("n_name").text(path)
    return tidy(S.read_texts(spark, path, "*.txt").select(F.regexp_extract("id", "n_name=([^/]*)/", 1).alias("name"), "sha", "lines"))


@query("SELECT 'nation' AS name, CAST(25 AS BIGINT) AS rows UNION ALL SELECT 'region', 5")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables saved as an index and loaded by its manifest."""
    path = scratch_path(spark, "index")
    S.save_index({n: load(spark, sf_dir, n) for n in ("nation", "region")}, path, 64)
    out = None
    for name, df in S.load_index(spark, path, 64).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id")
def online_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches of events upserted into a keyed table, the second one twice; the latest of each key is there."""
    e = load(spark, sf_dir, "events").select("user_id", "value", F.struct("ts", "event_id").alias("at"))
    table = OnlineTable(spark, scratch_path(spark, "online"), "user_id", e.schema)
    day = F.dayofmonth("at.ts")
    for i, part in ((0, day <= 10), (1, (day > 10) & (day <= 20)), (1, day <= 10), (2, day > 20)):
        table.upsert(e.where(part), i, "at")
    return tidy(table.rows().select("user_id", "value"))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, streamed from this library's own source in batches of a tenth of the files' bytes."""
    path = scratch_path(spark, "events")
    load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").repartition(4).write.json(f"{path}/in")
    size = spark.read.format("binaryFile").load(f"{path}/in").agg(F.sum("length").alias("n")).first().n
    stream = read_events(spark, f"{path}/in", "event_id long, user_id long, event_type string, value double", streaming=True, per_batch=max(1, size // 10))
    return tidy(_drained(stream, path, offsets=False))


@query(f"WITH {TRACE_SQL} SELECT regexp_replace(event, '\\.end$', '') AS name, session, turn, seq, round(coalesce(ms, 0), 6) AS ms, 'None' AS span FROM trace WHERE event LIKE '%.end'")
def trace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace streamed to a sink in four batches, the last of which is written again: the exporter's form of its end rows."""
    path = scratch_path(spark, "sink")
    rows = trace(spark, sf_dir).select("session", "turn", "event", F.col("_seq").alias("seq"), "ms", F.lit(None).cast("string").alias("span"))
    sink = trace_sink(f"{path}/out", exporter=True)
    # Each batch is written twice, as after a failure between the sink's commit and the stream's.
    stream = replay(spark, rows, ["seq"], 4, path)
    q = stream.writeStream.foreachBatch(lambda batch, i: (sink(batch, i), sink(batch, i)) and None).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination(1800)
    q.stop()
    return tidy(spark.read.schema("name string, session string, turn long, seq long, ms double, span string").json(f"{path}/out").drop("batch"))


@query("SELECT CAST(doc_id // 100 AS VARCHAR) || '/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of every document as a file, copied and hashed by the executors; its manifest."""
    path = scratch_path(spark, "bundle-files")
    _document_files(spark, sf_dir, f"{path}/source").write.format("noop").mode("overwrite").save()
    return B.write_bundle(spark, f"{path}/source", f"{path}/bundle", {"name": "documents", "version": "1"})


def _document_files(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    name = F.concat(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return B.write_files(d.select(name.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), root)


@query("SELECT CAST(doc_id // 100 AS VARCHAR) || '/' || doc_id || '.txt' AS path, unnest(CASE WHEN doc_id % 50 = 0 THEN ['checksum mismatch', 'size mismatch'] ELSE ['checksum mismatch'] END) AS problem FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'extra.bin', 'unlisted file'")
def bundle_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished bundle of every document is whole; then every tenth file is damaged, every fiftieth in size too, and one is added."""
    path = scratch_path(spark, "bundle-damage")
    _document_files(spark, sf_dir, f"{path}/source").write.format("noop").mode("overwrite").save()
    files = B.write_bundle(spark, f"{path}/source", f"{path}/bundle", {"name": "documents", "version": "1"})
    whole = B.verify_bundle(spark, f"{path}/bundle")
    before = whole.count()
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    bad = F.concat(F.repeat(F.lit("\u0000"), F.col("size").cast("int")), F.when(number % 50 == 0, "x").otherwise(""))
    damaged = files.where(number % 10 == 0).select("path", bad.cast("binary").alias("content"))
    extra = spark.range(1).select(F.lit("extra.bin").alias("path"), F.lit("x").cast("binary").alias("content"))
    B.write_files(damaged.unionByName(extra), f"{path}/bundle/files").write.format("noop").mode("overwrite").save()
    found = B.verify_bundle(spark, f"{path}/bundle")
    return found if not before else found.withColumn("problem", F.lit("not whole before"))


@query(
    """
WITH g AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us, count(*) AS events FROM r GROUP BY session, run
"""
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap of twelve hours."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    s = L.idle_sessions(e, "ts", idle="12 hours")
    return s.select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


def _drained(stream: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """The rows that a stream appends until its input ends; without ``offsets`` that a trigger may plan ahead, until it is idle.

    It is waited for as long as it takes: one that is stopped before has written a part of its rows, which looks like all of them.
    """
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state")
    q = (writer.trigger(availableNow=True) if offsets else writer).start(f"{path}/out")
    try:
        if offsets:
            q.awaitTermination()
        else:
            q.processAllAvailable()
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


_TRACE_COLUMNS = ("session", "event", "ts", "ms", "response_ms", "intent", "accent", "_seq")


@query(ORACLE["session_features_running"])
def session_features_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful fold over a stream of the events, in four micro-batches; the same rows as the batch operator."""
    path, own = scratch_path(spark, "stream"), L.stateful(spark)
    rows = replay(own, trace(spark, sf_dir).select(*_TRACE_COLUMNS), ["_seq"], 4, path)
    out = _drained(L.stream_session_features(rows, idle_ms=None), path)
    return tidy(spark.read.schema(out.schema).parquet(f"{path}/out"), digits=9).withColumn("event_ts", F.round("event_ts", 6))


#: Hours without news after which a session of the expiry query is over.
_IDLE_H = 12


@query(
    f"""
WITH {TRACE_SQL},
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY seq) <= {_IDLE_H * 3600} THEN 0 ELSE 1 END AS fresh FROM trace),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM g),
w AS (SELECT session, run, seq, event, max(ts) OVER o AS event_ts, count(CASE WHEN event = 'turn.end' THEN 1 END) OVER o AS turn_count,
  avg(CASE WHEN event = 'listen.end' THEN ms END) OVER o / 1000 AS avg_user_utterance_s, avg(CASE WHEN event = 'playback.end' THEN response_ms END) OVER o AS avg_response_ms,
  last_value(CASE WHEN event = 'llm.end' THEN intent END IGNORE NULLS) OVER o AS last_intent, last_value(CASE WHEN event = 'stt.end' THEN accent END IGNORE NULLS) OVER o AS accent_profile
  FROM r WINDOW o AS (PARTITION BY session, run ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT session, round(event_ts, 6) AS event_ts, turn_count, round(avg_user_utterance_s, 9) AS avg_user_utterance_s, round(avg_response_ms, 9) AS avg_response_ms, last_intent, accent_profile FROM w WHERE event = 'turn.end'
"""
)
def session_expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session features by event time, in six micro-batches: sessions expire, and rows that come days late are dropped.

    The last two batches bring the first batch's rows again, with other values; the SQL knows nothing of these.
    """
    path, own = scratch_path(spark, "expiry"), L.stateful(spark)
    rows = trace(spark, sf_dir).select(*_TRACE_COLUMNS)
    n = rows.count()
    late = rows.where(F.col("_seq") < n // 10).withColumns({"ms": F.lit(9e9).cast("double"), "response_ms": F.lit(9e9).cast("double"), "event": F.lit("turn.end")})
    both = rows.withColumn("place", F.col("_seq").cast("double")).unionByName(late.withColumn("place", F.lit(0.9 * n) + F.col("_seq") / 10))
    stream = L.stream_session_features(replay(own, both, ["place", "event"], 6, path).drop("place"), idle_ms=_IDLE_H * 3_600_000, late="1 hour")
    out = _drained(stream, path)
    return tidy(spark.read.schema(out.schema).parquet(f"{path}/out"), digits=9).withColumn("event_ts", F.round("event_ts", 6))


def _reply_tokens(replies: DataFrame) -> DataFrame:
    """The words of replies (conv_id, turn, text) as tokens; two of three replies have a last one."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    # What stands beside an explode in one select is worked out for each of its rows: the words are split before.
    c = replies.select(F.col("conv_id").cast("string").alias("session"), "turn", (F.col("conv_id") * 1000 + F.col("turn") * 10 + 1000).cast("double").alias("ts"), ((F.col("conv_id") * 7 + F.col("turn")) % 3 > 0).alias("ends"), F.size(words).alias("n"), words.alias("words"))
    t = c.select("session", "turn", "ts", "ends", "n", F.posexplode("words").alias("_seq", "w"))
    return t.select("session", "turn", "_seq", F.concat("w", F.lit(" ")).alias("token"), ((F.col("_seq") == F.col("n") - 1) & F.col("ends")).alias("last"), "ts")


@query(
    r"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM conversations WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS session, turn, array_to_string(ws, ' ') AS reply FROM t WHERE len(ws) > 0
"""
)
def segments_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as token streams in five micro-batches; every third one stops without its last token and is flushed when idle.

    The sentences of each reply, put together again, are its words.
    """
    path, own = scratch_path(spark, "tokens"), L.stateful(spark)
    t = _reply_tokens(load(spark, sf_dir, "conversations").where("role = 'assistant'"))
    # A session long after all others takes the watermark past the idle replies.
    end = spark.range(1).select(F.lit("~").alias("session"), F.lit(0).cast("bigint").alias("turn"), F.lit(0).alias("_seq"), F.lit("").alias("token"), F.lit(True).alias("last"), F.lit(1e9).alias("ts"))
    stream = L.stream_segments(replay(own, t.unionByName(end), ["ts", "session", "turn", "_seq"], 5, path), idle_ms=60_000, late="10 seconds")
    out = _drained(stream, path)
    rows = spark.read.schema(out.schema).parquet(f"{path}/out")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda r: r["sentence"])
    return rows.groupBy("session", "turn").agg(F.array_join(ordered, " ").alias("reply"))


@query("SELECT conv_id || '-' || turn AS id, md5(text) AS text_md5, CAST(conv_id AS VARCHAR) AS session, CAST(turn AS VARCHAR) AS turn FROM conversations WHERE role = 'user'")
def session_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions with an array of turns, one row an utterance of the user."""
    c = load(spark, sf_dir, "conversations").where("role = 'user'")
    user = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.create_map().cast("map<string,string>").alias("meta"))
    sessions = c.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct("turn", user.alias("user"), F.lit(None).cast("string").alias("assistant_text"))).alias("turns"))
    flat = C.flatten_sessions(sessions)
    return flat.select("id", F.md5("text").alias("text_md5"), F.col("meta")["session"].alias("session"), F.col("meta")["turn"].alias("turn"))


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("speaker"), F.create_map(F.lit("category"), F.col("lang")).alias("meta"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'en' AS category FROM documents WHERE lang = 'en'")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_category(_utterances(spark, sf_dir), "en").select("id", F.col("meta")["category"].alias("category"))


@query("SELECT coalesce(lang, 'uncategorised') AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.category_counts(_utterances(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(nullif(source, ''), CAST(doc_id AS VARCHAR)) AS group_key FROM documents")
def split_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _utterances(spark, sf_dir)
    return u.select("id", X.utterance_group_key(F.col("meta"), F.col("speaker"), F.col("id")).alias("group_key"))


@query("SELECT doc_id, 'doc-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS id FROM documents")
def default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without ids are numbered in their order."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("id"))
    return C.default_ids(d, "doc", "doc_id")


@query(
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS at, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT a.doc_id, b.doc_id AS other_id, a.text = b.text AS same, a.at - 1 AS at FROM d a JOIN d b ON a.at = b.place
"""
)
def zip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in order of ids beside texts in order of length, matched place by place."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    other = d.select(F.col("doc_id").alias("other_id"), (-F.col("n_chars")).alias("shorter"), F.col("text").alias("other"))
    both = zip_rows(d, other, ["doc_id"], ["shorter", "other_id"])
    return both.select("doc_id", "other_id", (F.col("text") == F.col("other")).alias("same"), "at")


@query(
    """
SELECT 'documents' AS other, count(*) AS zipped FROM documents
UNION ALL SELECT 'orders', CASE WHEN (SELECT count(*) FROM documents) = (SELECT count(*) FROM orders) THEN (SELECT count(*) FROM orders) END
"""
)
def zip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents zipped with a table of the same length; null for one of another length, which is refused."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    out = zip_rows(d, d.toDF("other_id"), ["doc_id"], ["other_id"]).agg(F.count("*").alias("zipped")).select(F.lit("documents").alias("other"), "zipped")
    try:
        unequal = zip_rows(d, load(spark, sf_dir, "orders").select("o_orderkey"), ["doc_id"], ["o_orderkey"]).agg(F.count("*").alias("zipped"))
    except ValueError:
        unequal = spark.range(1).select(F.lit(None).cast("bigint").alias("zipped"))
    return out.unionByName(unequal.select(F.lit("orders").alias("other"), "zipped"))


@query(
    """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'prompt' WHEN doc_id % 5 = 0 THEN 'chosen' WHEN doc_id % 3 = 0 THEN 'chosen equals rejected' ELSE 'none' END AS problem FROM documents) GROUP BY problem"""
)
def pair_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    at = lambda n: F.col("doc_id") % n == 0
    other = F.when(at(3), F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.lit("other"))
    pairs = d.select(F.when(~at(7), "p").alias("prompt"), F.when(at(5), "").otherwise(F.concat(F.lit("x"), F.col("doc_id"))).alias("chosen"), other.alias("rejected"))
    return C.validate_pairs(pairs).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'audio_path,text' WHEN doc_id % 2 = 0 THEN 'audio_path' WHEN doc_id % 5 = 0 THEN 'text' ELSE 'none' END AS problem FROM documents) GROUP BY problem")
def audio_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.col("doc_id") % n == 0
    rows = load(spark, sf_dir, "documents").select(F.when(~at(2), "a.wav").alias("audio_path"), F.when(at(5), "").otherwise("t").alias("text"))
    return C.validate_audio(rows).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def audio_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose file is not in a folder's listing."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat("doc_id", F.lit(".wav")).alias("audio_path"))
    return C.missing_audio(d, d.where("doc_id % 3 = 0").select(F.col("audio_path").alias("path"))).select("doc_id")


_N = "CAST(len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) AS BIGINT)"


@query(f"SELECT conv_id, turn, {_N.format(t='text')} AS chosen_words, {_N.format(t='role')} AS rejected_words FROM conversations")
def preference_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("prompt"), F.col("text").alias("chosen"), F.col("role").alias("rejected"))
    p = C.preference_rows(c)
    return tidy(p.select(F.split("prompt", "-")[0].cast("long").alias("conv_id"), F.split("prompt", "-")[1].cast("long").alias("turn"), "chosen_words", "rejected_words"))


@query(
    """
WITH p AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Score: ' || (item_id % 10) WHEN 1 THEN (item_id % 100 + 1) || ' of 100' WHEN 2 THEN '0.' || (item_id % 9 + 1) ELSE 'no number' END AS reply FROM benchmark),
v AS (SELECT item_id, TRY_CAST(nullif(regexp_extract(reply, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS x FROM p)
SELECT item_id, round(coalesce(least(greatest(CASE WHEN x > 10 THEN x / 100 WHEN x > 1 THEN x / 10 ELSE x END, 0), 1), 0), 6) AS score FROM v
"""
)
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from replies of several forms."""
    i = F.col("item_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit("Score: "), i % 10)).when(i % 4 == 1, F.concat(i % 100 + 1, F.lit(" of 100"))).when(i % 4 == 2, F.concat(F.lit("0."), i % 9 + 1)).otherwise("no number")
    return tidy(load(spark, sf_dir, "benchmark").select("item_id", X.parse_score(reply).alias("score")))


@query(
    r"""
SELECT conv_id, turn, round(((bare <> '')::INT + (CASE WHEN bare = '' THEN 0 ELSE greatest(len(regexp_extract_all(bare, '[.!?]+(\s|$)')), 1) END <= 3)::INT
 + (NOT regexp_matches(text, '(?i)https?://\S+|www\.\S+'))::INT + (NOT contains(lower(text), 'the'))::INT + (NOT contains(lower(text), 'en'))::INT) / 5.0::DOUBLE, 6) AS score
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations)
"""
)
def rubric_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forbidden phrases are two checks; markdown is allowed here."""
    score = X.rubric_score(F.col("text"), phrases=("The", "en"), forbid_markdown=False)
    return tidy(load(spark, sf_dir, "conversations").select("conv_id", "turn", score.alias("score")))


@query("SELECT p_partkey, contains(lower(p_type), 'steel') AS found FROM part")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", X.contains_words(F.col("p_type"), F.lit("Steel")).alias("found"))


@query("SELECT user_id, CAST(count(*) AS VARCHAR) AS events, 'x' AS view FROM events GROUP BY user_id")
def lineage_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage and metrics as a flat map of texts."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    tags = e.select("user_id", G.to_tags(F.create_map(F.lit("events"), F.col("n")), "run", view=F.lit("x")).alias("t"))
    return tags.select("user_id", F.col("t")["metric.events"].alias("events"), F.col("t")["run.view"].alias("view"))


@query("SELECT user_id, count(*)::DOUBLE AS events FROM events GROUP BY user_id")
def metrics_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    back = G.metrics_from_tags(G.to_tags(F.create_map(F.lit("events"), F.col("n")), "run", view=F.lit("x")))
    return e.select("user_id", back["events"].alias("events"))


@query(
    """
SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey % 4 = 3 THEN 'unknown fallback' END, CASE WHEN c_acctbal <= 0 THEN 'max_ttfa_ms must be positive' END,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'offline with allowed hosts' END, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 4 = 1 THEN 'offline with cloud fallback' END) AS problems FROM customer
"""
)
def policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    kind = F.col("c_nationkey") % 4
    fallback = F.when(kind == 0, "degrade").when(kind == 1, "cloud").when(kind == 2, "refuse").otherwise("other")
    allowed = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a.example"))).otherwise(F.array().cast("array<string>"))
    return c.select("c_custkey", F.array_join(G.policy_problems(F.col("c_custkey") % 2 == 0, allowed, fallback, F.col("c_acctbal")), ",").alias("problems"))


@query("SELECT n_name AS name, 'nation.key' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_name, 'nation.region', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT n_name, 'kind', '\"n\"' FROM nation")
def manifest_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested manifests as dotted keys."""
    n = load(spark, sf_dir, "nation")
    m = F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region")).alias("nation"), F.lit("n").alias("kind")))
    return n.select(F.col("n_name").alias("name"), F.explode(U.flatten_json(m)).alias("key", "value"))


@query("SELECT event_type AS model, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def jsonl_bounded_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by one writer and read as an event source in memory, whole."""
    e = load(spark, sf_dir, "events").select("event_type", "value")
    path = scratch_path(spark, "events")
    S.write_jsonl(e, path)
    rows = S.read_jsonl(spark, path, "event_type string, value double")
    return tidy(rows.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))


@query("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_nationkey")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one key: the first in order stays."""
    return tidy(C.keep_first(load(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", "n_name")


@query("SELECT CAST(item_id AS VARCHAR) AS item, CAST(first_at AS BIGINT) AS rank FROM (SELECT item_id, row_number() OVER (ORDER BY min(k), item_id) AS first_at FROM (SELECT item_id, item_id % 7 AS k FROM benchmark UNION ALL SELECT item_id, item_id % 5 FROM benchmark) GROUP BY item_id)")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of two rankings, each once, in the order of their first place."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"))
    both = b.withColumn("k", F.col("item") % 7).unionByName(b.withColumn("k", F.col("item") % 5))
    return tidy(C.ordered_distinct(both, "item", "k").select(F.col("item").cast("string").alias("item"), "rank"))


@query("SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes counted by label."""
    a = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.lit("Nation").alias("label"))
    return R.label_counts(a.unionByName(load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit("Region").alias("label"))))


@query("SELECT conv_id, turn, md5('q:' || conv_id) AS prompt_md5 FROM conversations WHERE role = 'user'")
def template_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template in place of a language model: prompts with the row's own fields."""
    c = load(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.md5(X.template("q:{conv_id}", conv_id=F.col("conv_id"))).alias("prompt_md5"))


@query(
    """
SELECT 'events_total' || '{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type
UNION ALL SELECT '# HELP events_total Events by type' UNION ALL SELECT '# TYPE events_total counter'
"""
)
def prom_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter in the text format, with its help and type lines."""
    e = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("value"))
    return T.exposition_values(e, "events_total", ("type",), "counter", "Events by type").select("line")


@query("SELECT c_mktsegment AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.create_map(F.lit("category"), F.col("c_mktsegment")).alias("meta"))
    n = C.category_counts(c)
    return tidy(n.withColumn("share", 100.0 * F.col("n") / n.agg(F.sum("n")).scalar()))


@query(
    """
WITH p AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'whisper-lora' WHEN 1 THEN 'sft' WHEN 2 THEN 'dpo' ELSE 'other' END AS kind, CASE WHEN c_custkey % 5 > 0 THEN 'm' ELSE ' ' END AS base_model,
  CASE WHEN c_custkey % 7 > 0 THEN 't' END AS train, 'out' AS output_dir, CAST(floor(c_acctbal) AS BIGINT) AS seed, c_nationkey % 3 AS epochs, c_custkey % 4 AS batch, c_acctbal / 10000 AS beta FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN kind = 'other' THEN 'kind' END, CASE WHEN trim(base_model) = '' THEN 'base_model' END, CASE WHEN train IS NULL THEN 'train' END,
  CASE WHEN seed < 0 THEN 'seed' END, CASE WHEN epochs <= 0 THEN 'epochs' END, CASE WHEN batch < 1 THEN 'per_device_batch_size' END, CASE WHEN kind = 'dpo' AND beta <= 0 THEN 'beta' END) AS problems FROM p
"""
)
def training_plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each training plan of a table from starting."""
    c = load(spark, sf_dir, "customer")
    kind = F.element_at(F.array(*map(F.lit, (*E.PLAN_KINDS, "other"))), F.col("c_nationkey") % 4 + 1)
    plans = c.select(
        "c_custkey", kind.alias("kind"), F.when(F.col("c_custkey") % 5 > 0, "m").otherwise(" ").alias("base_model"), F.when(F.col("c_custkey") % 7 > 0, "t").alias("train"), F.lit("out").alias("output_dir"),
        F.floor("c_acctbal").alias("seed"), (F.col("c_nationkey") % 3).alias("epochs"), (F.col("c_custkey") % 4).alias("per_device_batch_size"), (F.col("c_acctbal") / 10000).alias("beta"),
    )
    return plans.select("c_custkey", F.array_join(E.plan_problems(plans.columns), ",").alias("problems"))


@query(
    """
WITH e AS (SELECT user_id, event_id, value, epoch(ts) AS sec FROM events)
SELECT user_id, event_id, count(*) OVER w AS n_7d, round(avg(value) OVER w, 6) AS mean_7d, round(quantile_cont(value, 0.95) OVER d, 6) AS p95_24h FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)
"""
)
def trailing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's aggregates of the seven days and the day that end with it."""
    e = events(spark, sf_dir).select("user_id", "event_id", "value", "sec")
    week, day = O.trailing("user_id", "sec", 604800), O.trailing("user_id", "sec", 86400)
    return tidy(e.select("user_id", "event_id", F.count("*").over(week).alias("n_7d"), F.avg("value").over(week).alias("mean_7d"), F.percentile("value", 0.95).over(day).alias("p95_24h")))


_SPEAKER = """
sp AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, epoch(ts) AS event_ts, event_id, (event_type = 'error')::INT AS errors, 1 + event_id % 3 AS n_ref, event_type <> 'error' AS exact, (event_type = 'signup')::INT AS fixed FROM events),
spf AS (SELECT entity_id, event_ts, sum(errors) OVER w / sum(n_ref) OVER w AS wer_7d, avg(exact::INT) OVER w AS exact_match_rate_7d, CAST(sum(fixed) OVER w AS BIGINT) AS wake_word_corrections_7d FROM sp
  WINDOW w AS (PARTITION BY entity_id ORDER BY event_ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW))
"""
_DEVICE = """
dv AS (SELECT CAST(user_id % 40 AS VARCHAR) AS entity_id, epoch(ts) AS event_ts, CASE WHEN event_type = 'signup' THEN '1.' || event_id END AS version, CASE WHEN event_type = 'error' THEN value END AS ttfa FROM events),
dvf AS (SELECT entity_id, event_ts, last_value(version IGNORE NULLS) OVER b AS edge_bundle_version, quantile_cont(ttfa, 0.95) OVER d AS p95_ttfa_ms_24h FROM dv
  WINDOW b AS (PARTITION BY entity_id ORDER BY event_ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY entity_id ORDER BY event_ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
"""


def _speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = events(spark, sf_dir), F.col("event_type")
    return O.speaker_features(e.select(F.col("user_id").alias("speaker"), F.col("sec").alias("event_ts"), (kind == "error").cast("int").alias("errors"), (1 + F.col("event_id") % 3).alias("n_ref"), (kind != "error").alias("exact"), (kind == "signup").cast("int").alias("corrections")))


def _device(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = events(spark, sf_dir), F.col("event_type")
    return O.device_features(e.select((F.col("user_id") % 40).alias("device"), F.col("sec").alias("event_ts"), F.when(kind == "signup", F.concat(F.lit("1."), F.col("event_id").cast("string"))).alias("bundle_version"), F.when(kind == "error", F.col("value")).alias("ttfa_ms")))


@query(f"WITH {_SPEAKER} SELECT entity_id, round(event_ts, 6) AS event_ts, round(wer_7d, 6) AS wer_7d, round(exact_match_rate_7d, 6) AS exact_match_rate_7d, wake_word_corrections_7d FROM spf")
def speaker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day quality of each speaker, as the catalogue declares it."""
    return tidy(_speaker(spark, sf_dir).select(*O.DEFAULT_VIEWS["speaker_features"].schema.names))


@query(f"WITH {_DEVICE} SELECT entity_id, round(event_ts, 6) AS event_ts, edge_bundle_version, round(p95_ttfa_ms_24h, 6) AS p95_ttfa_ms_24h FROM dvf")
def device_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-day latency and installed version of each device, as the catalogue declares it."""
    return tidy(_device(spark, sf_dir).select(*O.DEFAULT_VIEWS["device_features"].schema.names))


@query(
    f"""WITH {_SPEAKER}, {_DEVICE}, v AS (SELECT 'speaker_features' AS name, 'speaker' AS entity, 604800.0::DOUBLE AS ttl_s, entity_id, event_ts FROM spf UNION ALL SELECT 'device_features', 'device', 86400.0, entity_id, event_ts FROM dvf),
l AS (SELECT name, entity, ttl_s, entity_id, max(event_ts) AS last_ts FROM v GROUP BY ALL)
SELECT name, entity, ttl_s, count(*) AS entities, count(CASE WHEN (SELECT max(epoch(ts)) FROM events) - 43200 - last_ts <= ttl_s THEN 1 END) AS valid FROM l GROUP BY ALL"""
)
def view_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each view of the catalogue that was made: its entities, and those whose last row is valid half a day before the last event."""
    made = None
    for name, rows in (("speaker_features", _speaker(spark, sf_dir)), ("device_features", _device(spark, sf_dir))):
        last = rows.groupBy("entity_id").agg(F.max("event_ts").alias("last_ts")).withColumn("name", F.lit(name))
        made = last if made is None else made.unionByName(last)
    now = events(spark, sf_dir).agg(F.max("sec")).scalar() - 43200
    valid = F.count_if(now - F.col("last_ts") <= F.col("ttl_s"))
    return O.DEFAULT_VIEWS.table(spark).drop("ddl").join(made, "name").groupBy("name", "entity", "ttl_s").agg(F.count("*").alias("entities"), valid.alias("valid"))


_FEAST = "('device_features', 'device', 86400.0), ('session_features', 'session', 3600.0), ('speaker_features', 'speaker', 604800.0)"


@query(f"SELECT name, entity, ttl_s FROM (VALUES {_FEAST.replace('.0', '.0::DOUBLE')}) t(name, entity, ttl_s)")
def view_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.DEFAULT_VIEWS.table(spark).drop("ddl")


@query(
    """
WITH b AS (SELECT p_brand || '/' || p_partkey || '.bin' AS path, sha256(p_name) AS sha256, CAST(p_size AS BIGINT) AS size FROM part)
SELECT path, sha256, size FROM b
"""
)
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written beside a bundle and read again."""
    path = scratch_path(spark, "bundle")
    files = load(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_partkey", F.lit(".bin")).alias("path"), F.sha2("p_name", 256).alias("sha256"), F.col("p_size").cast("long").alias("size"))
    S.write_manifest(files, path)
    return S.read_manifest(spark, path)


_EXPORT = """
p AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'onnx' WHEN 1 THEN 'gguf' WHEN 2 THEN 'mlx' ELSE 'tflite' END AS target, CASE s_suppkey % 5 WHEN 0 THEN 'int8' WHEN 1 THEN 'int4' WHEN 2 THEN 'q4_k_m' WHEN 3 THEN 'none' END AS m,
  CASE WHEN s_suppkey % 3 = 0 THEN 'adapters/' || s_suppkey END AS adapter, s_suppkey % 6 <> 0 AS merged, s_name AS base, CASE WHEN s_suppkey % 7 > 0 THEN 'out/' || s_suppkey END AS out_dir FROM supplier),
q AS (SELECT *, coalesce(m, 'none') AS method FROM p),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN target = 'tflite' THEN 'unknown target' END, CASE WHEN (target, method) IN (('onnx', 'int4'), ('onnx', 'q4_k_m'), ('gguf', 'int4'), ('mlx', 'q4_k_m')) THEN 'quantization not for this target' END, CASE WHEN out_dir IS NULL THEN 'no output folder' END], lambda x: x IS NOT NULL), ',') AS problems FROM q)
"""


@query(
    "WITH "
    + _EXPORT
    + """ SELECT s_suppkey, problems, CASE WHEN problems <> '' THEN '' ELSE array_to_string(list_filter(['validate()', CASE WHEN adapter IS NOT NULL AND merged THEN 'merge_adapter(peft+transformers)' END,
CASE target WHEN 'onnx' THEN 'convert_onnx(optimum+onnx)' WHEN 'gguf' THEN 'convert_gguf(llama_cpp+gguf)' ELSE 'convert_mlx(mlx_lm)' END, CASE WHEN target = 'onnx' AND method = 'int8' THEN 'quantize_int8(onnxruntime)' WHEN target = 'gguf' AND method <> 'none' THEN 'quantize_' || method || '(llama_cpp)' END, 'write_manifest()'], lambda x: x IS NOT NULL), ' ') END AS steps,
CASE WHEN problems <> '' THEN '' ELSE CASE target WHEN 'onnx' THEN 'model.onnx config.json tokenizer.json' || CASE WHEN method = 'int8' THEN ' model-int8.onnx' ELSE '' END WHEN 'gguf' THEN 'model-f16.gguf' || CASE WHEN method <> 'none' THEN ' model-' || method || '.gguf' ELSE '' END ELSE 'weights.safetensors config.json tokenizer.json' END END AS files FROM r"""
)
def export_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' models with a plan to export each: its problems, or its steps and files."""
    k = F.col("s_suppkey")
    pick = lambda by, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % by + 1).cast("int"))
    plans = load(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("base_model"), pick(4, "onnx", "gguf", "mlx", "tflite").alias("target"), pick(5, "int8", "int4", "q4_k_m", "none", None).alias("method"),
        F.when(k % 3 == 0, F.concat(F.lit("adapters/"), k.cast("string"))).alias("adapter_path"), (k % 6 != 0).alias("merge_adapter"), F.when(k % 7 > 0, F.concat(F.lit("out/"), k.cast("string"))).alias("out_dir"),
    )
    shown = F.transform("steps", lambda s: F.concat(s["name"], F.lit("("), F.array_join(s["requires"], "+"), F.lit(")")))
    return G.export_steps(plans).select("s_suppkey", F.array_join("problems", ",").alias("problems"), F.array_join(shown, " ").alias("steps"), F.array_join("files", " ").alias("files"))


@query("SELECT doc_id, 44 + 2 * n_chars AS bytes, round(n_chars / 8000.0::DOUBLE, 6) AS duration_s FROM documents")
def wav_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silent clip as long as each document has characters, and its duration as read from the clip."""
    d = load(spark, sf_dir, "documents").select("doc_id", V.silence(F.col("n_chars"), 8000).alias("clip"))
    return d.select("doc_id", F.octet_length("clip").cast("bigint").alias("bytes"), F.round(U.wav_duration_s("clip"), 6).alias("duration_s"))


@query("SELECT role AS category, count(*) AS n, 0.0::DOUBLE AS wer, 1.0::DOUBLE AS exact FROM conversations GROUP BY role")
def stub_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns spoken and heard by stand-ins: no errors, in any category."""
    c = load(spark, sf_dir, "conversations").select(F.col("role").alias("category"), F.col("text").alias("ref"), V.heard(V.spoken(F.col("text"))).alias("hyp"))
    scored = E.align(c)
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return scored.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum(errors) / F.sum("n_ref"), 6).alias("wer"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact"))
