from pyspark.sql import functions as F

from test_features import TRACE, trace_rows
from turnstone.operators import features as O
from turnstone.operators import trace as T
from turnstone.plans.sources import _drained
from turnstone.streaming import sessions as S


def drain(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_session_features_equal_their_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame(trace_rows(), TRACE)
    for i in range(3):
        rows.where(F.col("_seq").between(6 * i, 6 * i + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    got = drain(S.stream_session_features(stream, idle_ms=None), spark, "sess", tmp_path)
    want = O.session_features(rows).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_segments_and_rates(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tokens = spark.createDataFrame([("s", 1, i, t, t == "!") for i, t in enumerate(["Hel", "lo. Wor", "ld", "!"])], "session string, turn long, _seq int, token string, last boolean")
    tokens.coalesce(1).write.parquet(str(tmp_path / "tok"))
    got = drain(S.stream_segments(spark.readStream.schema(tokens.schema).parquet(str(tmp_path / "tok")), idle_ms=None), spark, "seg", tmp_path)
    assert [(r.n, r.sentence) for r in got.orderBy("n").collect()] == [(0, "Hello."), (1, "World!")]
    e = spark.createDataFrame([("2024-01-01 00:01:00", True), ("2024-01-01 00:02:00", False), ("2024-01-01 00:09:00", False)], "ts string, bad boolean").select(F.col("ts").cast("timestamp").alias("ts"), "bad")
    e.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    got = drain(S.stream_sliding_ratio(stream, "ts", F.col("bad"), F.lit(True), "10 minutes", "5 minutes"), spark, "rate", tmp_path, "complete")
    want = T.sliding_ratio(e, "ts", F.col("bad"), F.lit(True), "10 minutes", "5 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert S.idle_sessions(e.withColumn("session", F.lit("s")), "ts", idle="5 minutes").count() == 2


def test_idle_replies_are_flushed_and_late_tokens_dropped(spark, tmp_path):
    own = S.stateful(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = [("a", 1, 0, "One. Two", False, 1.0), ("b", 1, 0, "Whole. ", False, 1.0), ("b", 1, 1, "Reply.", True, 2.0), ("c", 1, 0, "Far", True, 500.0), ("c", 2, 0, "On", True, 700.0), ("a", 1, 1, "late", True, 3.0), ("a", 1, 2, "Again.", True, 800.0), ("d", 1, 0, "", True, 5000.0)]
    schema = "session string, turn long, _seq int, token string, last boolean, ts double"
    for i, part in enumerate(([0, 1], [2, 3], [4], [5, 6], [7])):
        own.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(S.stream_segments(stream, idle_ms=60_000, late="10 seconds"), own, "idle", tmp_path)
    assert sorted((r.session, r.n, r.sentence) for r in got.collect()) == [("a", 0, "Again."), ("a", 0, "One."), ("a", 1, "Two"), ("b", 0, "Whole."), ("b", 1, "Reply."), ("c", 0, "Far"), ("c", 0, "On")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_replay_in_batches_equals_the_batch_scan(spark, tmp_path):
    from turnstone.sources.replay import replay

    rows = spark.range(103).select((F.col("id") * 7 % 103).alias("k"), F.lit("x").alias("_at2"))
    seen = []
    q = replay(spark, rows, ["k"], 5, str(tmp_path / "r")).writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.k for r in b.collect()))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    seen = [b for b in seen if b]
    assert len(seen) == 5 and [k for b in seen for k in b] == list(range(103))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "r/rows")).collect()) == list(range(103))
    first = replay(spark, rows, ["k"], 2, str(tmp_path / "s"), max_messages=10)
    assert first.isStreaming and sorted(r.k for r in spark.read.parquet(str(tmp_path / "s/rows")).collect()) == list(range(10))


def test_upsert(spark, tmp_path):
    write = S.upsert_parquet(str(tmp_path / "kv"), "k", "ts")
    mk = lambda *r: spark.createDataFrame(list(r), "k string, ts double, v int")
    write(mk(("a", 1.0, 1), ("a", 2.0, 2), ("b", 1.0, 3)), 0)
    write(mk(("a", 1.5, 9)), 1)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "kv/v1")).collect()} == {("a", 9), ("b", 3)}


def test_state_has_as_many_partitions_as_the_cores_need(spark):
    assert int(S.stateful(spark).conf.get("spark.sql.shuffle.partitions")) == 2 * spark.sparkContext.defaultParallelism


def test_tokens_of_one_time_travel_as_one_row(spark):
    rows = [("a", 1, i, f"w{i} ", i == 2, 5.0) for i in range(3)] + [("a", 1, 3, None, None, 6.0), ("b", 1, 0, "x", False, None), ("b", 1, None, "y", False, None)]
    tokens = spark.createDataFrame(rows, "session string, turn long, _seq int, token string, last boolean, ts double").coalesce(1)
    got = {(r.session, r.ts): (r.seq, r.token, bool(r.last)) for r in S._packed(tokens, ["session", "turn", "ts"]).collect()}
    assert got == {("a", 5.0): ([0, 1, 2], ["w0 ", "w1 ", "w2 "], True), ("a", 6.0): ([3], [None], False), ("b", None): ([0, None], ["x", "y"], False)}


def test_replayed_files_hold_rows_that_follow_each_other(spark, tmp_path):
    from turnstone.sources.replay import replay

    replay(spark, spark.range(4000).withColumnRenamed("id", "k"), ["k"], 2, str(tmp_path / "r"))
    spans = spark.read.parquet(str(tmp_path / "r/rows")).groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).collect()
    assert len(spans) == 2 * spark.sparkContext.defaultParallelism and all(r.b - r.a + 1 == r.n for r in spans)


def test_words_are_split_once_a_reply(spark):
    from turnstone.plans.sources import _reply_tokens

    replies = spark.createDataFrame([(1, 1, " a  b\nc "), (2, 1, "d"), (3, 4, None), (4, 5, "e f")], "conv_id long, turn long, text string")
    tokens = _reply_tokens(replies)
    # Beside the explode, nothing but the exploded word is left to work out.
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Generate")] and "split(" in plan
    assert [(r.session, r._seq, r.token, r.last) for r in tokens.orderBy("session", "_seq").collect()] == [("1", 0, "a ", False), ("1", 1, "b ", False), ("1", 2, "c ", True), ("2", 0, "d ", False), ("4", 0, "e ", False), ("4", 1, "f ", False)]


def test_a_stream_is_waited_for_to_its_end(tmp_path):
    class Query:
        done = False

        def awaitTermination(self, timeout=None):  # noqa: N802
            # Too slow for any limit.
            self.done = timeout is None
            return self.done

        def exception(self):
            return None

        def stop(self):
            pass

    class Stream:
        query = Query()
        writeStream = sparkSession = read = property(lambda self: self)  # noqa: N815
        format = option = trigger = schema = lambda self, *_, **__: self
        start = lambda self, _: self.query
        parquet = lambda self, _: "rows of a query that " + ("ended" if self.query.done else "was stopped")

    assert _drained(Stream(), str(tmp_path)) == "rows of a query that ended"
