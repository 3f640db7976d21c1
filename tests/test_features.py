import pytest

from turnstone.operators import features as O

ROWS = [(0, "a", 10.0, 1.0, "one"), (1, "a", 20.0, 2.0, "two"), (2, "a", 30.0, 3.0, "three"), (3, "b", 25.0, 9.0, "nine")]
SCHEMA = "_seq long, entity_id string, event_ts double, x double, s string"


def ask(spark, requests, rows=ROWS, **options):
    r = spark.createDataFrame([(i, k, float(t)) for i, (k, t) in enumerate(requests)], "req int, entity_id string, event_ts double")
    f = spark.createDataFrame(rows, SCHEMA)
    got = O.point_in_time_join(r, f, ["x", "s"], seq="_seq", **options).orderBy("req").collect()
    return [(g.event_ts, g.x, g.s) for g in got]


@pytest.mark.parametrize("bucket", [None, 7.0])
def test_point_in_time(spark, bucket):
    assert [x for _, x, _ in ask(spark, [("a", 25), ("a", 20), ("a", 9.9)], bucket_s=bucket)] == [2.0, 2.0, None]
    assert ask(spark, [("a", 24), ("a", 26), ("zzz", 1)], ttl_s=5, bucket_s=bucket) == [(24.0, 2.0, "two"), (26.0, None, None), (1.0, None, None)]


@pytest.mark.parametrize("bucket", [None, 7.0])
def test_point_in_time_takes_whole_rows(spark, bucket):
    rows = [*ROWS[::-1], (9, "a", 40.0, 4.0, None)]
    assert ask(spark, [("a", 45), ("a", 45)], rows, bucket_s=bucket) == [(45.0, 4.0, None)] * 2


def test_point_in_time_ties_and_nulls(spark):
    rows = [(0, "a", 1.0, 1.0, "x"), (1, "a", 1.0, 2.0, "y"), (2, None, 1.0, 5.0, "z")]
    assert ask(spark, [("a", 1), (None, 3)], rows) == [(1.0, 2.0, "y"), (3.0, None, None)]
    assert ask(spark, [("a", 6)], rows, ttl_s=5) == [(6.0, 2.0, "y")]
    assert ask(spark, [], rows) == [] and ask(spark, [("a", 1)], []) == [(1.0, None, None)]


def test_latest_and_lookup(spark):
    f = spark.createDataFrame(ROWS, SCHEMA)
    latest = O.latest_per_entity(f, ["x"], seq="_seq")
    assert {(r.entity_id, r.event_ts, r.x) for r in latest.collect()} == {("a", 30.0, 3.0), ("b", 25.0, 9.0)}
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    got = {r.entity_id: r.x for r in O.online_lookup(keys, latest, ["x"], now=33.0, ttl_s=5).collect()}
    assert got == {"a": 3.0, "b": None, "c": None}
    assert O.materialize(f, ["x"], start=15, end=25, seq="_seq").count() == 2
    merged = O.merge_online(latest, spark.createDataFrame([("a", 99.0, 7.0)], latest.schema))
    assert {(r.entity_id, r.x) for r in merged.collect()} == {("a", 7.0), ("b", 9.0)}


def trace_rows():
    out, seq = [], 0
    for session, t, listen, response, intent in (("s1", 0, 1000, 400, "weather"), ("s2", 10, 3000, 800, "timer"), ("s1", 20, 2000, 600, "music")):
        for i, (event, ms, rm, it, ac) in enumerate(
            [("listen.start", None, None, None, None), ("listen.end", listen, None, None, None), ("stt.end", None, None, None, "en-IE"), ("llm.end", None, None, intent, None), ("playback.end", None, response, None, None), ("turn.end", None, None, None, None)]
        ):
            out.append((seq, float(t + i), session, event, None if ms is None else float(ms), None if rm is None else float(rm), it, ac))
            seq += 1
    return out


TRACE = "_seq long, ts double, session string, event string, ms double, response_ms double, intent string, accent string"


def test_session_features(spark):
    rows = [*trace_rows(), (90, 1.0, None, "turn.end", None, None, None, None), (91, 1.0, "s3", None, None, None, None, None), (92, 1.0, "s4", "turn.end", None, None, None, None)]
    got = O.session_features(spark.createDataFrame(rows, TRACE)).orderBy("session", "turn_count").collect()
    assert [(r.session, r.turn_count) for r in got] == [("s1", 1), ("s1", 2), ("s2", 1), ("s4", 1)]
    last = got[1]
    assert (last.avg_user_utterance_s, last.avg_response_ms, last.last_intent, last.accent_profile, last.event_ts) == (1.5, 500.0, "music", "en-IE", 25.0)
    assert got[3].avg_response_ms is None and got[3].last_intent is None


def test_views(spark):
    for bad in (lambda: O.view("e", 1, ("x", "bytes")), lambda: O.view("e", 0), lambda: O.view("e", 1, ("x", "int"), ("x", "int"))):
        with pytest.raises((KeyError, ValueError)):
            bad()
    c = O.ViewCatalog.from_config({"views": [{"name": "v", "entity": "e", "ttl_s": 5, "features": [{"name": "x", "dtype": "int"}]}]})
    assert list(c) == ["v"] and c["v"].ddl() == "entity_id string, event_ts double, x bigint"
    assert c.declare("v", O.view("e", 5, ("x", "int"))) == c["v"]
    with pytest.raises(ValueError):
        c.declare("v", O.view("e", 6, ("x", "int")))
    with pytest.raises(KeyError):
        c["w"]
    assert [r.name for r in O.DEFAULT_VIEWS.table(spark).collect()] == ["device_features", "session_features", "speaker_features"]


def test_feast_module_declares_every_view():
    import ast

    text = O.feast_text(O.DEFAULT_VIEWS, "data", "demo")
    calls = {n.targets[0].id: n.value for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Assign)}
    assert set(calls) == {"session", "speaker", "device", *O.DEFAULT_VIEWS}
    for name, v in O.DEFAULT_VIEWS.items():
        held = {k.arg: k.value for k in calls[name].keywords}
        fields = [[k.value for k in f.keywords] for f in held["schema"].elts]
        assert [f[0].value for f in fields] == v.columns.names and held["ttl"].keywords[0].value.value == v.ttl_s
        assert held["source"].keywords[0].value.value == f"data/{name}.parquet"


def test_trailing_percentile_slides_as_the_window_sums(spark):
    """Ties, nulls, NaN, times on the edges of buckets; no window holds a percentile, which it would sum up anew for each row."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    data = [(rng.choice("ab"), float(rng.randint(-30, 300)) / 2, rng.choice([None, float("nan"), -0.5, *range(9)]), i) for i in range(600)]
    rows = spark.createDataFrame([(k, t, None if v is None else float(v), i) for k, t, v, i in data], "key string, at double, v double, i int")
    got = O.trailing_percentile(rows, "key", "at", "v", 0.95, 10, "p")
    want = rows.withColumn("p", F.percentile("v", 0.95).over(O.trailing("key", "at", 10)))
    text = lambda df: [(r.i, str(r.p)) for r in df.orderBy("i").collect()]
    assert text(got) == text(want)
    made = O.device_features(rows.select(F.col("key").alias("device"), F.col("at").alias("event_ts"), F.lit("1").alias("bundle_version"), F.col("v").alias("ttfa_ms")))
    assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
