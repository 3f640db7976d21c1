import math

import pytest
from pyspark.sql import functions as F

from turnstone.operators import drift as D
from turnstone.operators import trace as T

SCHEMA = "_seq long, session string, turn int, event string, ms double, response_ms double, error string"


def rows(spark, items):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(items)], SCHEMA)


@pytest.fixture(scope="module")
def trace(spark):
    out = []
    for turn, stt, ttfa in ((1, 100, 900), (2, 300, 1100), (3, 200, 2000)):
        out += [("s", turn, "stt.end", float(stt), None, None), ("s", turn, "playback.end", 5.0, float(ttfa), None), ("s", turn, "playback.end", 5.0, None, None), ("s", turn, "turn.end", float(ttfa + 500), None, None)]
    return rows(spark, out)


def test_stage_percentiles(trace):
    got = {r.stage: r for r in T.stage_percentiles(trace).collect()}
    s = got["stt"]
    assert (s.n, s.p50, s["mean"], s["max"], round(s.p95, 6)) == (3, 200.0, 200.0, 300.0, 290.0)
    assert got["playback"].n == 6
    assert {r.stage for r in T.approx_stage_percentiles(trace).collect()} == set(got)


def test_first_audio(trace):
    r = T.ttfa_percentiles(trace).first()
    assert (r.n, r.p50, round(r.p95, 6), round(r["mean"], 2)) == (3, 1100.0, 1910.0, 1333.33)
    assert T.ttfa_percentiles(trace.where("turn > 9")).count() == 0


def test_indicators(spark):
    t = rows(spark, [("a", 1, "turn.start", None, None, None), ("a", 1, "turn.end", None, None, None), ("a", 2, "turn.start", None, None, None), ("a", 2, "llm.end", None, None, "boom"), ("a", 2, "turn.end", None, None, None), ("a", 3, "turn.start", None, None, None), (None, None, "x.end", None, None, "")])
    got = {r.indicator: r.value for r in T.indicators(t, wer=0.1).collect()}
    assert got["n_turns"] == 4 and got["error_rate"] == 0.5 and got["wer"] == 0.1 and "ttfa_p50_ms" not in got


def test_error_budget(spark):
    o = T.objective_table(spark, [T.Objective("a", "x", 0.0), T.Objective("b", "y", 0.9, comparator=">="), T.Objective("c", "z", 2.0)])
    v = spark.createDataFrame([("x", 1.0), ("y", 0.95)], "indicator string, value double")
    got = {r.slo: r for r in T.error_budgets(o, v, 0.5).collect()}
    assert got["a"].burn_rate == math.inf and not got["a"].met
    assert round(got["b"].burn_rate, 9) == 0.5 and round(got["b"].remaining, 9) == 0.75 and got["b"].met
    assert got["c"].measured is None and got["c"].burn_rate is None and got["c"].met is None
    with pytest.raises(ValueError):
        T.Objective("d", "x", 1.0, comparator="<")
    text = T.alert_rules([T.Objective("error_rate", "error_rate", 0.01, description='say "x"')], {"error_rate": "sum(rate(e[{w}]))"})
    assert 'expr: "(sum(rate(e[5m]))) > 0.01"' in text and "alert: SloErrorRate" in text and '\\"x\\"' in text


def test_turn_summary_lines(spark):
    t = rows(spark, [("s", 1, "stt.end", 100.0, None, None), ("s", 1, "tts.end", 50.0, None, None), ("s", 1, "tts.end", None, None, None), ("s", None, "stt.end", 7.0, None, None)])
    got = {r.turn: r.line for r in T.format_summary(T.turn_summary(t)).collect()}
    assert got == {1: "stt 1x 100ms | tts 2x 50ms (first 50, max 50)", 0: "stt 1x 7ms"}


def test_metrics(spark):
    d = spark.createDataFrame([("a", 5.0), ("a", 15.0), ("a", 100.0), ("b", None)], "stage string, v double")
    h = T.histogram(d, ["stage"], "v", (10.0, 50.0))
    assert [(r.le, r.bucket_count, r.sum, r["count"]) for r in h.orderBy("le").collect()] == [(10.0, 1, 120.0, 3), (50.0, 2, 120.0, 3), (math.inf, 3, 120.0, 3)]
    lines = [r.line for r in T.exposition(h, "m", ["stage"]).orderBy("k", "part", "le").collect()]
    assert lines == ['m_bucket{stage="a",le="10"} 1', 'm_bucket{stage="a",le="50"} 2', 'm_bucket{stage="a",le="+Inf"} 3', 'm_sum{stage="a"} 120', 'm_count{stage="a"} 3']
    assert T.histogram_quantile(h, ["stage"], 0.5).first().value == 30.0
    with pytest.raises(Exception, match="cannot go down"):
        T.counter(d, ["stage"], F.lit(-1)).collect()
    with pytest.raises(ValueError):
        T.histogram(d, [], "v", ())


def samples(spark, ref, cur):
    return spark.createDataFrame([("f", "reference", float(v)) for v in ref] + [("f", "current", float(v)) for v in cur], "feature string, sample string, value double")


def test_psi(spark):
    got = D.psi(samples(spark, [0] * 50 + [1] * 50, [0] * 40 + [1] * 60), 2).first().psi
    assert got == pytest.approx((0.4 - 0.5) * math.log(0.4 / 0.5) + (0.6 - 0.5) * math.log(0.6 / 0.5))
    assert D.psi(samples(spark, [1, 2, 3], [1, 2, 3])).first().psi == 0
    assert D.psi(samples(spark, [1], [])).count() == 0
    assert D.psi(samples(spark, [5, 5], [5])).first().psi == 0


@pytest.mark.parametrize(("a", "b", "want"), [([0, 1], [5, 6], 1.0), ([0, 0, 0, 0], [0, 0, 1, 1], 0.5), ([0, 1], [0, 1, 2, 3], 0.5)])
def test_ks(spark, a, b, want):
    assert D.ks(samples(spark, a, b)).first().ks == want


def test_drift_report(spark):
    r = D.drift_report(samples(spark, range(100), range(50, 150))).first()
    assert r.drifted and r.mean_shift == 50 and r.reasons == "psi,ks"


def test_turn_metrics(spark):
    t = spark.createDataFrame([({"stt": 5.0, "llm": 60.0},), ({"stt": 20.0005},)], "stages map<string,double>")
    got = {(r.stage, r.le): r.bucket_count for r in T.turn_metrics(t, (10.0, 50.0)).collect()}
    assert got[("stt", 10.0)] == 1 and got[("stt", 50.0)] == 2 and got[("llm", 50.0)] == 0 and got[("llm", math.inf)] == 1
    assert t.select(T.round_stages(F.col("stages")).alias("s")).collect()[1].s == {"stt": 20.0}


def test_whole_milliseconds_are_cut_from_the_sum_itself(spark, tmp_path):
    """4.65 + 14.29 + 2.06 is a little below 21 in doubles, and DuckDB's floor says 20."""
    import duckdb

    from turnstone import plans

    duckdb.sql("""COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 1 SECOND AS ts, 1::BIGINT AS user_id, 'signup' AS event_type, [4.65, 14.29, 2.06][i]::DOUBLE AS value, '{}' AS props
        FROM range(1, 4) r(i)) TO '%s/events.parquet'""" % tmp_path)
    want = duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS FROM '{tmp_path}/events.parquet'") or duckdb.sql(plans.ORACLE["turn_lines"]).fetchall()
    assert [tuple(r) for r in plans.QUERIES["turn_lines"](spark, str(tmp_path)).collect()] == want == [("1", 1, "listen 3x 20ms (first 4, max 14)")]
