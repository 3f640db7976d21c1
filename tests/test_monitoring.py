"""Spans, counter rates and alert intervals on small cases."""

import pytest

from turnstone.operators import alerting as A
from turnstone.operators import spans as N

ROWS = "session string, turn long, event string, span string, _seq long, ts double, error string"


def test_spans_nest_and_unclosed_ones_hold_nothing(spark):
    rows = [
        ("s", 1, "turn.start", "r", 1, 0.0, None), ("s", 1, "llm.start", "a", 2, 1.0, None), ("s", 1, "tool.start", "u", 3, 1.5, None), ("s", 1, "db.start", "d", 4, 2.0, None), ("s", 1, "db.end", "d", 5, 2.5, "Oops"),
        ("s", 1, "llm.end", "a", 6, 4.0, None), ("s", 1, "tts.end", "x", 7, 4.0, None), ("s", 1, "tts.start", "t", 8, 5.0, None), ("s", 1, "tts.end", "t", 9, 9.0, None), ("s", 1, "turn.end", "r", 10, 10.0, None),
        ("s", 2, "turn.start", "r", 11, 20.0, None), ("s", 2, "turn.end", "r", 12, 21.0, None), ("s", None, "turn.start", "q", 13, 1.0, None), ("s", 3, "turn.start", None, 14, 1.0, None),
    ]
    got = {(r.turn, r.span): r for r in N.spans(spark.createDataFrame(rows, ROWS).repartition(3)).collect()}
    assert set(got) == {(1, "r"), (1, "a"), (1, "u"), (1, "d"), (1, "t"), (2, "r")}
    assert {k[1]: (r.parent, r.level) for k, r in got.items() if k[0] == 1} == {"r": (None, 1), "a": ("r", 2), "u": ("a", 3), "d": ("a", 3), "t": ("r", 2)}
    assert (got[1, "r"].ms, got[1, "r"].self_ms, got[1, "a"].self_ms, got[1, "d"].error) == (10_000.0, 3_000.0, 2_500.0, "Oops")
    assert not got[1, "u"].closed and got[1, "u"].ms is None and got[2, "r"].self_ms == 1000.0
    assert sum(r.self_ms for k, r in got.items() if k[0] == 1 and r.closed) == got[1, "r"].ms
    total = {r.stage: r for r in N.span_totals(N.spans(spark.createDataFrame(rows, ROWS))).collect()}
    assert (total["db"].errors, total["tool"].unclosed, total["turn"].n) == (1, 1, 2)
    assert N.spans(spark.createDataFrame([], ROWS)).count() == 0


def test_a_counter_that_restarts(spark):
    # 10 a minute; the process restarts after the sample at 180 s.
    values = [(0, 100.0), (60, 110.0), (120, 120.0), (180, 130.0), (240, 10.0), (300, 20.0)]
    df = spark.createDataFrame([("a", t, v) for t, v in values] + [("b", 0, 5.0), ("a", 60, None), ("a", 120, 120.0)], "s string, at long, value double")
    assert [r.step for r in A.increases(df, ["s"]).where("s = 'a'").orderBy("at").collect()] == [None, 10.0, 10.0, 10.0, 10.0, 10.0]
    got = {(r.s, r["at"]): r.rate for r in A.counter_rate(df, ["s"], 300, 60).collect()}
    assert ("b", 0) not in got and got["a", 300] == pytest.approx(10 / 60)
    # Five samples over 240 s, half an interval more at most at the window's start.
    assert got["a", 300] == pytest.approx(40 * (240 + 60) / 240 / 300)
    with pytest.raises(ValueError):
        A.counter_rate(df, ["s"], 0, 60)


def test_alerts_hold_before_they_fire(spark):
    at = [0, 60, 120, 180, 300, 360, 600]
    df = spark.createDataFrame([("slow", t) for t in at] + [("fast", 0), ("fast", 0)], "alert string, at long")
    got = sorted(tuple(r) for r in A.alert_intervals(df, 60, {"slow": 150, "fast": 0}, until=600).collect())
    assert got == [("fast", 0, 0, 60, 1), ("slow", 0, 180, 240, 4), ("slow", 300, None, 420, 2), ("slow", 600, None, None, 1)]
    assert A.alert_intervals(df.limit(0), 60, {"slow": 1}).count() == 0


def test_spans_are_joined_with_nothing_but_their_ranges(spark):
    """Parents and children's times come in one pass each; what was placed is read once."""
    from turnstone.operators import spans as N

    rows = spark.createDataFrame([("s", 1, "a.start", "x", 1, 0.0, None), ("s", 1, "a.end", "x", 2, 1.0, None)], "session string, turn int, event string, span string, _seq int, ts double, error string")
    plan = N.spans(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("parquet") == 2
