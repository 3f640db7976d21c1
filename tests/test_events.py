"""The JSON-line source: ranges, offsets, bounds, and Kafka's reader over it."""

import json

import pytest

from turnstone.sources import events as E
from turnstone.sources import files as S

SCHEMA = "i long, t string"


def made(n, path, parts=3):
    rows = [{"i": i, "t": "é" * (i % 40)} for i in range(n)]
    for p in range(parts):
        E.write_events(rows[p::parts], f"{path}/in/part-{p}.jsonl")
    return rows


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_cut_anywhere_give_every_line_once(tmp_path, split, monkeypatch):
    rows = made(60, str(tmp_path))
    (tmp_path / "in/part-9.jsonl").write_bytes(b'\n\n{"i": 100, "t": ""}\r\n{"i": 101, "t": ""}')
    monkeypatch.setattr(E, "SPLIT", split)
    r = E._Batch({"path": str(tmp_path / "in")})
    got = [json.loads(v)["i"] for p in r.partitions() for _, v in r.read(p)]
    assert sorted(got) == [*range(60), 100, 101] and len(rows) == 60


def test_batch_stream_and_bounds(spark, tmp_path):
    rows = made(500, str(tmp_path))
    want = sorted((r["i"], r["t"]) for r in rows)
    path = str(tmp_path / "in")
    assert sorted(map(tuple, E.read_events(spark, path, SCHEMA).collect())) == want
    assert E.read_events(spark, path, SCHEMA, max_messages=17).count() == 17
    seen = []
    q = E.read_events(spark, path, SCHEMA, streaming=True, per_batch=4_000).writeStream.foreachBatch(lambda b, i: seen.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    E.write_events([{"i": 900, "t": "later"}], f"{path}/part-x.jsonl")
    with open(f"{path}/part-y.jsonl", "w") as f:
        f.write('{"i": 901, "t": "whole"}\n{"i": 902, "t": "half')
    q.processAllAvailable()
    q.stop()
    assert sorted(r for b in seen for r in b) == sorted([*want, (900, "later"), (901, "whole")])
    assert sum(1 for b in seen if b) >= 4
    # A restarted stream goes on where the last one committed.
    with open(f"{path}/part-y.jsonl", "a") as f:
        f.write('"}\n')
    again = []
    q = E.read_events(spark, path, SCHEMA, streaming=True).writeStream.foreachBatch(lambda b, i: again.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert again == [(902, "half")]


def test_lines_that_are_no_objects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"i": 1, "t": "a"}\n[1, 2]\n')
    with pytest.raises(Exception, match="no object"):
        E.read_events(spark, str(tmp_path / "x.jsonl"), SCHEMA, objects_only=True).collect()
    with pytest.raises(Exception):
        E.read_events(spark, str(tmp_path / "x.jsonl"), SCHEMA).collect()
    assert E.read_events(spark, str(tmp_path / "x.jsonl"), SCHEMA, max_messages=1, objects_only=True).count() == 1


def test_kafka_reader_over_this_source(spark, tmp_path):
    E.write_events([{"ts": 1.0, "session": "s", "turn": 1, "event": "llm.end", "ms": 2.0}, {"ts": 2.0, "session": "s", "turn": 1, "event": "turn.end"}], str(tmp_path / "topic.jsonl"))
    E.register(spark)
    rows = S.read_kafka(spark, "none:9092", "topic", bounded=True, fmt="jsonl_events", path=str(tmp_path / "topic.jsonl"))
    assert [(r.event, r.ms) for r in rows.orderBy("ts").collect()] == [("llm.end", 2.0), ("turn.end", None)]
    assert S.read_kafka(spark, "none:9092", "topic", fmt="jsonl_events", path=str(tmp_path / "topic.jsonl")).isStreaming
