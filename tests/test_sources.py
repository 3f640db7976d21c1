import json

import pytest
from pyspark.sql import functions as F

from turnstone.functions.udfs import wav_duration_s
from turnstone.operators.features import view
from turnstone.sources import files as S
from turnstone.sources.golden import golden_set

VIEW = view("e", 5, ("x", "float"), ("n", "int"), ("s", "str"))


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "text": "a"}\n\n{"id": "2", "text": "b"}\n')
    assert S.read_jsonl(spark, str(p), "id string, text string").count() == 2
    assert S.read_jsonl(spark, str(p), "id string, text string", 1).count() == 1
    p.write_text('{"id": "1"}\nnot json\n[1]\n')
    with pytest.raises(Exception):  # noqa: B017
        S.read_jsonl(spark, str(p), "id string").collect()
    assert [r.problem for r in S.read_jsonl_checked(spark, str(p), "id string").collect()] == [None, "invalid JSON", "not an object"]
    S.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_feature_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.5), ("b", 3.0, 3.5)], "entity_id string, event_ts double, x double")
    rows.write.parquet(str(tmp_path / "p"))
    got = S.read_features(spark, str(tmp_path / "p"), VIEW, 2, 3)
    assert got.count() == 2 and got.first().s is None and got.columns == ["entity_id", "event_ts", "x", "n", "s"]
    assert "PushedFilters: [IsNotNull(event_ts), GreaterThanOrEqual(event_ts,2.0)" in got._jdf.queryExecution().toString()
    S.append_features(got, str(tmp_path / "q"), VIEW)
    S.append_features(got, str(tmp_path / "q"), VIEW)
    assert S.read_features(spark, str(tmp_path / "q"), VIEW).count() == 4


def test_texts_numbers_and_index(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("x\ny\n")
    (tmp_path / "d" / "sub" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d" / "sub" / "c.md").write_text("z")
    got = {r.id: (r.lines, r.bytes) for r in S.read_texts(spark, str(tmp_path / "d"), "*.md").collect()}
    assert got == {"a.md": (2, 4), "sub/c.md": (1, 1)}
    assert {r.id for r in S.read_texts(spark, str(tmp_path / "d"), "*.md", ["sub"]).collect()} == {"a.md"}
    (tmp_path / "n.txt").write_text("1 2.5\n\n3")
    assert S.read_numbers(spark, str(tmp_path / "n.txt")).agg(F.sum("value")).first()[0] == 6.5
    S.save_index({"chunks": spark.range(2)}, str(tmp_path / "ix"), 8)
    assert S.load_index(spark, str(tmp_path / "ix"), 8)["chunks"].count() == 2
    with pytest.raises(ValueError):
        S.load_index(spark, str(tmp_path / "ix"), 9)


def test_trace_payload(spark, tmp_path):
    rows = [{"ts": 1.0, "session": "s", "turn": 1, "event": "llm.end", "payload": json.dumps({"intent": "x", "response_ms": 5})}, {"ts": 2.0, "session": "s", "event": "a", "payload": "broken"}]
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)))
    got = S.read_trace(spark, str(p)).orderBy("ts").collect()
    assert (got[0].intent, got[0].response_ms, got[1].intent) == ("x", 5.0, None)


def test_config_and_golden(spark, tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[a]\nb = 1\nc = "x"\n')
    assert S.load_config(str(p), {"TURNSTONE_A__B": "2", "OTHER": "1"}) == {"a": {"b": 2, "c": "x"}}
    assert S.merge_config({"a": {"b": 1}, "c": 2}, {"a": {"d": 3}, "c": 4}) == {"a": {"b": 1, "d": 3}, "c": 4}
    one, two = (golden_set(spark, 7, 3).collect() for _ in range(2))
    assert one == two and len(one) == 27


def test_wav(spark):
    data = b"\0" * 32000
    head = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + (16000).to_bytes(4, "little") + (32000).to_bytes(4, "little") + b"\2\0\x10\0data" + len(data).to_bytes(4, "little")
    d = spark.createDataFrame([(head + data,), (b"no",), (None,)], "c binary")
    assert [r.s for r in d.select(wav_duration_s("c").alias("s")).collect()] == [1.0, None, None]


def test_manifests_and_plug_ins(spark, tmp_path):
    from pyspark.sql import types as T

    from turnstone.functions.udfs import batch_function

    (tmp_path / "m" / "a").mkdir(parents=True)
    (tmp_path / "m" / "a" / "config.json").write_text('{"r": 8}')
    (tmp_path / "m" / "config.json").write_text("broken")
    got = sorted((r.problem or "", r.manifest.r if r.manifest else None) for r in S.read_manifests(spark, str(tmp_path / "m"), "config.json", "r int").collect())
    assert got == [("", 8), ("invalid JSON", None)]
    length = batch_function(lambda texts: [len(t) for t in texts], T.IntegerType())
    assert [r.n for r in spark.createDataFrame([("ab",), ("c",)], "t string").select(length("t").alias("n")).collect()] == [2, 1]
