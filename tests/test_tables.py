"""Online tables, trace sinks and bundles: what is left alone, repeated, damaged or never finished."""

import pytest
from pyspark.sql import functions as F

from turnstone.sources import bundle as B
from turnstone.streaming.tables import OnlineTable, finished_spans, trace_sink


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path / "t")
    t = OnlineTable(spark, root, "k", "k long, v string, ts long", buckets=8)
    mk = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, ts long")
    assert t.rows().count() == 0
    assert t.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).cast("long").alias("ts")), 0, "ts")
    before = t._manifest()["folders"]
    assert len(before) == 8 and t.upsert(mk((5, "b", 2), (5, "c", 3), (5, "b", 2)), 1, "ts")
    after = t._manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert t.rows().count() == 100 and [tuple(r) for r in t.lookup(mk((5, "", 0), (1000, "", 0))).collect()] == [(5, "c", 3)]
    assert not t.upsert(mk((5, "again", 9)), 1, "ts") and t._manifest()["folders"] == after
    # The folder that the second-last manifest names is still there; older ones go.
    assert OnlineTable(spark, root, "k", "k long, v string, ts long").buckets == 8
    t.upsert(mk((200, "n", 1)), 2, "ts")
    t.upsert(mk((5, "d", 4)), 3, "ts")
    assert {r.k: r.v for r in t.rows().where("k in (5, 6, 200)").collect()} == {5: "d", 6: "a", 200: "n"}
    named = {f for n in t.store.names("manifests") for f in __import__("json").loads(t.store.read(f"manifests/{n}"))["folders"].values()}
    held = {f"data/{b}/rows/{x}" for b in t.store.names("data") for x in t.store.names(f"data/{b}/rows") if x.startswith("_b=")}
    assert held == named and len(t.store.names("manifests")) == 2
    assert t.upsert(mk(), 4, "ts") and t.rows().count() == 101


def test_a_sink_keeps_a_batch_once_and_a_failed_one_not_at_all(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("s", 1, "llm.end", 3, 2.5, "x"), (None, None, "llm.end", None, None, None), ("s", 1, "llm.start", 1, None, "x")], "session string, turn long, event string, seq long, ms double, span string")
    assert sorted(map(tuple, finished_spans(rows).collect())) == [("llm", "None", 0, 0, 0.0, "None"), ("llm", "s", 1, 3, 2.5, "x")]
    write = trace_sink(path)
    write(rows, 0)
    write(rows, 0)
    assert spark.read.json(path).count() == 3
    broken = rows.withColumn("ms", F.when(F.col("seq") == 1, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("ms")))
    with pytest.raises(Exception, match="broken"):
        write(broken, 1)
    assert spark.read.json(path).count() == 3
    write(rows, 1)
    assert spark.read.json(path).count() == 6


def test_a_bundle_is_finished_by_its_manifest(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    big = bytes(range(256)) * 20_000
    files = spark.createDataFrame([("a/model.bin", big), ("b.txt", b"hello"), ("empty", b"")], "path string, content binary")
    B.write_files(files, src).collect()
    assert not list((tmp_path / "src").rglob("*.writing"))
    with pytest.raises(Exception):
        B.read_bundle(spark, out)
    listed = B.write_bundle(spark, src, out, {"name": "n", "version": "2"})
    assert {(r.path, r.size) for r in listed.collect()} == {("a/model.bin", len(big)), ("b.txt", 5), ("empty", 0)}
    assert B.verify_bundle(spark, out).count() == 0 and B.read_bundle(spark, out)[0]["version"] == "2"
    assert (tmp_path / "out/files/a/model.bin").read_bytes() == big
    with pytest.raises(FileExistsError):
        B.write_bundle(spark, src, out, {})
    (tmp_path / "out/files/b.txt").write_bytes(b"HELLO")
    (tmp_path / "out/files/empty").unlink()
    got = {tuple(r) for r in B.verify_bundle(spark, out).collect()}
    assert got == {("b.txt", "checksum mismatch"), ("empty", "required file missing")}
