import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.functions import vector as V
from turnstone.functions.udfs import embed_text, hashing_embedder
from turnstone.operators import registry as G
from turnstone.operators import retrieval as R


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_chunks(spark):
    text = "\n".join(f"l{i}" for i in range(1, 11))
    c = R.chunk_lines(docs(spark, text, "", None, "\n\n", "one\r\ntwo\n"), 4, 1).orderBy("document_id", "start_line").collect()
    assert [(r.document_id, r.start_line, r.end_line) for r in c] == [("0", 1, 4), ("0", 4, 7), ("0", 7, 10), ("4", 1, 2)]
    assert c[0].chunk_id == "0:1-4" and c[0].text == "l1\nl2\nl3\nl4" and c[3].text == "one\ntwo"
    for lines, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            R.chunk_lines(docs(spark, "x"), lines, overlap)


def test_keyword_and_hybrid(spark):
    texts = ["Dock 7B weighs the crates of the morning ferry."] + [f"Notice {w} is on paint and brushes." for w in ("one", "two", "three", "four", "five")]
    embed = hashing_embedder(64)
    c = R.chunk_lines(docs(spark, *texts)).withColumn("embedding", embed("text"))
    q = spark.createDataFrame([(0, "what does Dock 7B weigh"), (1, "violet comet"), (2, "  ")], "query_id int, text string").withColumn("embedding", embed("text"))
    hits = R.keyword_search(c, q).collect()
    assert {(r.query_id, r.chunk_id) for r in hits} == {(0, "0:1-1")}
    got = R.hybrid_retrieve(c, R.mentions(c), q).orderBy("query_id", "rank").collect()
    first = [r for r in got if r.query_id == 0][0]
    assert first.chunk_id == "0:1-1" and first.path == "fused"
    assert not [r for r in got if r.query_id == 2]
    pack = R.context_pack(R.keyword_search(c, q, 1).join(c, "chunk_id"), 40).first().context
    assert pack.startswith("From 0, lines 1 to 1.\nDock 7B") and len(pack) <= 40


def test_rrf(spark):
    mk = lambda ids: spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    r = R.reciprocal_rank_fusion({"x": mk("abc"), "y": mk("bc"), "z": mk("c")}).orderBy("rank").collect()
    assert [x.chunk_id for x in r] == ["c", "b", "a"] and r[0].score == pytest.approx(1 / 63 + 1 / 62 + 1 / 61)


def test_vectors(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]])], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, embedding array<double>")
    hits = R.vector_search(v, q, 2).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in hits] == [(0, 1.0), (2, 0.707107)]
    assert R.vector_search(v, q, 0).count() == 0 and R.vector_search(v, q.limit(0)).count() == 0
    assert v.select(V.cosine(F.col("embedding"), F.array(F.lit(0.0), F.lit(2.0))).alias("s")).collect()[3].s == 0.0
    with pytest.raises(Exception, match="dimension"):
        R.vector_search(v, spark.createDataFrame([(7, [1.0])], "query_id int, embedding array<double>")).collect()
    e = embed_text("Gate gate alarm", 32)
    assert abs((e * e).sum() - 1) < 1e-9 and not embed_text("", 32).any()


def test_vectors_in_blocks_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)], "chunk_id int, embedding array<double>")
    q = v.withColumnRenamed("chunk_id", "query_id").where("query_id < 11")
    rows = lambda: sorted(tuple(r) for r in R.vector_search(v, q, 3).collect())
    whole = rows()
    monkeypatch.setattr(R, "MAX_QUERIES", 4)
    monkeypatch.setattr(R, "AT_ONCE", 3)
    got = rows()
    assert len(got) == 33 and [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in whole] and [a[2] for a in got] == pytest.approx([a[2] for a in whole])


def test_entities_and_graph(spark):
    c = R.chunk_lines(docs(spark, "The Pier Q crew runs `load_map` in nav.core for GPS. Then pier q again: PierMaster.", "load_map and GPS"))
    m = R.mentions(c)
    names = {r.name for r in m.where("chunk_id like '0%'").collect()}
    assert {"Pier Q", "GPS", "load_map", "nav.core", "PierMaster"} <= names and "The" not in names and "Then" not in names
    e = R.graph_edges(m)
    n = m.where("chunk_id like '0%'").count()
    assert e.where("rel = 'cooccurs'").count() == n * (n - 1) // 2
    assert e.where("rel = 'mentions'").count() == m.count()
    g = spark.createDataFrame([("chunk:1", "ent:a", "mentions"), ("ent:a", "ent:b", "cooccurs"), ("chunk:2", "ent:b", "mentions")], "src string, dst string, rel string")
    start = lambda k: spark.createDataFrame([(k,)], "key string")
    near = lambda k, d, rel=None: sorted(r.key for r in R.neighbours(g, start(k), d, rel).collect())
    assert near("ent:a", 1) == ["chunk:1", "ent:b"] and near("ent:a", 1, "mentions") == ["chunk:1"]
    assert near("chunk:1", 3) == ["chunk:2", "ent:a", "ent:b"]


def test_tokens(spark):
    r = spark.createDataFrame([("The gate A, the gate",)], "t string").select(X.tokens(F.col("t"), True).alias("t"), X.grams(F.col("t")).alias("g")).first()
    assert r.t == ["gate", "gate"] and set(r.g) == {"the", "gate", "a", "the gate", "gate a", "a the"}


def test_diff_and_bundle(spark):
    old = spark.createDataFrame([("model", "h1", 10), ("cfg", "h2", 1), ("vad", "h3", 2)], "path string, sha256 string, size long")
    new = spark.createDataFrame([("model", "h9", 8), ("cfg", "h2", 1), ("projector.bin", "h4", 17)], "path string, sha256 string, size long")
    r = G.bundle_update(G.diff(old, new, "path", "sha256", "size")).first()
    assert (r.added, r.changed, r.removed, r.unchanged, r.download_bytes) == (1, 1, 1, 1, 25)
    need = spark.createDataFrame([("vad",), ("zzz",)], "path string")
    got = {(x.path, x.problem) for x in G.verify_files(old, new, need).collect()}
    assert got == {("model", "checksum mismatch"), ("model", "size mismatch"), ("vad", "required file missing"), ("projector.bin", "unlisted file"), ("zzz", "required file not in manifest")}


def test_registry(spark):
    q = spark.createDataFrame([("m", "1", "candidate", 0), ("m", "2", "candidate", 1), ("m", "1", "staging", 2), ("m", "1", "production", 3), ("m", "2", "staging", 4), ("m", "2", "production", 5)], "name string, version string, to string, seq int")
    log = G.registry_log(q).orderBy("seq", F.col("reason").isNull()).collect()
    assert [r.to for r in log] == ["candidate", "candidate", "staging", "production", "staging", "retired", "production"]
    assert [r.reason for r in log if r.reason] == ["replaced by 2"]
    assert {r.version: r.stage for r in G.current_stage(G.registry_log(q)).collect()} == {"1": "retired", "2": "production"}
    bad = spark.createDataFrame([("m", "1", "candidate", 0), ("m", "1", "production", 1), ("m", "1", "oops", 2)], "name string, version string, to string, seq int")
    assert [r.problem for r in G.audit(bad).orderBy("seq").collect()] == [None, "not allowed", "unknown"]


def test_policy(spark):
    d = spark.createDataFrame([("network", "api.x.io", False, ["*.x.io"], "degrade", "none"), ("network", "x.io", False, ["*.x.io"], "degrade", "none"), ("network", "a", True, [], "degrade", "none"), ("cloud_fallback", None, False, [], "cloud", "none"), ("store_audio", None, True, [], "degrade", "none"), ("fly", None, True, [], "degrade", "none")], "kind string, target string, offline boolean, allowed array<string>, fallback string, audio string")
    got = d.select(G.policy_decision(*[F.col(c) for c in ("kind", "target", "offline", "allowed", "fallback", "audio")]).alias("r")).collect()
    assert [r.r for r in got] == [None, "host not allowed", "offline only", None, "audio is not kept", "unknown action"]
    v = spark.createDataFrame([("1.9", "1.10"), ("2.0", "1.10.3"), ("1.2.0-rc1", "1.2")], "a string, b string").select(G.runtime_too_old(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in v] == [True, False, False]
    t = spark.createDataFrame([({"wer": 0.1},)], "m map<string,double>").select(G.to_tags(F.col("m"), "own", stage=F.lit("staging")).alias("t")).select("t", G.metrics_from_tags(F.col("t")).alias("m")).first()
    assert t.t == {"own.stage": "staging", "metric.wer": "0.1"} and t.m == {"wer": 0.1}


def test_illegal_moves_are_refused(spark):
    rows = [("m", "1", 1, "candidate"), ("m", "1", 2, "production"), ("m", "1", 3, "staging"), ("m", "1", 4, "production"), ("m", "2", 5, "staging"), ("m", "2", 6, "candidate"), ("m", "1", 7, "retired"), ("m", "1", 8, "staging")]
    q = spark.createDataFrame(rows, "name string, version string, seq long, to string")
    assert sorted(r.seq for r in G.accepted_moves(q).collect()) == [1, 3, 4, 6, 7]
    assert {r.version: r.stage for r in G.current_stage(G.registry_log(q)).collect()} == {"1": "retired", "2": "candidate"}


def test_what_a_newer_production_retired_stays_retired(spark):
    rows = [("m", "1", 1, "candidate"), ("m", "1", 2, "staging"), ("m", "1", 3, "production"), ("m", "2", 4, "candidate"), ("m", "2", 5, "staging"), ("m", "2", 6, "production"), ("m", "1", 8, "retired"), ("m", "1", 9, "candidate"), ("m", "2", 10, "production"), ("m", "3", 11, "retired"), ("n", "1", 12, "oops")]
    q = spark.createDataFrame(rows, "name string, version string, seq long, to string")
    log = [(r.version, r.seq, r["from"], r.to, r.reason) for r in G.registry_log(q).where("to = 'retired'").collect()]
    assert log == [("1", 6, "production", "retired", "replaced by 2")]
    assert {r.seq: r.problem for r in G.audit(q).where("seq > 7").collect()} == {8: "terminal", 9: "terminal", 10: "same", 11: "not allowed", 12: "unknown"}
    assert G.registry_log(q.limit(0)).count() == 0 and G.audit(q.limit(0)).count() == 0


def test_newest_first(spark):
    a = spark.createDataFrame([("b", "1", 5.0), ("a", "2", 5.0), ("a", "1", 5.0), ("c", "1", 9.0)], "name string, version string, created_at double")
    assert [(r.name, r.version) for r in G.newest_first(a).orderBy("rank").collect()] == [("c", "1"), ("a", "1"), ("a", "2"), ("b", "1")]


def test_grams_inside_tasks_equal_the_column_function(spark, sf_dir, monkeypatch):
    c = R.chunk_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    odd = spark.createDataFrame([("x:1-1", None), ("y:1-1", "İstanbul K_ÄÖ a_b  a_b"), ("z:1-1", "")], "chunk_id string, text string")
    c = c.select("chunk_id", "text").unionByName(odd)
    want = {(r.gram, r.n) for r in R.postings(c).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    got = R.gram_frequencies(c).collect()
    assert {(r.gram, r.df) for r in got} == want and {r.n for r in got} == {c.count()}
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    quick = {tuple(r) for r in R.rare_postings(c, q).collect()}
    monkeypatch.setattr(R, "BROADCAST_GRAMS", 0)
    assert quick == {tuple(r) for r in R.rare_postings(c, q).collect()} and quick


@pytest.mark.parametrize(("text", "key", "n"), [("Ab " * 40000, "ent:ab ab", 119999), ("Ab" * 40000, "ent:abab", 80000), ("a." * 40000 + "a", "ent:a.a.", 80001), ("The " * 40000 + "Ab", "ent:ab", 2)])
def test_long_runs_of_names_do_not_overflow_the_stack(spark, text, key, n):
    """One repeat of a pattern's group is no call of its own, however many there are."""
    found = R.mentions(spark.createDataFrame([("c", text)], "chunk_id string, text string")).collect()
    assert [(r.key.startswith(key), len(r.name)) for r in found] == [(True, n)]


def test_a_name_ends_at_a_word_end(spark):
    """Words that go on in other letters end the run before them."""
    found = R.entities(F.lit("Foo Barß Baz qux.yß a.b.cß AbCdé"))
    assert sorted(spark.range(1).select(found.alias("e")).first().e) == ["Baz", "Foo", "a.b"]


def test_labels_are_ranked_once_not_for_each_query(spark, sf_dir):
    """A query joins the first vectors of its label, not all of them."""
    from turnstone import plans

    plan = plans.QUERIES["rrf_fuse"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(label" in plan


def test_requests_are_read_once_for_all_stages(spark):
    """A random history equals its replay, and neither reads nor deals the requests anew for each stage."""
    rng = random.Random(3)
    rows = [(f"m{rng.randrange(3)}", f"{rng.randrange(4)}", i, rng.choice(["candidate", "staging", "production", "retired", "oops"])) for i in range(300)]
    stage, want = {}, []
    for name, version, seq, to in rows:
        was = stage.get((name, version))
        if to == "candidate" if was is None else to in G.TRANSITIONS.get(was, ()):
            for other in [v for (n, v), s in stage.items() if n == name and s == to == "production"]:
                stage[name, other] = "retired"
                want.append((name, other, seq, "production", "retired", f"replaced by {version}"))
            stage[name, version] = to
            want.append((name, version, seq, was, to, None))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "name string, version string, seq long, to string"
    requests = spark.createDataFrame(rows, schema).mapInArrow(seen, schema)
    assert sorted(map(str, G.registry_log(requests).collect())) == sorted(str(Row(name=n, version=v, seq=s, **{"from": f}, to=t, reason=r)) for n, v, s, f, t, r in want)
    assert read.value == len(rows)
