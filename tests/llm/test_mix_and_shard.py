import hashlib
import math
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnstone.llm import mixing as M
from turnstone.llm import sharding as S


def water_fill(sizes, weights, budget, cap=3):
    """Shares the budget by weight; what exceeds cap times a size is shared again among the others."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in full]
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 100], [1, 1], [5], [3, 3000, 1, 40, 7, 7, 900], [1, 10**6]])
def test_targets_fill_like_water(spark, sizes):
    cells = spark.createDataFrame([(f"={i:02}", f"{i:02}", n) for i, n in enumerate(sizes)], "key string, source string, size long")
    got = [r.target for r in M.targets(cells).orderBy("key").collect()]
    assert got == pytest.approx(water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes)))


def test_mix_on_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in zip(docs.doc_id, docs.text)}
    one = {r.doc_id: r for r in M.op1_mixing(spark, sf_dir).collect()}
    two = {r.doc_id: r.taken for r in M.op1_mixing(spark, sf_dir).collect()}
    assert {i: r.taken for i, r in one.items()} == two and {i: r.size for i, r in one.items()} == size
    by = defaultdict(int)
    for i, s in zip(docs.doc_id, docs.source):
        by[s] += size[i]
    order = sorted(by)
    want = dict(zip(order, water_fill([by[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], sum(by.values()))))
    took = defaultdict(int)
    for r in one.values():
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        took[r.source] += r.taken
    largest = defaultdict(int)
    for r in one.values():
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(took[s] - want[s]) <= largest[s] for s in order)
    # Longer texts weigh more: inclusion probabilities differ within a source.
    _, decisions, _ = M.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    expected = defaultdict(dict)
    for r in decisions.collect():
        expected[r.key][r.w] = r.expected
    assert all(list(e[w] for w in sorted(e)) == sorted(e.values()) for e in expected.values())
    assert sum(len(set(e.values())) > 1 for e in expected.values()) > len(expected) / 2


EDGE = "doc_id long, text string, lang string, source string, n_chars long, u double, v string, copies int, shard int"


def edge_rows():
    rows = [(None, None, None, None, None, 0.5, "x", 9, 9), (1, "", "en", "b", 0, 0.5, "x", 9, 9), (2, "w " * 50_000, "en", "b", 1, 0.5, "x", 9, 9), (3, "a b c", "en", None, 1, 0.5, "x", 9, 9)]
    rows += [(i, "same text here", "en", "é" if i % 2 else "z", 1, 0.5, "x", 9, 9) for i in range(10, 40)]
    return rows + rows[-3:]


def test_mix_edges(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    slim, decisions, _ = M.mix(docs)
    got = M.copies_of(slim, decisions).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 3 for r in got)
    assert {r.key for r in decisions.collect()} == {"=b", "=z", "=é", "~"}
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert M.mix_documents(docs.limit(0)).count() == 0
    per = {(r.id, r.source): r.copies for r in got}
    n = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    rows = {(r.doc_id, r.source): r["count"] for r in docs.groupBy("doc_id", "source").count().collect()}
    assert n == {k: per[k] * rows[k] for k in rows if per[k]}


def test_mix_follows_document_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("q"))
    other = spark.range(4000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("t").alias("source"), F.lit(1.0).alias("q"))
    slim, decisions, _ = M.mix(docs.unionByName(other), weights=(1.0, 3.0), doc_weight=F.col("q"))
    assert {r.key: r.target for r in decisions.collect()} == {"=s": 8000.0, "=t": 24000.0}
    by = {r.w: r.c for r in M.copies_of(slim, decisions).where("key = '=s'").groupBy("w").agg(F.avg("copies").alias("c")).collect()}
    assert by[3.0] == pytest.approx(0.75, abs=0.05) and by[1.0] == pytest.approx(0.25, abs=0.05)


def test_shards(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    got = S.op5_sharding(spark, sf_dir).toPandas()
    assert len(got) == len(docs) and set(got.law) == {"key"} and set(got["shard"]) <= set(range(8))
    for r in got.itertuples():
        b = docs[r.doc_id].encode()
        assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b) and r.grown_shard in (r.shard, 8)
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, S.topology(8)), plain_shard(r.doc_id, S.grow(S.topology(8))))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = S.op5_sharding(spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()


def plain_shard(key, leaves, seed="shard"):
    """The descent over plain dictionaries."""
    path = ()
    for depth in range(3):
        weights = defaultdict(float)
        for x in leaves:
            if (x.region, x.rack, x.shard)[:depth] == path:
                weights[(x.region, x.rack, x.shard)[depth]] += x.weight

        def drawn(name):
            text = ":".join([seed, str(depth), *map(str, path), str(name), "~" if key is None else str(key)])
            return -math.log((int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[name]

        path = (*path, min((n for n in weights if weights[n] > 0), key=drawn))
    return path[2]


def shards_of(spark, leaves, n=3000):
    return [r.s for r in S.descend(spark.range(n).withColumn("_region", F.lit("clash")), F.col("id"), leaves, "s").orderBy("id").collect()]


TREES = [S.topology(1), S.topology(8), S.topology(30), [S.Leaf(0, 0, 0), S.Leaf(0, 1, 1, 3.0), S.Leaf(0, 1, 2, 0.5), S.Leaf(7, 2, 3, 2.0), S.Leaf(7, 0, 4, 0.0)]]


@pytest.mark.parametrize("leaves", TREES)
def test_descent_against_plain_version(spark, leaves):
    got = shards_of(spark, leaves)
    assert got == [plain_shard(i, leaves) for i in range(3000)]
    total = sum(x.weight for x in leaves)
    assert all(got.count(x.shard) == pytest.approx(3000 * x.weight / total, rel=0.3, abs=10) for x in leaves)


@pytest.mark.parametrize("n", [1, 5, 8, 12])
def test_a_new_shard_only_takes(spark, n):
    leaves = S.topology(n)
    a, b = shards_of(spark, leaves), shards_of(spark, S.grow(leaves))
    assert all(y in (x, n) for x, y in zip(a, b))
    assert b.count(n) == pytest.approx(3000 / (n + 1), rel=0.25)


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    leaves = S.topology(8)
    heavier = [S.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in leaves]
    at = {x.shard: x for x in leaves}
    a, b = shards_of(spark, leaves), shards_of(spark, heavier)
    # Between regions only into region 1; inside region 1 only into shard 5's rack, or inside that rack only into it.
    for x, y in zip(a, b):
        if x != y:
            assert at[y].region == at[5].region
            assert at[x].region != at[5].region or at[y].rack == at[5].rack
            assert (at[x].region, at[x].rack) != (at[5].region, at[5].rack) or y == 5
    assert b.count(5) == pytest.approx(3000 * 2 / 9, rel=0.2)


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 100)
    docs = spark.range(2050).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = S.shard_slots(docs, 3).toPandas()
    assert len(got) == 2050 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shard_edges(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    got = S.shard_slots(docs, 3).toPandas()
    assert len(got) == docs.count()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert S.shard_slots(docs.limit(0), 3).count() == 0
    assert S.assign_shards(docs, 3).columns[-1] == "shard" or "shard" in S.assign_shards(docs, 3).columns
