import gc
import hashlib
import os
import re
from collections import Counter
from urllib.parse import unquote

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import exact_dedup as D
from turnstone.llm import _util, mixing, queries, sharding
from turnstone.llm import url_filter as U


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
    fuse = D.build_fuse(keys)
    assert D.probe_fuse(fuse, keys).all()
    assert D.probe_fuse(fuse, rng.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 2e-3
    assert len(fuse[3]) <= max(1.6 * n, 64)


TEXTS = ["a  b", "a b", "a\tb\n", None, "", " ", "x" * 200_000, "é", "A b", "a b"]


def test_exact_dedup(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", "", ""), (4, "", "", ""), (4, "", "", ""), (-1, "é", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n string")
    for batch in (F.lit(None), F.lit(0), F.col("doc_id") % 3, F.col("doc_id")):
        got = D.exact_dedup(docs, batch).collect()
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _, _ in rows]
        assert len(got) == len(rows)
        for r in got:
            same = [i for (i, *_), n in zip(rows, norm) if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256]
            ids = [i for i in same if i is not None]
            assert (r.keep_id, r.group_size) == (min(ids), len(same))
            assert not r.kept or r.doc_id == r.keep_id
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in got}) == len(set(norm))
    assert D.exact_dedup(docs.limit(0), F.lit(0)).count() == 0


def test_exact_dedup_hot_group_across_batches(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    got = D.exact_dedup(docs, F.floor(F.col("doc_id") / 1000)).groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("group_size").alias("g"), F.count_if("kept").alias("k"), F.min("doc_id").alias("m"), F.max("keep_id").alias("keep")).collect()
    assert all(r.n == r.g and r.k == 1 and r.m == r.keep for r in got) and max(r.n for r in got) == 1000


ENDS = [0, 5 * 10**18, -(2**63), 2**63 - 1, 17, -1]


def test_exact_dedup_takes_any_id(spark, tmp_path):
    rows = [(i, "same") for i in ENDS] + [(5, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in D.op8_exact_dedup(spark, str(tmp_path)).collect()}
    assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (-(2**63), 6, i == -(2**63)) for i in ENDS)
    assert got[5].kept and got[5].group_size == 1


def test_exact_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    monkeypatch.setattr(D, "digest_of", lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 2)))
    rows = [(i, f"text {i % 400}") for i in range(1000)] + [(None, "text 3"), (7, "text 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.exact_dedup(docs, F.pmod("doc_id", F.lit(3))).collect()
    size = Counter(t for _, t in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((i is None, i, int(t[5:]), size[t]) for i, t in rows)
    assert sum(r.kept for r in got) == 400


def test_snapshots_outlive_their_run(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    first = table(*[(i, f"text  {i % 300}") for i in range(600)], (1000, None))
    D.build_snapshot(first, str(tmp_path / "s1"))
    D.build_snapshot(table((2000, "late"), (2001, "text 5")), str(tmp_path / "s2"))
    D.build_snapshot(first.limit(0), str(tmp_path / "s0"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        D.build_snapshot(first, str(tmp_path / "s1"))
    paths = [str(tmp_path / f"s{i}") for i in range(3)]
    batch = table((1, "text 5"), (2, "late"), (3, "new"), (4, "new "), (5, "new"), (None, "new"), (6, ""), (7, "x" * 100_000))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.snapshot, r.held_id) for r in D.screen(batch, paths).collect()}
    assert got == {1: (1, 1, False, paths[1], 5), 2: (2, 1, False, paths[2], 2000), 3: (3, 3, True, None, None), 4: (4, 1, True, None, None), 5: (3, 3, False, None, None), None: (3, 3, False, None, None), 6: (6, 1, False, paths[1], 1000), 7: (7, 1, True, None, None)}
    assert D.screen(batch, []).where("kept").count() == 6 and D.screen(batch.limit(0), paths).count() == 0


def test_results_can_be_transformed_and_outlive_other_calls(spark, sf_dir):
    kept = D.op8_exact_dedup(spark, sf_dir).where("kept")
    taken = mixing.op1_mixing(spark, sf_dir).where("taken > 0").select("doc_id")
    placed = sharding.op5_sharding(spark, sf_dir).where("shard < 4").select("doc_id")
    gc.collect()
    both = kept.join(taken, "doc_id").join(placed, "doc_id")
    gc.collect()
    assert 0 < both.count() < kept.count()
    before = set(os.listdir(_util.shared_dir(spark)))
    with _util.scratch():
        assert D.op8_exact_dedup(spark, sf_dir).count() > 0
    assert set(os.listdir(_util.shared_dir(spark))) == before and kept.count() > 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/1", "https://a.example.net/en/", "https://example.net/EN/", "x://example.net", "http://b.net/q?x=://y.org/fr/", "http://Sub.Example.com/de/1#f", "http://example.com/de", "http://a.org/fr/x", "http://a.org/fr?x",
    "http://notexample.net.org/fr/", "http://adult-x.example.com/", "http://www.adult-x.example.com", "http://badadult-x.example.com/", "http://" + "a." * 3000 + "net/" + "p" * 10000, "https://x/y#://z.net/", "http://example.net:80/en/",
    "http://adult-x.example.com:8080/a", "http://u:p@adult-x.example.com./", "http://adult%2Dx.EXAMPLE.com/", "http://a@b@spam-farm.example.org.:1",
]


def plain_verdict(url, rules, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = (m[1] if m else "").translate(str.maketrans(U.UPPER, U.LOWER))
    path = m[2] if m else ""
    fits = lambda e: (host == e.host or host.endswith("." + e.host)) and path.startswith(e.path)
    hit = max((e for e in rules if fits(e)), key=lambda e: len(e.key), default=None)
    plain = host
    host = re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", re.sub("^.*@", "", unquote(plain)))).lower()
    verdict = hit.verdict if hit else "block" if any(map(fits, listed)) else "allow"
    host = plain
    return host, path, hit.key if hit else None, verdict


def test_url_filter_against_plain_rules(spark, monkeypatch):
    rows = [(i, u, "c", "c") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id int, url string, host string, _url string").drop("_url")
    long = tuple(U.Entry("long.net", "/" + "p" * i, "block", "list") for i in range(700))
    for listed, few in ((U.LISTED, 8), (U.LISTED, 0), (U.LISTED + long, 8)):
        monkeypatch.setattr(U, "MAX_SHAPES", few)
        got = U.filter_urls(pages, U.listed_table(spark, U.RULES + listed)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, U.RULES, listed)
    assert U.filter_urls(pages.limit(0), U.listed_table(spark, U.RULES)).count() == 0
    assert {r.verdict for r in U.filter_urls(pages, U.listed_table(spark, [])).collect()} == {"allow"}


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    listed = U.listed_table(spark, [U.Entry(f"h{i}.net", "/", "block", "list") for i in range(2000)])
    blocks = 2000 // U.KEYS_PER_BLOCK
    bloom = U.build_filter(listed, "key", blocks)
    probe = lambda df: df.select(U._block(F.col("key"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(U._bits(F.col("key")))]).join(bloom, "block").where(" AND ".join(f"w{i} & m{i} = m{i}" for i in range(4))).count()
    assert probe(listed.select("key")) == 2000
    assert probe(spark.range(20000).select(F.concat(F.lit("x"), "id").alias("key"))) < 400
    plan = U.filter_urls(spark.createDataFrame([("u",)], "url string"), listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got = queries.queries()[name](spark, sf_dir)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(k) for k in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
