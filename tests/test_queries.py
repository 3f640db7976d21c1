"""Every query with SQL gives the rows that DuckDB gives."""

import hashlib
import math
import os
import re
import string
from collections import Counter

import duckdb
import pytest

from turnstone import plans
from turnstone.functions import text as X
from turnstone.operators import retrieval as R


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_sql(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = duck.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = Counter(tuple(map(plain, r)) for r in got.collect())
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_others_run(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).limit(5).collect() is not None


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def neighbours(duck):
    """Neighbouring turns, as reference and hypothesis."""
    rows = duck.sql("SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations").fetchall()
    return [r for r in rows if r[3] is not None]


def test_error_rates_against_plain_version(spark, sf_dir, neighbours):
    strip = str.maketrans("", "", string.punctuation)
    normal = lambda t: t.lower().replace("-", " ").translate(strip).split()
    words = {(c, t): (normal(a), normal(b)) for c, t, a, b in neighbours}
    got = plans.QUERIES["wer_align"](spark, sf_dir).collect()
    assert len(got) == len(words)
    for r in got:
        a, b = words[r.conv_id, r.turn]
        assert r.substitutions + r.deletions + r.insertions == plain_edits(a, b)
        assert (r.hits + r.substitutions + r.deletions, r.hits + r.substitutions + r.insertions) == (len(a), len(b))
    kinds = {r.op: r.n for r in plans.QUERIES["wer_ops"](spark, sf_dir).collect()}
    assert [kinds.get(k, 0) for k in ("equal", "substitute", "delete", "insert")] == [sum(r[c] for r in got) for c in ("hits", "substitutions", "deletions", "insertions")]
    pooled = {r.category: r for r in plans.QUERIES["corpus_wer"](spark, sf_dir).collect()}
    assert pooled[None].n == len(words) and pooled[None].wer == pytest.approx(sum(plain_edits(*w) for w in words.values()) / sum(len(a) for a, _ in words.values()), abs=1e-6)
    joined = [(a.lower().translate(strip).split(), b.lower().translate(strip).split()) for _, _, a, b in neighbours]
    trained = plans.QUERIES["word_edits"](spark, sf_dir).first()
    assert trained.wer == pytest.approx(sum(plain_edits(a, b) for a, b in joined) / sum(len(a) for a, _ in joined), abs=1e-6)


def test_hashing_embed_against_plain_version(spark, sf_dir):
    stop = set(X.STOPWORDS)
    got = {r.chunk_id: r for r in plans.QUERIES["hashing_embed"](spark, sf_dir).collect()}
    rows = R.chunk_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(rows) == len(got)
    for r in rows:
        t = [w for w in re.findall("[a-z0-9_]+", r.text.lower()) if w not in stop]
        cells = Counter()
        for f in t + [f"{a} {b}" for a, b in zip(t, t[1:])]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            cells[h % 512] += -1 if h >> 63 else 1
        held = sum(v != 0 for v in cells.values())
        assert got[r.chunk_id].nonzero == held and got[r.chunk_id].norm == pytest.approx(1.0 if held else 0.0)


def test_pii_totals_are_the_sums_of_the_rows(spark, sf_dir):
    totals = {r.kind: r.n for r in plans.QUERIES["pii_totals"](spark, sf_dir).collect()}
    rows = plans.QUERIES["pii_full"](spark, sf_dir).drop("doc_id", "text_md5").toPandas().sum()
    assert totals == {k: n for k, n in rows.items() if n}


def test_entry_lists_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "pit_join" in e.queries()
