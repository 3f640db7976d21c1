"""Removal of repeated passages against a plain version over all 50-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from turnstone.llm import suffix_dedup as S

W = S.LENGTH
SCHEMA = "doc_id long, text string, tid int, runs string"


def plain(rows):
    """(id, n_bytes, n_removed, spans, digest of the rest) of each row."""
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - W + 1):
            w = b[k : k + W]
            if w not in least or key(i) < least[w]:
                least[w] = key(i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - W + 1):
            if least[b[k : k + W]] < key(i):
                gone[k : k + W] = b"\1" * W
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(b) if end < 0 else end
            spans.append((at, end))
            at = end
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(spans), tuple(spans), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, tuple((s.start, s.end) for s in r.spans), r.kept_sha256) for r in df.collect())


def made(seed):
    """Documents of shared and own passages: near copies, periodic texts, matches of 49 and 50 bytes, repeated ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.choice((5, 10, 40, 200))) for _ in range(12)]
    line = "This common line stands in many documents, word for word, again."
    rows = []
    for i in range(150):
        parts = [rng.choice((prose(rng.randint(0, 30)), rng.choice(shared), line, "\n")) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randrange(-20, 200), " ".join(parts)))
    base = prose(300)
    rows += [(i, base[: i * 7 % 500] + "#" + base[i * 7 % 500 :]) for i in range(300, 330)]
    rows += [(400 + i, "ab" * (20 + i * 9)) for i in range(12)] + [(420, "a" * 5_000), (421, "a" * 49), (422, "a" * 50), (423, "a" * 51)]
    exact = prose(40).encode()[:50].decode(errors="ignore")
    rows += [(500, "x" + exact + "y"), (501, exact), (502, exact[:-1] + "?"), (503, exact[1:] + "z" + exact)]
    rows += [(None, base), (None, base), (None, None), (7, base), (7, base), (7, base + " own"), (600, None), (601, ""), (602, " "), (700, base), (None, line + base), (-(1 << 63), line)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_made_documents_against_plain_version(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert rows_of(S.remove_repeats(docs)) == plain(rows)


def test_frequent_grams_by_key(spark):
    rows = made(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(S.remove_repeats(docs, block_runs=3)) == plain(rows)


def test_stretches_of_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long[100_000:400_000]), (2, long), (3, "start " + long[262_100:262_200] + " end"), (4, long[:10] + "é" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(S.remove_repeats(docs)) == plain(rows)


def test_documents_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()])
    assert sum(r[2] * n for r, n in want.items())
    assert rows_of(S.remove_repeats(docs)) == want
    got = Counter(tuple(r) for r in S.op12_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter({(a, b, c, d, f): n for (a, b, c, d, _, f), n in want.items()})


def test_kept_bytes_are_what_is_left(spark):
    rows = made(2)
    for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.remove_repeats(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize("letters", [2, 3, 200])
def test_difference_cover_finds_the_least_owner(letters):
    rng = np.random.default_rng(letters)
    strings = [rng.integers(256 - letters, 256, rng.integers(W, W + 48)).astype(np.uint8) for _ in range(300)]
    strings += [s[rng.integers(0, 20) :][:W] for s in strings if len(s) >= W + 20] + [np.full(W + 30, 255, np.uint8), np.full(W, 255, np.uint8), np.zeros(W + 5, np.uint8), np.tile(np.array([1, 2], np.uint8), 40)]
    owner = rng.permutation(len(strings)).astype(np.int64)
    best, first = S.least_owner(np.concatenate(strings), np.cumsum([len(s) for s in strings]), owner)
    least = {}
    for s, o in zip(strings, owner):
        for k in range(len(s) - W + 1):
            w = s[k : k + W].tobytes()
            least[w] = min(least.get(w, o), o)
    for i, s in enumerate(strings):
        for k in range(len(s) - W + 1):
            assert best[first[i] + k] == least[s[k : k + W].tobytes()]


def test_equal_strings_share_their_gram():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5_000).astype(np.uint8)
    m = S.smallest_grams(data)
    assert len(m) == len(data) - W + 1
    held = {}
    for k in range(len(m)):
        assert held.setdefault(data[k : k + W].tobytes(), m[k]) == m[k]
