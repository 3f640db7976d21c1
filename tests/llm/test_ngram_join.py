import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

from turnstone.llm import ngram_join as G
from turnstone.llm._util import Staging
from turnstone.llm.components import connected_components


def brute(rows):
    """(class ids, links) of (id, text) rows over an inverted index of shingles."""
    sets = dict(G.shingle_sets(pa.array([t for _, t in rows], pa.string())))
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    common = Counter()
    for at in index.values():
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                common[at[a], at[b]] += 1
    blank = [i for i, s in sets.items() if not len(s)]
    links = [(a, b) for (a, b), n in common.items() if n >= G.THRESHOLD * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    links += [(a, b) for k, a in enumerate(blank) for b in blank[k + 1 :]]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = Counter()
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        parent[max(root(a), root(b))] = min(root(a), root(b))
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[root(i)].append(d)
    first = lambda ids: min((d for d in ids if d is not None), default=None)
    return [first(members[root(i)]) for i in range(len(rows))], [degree[i] for i in range(len(rows))], len(members)


def corpus(seed, families=12, copies=12):
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = prose(40)
    rows = []
    for _ in range(families):
        base = prose(rng.choice([3, 20, 120, 300]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = "x"
            if rng.random() < 0.3:
                w += passage
            rows.append((len(rows), " ".join(w)))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "c", 0) for d, t in rows], "doc_id long, text string, k1 string, copies int")
    found, _ = G.similarity_classes(docs)
    got = Counter((r.id, r.class_id, r.links) for r in found.collect())
    classes, links, n = brute(rows)
    assert got == Counter((d, c, k) for (d, _), c, k in zip(rows, classes, links))
    kept = G.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == n == found.where("kept").count()


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_blocks_meet_each_other(spark, monkeypatch):
    # Small blocks: every bucket and group is split; closures read the module's values when they are built.
    monkeypatch.setattr(G, "BLOCK", 3)
    monkeypatch.setattr(G, "BLOCK_SHINGLES", 300)
    check(spark, corpus(2, 6, 25))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a"), (5, "A!"), (6, "a b c d e"), (7, "long word " * 60_000), (8, "long word " * 60_000), (None, "a b c d e"), (None, None), (6, "a b c d e"), (9, "other words"), (9, "a")]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert G.similarity_classes(empty)[0].count() == 0 and G.drop_near_duplicates(empty).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = kept_low = 0
    for _ in range(300):
        size = 400
        common = int(round(size * 2 * 0.82 / 1.82))
        base = rng.integers(0, 2**63, size * 2 - common, dtype=np.uint64)
        a, b = np.unique(base[:size]), np.unique(base[size - common :])
        sa, sb = (np.frombuffer(G.minhash(x), np.uint16) for x in (a, b))
        lost += not len(G.survivors(sa, sb[None, :]))
        c = np.unique(np.concatenate([base[: size // 2], rng.integers(0, 2**63, size // 2, dtype=np.uint64)]))
        kept_low += len(G.survivors(sa, np.frombuffer(G.minhash(c), np.uint16)[None, :]))
    assert lost == 0 and kept_low == 0
    assert all(a[1] < b[1] for a, b in zip(G.fewest_matches(), G.fewest_matches()[1:]))


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(base[:2000]), np.unique(base[500:2500])
    sa, sb = (np.frombuffer(G.minhash(x), np.uint16) for x in (a, b))
    assert abs((sa == sb).mean() - 1500 / 2500) < 0.12


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5)]
    scope = Staging(spark, "test")
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scope).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), scope).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    classes, links, _ = brute(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in G.op7_ngram_join(spark, sf_dir).collect()}
    assert got == {d: (c, k) for (d, _), c, k in zip(rows, classes, links)}
