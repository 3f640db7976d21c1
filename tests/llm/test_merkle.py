"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnstone.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(hashes):
    """(root, each leaf's steps of (left, right) siblings)."""
    steps, place, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for leaf, at in enumerate(place):
            run = runs[at // 8]
            steps[leaf].append((run[: at % 8], run[at % 8 + 1 :]))
            place[leaf] = at // 8
        level = [H(*r) for r in runs]
    return level[0], steps


def plain(rows):
    trees = defaultdict(list)
    for r in rows:
        i, source, lang, n, text = r[:5]
        leaf = plain_leaf((i, source, lang, n, text))
        used = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
            used = plain_leaf((i, source, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        trees[lang].append((i is not None, i or 0, leaf, used, i))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: (sorted(trees[t]), *plain_tree([x[2] for x in sorted(trees[t])])) for t in names}
    root, tops = plain_tree([made[t][1] for t in names])
    out = []
    for t, top in zip(names, tops):
        leaves, subroot, steps = made[t]
        for (_, _, leaf, used, i), path in zip(leaves, steps):
            at, proof = used, []
            for left, right in [*path, *top]:
                proof += [*left, *right]
                at = H(*left, at, *right)
            out.append((i, leaf, subroot, root, H(*proof), at, at == root))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def proved(docs):
    lowered = M.fields_hash([F.translate("text", M.UPPER, M.LOWER) if f == "text" else F.col(f) for f in M.FIELDS])
    return M.prove(docs, "lang", "doc_id", M.FIELDS, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9, 64, 1], [65, 513, 7], [4097, 4096, 600], [3] * 75])
def test_trees_of_any_size_against_plain_version(spark, sizes):
    rng = random.Random(len(sizes))
    rows = []
    for t, n in enumerate(sizes):
        rows += [(rng.randrange(-50, 10 * n), "s" if i % 4 else None, None if t == 0 else f"é{t}", i if i % 5 else None, rng.choice(["Aé", "B x", "", "low", None]), 1, "x") for i in range(n)]
    rows += [rows[0], rows[0]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(proved(docs)) == plain(rows)


def test_null_ids_and_long_texts(spark):
    rows = [(None, None, None, None, None, 1, "x"), (None, "s", "en", 3, "A" * 300_000, 1, "x"), (5, "s", "en", 3, "tEXT", 1, "x"), (5, "s", "en", 3, "tEXT", 1, "x"), (5, "s", "en", 3, "text", 1, "x")]
    assert rows_of(proved(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert proved(none).count() == 0
    assert all(t.count() == 0 for t in M.manifest(none, "lang", "doc_id", M.FIELDS).values())


def test_documents_against_plain_version_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*M.FIELDS[:1], "source", "lang", "n_chars", "text").collect()]
    got = rows_of(M.op13_merkle(spark, sf_dir))
    assert got == plain(rows)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(M.ORACLE["op13_merkle"]).fetchall()
    assert got == Counter(want)


@pytest.mark.parametrize("cuts", [[], [1], [3, 5], [8, 9, 64, 71], list(range(1, 600, 7)), list(range(600))])
def test_stretches_cut_anywhere_give_all_nodes_once(spark, cuts):
    """Whatever the tasks' shares of the leaves, complete nodes and edges together make one tree."""
    hashes = [H(str(i)) for i in range(600)]
    nodes, edges = Counter(), {}
    at = [0, *cuts, 600]
    for a, b in zip(at, at[1:]):
        batch = pa.RecordBatch.from_arrays([pa.array(["t"] * (b - a)), pa.array(range(a, b), pa.int64()), pa.array(hashes[a:b])], names=["tree", "pos", "hash"])
        for out in M._climb(iter([batch])):
            for tree, level, pos, hash_, edge in zip(*(c.to_pylist() for c in out.columns)):
                nodes[level, pos] += 1
                edges[level, pos] = (hash_, edge)
    assert set(nodes.values()) <= {1}
    level = hashes
    for depth in range(4):
        for pos, h in enumerate(level):
            if (depth, pos) in edges:
                assert edges[depth, pos][0] == h
        full = {(depth + 1, p) for p in range(len(level) // 8)}
        for key in full & set(edges):
            assert not any(edges[depth, key[1] * 8 + i][1] for i in range(8) if (depth, key[1] * 8 + i) in edges)
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]


def test_saved_manifest_names_the_changed_rows(spark, tmp_path):
    rows = [(i, "s", "en" if i % 3 else "fr", 1, f"Text {i}", 1, "x") for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "manifest")
    M.save_manifest(M.manifest(docs, "lang", "doc_id", M.FIELDS), path)
    assert M.changed_rows(docs.repartition(7), path, "lang", "doc_id", M.FIELDS).count() == 0
    rows[3] = (3, "s", "fr", 1, "Text, changed", 1, "x")
    del rows[10]
    rows.append((9_000, "s", None, 1, None, 1, "x"))
    got = {tuple(r) for r in M.changed_rows(spark.createDataFrame(rows, SCHEMA), path, "lang", "doc_id", M.FIELDS).collect()}
    assert got == {("fr", 3, "changed"), ("en", 10, "removed"), (None, 9_000, "added")}
