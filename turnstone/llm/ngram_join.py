"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed five-word shingles; equal sets are one class, so copies are
counted before anything is compared. Classes that agree on a band of MinHash values are
candidates. A pair's values are compared a few at a time, and the pair is dropped as soon
as the posterior probability of reaching the threshold falls below a tolerance. What is
left is held together as candidate groups (never as pairs), and within each group the
remaining pairs are verified on the shingle sets themselves. Buckets and groups of any size are
cut into blocks that meet each other in tasks of bounded size, and a task returns counts
and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tokens import mix64, shingles, word_hashes
from ._util import BROADCAST_ROWS, Staging, join_heavy, maybe_broadcast, read, sliced, small
from .components import connected_components

WORDS = 5
THRESHOLD = 0.8
#: Bands of MinHash values: a pair at the threshold shares none with probability 3e-6.
BANDS, BAND_ROWS = 32, 5
VALUES = BANDS * BAND_ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Classes, and shingles, that a block holds.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000

_SALTS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64)).astype(np.uint32)
_FACTORS = (mix64(np.arange(1001, VALUES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for row, h, at in word_hashes(texts):
        s, out = shingles(h, at, WORDS)
        for i in range(len(at) - 1):
            yield row + i, np.unique(s[out[i] : out[i + 1]])


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone; an empty set has zeros."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a, b = np.bitwise_xor.reduce(mix64(s + np.uint64(1))), np.add.reduce(mix64(s ^ np.uint64(0x5DEECE66D)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def minhash(s: np.ndarray) -> bytes:
    """The low 16 bits of the smallest value under each of VALUES permutations of 32-bit hashes."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 512):
            v = (low[i : i + 512, None] ^ _SALTS) * _FACTORS
            np.minimum(best, v.min(0), out=best)
    return (mix64(best.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


@lru_cache(1)
def fewest_matches() -> tuple[tuple[int, int], ...]:
    """(values compared, fewest agreeing values a pair needs to go on).

    With a uniform prior, after m agreements in n values the posterior probability of a
    similarity of at least t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Indices of the rows of ``others`` whose posterior stays above the tolerance."""
    left = np.arange(len(others))
    agree = np.zeros(len(others), np.int64)
    at = 0
    for n, least in fewest_matches():
        agree = agree + (others[left, at:n] == one[at:n]).sum(1)
        go = agree >= least
        left, agree, at = left[go], agree[go], n
        if not len(left):
            break
    return left


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading key columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _halves(t: pa.Table, block: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the group's first and second block; the same rows where a block meets itself."""
    lo, hi, own = t["lo"][0].as_py(), t["hi"][0].as_py(), t[block].to_numpy()
    return np.flatnonzero(own == lo), np.flatnonzero(own == hi)


def _blocked(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deals the rows of a key to its pairs of blocks; most keys have one block and each row one task."""
    own = F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
    dealt = df.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "x")).withColumn("hi", F.greatest("own", "x")).drop("x", blocks)
    first = [key, "lo", "hi"]
    return dealt.select(*first, *[c for c in dealt.columns if c not in first]).repartition(*first).sortWithinPartitions(*first)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket task, a spanning forest of the pairs that survive."""
    for t in _groups(batches, 3):
        cid = t["cid"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, VALUES)
        left, right = _halves(t, "own")
        same = t["lo"][0].as_py() == t["hi"][0].as_py()
        forest = _Forest(len(cid))
        for i, a in enumerate(left):
            others = right[i + 1 :] if same else right
            for b in others[survivors(sig[a], sig[others])]:
                forest.join(int(a), int(b))
        edges = [(cid[forest.root(x)], cid[x]) for x in range(len(cid)) if forest.root(x) != x]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right sets: products of 0/1 columns, some thousand shingles at a time."""
    both = np.union1d(left, right)
    flat = np.concatenate([sets[x] for x in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[x]) for x in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    li, ri = np.searchsorted(both, left), np.searchsorted(both, right)
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(both), width), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += dense[li] @ dense[ri].T
    return out


VERIFIED = "a long, b long, texts long, documents long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: how many classes and documents each class links to, and a spanning forest of the links."""
    for t in _groups(batches, 3):
        cid, copies, n = t["cid"].to_numpy(), t["copies"].to_numpy(), t["n"].to_numpy()
        left, right = _halves(t, "own")
        same = t["lo"][0].as_py() == t["hi"][0].as_py()
        if not len(left) or not len(right) or (same and len(left) < 2):
            continue
        sets = [np.frombuffer(b, np.uint64) for b in t["sets"].to_pylist()]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, VALUES)
        overlap = None
        if len(left) > 4 or len(right) > 4:
            overlap = _overlaps(sets, left, right)
        forest = _Forest(len(cid))
        texts, documents = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64)
        for i, a in enumerate(left):
            at = np.arange(i + 1, len(right)) if same else np.arange(len(right))
            at = at[survivors(sig[a], sig[right[at]])]
            if not len(at):
                continue
            common = overlap[i, at] if overlap is not None else np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in right[at]])
            b = right[at][common >= THRESHOLD * (n[a] + n[right[at]] - common) - 1e-9]
            texts[a] += len(b)
            documents[a] += copies[b].sum()
            texts[b] += 1
            documents[b] += copies[a]
            for x in b:
                forest.join(int(a), int(x))
        rows = [(cid[x], None, texts[x], documents[x]) for x in np.flatnonzero(texts)]
        rows += [(cid[forest.root(x)], cid[x], None, None) for x in range(len(cid)) if forest.root(x) != x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a", "b", "texts", "documents"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = batch.num_rows
        k1, k2, n, sig = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int32), [b""] * rows
        memo: dict[tuple[int, int], bytes] = {}
        for r, s in shingle_sets(batch.column(1)):
            key = k1[r], k2[r] = set_key(s)
            n[r] = len(s)
            if key not in memo:
                memo[key] = minhash(s) if len(s) else b""
            sig[r] = memo[key]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1), pa.array(k2), pa.array(n), pa.array(sig, pa.binary())], names=["id", "k1", "k2", "n", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        keys, sets = [], []
        for _, s in shingle_sets(batch.column(0)):
            keys.append(set_key(s))
            sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sets, pa.binary())], names=["k1", "k2", "sets"])


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Staging]:
    """One row per input row: id, k1, k2, rid, copies, class_id, kept, texts, links.

    ``class_id`` is the smallest id among the documents that links connect; ``links`` are
    the other documents at a Jaccard similarity of THRESHOLD or more (copies included),
    ``texts`` the different shingle sets among these. One row of each class is ``kept``:
    that of the smallest id (null ids last). Texts without a word, null ones too, are one
    class of copies. Texts of under WORDS words are one shingle. Repeated rows are copies
    of each other; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scope = Staging(spark, "ngram-join")
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = scope.write(src.mapInArrow(_signed, "id long, k1 long, k2 long, n int, sig binary").withColumn("rid", F.monotonically_increasing_id()), "rows")
    slim = rows.select("id", "k1", "k2", "n", "rid")
    total = slim.count()
    head = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))).alias("head")
    classes = scope.write(rows.groupBy("k1", "k2").agg(head, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()), "classes", slim=True)

    # Buckets: bands that several classes share. Bands with the same members are one bucket.
    width = 2 * BAND_ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {b * width + 1}, {width})")) for b in range(BANDS)])
    dealt = classes.where("n > 0").select("cid", F.explode(bands).alias("band"))
    members = dealt.groupBy("band").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("h1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("h2")).where("m > 1")
    buckets = scope.write(members.groupBy("m", "h1", "h2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "buckets", slim=True)
    met = dealt.join(maybe_broadcast(buckets), "band")
    signed = met.join(classes.select("cid", "sig"), "cid")
    candidates = _blocked(signed, "band", "blocks").mapInArrow(_prune, "a long, b long")
    groups = scope.write(connected_components(candidates, scope).select(F.col("node").alias("cid"), "component"), "groups", slim=True)

    # The shingle sets of the classes in a group, once each.
    wanted = scope.write(classes.join(groups, "cid").select("cid", "component", "k1", "k2", "n", "copies", "sig", F.col("head.id").alias("head_id")), "wanted", slim=True)
    ids = wanted.select(F.col("head_id").alias("id")).distinct()
    ids = F.broadcast(ids) if small(ids, 10 * BROADCAST_ROWS) else ids
    sets = src.join(ids, src["id"].eqNullSafe(ids["id"]), "left_semi").select("text").mapInArrow(_sets, "k1 long, k2 long, sets binary")
    sizes = wanted.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    full = wanted.join(sets, ["k1", "k2"]).dropDuplicates(["cid"]).join(sizes, "component").select("component", "cid", "n", "copies", "sig", "sets", "blocks")
    verified = scope.write(_blocked(full, "component", "blocks").mapInArrow(_verify, VERIFIED), "verified", slim=True)
    counts = verified.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    linked = connected_components(verified.where("b is not null").select("a", "b"), scope).withColumnRenamed("node", "cid")

    named = linked.join(classes.select("cid", "head"), "cid").groupBy("component").agg(F.min("head").alias("first"))
    info = classes.select("cid", "k1", "k2", "head", "copies").join(linked.join(named, "component").select("cid", "first"), "cid", "left").join(counts, "cid", "left")
    info = scope.write(info.where("copies > 1 or first is not null").select("k1", "k2", "copies", F.coalesce("first", "head").alias("first"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("documents", F.lit(0)).alias("documents")), "info", slim=True)
    out = join_heavy(slim, info, ["k1", "k2"], "copies", total)
    alone = F.col("copies").isNull()
    return out.select(
        "id", "k1", "k2", "rid",
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        (alone | (F.col("first.rid") == F.col("rid"))).alias("kept"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("texts"),
        F.coalesce(F.col("documents") + F.col("copies") - 1, F.lit(0)).cast("long").alias("links"),
    ), scope


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each similarity class, with the columns it had."""
    found, scope = similarity_classes(docs, id_col, text_col)
    found = scope.write(found.select("id", "k1", "k2", "kept"), "kept", slim=True)
    # Ids that don't name one row (null, repeated) are told apart by their texts.
    shared = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    blank = found.where("id is null").limit(1).count() > 0
    some = shared.limit(1).count() > 0
    lost = found.where("not kept and id is not null").select("id").distinct()
    drop = lost.join(shared, "id", "left_anti") if some else lost
    drop = F.broadcast(drop) if small(drop, 10 * BROADCAST_ROWS) else drop
    plain = docs.where(F.col(id_col).isNotNull()).join(drop, F.col(id_col).cast("long") == drop["id"], "left_anti")
    if some:
        plain = plain.join(shared, F.col(id_col).cast("long") == shared["id"], "left_anti")
    if not (some or blank):
        return plain
    vague = docs.where(F.col(id_col).isNull())
    if some:
        vague = vague.unionByName(docs.join(shared, F.col(id_col).cast("long") == shared["id"], "left_semi"))
    at = vague.columns.index(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = [set_key(s) for _, s in shingle_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=[*batch.schema.names, "_k1", "_k2"])

    schema = T.StructType([*vague.schema.fields, T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType())])
    marked = vague.mapInArrow(keyed, schema)
    stay = found.where("kept")
    stay = marked.join(stay, marked[id_col].cast("long").eqNullSafe(stay["id"]) & (marked["_k1"] == stay["k1"]) & (marked["_k2"] == stay["k2"]), "left_semi")
    return plain.unionByName(stay.dropDuplicates([id_col, "_k1", "_k2"]).drop("_k1", "_k2"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, scope = similarity_classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("links").alias("n_links"), F.col("texts").alias("n_text_links"), "copies", "kept")


ORACLE: dict[str, str] = {}
QUERIES = {"op7_ngram_join": op7_ngram_join}
