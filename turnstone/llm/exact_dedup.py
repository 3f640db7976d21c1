"""Exact deduplication: binary-fuse filters per immutable snapshot screen incoming digests.

Documents come in numbered batches. Each batch becomes an immutable snapshot whose
distinct digests get a static 3-wise binary-fuse filter, built and probed in shards.
A batch's distinct digests (its own duplicates are grouped first) are screened by the
filters of the snapshots before it: a negative is new for sure, a positive meets that
snapshot's exact bucket, and the texts behind every shared digest are compared.

``exact_dedup`` does so for the numbered batches of one table; ``build_snapshot`` writes a
snapshot that stays, and ``screen`` holds a later batch against any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Staging, join_heavy, read, small

#: Digests a shard of a filter should hold; shards are built and probed one a task.
SHARD_KEYS = 100_000
MIN_SHARDS = 32
#: Repeated digests that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.view(np.uint64) + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(33))) * _C2
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """Three slots in consecutive segments of a power-of-two length."""
    first = ((h >> np.uint64(32)) * np.uint64(seg * count)) >> np.uint64(32)
    mask = np.uint64(seg - 1)
    second = (first + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg)) ^ (h & mask)
    return np.stack([first, second, third], 1).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(16)) ^ (h >> np.uint64(48))).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, 16-bit fingerprints) over distinct int64 keys.

    Peeling runs in rounds over the slots that one key alone still uses; the keys of a
    round don't touch each other's slots, so each round is one vector operation.
    """
    n = len(keys)
    seg = 1 << max(2, min(16, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, int(np.ceil(n * factor / seg)) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        slots = _slots(h, seg, count)
        size = (count + 2) * seg
        used = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        np.bitwise_xor.at(owner, slots.ravel(), np.repeat(np.arange(n), 3))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        free, left = np.flatnonzero(used == 1), n
        while len(free):
            who, at = np.unique(owner[free], return_index=True)
            order.append((who, free[at]))
            left -= len(who)
            gone = slots[who].ravel()
            np.subtract.at(used, gone, 1)
            np.bitwise_xor.at(owner, gone, np.repeat(who, 3))
            gone = np.unique(gone)
            free = gone[used[gone] == 1]
        if left == 0:
            prints = np.zeros(size, np.uint16)
            want = _print(h)
            for who, at in reversed(order):
                prints[at] = 0
                s = slots[who]
                prints[at] = want[who] ^ prints[s[:, 0]] ^ prints[s[:, 1]] ^ prints[s[:, 2]]
            return seed, seg, count, prints
        if seed % 8 == 0:
            count += max(1, count // 10)
    raise RuntimeError("no binary-fuse filter found; keys must be distinct")


def probe_fuse(fuse: tuple[int, int, int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    seed, seg, count, prints = fuse
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
    s = _slots(h, seg, count)
    return _print(h) == (prints[s[:, 0]] ^ prints[s[:, 1]] ^ prints[s[:, 2]])


FILTERS = "shard int, batch int, seed int, seg int, segments int, prints binary"
POSITIVES = "digest binary, batch int, snapshot int"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for batch, part in pdf.groupby("batch"):
        seed, seg, count, prints = build_fuse(np.unique(part["key"].to_numpy(np.int64)))
        rows.append((int(part["shard"].iloc[0]), int(batch), seed, seg, count, prints.tobytes()))
    return pd.DataFrame(rows, columns=["shard", "batch", "seed", "seg", "segments", "prints"])


def _probe(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = []
    keys = incoming["key"].to_numpy(np.int64)
    for f in filters.itertuples():
        later = (incoming["batch"] > f.batch).to_numpy()
        if later.any():
            hit = incoming[later][probe_fuse((f.seed, f.seg, f.segments, np.frombuffer(f.prints, np.uint16)), keys[later])]
            out.append(pd.DataFrame({"digest": hit["digest"], "batch": hit["batch"], "snapshot": f.batch}))
    return pd.concat(out) if out else pd.DataFrame({"digest": [], "batch": [], "snapshot": []})


def _shards(rows: int) -> int:
    return max(MIN_SHARDS, -(-rows // SHARD_KEYS))


def _dealt(digests: DataFrame, shards: int) -> DataFrame:
    """Adds the 64-bit key that filters hold, and its shard."""
    key = F.xxhash64("digest")
    return digests.withColumn("key", key).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def _first() -> Column:
    """Of equal texts the smallest id, null ids last, and of repeated rows with it one."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))).alias("first")


def exact_dedup(docs: DataFrame, batch: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, batch.

    ``batch`` numbers the batch that a row came in (null: 0). Texts are equal when equal
    after white-space normalisation; null is the empty text. The smallest id stays, null
    ids last; of repeated rows with that id exactly one is kept. Different texts of one
    digest are told apart by their bytes. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    scope = Staging(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.coalesce(batch, F.lit(0)).cast("int").alias("batch"))
    slim = scope.write(rows.select("id", "batch", digest_of(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("rid")), "rows")
    total = slim.count()
    # New-batch duplicates are grouped here: one row a batch and digest.
    digests = scope.write(_dealt(slim.groupBy("digest", "batch").agg(_first(), F.count("*").alias("n")), _shards(total)), "digests", slim=True)
    sides = digests.select("shard", "batch", "key", "digest")
    filters = sides.drop("digest").groupBy("shard").applyInPandas(_build, FILTERS)
    positives = sides.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_probe, POSITIVES)
    held = digests.select("digest", F.col("batch").alias("snapshot"))
    shared = scope.write(positives.join(held, ["digest", "snapshot"]).select("digest").distinct(), "shared", slim=True)

    across = digests.join(shared, "digest").groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    alone = digests.join(shared, "digest", "left_anti").where("n > 1").select("digest", "first", "n")
    groups = scope.write(across.unionByName(alone), "groups", slim=True)

    # Byte check: the texts behind each repeated digest, one row for each different text.
    repeated = groups.select("digest")
    texts = rows.select(digest_of(F.col("norm")).alias("digest"), "norm")
    texts = texts.join(F.broadcast(repeated) if small(repeated, BROADCAST_DIGESTS) else repeated, "digest", "left_semi")
    unequal = scope.write(texts.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "unequal", slim=True)
    split = unequal.limit(1).count() > 0
    if split:
        slim, groups = (t.join(unequal, "digest", "left_anti") for t in (slim, groups))

    out = join_heavy(slim, groups, ["digest"], "n", total)
    keep = F.coalesce(F.col("first.id"), F.when(F.col("n").isNull(), F.col("id")))
    columns = [
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "batch",
    ]
    out = out.select(*columns)
    if not split:
        return out
    # Rows behind a digest of several texts are grouped by the text itself.
    vague = scope.write(rows.withColumn("digest", digest_of(F.col("norm"))).join(unequal, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id()), "vague")
    exact = scope.write(vague.groupBy("norm").agg(_first(), F.count("*").alias("n")), "exact", slim=True)
    return out.unionByName(join_heavy(vague, exact, ["norm"], "n", vague.count()).select(*columns))


def build_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes an immutable snapshot: its different texts with their smallest ids, in exact buckets, and the filter of each bucket.

    Null texts count as empty. An existing path is refused; an empty table makes a snapshot
    that holds nothing. The number of buckets follows the number of texts and is kept beside
    them. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows.groupBy(digest_of(F.col("norm")).alias("digest"), "norm").agg(F.min("id").alias("id")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    shards = _shards(texts.count())
    sides = _dealt(texts.select("digest"), shards).select("shard", F.lit(0).alias("batch"), "key").distinct()
    sides.groupBy("shard").applyInPandas(_build, FILTERS).drop("batch").withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")


def screen(docs: DataFrame, snapshots: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of a batch: id, keep_id, group_size, kept, snapshot, held_id.

    ``snapshot`` is the path of the first snapshot that holds the text, with its id there,
    null for a new text; the first row of a new text is ``kept``. Group and keep_id are the
    batch's own. Filters screen the batch's different digests; only positives meet the texts,
    on digest and bytes. Nulls, ties, repeats and empty tables are as in ``exact_dedup``.
    """
    spark = docs.sparkSession
    scope = Staging(spark, "screen")
    src = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = scope.write(src.withColumn("digest", digest_of(F.col("norm"))).withColumn("rid", F.monotonically_increasing_id()), "rows")
    groups = scope.write(rows.groupBy("digest", "norm").agg(_first(), F.count("*").alias("n")), "groups", slim=True)
    held = None
    for at, path in enumerate(snapshots):
        filters = spark.read.parquet(f"{path}/filters")
        some = filters.select("shards").first()
        if some is None:
            continue
        incoming = _dealt(groups.select("digest").distinct(), some.shards).withColumn("batch", F.lit(1))
        positives = incoming.groupBy("shard").cogroup(filters.withColumn("batch", F.lit(0)).groupBy("shard")).applyInPandas(_probe, POSITIVES).select("digest").distinct()
        found = groups.join(positives, "digest", "left_semi").select("digest", "norm").join(spark.read.parquet(f"{path}/texts").withColumnRenamed("id", "held_id"), ["digest", "norm"])
        found = found.select("digest", "norm", F.struct(F.lit(at).alias("at"), F.lit(path).alias("path"), "held_id").alias("held"))
        held = found if held is None else held.unionByName(found)
    if held is None:
        groups = groups.withColumn("held", F.lit(None).cast("struct<at: int, path: string, held_id: bigint>"))
    else:
        groups = scope.write(groups.join(held.groupBy("digest", "norm").agg(F.min("held").alias("held")), ["digest", "norm"], "left"), "held", slim=True)
    out = join_heavy(rows.drop("norm"), groups.drop("norm"), ["digest"], "n", rows.count()) if _one_text(groups) else join_heavy(rows, groups, ["digest", "norm"], "n", rows.count())
    return out.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("first.rid") == F.col("rid")) & F.col("held").isNull()).alias("kept"),
        F.col("held.path").alias("snapshot"),
        F.col("held.held_id").alias("held_id"),
    )


def _one_text(groups: DataFrame) -> bool:
    """Whether no digest stands for several texts, so that the digest alone may join."""
    return groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").limit(1).count() == 0


#: The query's batches, dealt by a hash of the id: any id is a valid one.
BATCHES = 3


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
}
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
