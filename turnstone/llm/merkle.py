"""Merkle dataset manifest: one tree of base-8 runs per partition value, and one over their roots.

Leaves are numbered by partition and id. Each task walks its stretch of numbered leaves
with a mountain-range stack: a level that has eight aligned nodes carries one parent to the
next. What a stretch cannot complete (the runs that begin before it or end after it) is
left on the stack as edges; these are merged level by level across tasks, where short last
runs are hashed as they are, without padding. Proofs are read off blocks of 8^4 leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import number_rows
from ._util import Staging, maybe_broadcast, read, sliced

BITS = 3
FANOUT = 1 << BITS
#: Levels of a block: proofs are made for 8^4 leaves at a time.
BLOCK_LEVELS = 4


def fields_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _digest(texts: Sequence[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


NODES = "tree string, level int, pos bigint, hash string, edge boolean"


class Mountain:
    """The stack of one stretch of leaves: for each level the nodes of its open run."""

    def __init__(self, tree: str | None, pos: int, emit: Callable[[tuple], None]):
        self.tree, self.next, self.emit = tree, pos, emit
        self.open: list[list[tuple[int, str]]] = [[]]

    def push(self, hash_: str) -> None:
        level, pos = 0, self.next
        self.next += 1
        while True:
            if level == len(self.open):
                self.open.append([])
            run = self.open[level]
            run.append((pos, hash_))
            if (pos + 1) % FANOUT:
                return
            self.open[level] = []
            if len(run) < FANOUT:  # began before this stretch
                self._leave(level, run, True)
                return
            if level:
                self._leave(level, run, False)
            level, pos, hash_ = level + 1, pos // FANOUT, _digest([h for _, h in run])

    def close(self) -> None:
        """Leaves what no run of this stretch completes."""
        for level, run in enumerate(self.open):
            self._leave(level, run, True)

    def _leave(self, level: int, run: list[tuple[int, str]], edge: bool) -> None:
        for pos, hash_ in run:
            self.emit((self.tree, level, pos, hash_, edge))


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that are complete within consecutive leaves (tree, pos, hash), and edges; leaves are emitted as edges only."""
    out: list[tuple] = []
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    stack: Mountain | None = None
    for part in sliced(batches, 10_000):
        for tree, pos, hash_ in zip(*(c.to_pylist() for c in part.columns)):
            if stack is None or stack.tree != tree or stack.next != pos:
                if stack is not None:
                    stack.close()
                stack = Mountain(tree, pos, out.append)
            stack.push(hash_)
        yield batch()
    if stack is not None:
        stack.close()
    yield batch()


@dataclass
class Forest:
    """Trees over numbered leaves: all nodes above the leaves, and (tree, n, hash) of each root."""

    nodes: DataFrame
    roots: DataFrame
    depth: int


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plant(leaves: DataFrame, scope: Staging) -> Forest:
    """The trees of leaves (tree, pos, hash) with positions 0 to n-1 in each tree, n over 0."""
    climbed = scope.write(leaves.select("tree", "pos", "hash").mapInArrow(_climb, NODES), "climbed")
    sizes = scope.write(leaves.groupBy("tree").agg(F.count("*").alias("n")), "sizes", slim=True)
    most = sizes.agg(F.max("n")).first()[0] or 0
    depth = 0
    while most > FANOUT**depth:
        depth += 1
    known = maybe_broadcast(sizes.withColumnRenamed("tree", "_tree"))
    # (tree, pos, hash) at the level that is merged next; trees of one node are ready.
    edges = climbed.where("edge AND level = 0").select("tree", "pos", "hash")
    merged, ready = [], []
    for level in range(depth + 1):
        width = F.ceil(F.col("n") / F.lit(FANOUT**level))
        held = edges.join(known, _same("tree", "_tree")).drop("_tree")
        ready.append(held.where(width == 1).select("tree", "n", "hash"))
        if level == depth:
            break
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]), "")
        above = held.where(width > 1).groupBy("tree", F.shiftright("pos", BITS).alias("pos")).agg(F.sha2(run, 256).alias("hash"))
        above = scope.write(above, f"merged{level + 1}", slim=True)
        merged.append(above.select("tree", F.lit(level + 1).alias("level"), "pos", "hash"))
        edges = above.unionByName(climbed.where(F.col("edge") & (F.col("level") == level + 1)).select("tree", "pos", "hash"))
    nodes = climbed.where("level > 0").drop("edge")
    for m in merged:
        nodes = nodes.unionByName(m)
    roots = ready[0]
    for r in ready[1:]:
        roots = roots.unionByName(r)
    return Forest(scope.write(nodes, "nodes", slim=True), scope.write(roots, "roots", slim=True), depth)


def _paths(forest: Forest, leaves: DataFrame, above: DataFrame, down_to: int) -> DataFrame:
    """(tree, pos, path, rest) of the nodes at a level: the runs from there up to the root, then ``rest`` of ``above`` (tree, rest).

    A run is (own place, hashes). Going down, every node joins its parent, which has at
    most eight children, so no key is hot.
    """
    empty = F.array().cast("array<struct<own: int, run: array<string>>>")
    path = None
    for level in range(max(forest.depth, down_to), down_to - 1, -1):
        # Roots that stand at this level have an empty path; at the lowest, those from below it too.
        here = forest.roots.where(F.col("n") <= FANOUT**level)
        here = here.where(F.col("n") > FANOUT ** (level - 1)) if level > down_to else here
        tops = here.join(maybe_broadcast(above.withColumnRenamed("tree", "_t")), _same("tree", "_t")).select("tree", F.lit(0).cast("bigint").alias("pos"), empty.alias("path"), "rest", "n")
        if path is None:
            path = tops
            continue
        nodes = forest.nodes.where(F.col("level") == level).drop("level") if level else leaves.select("tree", "pos", "hash")
        runs = nodes.groupBy(F.col("tree").alias("_t"), F.shiftright("pos", BITS).alias("_p")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("run"))
        # Trees whose root stands here have a node but no run at this level.
        down = path.join(runs, _same("tree", "_t") & (F.col("pos") == F.col("_p"))).select("tree", "path", "rest", "n", F.transform("run", lambda x: x["hash"]).alias("run"), F.posexplode("run").alias("own", "node"))
        step = F.struct(F.col("own"), F.col("run"))
        path = tops.unionByName(down.select("tree", F.col("node.pos").alias("pos"), F.concat(F.array(step), "path").cast("array<struct<own: int, run: array<string>>>").alias("path"), "rest", "n"))
    return path


PROVED = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(rows: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of a block, from the block's nodes and the path above it."""
    top = rows[rows["kind"] == 2].iloc[0]
    nodes = rows[rows["kind"] == 1]
    leaves = rows[rows["kind"] == 0].sort_values("pos", kind="stable")
    first, n = int(leaves["pos"].iloc[0]), int(top["n"])
    levels = [leaves["hash"].tolist()]
    for level in range(1, BLOCK_LEVELS):
        levels.append(nodes[nodes["level"] == level].sort_values("pos")["hash"].tolist())
    # Levels above a tree's root have no runs.
    levels = [x for k, x in enumerate(levels) if n > FANOUT**k]
    above = [(x["own"], list(x["run"])) for x in [*top["path"], *top["rest"]]]
    assert first % FANOUT**BLOCK_LEVELS == 0

    def siblings(own: int, run: list[str]) -> tuple[str, str]:
        return "".join(run[:own]), "".join(run[own + 1 :])

    outer = [siblings(own, run) for own, run in above]
    tails: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def steps(level: int, i: int) -> list[tuple[str, str]]:
        """What stands left and right of node ``i`` and of its parents."""
        if level >= len(levels):
            return outer
        if (level, i) not in tails:
            base = i - i % FANOUT
            tails[level, i] = [siblings(i - base, levels[level][base : base + FANOUT]), *steps(level + 1, i // FANOUT)]
        return tails[level, i]

    root, proofs, folded = top["root"], [], []
    for i, (hash_, other) in enumerate(zip(leaves["hash"], leaves["other"])):
        path = steps(0, i)
        proofs.append(hashlib.sha256("".join([x + y for x, y in path]).encode()).hexdigest())
        at = hash_ if other is None else other
        for x, y in path:
            at = hashlib.sha256((x + at + y).encode()).hexdigest()
        folded.append(at)
    out = pd.DataFrame({"id": leaves["id"], "leaf": leaves["hash"], "subroot": top["hash"], "root": root, "proof_sha256": proofs, "folded_root": folded})
    out["verified"] = out["folded_root"] == root
    return out


def hashed_leaves(docs: DataFrame, by: str, order: str, fields: Sequence[str], scope: Staging, other: Column | None = None) -> DataFrame:
    """(id, tree, hash, other, pos): the leaves, numbered in ``order`` within each value of ``by``.

    Rows of one id are numbered by their hashes; rows that repeat in every field are equal leaves.
    """
    other = F.lit(None).cast("string") if other is None else other
    slim = docs.select(F.col(order).alias("id"), F.col(by).cast("string").alias("tree"), fields_hash([F.col(f) for f in fields]).alias("hash"), other.alias("other"))
    return number_rows(scope.write(slim, "leaves"), ["id", "hash"], ["tree"], "pos", f"{scope.path}/numbered")


def _crown(forest: Forest, scope: Staging) -> tuple[Forest, DataFrame]:
    """The tree over the roots, in order of their trees' names, and its leaves."""
    tops = number_rows(forest.roots.select("tree", "hash"), ["tree"], (), "pos", f"{scope.path}/tops").withColumnRenamed("tree", "name").withColumn("tree", F.lit("root"))
    return plant(tops, scope), tops


def manifest(docs: DataFrame, by: str, order: str, fields: Sequence[str]) -> dict[str, DataFrame]:
    """The manifest's tables: leaves (id, tree, pos, hash), nodes (tree, level, pos, hash), subroots (tree, n, hash), root (hash).

    Null field values and null trees are values of their own; texts of any length are
    hashed where they are read. An empty table has an empty manifest.
    """
    scope = Staging(docs.sparkSession, "manifest")
    leaves = hashed_leaves(docs, by, order, fields, scope)
    if leaves.limit(1).count() == 0:
        none = docs.sparkSession.createDataFrame([], "tree string, level int, pos bigint, n bigint, hash string")
        return {"leaves": leaves.drop("other"), "nodes": none.drop("n"), "subroots": none.select("tree", "n", "hash"), "root": none.select("hash")}
    forest = plant(leaves, scope)
    crown, _ = _crown(forest, scope)
    return {"leaves": leaves.drop("other"), "nodes": forest.nodes, "subroots": forest.roots, "root": crown.roots.select("hash")}


def save_manifest(tables: dict[str, DataFrame], path: str) -> None:
    """Writes a manifest; its root, one row, is written last and makes it complete."""
    for name in ("leaves", "nodes", "subroots", "root"):
        tables[name].write.parquet(f"{path}/{name}")


def changed_rows(docs: DataFrame, path: str, by: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(tree, id, status): rows added, removed or changed against a saved manifest; none if the data are as they were.

    Only trees whose roots differ are compared, by id; rows that repeat an id are compared by
    their hashes, where an id counts as changed if its hashes are not the same ones.
    """
    spark = docs.sparkSession
    new = manifest(docs, by, order, fields)
    a, b = spark.read.parquet(f"{path}/subroots"), new["subroots"].select(F.col("tree").alias("_t"), F.col("hash").alias("_h"))
    differ = a.join(b, _same("tree", "_t"), "full").where(~_same("hash", "_h")).select(F.coalesce("tree", "_t").alias("_tree"))

    def side(leaves: DataFrame, name: str) -> DataFrame:
        rows = leaves.join(maybe_broadcast(differ), _same("tree", "_tree"), "left_semi")
        return rows.groupBy(F.col("tree").alias(f"{name}t"), F.col("id").alias(f"{name}i")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("hash"))), 256).alias(f"{name}h"), F.lit(True).alias(name))

    both = side(spark.read.parquet(f"{path}/leaves"), "x").join(side(new["leaves"], "y"), _same("xt", "yt") & _same("xi", "yi"), "full").where(~_same("xh", "yh"))
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("xt", "yt").alias("tree"), F.coalesce("xi", "yi").alias("id"), status.alias("status"))


def prove(docs: DataFrame, by: str, order: str, fields: Sequence[str], other: Column | None = None) -> DataFrame:
    """One row per row: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    The root is folded anew from the leaf, or from the hash ``other`` where that isn't null
    (a tampered row's), and the leaf's siblings. Null ids, trees and texts are values of
    their own; repeated rows are leaves of their own; an empty table gives an empty result.
    Columns other than ``by``, ``order`` and the fields are ignored.
    """
    scope = Staging(docs.sparkSession, "prove")
    leaves = hashed_leaves(docs, by, order, fields, scope, other)
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, {PROVED}"
    if leaves.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", order)
    forest = plant(leaves, scope)
    crown, tops = _crown(forest, scope)
    rest = _paths(crown, tops, crown.roots.select("tree", F.lit(0).alias("rest")), 0).select("pos", F.col("path").alias("rest"))
    rest = scope.write(tops.join(rest, "pos").select(F.col("name").alias("tree"), "rest"), "rest", slim=True)
    blocks = _paths(forest, leaves, rest, BLOCK_LEVELS)
    roots = forest.roots.select(F.col("tree").alias("_t"), "hash", F.lit(crown.roots.first()["hash"]).alias("root"))
    blocks = blocks.join(maybe_broadcast(roots), _same("tree", "_t")).select(
        "tree", F.col("pos").alias("block"), F.lit(2).alias("kind"), F.lit(None).cast(kind).alias("id"), F.lit(BLOCK_LEVELS).alias("level"), "pos", "hash", F.lit(None).cast("string").alias("other"), "n", "path", "rest", "root"
    )
    null = lambda c: F.lit(None).cast(blocks.schema[c].dataType).alias(c)
    nothing = [null(c) for c in ("n", "path", "rest", "root")]
    own = leaves.select("tree", F.shiftright("pos", BITS * BLOCK_LEVELS).alias("block"), F.lit(0).alias("kind"), "id", F.lit(0).alias("level"), "pos", "hash", "other", *nothing)
    inner = F.expr(f"shiftright(pos, {BITS} * ({BLOCK_LEVELS} - level))")
    nodes = forest.nodes.where(F.col("level") < BLOCK_LEVELS).select("tree", inner.alias("block"), F.lit(1).alias("kind"), null("id"), "level", "pos", "hash", null("other"), *nothing)
    rows = own.unionByName(nodes).unionByName(blocks)
    return rows.groupBy("tree", "block").applyInPandas(_prove, schema).withColumnRenamed("id", order)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lowered = fields_hash([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered)
    return prove(docs, "lang", "doc_id", FIELDS, tampered)


ORACLE = {
    "op13_merkle": r"""
WITH RECURSIVE
d AS (SELECT *, row_number() OVER () AS rid FROM documents),
h AS (SELECT rid, doc_id, lang, text,
  sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc FROM d),
leaves AS (SELECT *, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS used, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS hash, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, n, pos // 8),
subroots AS (SELECT lang, hash AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS level, place AS pos, subroot AS hash, trees AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, n, pos // 8),
-- Each leaf's runs from itself to the root: what stands left and right of its own path.
path AS (
  SELECT l.rid, x.level, x.level AS step, l.pos // (8 ** x.level)::BIGINT AS own, x.pos, x.hash FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1 AND x.pos // 8 = l.pos // (8 ** (x.level + 1))::BIGINT
  UNION ALL
  SELECT l.rid, 100 + x.level, s.height + x.level, s.place // (8 ** x.level)::BIGINT, x.pos, x.hash FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN crown x ON x.n > 1 AND x.pos // 8 = s.place // (8 ** (x.level + 1))::BIGINT),
runs AS (SELECT rid, level, step, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS lft, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS rgt FROM path GROUP BY rid, level, step),
proofs AS (SELECT rid, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof_sha256 FROM runs GROUP BY rid),
folded AS (
  SELECT rid, 0 AS step, used AS hash FROM leaves
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(r.lft || f.hash || r.rgt) FROM folded f JOIN runs r ON r.rid = f.rid AND r.step = f.step),
tops AS (SELECT rid, arg_max(hash, step) AS folded_root FROM folded GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, c.hash AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, t.folded_root, t.folded_root = c.hash AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN crown c ON c.n = 1 JOIN tops t ON t.rid = l.rid LEFT JOIN proofs p ON p.rid = l.rid
"""
}
QUERIES = {"op13_merkle": op13_merkle}
