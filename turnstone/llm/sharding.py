"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A document draws an exponential at every region, of the region's summed weight, and goes
to the smallest; there it draws at the region's racks only, and then at the rack's shards.
A node's draw depends on the document and the node's name, so a changed weight moves
documents only into or out of the subtree that holds it. A shard that is added opens a
region of its own: documents move into that region and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import number_rows
from ._util import Staging, draw, fresh, read

#: Equal rows that one generator row makes; more are made from several rows, dealt to several tasks.
RUN = 10_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int) -> list[Leaf]:
    """Shards in order, with about as many shards a rack as racks a region and regions."""
    side = 1
    while side**3 < shards:
        side += 1
    return [Leaf(s // side**2, s // side % side, s) for s in range(shards)]


def grow(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own."""
    return [*leaves, Leaf(max((x.region for x in leaves), default=-1) + 1, 0, max((x.shard for x in leaves), default=-1) + 1, weight)]


Path = tuple[int, ...]


def levels(leaves: Sequence[Leaf]) -> list[dict[Path, dict[int, float]]]:
    """For each level, the children's names and summed weights of every node above it; nodes without weight are left out."""
    out: list[dict[Path, dict[int, float]]] = [{}, {}, {}]
    for x in leaves:
        path = (x.region, x.rack, x.shard)
        for depth in range(3) if x.weight > 0 else ():
            children = out[depth].setdefault(path[:depth], {})
            children[path[depth]] = children.get(path[depth], 0.0) + x.weight
    if not out[0]:
        raise ValueError("a tree needs a shard of positive weight")
    return out


def _drawn(seed: str, key: Column, above: list[Column], children: dict[Path, dict[int, float]]) -> Column:
    """The child with the smallest draw among those of the node that ``above`` names.

    As many draws as a node has children at most: the i-th child's name and weight come from
    constant arrays, at the node's place.
    """
    nodes = sorted(children)
    width = max(len(c) for c in children.values())
    cells = [(sorted(children[n].items()) + [(None, None)] * width)[:width] for n in nodes]
    if above:
        place = F.element_at(F.create_map(*[y for i, n in enumerate(nodes) for y in (F.lit("/".join(map(str, n))), F.lit(i))]), F.concat_ws("/", *above))
    draws = []
    for i in range(width):
        if above:
            name = F.get(F.array(*[F.lit(c[i][0]).cast("int") for c in cells]), place)
            weight = F.get(F.array(*[F.lit(c[i][1]).cast("double") for c in cells]), place)
        else:
            name, weight = (F.lit(x) for x in cells[0][i])
        d = -F.ln(draw(seed, F.lit(len(above)), *above, name, key)) / weight
        draws.append(F.when(weight.isNotNull(), F.struct(d.alias("d"), name.alias("n"))))
    return (draws[0] if width == 1 else F.least(*draws))["n"].cast("int")


def descend(docs: DataFrame, key: Column, leaves: Sequence[Leaf], column: str, seed: str = "shard") -> DataFrame:
    """Adds the shard of a key: region, then rack of that region, then shard of that rack. A column of the same name gives way to it."""
    region, rack = fresh(docs.columns, "_region"), fresh(docs.columns, "_rack")
    regions, racks, shards = levels(leaves)
    docs = docs.withColumn(region, _drawn(seed, key, [], regions))
    docs = docs.withColumn(rack, _drawn(seed, key, [F.col(region)], racks))
    return docs.withColumn(column, _drawn(seed, key, [F.col(region), F.col(rack)], shards)).drop(region, rack)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", column: str = "shard") -> DataFrame:
    """Adds the shard; an expression on the id, without a shuffle.

    Null ids share one shard, rows of one id too; texts don't matter. A column of the same
    name gives way to it; an empty table stays empty.
    """
    return descend(docs, F.col(id_col), topology(shards), column)


def _each(counted: DataFrame) -> DataFrame:
    """A row, with ``i`` from 0, for each of the n rows that a row counts; bounded arrays, large counts over several tasks."""
    few = counted.where(F.col("n") <= RUN).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    runs = counted.where(F.col("n") > RUN).withColumn("_first", first).repartition("_first")
    many = runs.withColumn("i", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + RUN, F.col("n")) - 1))).drop("_first")
    return few.unionByName(many)


def shard_slots(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty. Slots number the rows of a shard from 0 without gaps, by id
    (null first), checksum and size; identical rows are counted before the shuffle and told
    apart by their number, so rows are dealt evenly whatever repeats. Null and repeated ids
    are ordinary keys; an empty table gives an empty result. Other columns are ignored.
    """
    scope = Staging(docs.sparkSession, "shard-slots")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (text_bytes(F.col(text_col)) + 1).alias("size"), F.crc32(text).alias("crc"))
    counted = scope.write(rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n")), "rows", slim=True)
    leaves = topology(shards)
    both = descend(descend(counted, F.col("id"), leaves, "shard"), F.col("id"), grow(leaves), "grown")
    placed = number_rows(_each(both), ["id", "crc", "size", "i"], ["shard"], "slot", f"{scope.path}/slots")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"))


SHARDS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(read(spark, sf_dir, "documents"), SHARDS)


def _draw_sql(path: str, weight: float) -> str:
    return f"-ln(((('0x' || substr(md5('shard:{path}:' || key), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / {weight}"


def _least_sql(cells: dict[int, str]) -> str:
    return "list_min([" + ", ".join(f"{{'d': {d}, 'n': {n}}}" for n, d in sorted(cells.items())) + "]).n"


def _tree_sql(leaves: Sequence[Leaf]) -> str:
    """The shard of ``key``, level by level, for every node spelled out."""
    regions, racks, shards = levels(leaves)
    by_region = []
    for (r,), names in sorted(racks.items()):
        inner = " ".join(f"WHEN {k} THEN {_least_sql({s: _draw_sql(f'2:{r}:{k}:{s}', w) for s, w in shards[r, k].items()})}" for k in sorted(names))
        by_region.append(f"WHEN {r} THEN CASE {_least_sql({k: _draw_sql(f'1:{r}:{k}', w) for k, w in names.items()})} {inner} END")
    return f"CASE {_least_sql({r: _draw_sql(f'0:{r}', w) for r, w in regions[()].items()})} {' '.join(by_region)} END"


ORACLE = {
    "op5_sharding": rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '~') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda c: [('0x' || c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc FROM documents),
s AS (SELECT *, {_tree_sql(topology(SHARDS))} AS shard, {_tree_sql(grow(topology(SHARDS)))} AS grown FROM d)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, grown::INT AS grown_shard FROM s
"""
}
QUERIES = {"op5_sharding": op5_sharding}
