"""URL filters: a blocked Bloom filter screens canonical keys, an exact hash join decides.

Listed entries and policy rules are stored under canonical keys (host, then path).
A url is turned into the few keys under which an entry could cover it: its host
suffixes with as many labels, and its path prefixes of as many characters, as some
entry has. Rules read the host as it is written; the list reads its canonical form,
without user, port, trailing dot and escapes. Each key is tested against one 256-bit
block of the filter; possible hits meet the listed keys in an exact join, so that false
positives go. Where filter and list are of a checked size, every row is judged where it
is, without a shuffle; else each different url is judged once. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import join_heavy

#: Bits a key sets in its block, one in each of as many 32-bit lanes (four 64-bit words).
LANES = 8
#: Keys per 256-bit block: about 0.3 % false positives.
KEYS_PER_BLOCK = 16
#: Blocks (32 bytes of bits) up to which the filter is broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 100_000
#: Entries up to which the list is broadcast, and shapes of entries up to which a row is judged by joins of its own.
MAX_BROADCAST_ENTRIES, MAX_SHAPES = 200_000, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Entry:
    """A covered part of the web: a host with its subdomains, and a path prefix."""

    host: str
    path: str
    verdict: str
    origin: str = "rule"

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """The host behind escapes, without user, port and trailing dots."""
    plain = F.coalesce(F.try_url_decode(host), host)
    for pattern in ("^.*@", ":[0-9]*$", r"\.+$"):
        plain = F.regexp_replace(plain, pattern, "")
    return F.translate(plain, UPPER, LOWER)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """Word masks of a key: lane i sets one of 32 bits; two lanes make a word."""
    h = F.xxhash64(key, F.lit("lane"))
    one = F.lit(1).cast("long")
    words = []
    for w in range(LANES // 2):
        low, high = (F.call_function("shiftleft", one, (F.shiftrightunsigned(h, 5 * (2 * w + k)).bitwiseAND(F.lit(31)) + F.lit(32 * k)).cast("int")) for k in (0, 1))
        words.append(low.bitwiseOR(high))
    return words


def build_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocks that hold any key: (block, w0..w3)."""
    masks = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_bits(F.col(key)))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES // 2)])


def listed_table(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "host", "path", "verdict", "origin")])
    return spark.createDataFrame([(e.key, e.host, e.path, e.verdict, e.origin) for e in entries], schema)


def shapes_of(listed: DataFrame) -> list[tuple[bool, int, int]]:
    """Distinct (is a rule, labels of the host, characters of the path): as many as the entries have shapes, not entries."""
    rows = listed.select((F.col("origin") == "rule").alias("r"), F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("l")).distinct().collect()
    return sorted((r.r, r.n, r.l) for r in rows)


def _stored(origin_is_rule: Column, key: Column) -> Column:
    return F.concat(F.when(origin_is_rule, "r").otherwise("l"), key)


def _candidate(rule: Column, labels: Column, chars: Column) -> Column:
    """The key under which an entry of a shape would cover a url of _host, _site and _path; null where it is too short."""
    host = F.when(rule, F.col("_host")).otherwise(F.col("_site"))
    suffix = F.array_join(F.slice(F.split(host, r"\."), -labels, labels), ".")
    fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length("_path") >= chars) & (host != "")
    return F.when(fits, _stored(rule, F.concat(suffix, F.substring("_path", F.lit(1), chars))))


def _passes(prefix: str) -> Column:
    """Whether the block that was joined has all bits of the key; false where no block was."""
    hit = F.lit(True)
    for i, m in enumerate(_bits(F.col(f"{prefix}key"))):
        hit = hit & (F.col(f"{prefix}w{i}").bitwiseAND(m) == m)
    return F.coalesce(hit, F.lit(False))


def _judged_in_place(parts: DataFrame, shapes: list[tuple[bool, int, int]], bloom: DataFrame, exact: DataFrame, blocks: int) -> DataFrame:
    """Adds _rule and _list, the best hit of either kind, to every row by broadcast joins: the filter's block, then the exact key, once a shape."""
    kinds: dict[bool, list[Column]] = {True: [], False: []}
    for at, (rule, n, l) in enumerate(shapes):
        p = f"_{at}_"
        parts = parts.withColumn(f"{p}key", _candidate(F.lit(rule), F.lit(n), F.lit(l)))
        block = bloom.select(F.col("block").alias(f"{p}block"), *[F.col(f"w{i}").alias(f"{p}w{i}") for i in range(LANES // 2)])
        parts = parts.join(F.broadcast(block), _block(F.col(f"{p}key"), blocks) == F.col(f"{p}block"), "left")
        parts = parts.withColumn(f"{p}maybe", F.when(_passes(p), F.col(f"{p}key")))
        parts = parts.join(F.broadcast(exact.select(F.col("_stored").alias(f"{p}stored"), F.col("_rank").alias(f"{p}rank"))), F.col(f"{p}maybe") == F.col(f"{p}stored"), "left")
        kinds[rule].append(F.col(f"{p}rank"))
    none = F.lit(None).cast(exact.schema["_rank"].dataType)
    best = {k: F.greatest(*c, none) if c else none for k, c in kinds.items()}
    return parts.withColumn("_rule", best[True]).withColumn("_list", best[False])


def _judged_by_url(parts: DataFrame, shapes: list[tuple[bool, int, int]], bloom: DataFrame, exact: DataFrame, blocks: int) -> DataFrame:
    """Adds _rule and _list to every row: each different url meets filter and list once, and hits go back to its rows; frequent urls by broadcast."""
    urls = parts.where("_url is not null").groupBy("_url", "_host", "_site", "_path").agg(F.count("*").alias("_n"))
    shape = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(n).alias("n"), F.lit(l).alias("l")) for r, n, l in shapes])
    found = F.array_distinct(F.filter(F.transform(shape, lambda x: _candidate(x["r"], x["n"], x["l"])), lambda x: x.isNotNull()))
    probes = urls.select("_url", "_n", F.explode(found).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    possible = probes.join(bloom, "block").where(_passes("")).select("_url", "_n", "key")
    hits = possible.join(exact, F.col("key") == F.col("_stored"))
    best = hits.groupBy("_url", "_n").agg(F.max(F.when(F.col("_origin") == "rule", F.col("_rank"))).alias("_rule"), F.max(F.when(F.col("_origin") != "rule", F.col("_rank"))).alias("_list"))
    blank = parts.where("_url is null")
    some = join_heavy(parts.where("_url is not null"), best, ["_url"], "_n", parts.count()).drop("_n")
    return some.unionByName(blank, allowMissingColumns=True)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule, listed and verdict to every row.

    ``listed`` has key, host, path, verdict and origin ('rule' or 'list'), one row a key of
    an origin. The longest covering rule decides; without one, a covering list entry blocks,
    and anything else is allowed. Null and malformed urls have an empty host and path and
    are allowed. Rows are never dropped, and repeated rows stay repeated; an empty table
    gives an empty result. Columns of ``pages`` whose names clash with an added one give way
    to it; names that begin with an underscore are kept apart.
    """
    added = ("host", "path", "rule", "listed", "verdict")
    base = pages.drop(*[c for c in added if c != url and c in pages.columns])
    shapes = shapes_of(listed)
    n = listed.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    rank = F.struct(F.length("key").alias("l"), F.col("key").alias("k"), F.col("verdict").alias("v"))
    exact = listed.select(_stored(F.col("origin") == "rule", F.col("key")).alias("_stored"), F.col("origin").alias("_origin"), rank.alias("_rank"))
    bloom = build_filter(exact, "_stored", blocks)

    parts = base.select(F.struct(*[base[c] for c in base.columns]).alias("_row"), base[url].alias("_url"), url_host(base[url]).alias("_host"), url_path(base[url]).alias("_path"))
    parts = parts.withColumn("_site", canonical_host(F.col("_host")))
    near = blocks <= MAX_BROADCAST_BLOCKS and n <= MAX_BROADCAST_ENTRIES and len(shapes) <= MAX_SHAPES
    if not shapes:
        judged = parts.withColumn("_rule", F.lit(None).cast(exact.schema["_rank"].dataType)).withColumn("_list", F.col("_rule"))
    else:
        judged = (_judged_in_place if near else _judged_by_url)(parts, shapes, bloom, exact, blocks)
    return judged.select(
        *[F.col("_row").getField(c).alias(c) for c in base.columns if c not in added or c == url],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.k").alias("rule"),
        F.col("_list.k").alias("listed"),
        F.coalesce("_rule.v", "_list.v", F.lit("allow")).alias("verdict"),
    )


#: The policy rules of the query, and the hosts that the method lists for it. The tables bring no list, so this one
#: names those hosts of theirs whose names speak of adult, pharmacy, betting, casino, advertising and spam sites, under each domain.
RULES = (
    Entry("net", "/", "block"),
    Entry("example.net", "/en/", "allow"),
    Entry("example.com", "/de/", "block"),
    Entry("org", "/fr/", "allow"),
)
LISTED = tuple(Entry(f"{name}.example.{top}", "", "block", "list") for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_table(spark, RULES + LISTED)).select("page_id", "host", "path", "rule", "verdict", "listed")


def _sql_covers(e: Entry) -> str:
    host = "host" if e.origin == "rule" else "site"
    return f"(({host} = '{e.host}' OR ends_with({host}, '.{e.host}')) AND starts_with(path, '{e.path}'))"


def _sql() -> str:
    rules = sorted(RULES, key=lambda e: (-len(e.key), e.key))
    rule = " ".join(f"WHEN {_sql_covers(e)} THEN '{e.key}'" for e in rules)
    verdict = " ".join(f"WHEN {_sql_covers(e)} THEN '{e.verdict}'" for e in rules)
    listed = " ".join(f"WHEN {_sql_covers(e)} THEN '{e.key}'" for e in sorted(LISTED, key=lambda e: (-len(e.key), e.key)))
    return f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (SELECT *, translate(regexp_replace(regexp_replace(regexp_replace(url_decode(host), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', ''), '{UPPER}', '{LOWER}') AS site FROM u),
v AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict, CASE {listed} END AS listed FROM c)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed FROM v
"""


ORACLE = {"op9_url_filter": _sql()}
QUERIES = {"op9_url_filter": op9_url_filter}
