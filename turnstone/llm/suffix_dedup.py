"""Removal of repeated passages by a distributed difference-cover suffix sort.

A byte goes if a 50-byte string covers it that also starts in a document with a smaller
id. Whole copies are settled first, by digest. Of the other texts, only strings that can
repeat are sorted: each string is dealt by its smallest 16-gram (all occurrences of a
string have the same one), and a gram that one text alone holds ends there.

The strings of a gram meet in a block, where they are sorted by the difference cover of
period 3: positions 1 and 2 modulo 3 are sampled, sampled triples of six bytes are sorted
and named, triples of these names are sorted and named again (48 bytes by then), and the
remaining suffixes are merged in: two positions modulo 3 always reach sampled ones after
the same zero, one or two bytes. Equal neighbours in these orders are equal strings. A gram
of too many strings for one block is settled by the strings themselves, as keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tokens import mix64
from ._util import Staging, join_heavy, maybe_broadcast, read, release_memory, sliced, small

#: Bytes of a string that may not repeat, and of a gram that deals it.
LENGTH = 50
GRAM = 16
#: Starts of strings in one run at most: a run's marks are the bits of one long.
RUN = 48
#: Bytes worked on at a time, and runs that a task compares before it deals them.
SLICE = 1 << 18
CHUNK_RUNS = 1 << 19
#: Runs that a task compares after dealing, on average.
TASK_RUNS = 400_000
#: Runs of one gram that are sorted in one block; beyond that, strings are keys.
BLOCK_RUNS = 50_000
#: Rows from which a block is sorted.
LEAST_BLOCK = 8_000

_BASE = 0x9E3779B97F4A7C15


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, tids, offsets) of a few whole texts, or of a stretch of a long one that overlaps the next by 49 bytes."""
    held: list[np.ndarray] = []
    tids: list[int] = []
    offsets: list[int] = []
    size = 0

    def pack() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(held), np.cumsum([len(x) for x in held]), np.array(tids), np.array(offsets)

    for batch in batches:
        for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for at in range(0, max(1, len(data) - LENGTH + 1), SLICE):
                piece = data[at : at + SLICE + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                held.append(piece)
                tids.append(tid)
                offsets.append(at)
                size += len(piece)
                if size >= SLICE:
                    yield pack()
                    held, tids, offsets, size = [], [], [], 0
    if held:
        yield pack()


def smallest_grams(data: np.ndarray) -> np.ndarray:
    """For every start of a string of LENGTH bytes, the smallest hash of its GRAM-byte grams."""
    h = mix64(data.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        step = 1
        while step < GRAM:
            h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
            step *= 2
        h = mix64(h)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, text, start in the text, number of starts) of runs of strings with one smallest gram."""
    m = smallest_grams(data)
    begins = np.concatenate([[0], ends[:-1]])
    cut = np.zeros(len(m) + 1, bool)
    cut[1:-1] = m[1:] != m[:-1]
    cut[0] = cut[-1] = True
    # A string ends in its text: starts from ``ends - 49`` on belong to none.
    over = ends - LENGTH + 1
    cut[begins] = cut[over] = True
    at = np.flatnonzero(cut)
    lo, n = at[:-1], np.diff(at)
    text = np.searchsorted(ends, lo, "right")
    inside = lo < over[text]
    lo, n, text = lo[inside], n[inside], text[inside]
    # Runs of periodic texts may be long; they are cut to bits of a long.
    parts = -(-n // RUN)
    row = np.repeat(np.arange(len(lo)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo, n, text = lo[row] + k * RUN, np.minimum(n[row] - k * RUN, RUN), text[row]
    return m[lo].view(np.int64), text, lo - begins[text], n


RUNS = "gram bigint, tid bigint, lo bigint, n int, known boolean"


def _batch(gram, tid, lo, n, known) -> pa.RecordBatch:
    columns = [pa.array(gram, pa.int64()), pa.array(tid, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(known, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["gram", "tid", "lo", "n", "known"])


def _several(gram: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of grams, where each gram begins, and whether it is in more than one text."""
    order = np.argsort(gram, kind="stable")
    g, t = gram[order], tid[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return order, first, np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts (tid, text). A gram that several texts of a chunk hold is ``known`` to repeat.

    Known runs need no other; one mark (tid -1) of each tells the chunks that hold its gram
    once. So a chunk sends at most one text's runs of a gram, however many hold it.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def chunk() -> Iterator[pa.RecordBatch]:
        gram, tid, lo, n = (np.concatenate(c) for c in zip(*held))
        order, first, many = _several(gram, tid)
        known = np.empty(len(gram), bool)
        known[order] = np.repeat(many, np.diff(np.append(first, len(gram))))
        marks = gram[order][first[many]]
        none = np.full(len(marks), -1)
        yield _batch(np.append(gram, marks), np.append(tid, none), np.append(lo, none), np.append(n, none), np.append(known, np.zeros(len(marks), bool)))

    for data, ends, tids, offsets in _pieces(batches):
        gram, text, lo, n = _runs(data, ends)
        held.append((gram, tids[text], lo + offsets[text], n))
        size += len(gram)
        if size >= CHUNK_RUNS:
            yield from chunk()
            held, size = [], 0
    if size:
        yield from chunk()
    release_memory()


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of dealt runs those whose gram several texts hold."""
    held = []
    for batch in batches:
        known = batch.filter(batch.column("known"))
        if known.num_rows:
            yield known.select(["gram", "tid", "lo", "n"])
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.filter(pa.compute.invert(batch.column("known"))).select(["gram", "tid", "lo", "n"]).columns])
    if held:
        gram, tid, lo, n = (np.concatenate(c) for c in zip(*held))
        if len(gram):
            order, first, many = _several(gram, tid)
            keep = order[np.repeat(many, np.diff(np.append(first, len(gram))))]
            keep = keep[tid[keep] >= 0]
            yield _batch(gram[keep], tid[keep], lo[keep], n[keep], np.ones(len(keep), bool)).select(["gram", "tid", "lo", "n"])
    release_memory()


STRINGS = "gram bigint, doc bigint, tid bigint, lo bigint, string binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run of a text (tid, doc, text, runs)."""
    for batch in sliced(batches, 200):
        lists = batch.column("runs").flatten()
        gram, lo, n = (lists.field(c).to_numpy() for c in ("gram", "lo", "n"))
        count = batch.column("runs").value_lengths().to_numpy()
        texts = batch.column("text")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        size = n.astype(np.int64) + LENGTH - 1
        begin = np.repeat(bounds[:-1], count) + lo
        for a in range(0, len(size), 20_000):
            s, z = begin[a : a + 20_000], size[a : a + 20_000]
            ends = np.cumsum(z)
            where = np.arange(ends[-1]) + np.repeat(s - (ends - z), z)
            strings = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data[where].tobytes())])
            own = np.repeat(np.arange(len(count)), count)[a : a + 20_000]
            pick = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(gram[a : a + 20_000]), batch.column("doc").take(pick), batch.column("tid").take(pick), pa.array(lo[a : a + 20_000]), strings], names=["gram", "doc", "tid", "lo", "string"])


def _names(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys in their order, from 0; equal keys have one."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
    return out


def _triples(name: np.ndarray, place: np.ndarray, at: np.ndarray, second: int, third: int) -> np.ndarray:
    """Ranks of the triples of names at ``at``, ``at + second`` and ``at + third``; ``place`` finds a position's name."""
    a, b, c = (name[place[at + d]] for d in (0, second, third))
    most = int(name.max()) if len(name) else 0
    bits = np.uint64(most.bit_length())
    if 3 * most.bit_length() <= 64:
        return _names((a << (bits + bits)) | (b << bits) | c)
    return _names((_names((a << np.uint64(32)) | b) << np.uint64(32)) | c)


def least_owner(strings: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LENGTH-byte string inside the concatenated strings, the least owner among all that hold it; and each string's first.

    The order is that of a suffix array cut at LENGTH bytes, by the difference cover {1, 2} modulo 3.
    """
    begin = np.append(0, ends[:-1])
    n = ends - begin - LENGTH + 1
    text = np.append(strings, np.zeros(LENGTH, np.uint8))
    word = np.zeros(len(strings), np.uint64)
    for k in range(6):
        word = (word << np.uint64(8)) | text[k : k + len(strings)]
    sample = np.arange(len(strings))
    sample = sample[sample % 3 != 0]
    place = np.zeros(len(text) + 4, np.int64)
    place[sample] = np.arange(len(sample))
    six = _names(word[sample])
    # Positions whose 18 and 48 bytes lie in the whole text; those that run into the next string are named, but never used.
    some = sample[sample + 18 <= len(strings)]
    place18 = np.zeros(len(text) + 4, np.int64)
    place18[some] = np.arange(len(some))
    eighteen = _triples(six, place, some, 6, 12)
    first = np.cumsum(n) - n
    start = np.arange(n.sum()) + np.repeat(begin - first, n)
    needed = np.zeros(len(text) + 4, bool)
    for d in range(3):
        needed[start + d] = True
    deep = np.flatnonzero(needed)
    deep = deep[(deep % 3 != 0) & (deep + 48 <= len(strings))]
    place48 = np.zeros(len(text) + 4, np.int64)
    place48[deep] = np.arange(len(deep))
    long = _triples(eighteen, place18, deep, 18, 30)

    who = np.repeat(owner, n)
    best = who.copy()
    kind = start % 3
    byte = text.astype(np.uint64)
    eight, sixteen = np.uint64(8), np.uint64(16)

    def settle(mine: np.ndarray, key: np.ndarray) -> None:
        """Equal neighbours in the order of keys are equal strings: the least owner is theirs."""
        order = np.argsort(key)
        k = key[order]
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        least = np.repeat(np.minimum.reduceat(who[mine][order], heads), np.diff(np.append(heads, len(k))))
        best[mine[order]] = np.minimum(best[mine[order]], least)

    # Merging: both sides of a comparison reach sampled positions after 0, 1 or 2 bytes.
    for out, ahead in ((0, 0), (2, 1), (1, 2)):
        mine = np.flatnonzero(kind != out)
        if not len(mine):
            continue
        s = start[mine]
        key = long[place48[s + ahead]] << sixteen
        for i, d in enumerate([*range(ahead), *range(ahead + 48, LENGTH)]):
            key = key | (byte[s + d] << (eight if i == 0 else np.uint64(0)))
        settle(mine, key)
    return best, first


MARKS = "tid bigint, lo bigint, marks bigint"


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The marks of a block's runs: the starts whose string a smaller document holds."""
    code, different = pd.factorize(rows["string"].to_numpy())
    doc = rows["doc"].to_numpy(np.int64)
    owner = np.full(len(different), np.iinfo(np.int64).max)
    np.minimum.at(owner, code, doc)
    ends = np.cumsum([len(x) for x in different])
    best, first = least_owner(np.frombuffer(b"".join(different), np.uint8), ends, owner)
    n = (np.diff(ends, prepend=0) - LENGTH + 1)[code]
    row = np.repeat(np.arange(len(rows)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    repeated = best[first[code][row] + k] < doc[row]
    marks = np.add.reduceat(repeated.astype(np.int64) << k, np.cumsum(n) - n)
    out = pd.DataFrame({"tid": rows["tid"].to_numpy(), "lo": rows["lo"].to_numpy(), "marks": marks})
    return out[marks != 0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles runs that come in order of grams, whole grams at a time."""
    schema = pa.schema([("tid", pa.int64()), ("lo", pa.int64()), ("marks", pa.int64())])
    held: list[pd.DataFrame] = []
    size = 0

    def settled(rows: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(_settle(rows), schema=schema, preserve_index=False)

    for batch in sliced(batches, 5_000):
        held.append(batch.to_pandas())
        size += batch.num_rows
        if size >= LEAST_BLOCK:
            rows = pd.concat(held, ignore_index=True)
            gram = rows["gram"].to_numpy()
            # The last gram may go on in the next batch.
            whole = int(np.argmax(gram == gram[-1]))
            if whole:
                yield settled(rows[:whole])
            held = [rows[whole:]]
            size = len(rows) - whole
    if size:
        yield settled(pd.concat(held, ignore_index=True))
    release_memory()


KEYS = "string binary, doc bigint, tid bigint, lo bigint"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of LENGTH bytes of the runs."""
    for batch in sliced(batches, 1_000):
        out: list[tuple] = []
        for doc, tid, lo, string in zip(*(batch.column(c).to_pylist() for c in ("doc", "tid", "lo", "string"))):
            out += [(string[k : k + LENGTH], doc, tid, lo + k) for k in range(len(string) - LENGTH + 1)]
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["string", "doc", "tid", "lo"])


def _by_key(runs: DataFrame, scope: Staging) -> DataFrame:
    """Marks of runs whose grams are too frequent for one block: least documents are combined before the shuffle."""
    keys = scope.write(runs.select("doc", "tid", "lo", "string").mapInArrow(_strings, KEYS), "keys")
    least = scope.write(keys.groupBy("string").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    found = join_heavy(keys, least, ["string"], "n", keys.count()).where(F.col("least") < F.col("doc"))
    return found.select("tid", "lo", F.lit(1).cast("bigint").alias("marks"))


CLEANED = "digest binary, spans array<struct<start: bigint, end: bigint>>, n_removed bigint, kept_sha256 string, kept binary"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and remaining bytes of texts (digest, text, marks)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in sliced(batches, 100):
        out: list[list] = [[], [], [], []]
        for text, marks in zip(batch.column("text"), batch.column("marks")):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            lo, bits = (marks.values.field(c).to_numpy() for c in ("lo", "marks"))
            at = lo[:, None] + np.arange(RUN)
            at = at[(bits[:, None] >> np.arange(RUN)) & 1 == 1]
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
            gone = np.cumsum(edge) > 0
            turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
            kept = data[~gone[:-1]].tobytes()
            for column, value in zip(out, (spans, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("digest"), *[pa.array(c, t) for c, t in zip(out, (kind, pa.int64(), pa.string(), pa.binary()))]], names=["digest", "spans", "n_removed", "kept_sha256", "kept"])


#: What null ids are ordered as: after all others.
LAST = (1 << 63) - 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (start, end), kept_sha256; with ``keep`` also kept (binary).

    Ids are integers. Null texts are empty; null ids come after all others, and like repeated
    ids are not smaller than each other. Repeated rows have the same result. Texts of any
    length are worked on in stretches; texts under 50 bytes lose nothing. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scope = Staging(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = F.coalesce("id", F.lit(LAST))
    digest = F.unhex(F.sha2("text", 256))
    slim = scope.write(rows.select("id", digest.alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")), "rows")
    total = slim.count()
    copies = scope.write(slim.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "copies", slim=True)

    # One text of each group of copies is compared with the others.
    long = rows.where(F.octet_length("text") >= LENGTH).select("text", digest.alias("digest"), order.alias("doc"))
    texts = long.join(maybe_broadcast(copies.drop("n")), "digest", "left").where(F.col("first").isNull() | (F.col("first") == F.col("doc")))
    texts = scope.write(texts.select(F.monotonically_increasing_id().alias("tid"), "doc", "digest", F.col("text").cast("binary").alias("text")), "texts", codec="zstd")

    tasks = int(max(spark.conf.get("spark.sql.shuffle.partitions"), (slim.agg(F.sum("n_bytes")).first()[0] or 0) // (17 * TASK_RUNS), key=int))
    found = texts.select("tid", "text").mapInArrow(_find, RUNS)
    dealt = found.repartition(tasks, F.when(F.col("known"), F.xxhash64("tid", "lo")).otherwise(F.col("gram")))
    runs = scope.write(dealt.mapInArrow(_repeating, "gram bigint, tid bigint, lo bigint, n int"), "runs")
    frequent = scope.write(runs.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > block_runs).select("gram"), "frequent", slim=True)
    scope.sweep()

    # Strings of a text's runs overlap, so they take little room written one after another; each shuffle goes before the next.
    lists = runs.groupBy("tid").agg(F.collect_list(F.struct("gram", "lo", "n")).alias("runs"))
    strings = scope.write(texts.select("tid", "doc", "text").join(lists, "tid").mapInArrow(_cut, STRINGS), "strings", codec="zstd")
    scope.drop(runs)
    scope.sweep()
    blocks = strings
    some = not small(frequent, 0)
    if some:
        blocks = strings.join(maybe_broadcast(frequent), "gram", "left_anti")
    marks = scope.write(blocks.repartition(tasks, "gram").sortWithinPartitions("gram").mapInArrow(_blocks, MARKS), "marks")
    if some:
        marks = marks.unionByName(scope.write(_by_key(strings.join(maybe_broadcast(frequent), "gram", "left_semi"), scope), "frequent-marks"))
    scope.drop(strings)
    scope.sweep()

    lists = marks.groupBy("tid").agg(F.collect_list(F.struct("lo", "marks")).alias("marks"))
    cleaned = texts.select("tid", "digest", "text").join(lists, "tid").select("digest", "text", "marks").mapInArrow(_clean, CLEANED)
    cleaned = scope.write(cleaned if keep else cleaned.drop("kept"), "cleaned").dropDuplicates(["digest"])

    out = join_heavy(slim, copies, ["digest"], "n", total)
    copy = (order > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    whole = out.where(copy).select(
        "id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if keep else [])
    )
    firsts = out.where(~F.coalesce(copy, F.lit(False))).join(cleaned, "digest", "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    firsts = firsts.select("id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), *(["kept", "digest"] if keep else []))
    if keep:
        # Texts that lose nothing are kept as they are.
        raw = rows.select(digest.alias("digest"), F.col("text").cast("binary").alias("raw")).dropDuplicates(["digest"])
        firsts = firsts.join(raw, "digest").withColumn("kept", F.coalesce("kept", "raw")).drop("digest", "raw")
    return whole.unionByName(firsts).select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "spans", "kept_sha256", *(["kept"] if keep else []))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


ORACLE: dict[str, str] = {}
QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
