"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words in a span and ignore the others, so a substituted word
does not break every seed around it. Seeds of the benchmark and of the documents are
joined on their hash; each hit proposes an alignment of an item with a document, and the
words along it are compared. The benchmark is the query set: it is held in blocks of
bounded size, and every block meets every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._tokens import _BASE, mix64, word_hashes
from ._util import Staging, read, sliced

#: Fixed masks: 1 takes a word, 0 ignores it.
MASKS = ("111111", "1101011", "11100101", "10110011")
#: Words of the shortest mask; items of fewer are searched as exact word sequences.
SPAN = min(map(len, MASKS))
#: An alignment is a leak if this share of the item's words agree (of short items NEARLY all, up to so many words), or a stretch of it is this long and this pure.
SHARE, NEARLY, ENOUGH, STRETCH, PURITY = 0.5, 0.75, 8, 12, 0.8
#: Words of the benchmark that one pass over the documents holds.
BLOCK_WORDS = 1_000_000
#: Proposed alignments held at a time, and words of items compared at a time (one item's at least): a seed that many items and places share costs time, not memory.
ALIGNMENTS, CELLS = 400_000, 2_000_000

HITS = "doc_id long, item_id long, start_word long, matched_words int, item_words int, overlap double"


def words_needed(n: int) -> float:
    """Agreeing words that make a leak of an item of n words: all of fewer than SPAN, NEARLY all of few, a SHARE of many."""
    return n if n < SPAN else max(SHARE * n, min(NEARLY * n, ENOUGH))


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, len(mask) * 31 + mask.count("1"), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                s = s * np.uint64(_BASE) + h[j : j + n]
        return mix64(s)


def _best_stretch(equal: np.ndarray) -> np.ndarray:
    """For each row, most agreeing words in a stretch whose share of agreeing words is at least PURITY (by its best-scoring segment)."""
    equal = np.atleast_2d(equal)
    zero = np.zeros((len(equal), 1))
    sums = np.concatenate([zero, np.cumsum(np.where(equal, 1.0 - PURITY, -PURITY), axis=1)], axis=1)
    low = np.minimum.accumulate(sums, axis=1)
    row = np.arange(len(equal))
    end = np.argmax(sums - low, axis=1)
    start = np.argmax(sums == low[row, end][:, None], axis=1)
    agree = np.concatenate([zero, np.cumsum(equal, axis=1)], axis=1)
    return (agree[row, end] - agree[row, start]).astype(np.int64)


class Matcher:
    """A block of benchmark items, with a hash table of their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        parts: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
        for row, h, at in word_hashes(pa.array([t for _, t in items], pa.string())):
            for i in range(len(at) - 1):
                parts[row + i] = h[at[i] : at[i + 1]]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.needed = np.array([words_needed(n) for n in self.lengths.tolist()])
        self.tables = []
        short = sorted({n for n in self.lengths.tolist() if 0 < n < SPAN})
        for mask in (*MASKS, *("1" * n for n in short)):
            s = _seeds(self.words, mask)
            item = np.searchsorted(self.starts, np.arange(len(s)), "right") - 1
            inside = np.arange(len(s)) + len(mask) <= self.starts[item + 1] if len(s) else np.zeros(0, bool)
            ok = inside & (self.lengths[item] == len(mask) if len(mask) < SPAN else self.lengths[item] >= SPAN) if len(s) else inside
            at = np.flatnonzero(ok)
            order = np.argsort(s[at], kind="stable")
            bits = max(16, int(len(at) * 16).bit_length())
            screen = np.zeros(1 << bits, bool)
            screen[(s[at] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((mask, s[at][order], at[order], screen, np.uint64(64 - bits)))

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, agreeing words) of the best leak of each item in each row."""
        for row, h, offsets in word_hashes(texts):
            best = [part for hits in self._alignments(h, offsets) if len(part := self._leaks(h, offsets, hits))]
            if not best:
                continue
            found = np.concatenate(best)
            # Of an item's leaks in a row the one of most words, the first of equals.
            found = found[np.lexsort((found[:, 2], -found[:, 3], found[:, 1], found[:, 0]))]
            first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))
            for d, item, shift, agree in found[first].tolist():
                yield row + d, item, max(0, shift), agree

    def _alignments(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Different (row, item, shift) that seeds propose, about ALIGNMENTS at a time, in order of places in the texts."""
        found: list[np.ndarray] = []
        for table, (mask, keys, _, screen, shift) in enumerate(self.tables):
            s = _seeds(h, mask)
            at = np.flatnonzero(screen[(s >> shift).astype(np.int64)]) if len(s) and len(keys) else np.zeros(0, np.int64)
            if not len(at):
                continue
            low, high = np.searchsorted(keys, s[at], "left"), np.searchsorted(keys, s[at], "right")
            doc = np.searchsorted(offsets, at, "right") - 1
            ok = (high > low) & (at + len(mask) <= offsets[doc + 1])
            found.append(np.stack([at[ok], doc[ok], low[ok], (high - low)[ok], np.full(ok.sum(), table)], 1))
        if not found:
            return
        seeds = np.concatenate(found)
        seeds = seeds[np.argsort(seeds[:, 0], kind="stable")]
        total = np.cumsum(seeds[:, 3])
        start = 0
        while start < len(seeds):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + ALIGNMENTS, "right")))
            at, doc, low, times, table = seeds[start:stop].T
            each = np.repeat(np.arange(stop - start), times)
            rank = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            place = np.empty(len(each), np.int64)
            for t in np.unique(table):
                mine = table[each] == t
                place[mine] = self.tables[t][2][rank[mine]]
            item = np.searchsorted(self.starts, place, "right") - 1
            shift = at[each] - offsets[doc[each]] - (place - self.starts[item])
            order = np.lexsort((shift, item, doc[each]))
            rows = np.stack([doc[each], item, shift], 1)[order]
            yield rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            start = stop

    def _leaks(self, h: np.ndarray, offsets: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """(row, item, shift, agreeing words) of the alignments that are leaks; compared many at once, items of like length together."""
        n = self.lengths[hits[:, 1]]
        order = np.argsort(n, kind="stable")
        hits, n, out, start = hits[order], n[order], [], 0
        while start < len(hits):
            # Rows are as wide as their longest item.
            stop = start + 1 + int(np.searchsorted(np.arange(2, len(hits) - start + 1) * n[start + 1 :], CELLS, "right"))
            (doc, item, shift), size = hits[start:stop].T, n[start:stop]
            column = np.arange(size[-1])
            at = offsets[doc][:, None] + shift[:, None] + column
            inside = (column < size[:, None]) & (at >= offsets[doc][:, None]) & (at < offsets[doc + 1][:, None])
            own = np.minimum(self.starts[item][:, None] + column, len(self.words) - 1)
            equal = inside & (h[np.clip(at, 0, len(h) - 1)] == self.words[own])
            agree = equal.sum(axis=1)
            leak = agree >= self.needed[item]
            maybe = np.flatnonzero(~leak & (agree >= STRETCH))
            if len(maybe):
                leak[maybe] = _best_stretch(equal[maybe]) >= STRETCH
            out.append(np.stack([doc, item, shift, agree], 1)[leak])
            start = stop
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Matcher]:
    """The benchmark in blocks; the driver holds one at a time."""
    held: list[tuple[int | None, str | None]] = []
    size = 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") // 5 + 1
        if size > BLOCK_WORDS:
            yield Matcher(held)
            held, size = [], 0
    if held:
        yield Matcher(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document and benchmark item that it leaks; clean documents have none.

    Null and empty texts leak nothing; items of under SPAN words leak where they stand word
    for word. Null ids of documents and items stay null; repeated rows give repeated hits.
    Empty tables give an empty result. Other columns are ignored.
    """
    scope = Staging(docs.sparkSession, "leaks")
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), "text")
    out = None
    for m in blocks(benchmark):
        part = scope.write(src.mapInArrow(_hit_rows(m), HITS), "hits")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def _hit_rows(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], matcher.ids[i], lo, agree, int(matcher.lengths[i]), agree / int(matcher.lengths[i])) for r, i, lo, agree in matcher.hits(batch.column(1))]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that leak no benchmark item, with the columns they had, whatever their names; one pass a block, without a shuffle.

    Null and empty texts stay, repeated rows share one fate, empty tables change nothing.
    """
    at = docs.columns.index(text_col)
    for matcher in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], m: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in m.hits(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_decontamination": op3_decontamination}
