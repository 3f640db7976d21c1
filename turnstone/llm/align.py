"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes. The union of both arrays of token ends cuts them into
elementary intervals; each lies in one token of either side, found by ``searchsorted``, so
an interval is one overlap (a link). Ends that both share close a group. A link's count is
the number of documents that hold its pair of ids linked.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Staging, read, release_memory, small

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Bytes of text encoded at a time, and about the bytes of a chunk of documents; a longer text is a chunk of its own.
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
#: Different pairs up to which their counts go to every task (20 bytes a pair); more are joined by chunk.
BROADCAST_PAIRS = 2_000_000
#: Pairs that a task counts before it hands them on.
HELD_PAIRS = 1_000_000

#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE file. Its merges run in tiktoken where ids are ranks of merges, else in its own library."""

    prefix = " "

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        plain = {k: v for k, v in vocab.items() if k not in special}
        ranks = {bytes(letters[c] for c in k): v for k, v in plain.items()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        merges = [m if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ordered = all(plain.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges)) and len(plain) == 256 + len(merges)
        if ordered and spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            import tiktoken

            self._rank = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self._rank, self._own = None, Tokenizer.from_str(content.decode())
            self._own.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space+text, special tokens' strings being plain text."""
        texts = [self.prefix + t for t in texts]
        if self._rank is not None:
            return [self._rank.encode_ordinary(t) for t in texts]
        return [e.ids for e in self._own.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts a space before a text itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self._model.get_piece_size()
        self.bytes = [self._bytes(self._model.id_to_piece(i)) for i in range(n)]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1) if texts else []


class Pair:
    """Both tokenizers of a process, with the byte lengths and decimal names of their ids."""

    _made: dict[tuple[bytes, bytes], Pair] = {}

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ((ByteLevel if c.lstrip()[:1] == b"{" else Pieces)(c) for c in (a, b))
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # A's ids end in a comma, or at their group's end in a bar; B's in a comma or a semicolon.
        self.name_a, self.name_b = (np.array([[b"%d%c" % (i, c) for c in seps] for i in range(len(t.bytes))], object) for t, seps in ((self.a, b",|"), (self.b, b",;")))
        self.width = len(self.b.bytes)

    @classmethod
    def of(cls, content: tuple[bytes, bytes]) -> Pair:
        if content not in cls._made:
            cls._made[content] = cls(*content)
        return cls._made[content]


class Aligned:
    """The alignment of a few texts: tokens, ends, groups and links, the texts one after another."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        raw = [(" " + t).encode() if t else b"" for t in texts]
        full = [i for i, r in enumerate(raw) if r]
        ids = [pair.a.encode([texts[i] for i in full]), pair.b.encode([texts[i] for i in full])]
        same = [all(b"".join([t.bytes[x] for x in side[k]]) == raw[i] for t, side in ((pair.a, ids[0]), (pair.b, ids[1]))) for k, i in enumerate(full)]
        #: Texts that both tokenizers give back byte for byte; the others have no tokens.
        self.docs = [i for k, i in enumerate(full) if same[k]]
        ids_a, ids_b = ([x for k, x in enumerate(side) if same[k]] for side in ids)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (ids_a, ids_b))
        flat = lambda side: np.fromiter((x for s in side for x in s), np.int64, sum(map(len, side)))
        self.a, self.b = flat(ids_a), flat(ids_b)
        self.end_a, self.end_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        #: Where each text ends, in tokens of either side and in bytes.
        self.at_a, self.at_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.at = np.cumsum([len(raw[i]) for i in self.docs]).astype(np.int64)

        ends = np.union1d(self.end_a, self.end_b)
        owner_a, owner_b = np.searchsorted(self.end_a, ends), np.searchsorted(self.end_b, ends)
        self.link_key = self.a[owner_a] * pair.width + self.b[owner_b]
        self.link_at = np.searchsorted(ends, self.at, "right")
        #: Shared ends close a group; every text's last end is one.
        closed = self.end_a[np.isin(self.end_a, self.end_b, assume_unique=True)]
        self.group_a, self.group_b = np.searchsorted(closed, self.end_a), np.searchsorted(closed, self.end_b)
        self.group_at = np.searchsorted(closed, self.at, "right")
        self.closed = closed

    def written(self, pair: Pair) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        a, b = self.group_a, self.group_b
        parts = np.empty(len(a) + len(b), object)
        last = lambda g: np.append(g[1:] != g[:-1], True).astype(np.int64)[: len(g)]
        parts[np.arange(len(a)) + np.searchsorted(b, a, "left")] = pair.name_a[self.a, last(a)]
        parts[np.arange(len(b)) + np.searchsorted(a, b, "right")] = pair.name_b[self.b, last(b)]
        start = 0
        for end in self.at_a + self.at_b:
            yield b"".join(parts[start:end].tolist())[:-1]
            start = end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches (id, text) of bounded bytes, a longer text alone."""
    for batch in batches:
        sizes = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)), np.int64, batch.num_rows)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + SLICE_BYTES, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(1).to_pylist()
            start = stop


ENCODED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, chunk bigint"


def _encoder(content: Broadcast, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, pack = Pair.of(content.value), zstandard.ZstdCompressor(level=1)
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for part, texts in _texts(batches):
            got = Aligned(pair, texts)
            n = len(texts)
            out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
            docs = np.array(got.docs, np.int64)
            out["n_a"][docs], out["n_b"][docs] = got.n_a, got.n_b
            out["n_groups"][docs], out["n_links"][docs] = np.diff(got.group_at, prepend=0), np.diff(got.link_at, prepend=0)
            digests, pairs, start = [""] * n, [None] * n, 0
            for i, end, text in zip(got.docs, got.link_at, got.written(pair)):
                digests[i] = hashlib.sha256(text).hexdigest()
                keys, times = np.unique(got.link_key[start:end], return_counts=True)
                pairs[i] = pack.compress(np.concatenate([np.diff(keys, prepend=0), times]).astype("<i8").tobytes())
                start = end
            columns = [part.column(0).cast(id_type), *[pa.array(out[k]) for k in out], pa.array(digests), pa.array(pairs, pa.binary()), pa.array(np.full(n, chunk))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *out, "groups_sha256", "pairs", "chunk"])
            held += sum(len(t) for t in texts if t)
            if held >= CHUNK_BYTES:
                chunk, held = chunk + 1, 0
        release_memory()

    return run


def _unpack(blob: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, times) of one document."""
    both = np.frombuffer(unpack.decompress(blob), "<i8")
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, key, n): in how many documents of a chunk a pair is linked; a chunk may come in several parts."""
    unpack = zstandard.ZstdDecompressor()

    def flush(chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys), pa.array(n)], names=["chunk", "key", "n"])

    for batch in batches:
        held: list[np.ndarray] = []
        now, size = None, 0
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and (chunk != now or size > HELD_PAIRS):
                yield flush(now, held)
                held, size = [], 0
            now = chunk
            if blob.is_valid:
                held.append(_unpack(blob.as_buffer(), unpack)[0])
                size += len(held[-1])
        if held:
            yield flush(now, held)
    release_memory()


SCORED = "n_best bigint, count_sum bigint"


def _scored(blobs, keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[list[int], list[int]]:
    """(n_best, count_sum) of each document; ``keys`` is sorted and holds each of their pairs."""
    unpack = zstandard.ZstdDecompressor()
    out: tuple[list[int], list[int]] = ([], [])
    for blob in blobs:
        if blob is None:
            row = (0, 0)
        else:
            own, times = _unpack(blob, unpack)
            at = np.searchsorted(keys, own)
            row = (int((times * best[at]).sum()), int((times * n[at]).sum()))
        out[0].append(row[0])
        out[1].append(row[1])
    return out


def read_tokenizers(spark: SparkSession, a: str, b: str) -> Broadcast:
    """The two vocabulary files, a few MB whatever the corpus, for every task; executors need no files of their own."""
    return spark.sparkContext.broadcast((Path(a).read_bytes(), Path(b).read_bytes()))


def token_groups(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group: id, group (from 0), a and b (arrays of ids), start and end (bytes of space+text).

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have
    no groups. Repeated ids and texts are ordinary rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    content = read_tokenizers(spark, a, b)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(content.value)
        for part, texts in _texts(batches):
            got = Aligned(pair, texts)
            if not got.docs:
                continue
            groups = len(got.closed)
            doc = np.searchsorted(got.group_at, np.arange(groups), "right")
            begin, base = np.concatenate([[0], got.closed[:-1]]), np.concatenate([[0], got.at])[doc]
            first = np.concatenate([[0], got.group_at])[doc]
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(groups + 1)).astype(np.int32)), pa.array(x.astype(np.int32))) for g, x in ((got.group_a, got.a), (got.group_b, got.b))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.array(got.docs)[doc])), pa.array(np.arange(groups) - first), *lists, pa.array(begin - base), pa.array(got.closed - base)], names=["id", "group", "a", "b", "start", "end"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, group bigint, a array<int>, b array<int>, start bigint, end bigint").withColumnRenamed("id", id_col)


def align(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Each text is encoded once; a staged table holds its different pairs with how often it
    links them. Pair counts are summed over all documents. Where there are more of them
    than may be broadcast, each chunk of documents asks for its own pairs by a join. Null and
    empty texts, and texts that a tokenizer does not give back byte for byte, have zeros and
    an empty digest. Texts of any length, ties, repeated rows and null ids are ordinary; an
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scope = Staging(spark, "align")
    content = read_tokenizers(spark, a, b)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    encoded = scope.write(src.mapInArrow(_encoder(content, id_type), f"id {kind}, {ENCODED}"), "encoded")

    asked = encoded.select("chunk", "pairs").mapInArrow(_count, "chunk bigint, key bigint, n bigint")
    total = scope.write(asked.groupBy("key").agg(F.sum("n").alias("n")), "totals", slim=True)
    # At most one row an id of A's vocabulary.
    total = total.withColumn("a", F.expr(f"key div {Pair.of(content.value).width}"))
    most = total.groupBy("a").agg(F.max("n").alias("most"))
    counted = total.join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    if small(total, broadcast_pairs):
        held = counted.toPandas().sort_values("key")
        table = spark.sparkContext.broadcast((held["key"].to_numpy(np.int64), held["n"].to_numpy(np.int64), held["best"].to_numpy(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, count = _scored(batch.column("pairs").to_pylist(), *table.value)
                yield pa.RecordBatch.from_arrays([*batch.drop_columns(["pairs", "chunk"]).columns, pa.array(best, pa.int64()), pa.array(count, pa.int64())], names=[*batch.drop_columns(["pairs", "chunk"]).schema.names, "n_best", "count_sum"])

        out = encoded.mapInArrow(run, f"id {kind}, {ENCODED.rsplit(', pairs', 1)[0]}, {SCORED}")
    else:
        wanted = asked.select("chunk", "key").join(counted, "key")

        def one(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            answers = answers.drop_duplicates("key").sort_values("key")
            rows["n_best"], rows["count_sum"] = _scored(rows["pairs"], *(answers[c].to_numpy(t) for c, t in (("key", np.int64), ("n", np.int64), ("best", bool))))
            return rows.drop(columns=["pairs", "chunk"])

        out = encoded.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInPandas(one, f"id {kind}, {ENCODED.rsplit(', pairs', 1)[0]}, {SCORED}")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op11_align": op11_align}
