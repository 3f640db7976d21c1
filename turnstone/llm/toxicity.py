"""Toxicity by compression distance.

zstandard's trainer makes dictionaries of toxic and of ordinary text; a window is
compressed with either, and the difference of the two lengths says which class it is
closer to. A window is one word with its surrounding spaces (longer ones drown the
difference in noise, see the README), re-coded so that every character takes two bytes
that depend on the two characters before it: then only matches of five characters or
more save space. Toxic text is trained on with several sizes and segment lengths, so that
what one of them misses is in another; what the trainer picked although ordinary text has
it as often is cut out again, and the rest is one dictionary. A document's differences become counts, and a calibrated logistic
threshold turns these into a score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tokens import mix64, shingles, word_hashes
from ._util import Staging, read, sliced

#: Labelled rows used at most: toxic and ordinary ones for the dictionaries, and as many each for calibration.
DICTIONARY_ROWS = (2000, 4000)
CALIBRATION_ROWS = (800, 3200)
#: Windows of either label that dictionaries are trained on at most.
TRAINING_WINDOWS = 500_000
#: (bytes, bytes of a segment) of the trained dictionaries that make up the toxic one, and of the ordinary one.
TOXIC = tuple((size, segment) for size in (2048, 4096, 8192) for segment in (16, 24, 32))
ORDINARY = (2048, 24)
#: Bytes of a gram, and how often and how many times likelier than in ordinary windows it must be in toxic ones to stay in a dictionary.
GRAM, LEAST_WINDOWS, LEAST_ODDS = 8, 4, 10.0
#: What a trained dictionary has besides content at most: entropy tables, which only add noise to short windows.
TABLE_BYTES = 300
#: Differences that are told apart; larger ones count as the last.
LEVELS = 16
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Bytes of a word beyond which its window is cut in pieces; bounds the cost of junk without spaces.
PIECE = 64
_MEMO = 100_000

#: Lower-cases A-Z; other ASCII characters but digits and letters separate words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The windows of a whole text, without their spaces, in order."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split()
    if any(len(w) > PIECE for w in words):
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


_codes: dict[int, bytes] = {}


def recode(text: bytes) -> bytes:
    """Two bytes a character, from it and the two before it on its line."""
    out = []
    key = 0
    for c in text:
        if c == 10:
            key = 0
            continue
        key = (key << 8 | c) & 0xFFFFFF
        code = _codes.get(key)
        if code is None:
            h = (key * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
            if len(_codes) > _MEMO:
                _codes.clear()
            code = _codes[key] = ((h ^ h >> 13) & 0xFFFF).to_bytes(2, "little")
        out.append(code)
    return b"".join(out)


#: The end of a short dictionary is never matched, so all end in the same bytes that no window has.
_PADDING = bytes(np.random.default_rng(1).integers(0, 256, 256, dtype=np.uint8))


def train_dictionary(samples: Sequence[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that zstandard's trainer picks from re-coded windows, in the order given.

    Where there is too little to train on, the last bytes of the windows themselves.
    """
    try:
        trained = zs.train_dictionary(size, samples, k=segment, d=8, level=3, steps=4).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]
    return trained[-max(1, min(len(trained), size) - TABLE_BYTES) :]


def contrast(contents: Sequence[bytes], own: Sequence[bytes], other: Sequence[bytes]) -> list[bytes]:
    """The dictionaries without the bytes that are in no gram typical of own windows against others."""
    counts = {c[i : i + GRAM]: [0, 0] for c in contents for i in range(len(c) - GRAM + 1)}
    for k, windows in enumerate((own, other)):
        for x in windows:
            for i in range(0, len(x) - GRAM + 1, 2):
                found = counts.get(x[i : i + GRAM])
                if found:
                    found[k] += 1
    bar = LEAST_ODDS * len(own) / max(1, len(other))
    typical = {g for g, (a, b) in counts.items() if a >= LEAST_WINDOWS and a + 0.5 >= bar * (b + 0.5)}
    out = []
    for c in contents:
        keep = np.zeros(len(c), bool)
        for i in range(len(c) - GRAM + 1):
            if c[i : i + GRAM] in typical:
                keep[i : i + GRAM] = True
        out.append(np.frombuffer(c, np.uint8)[keep].tobytes())
    return out


def _compressor(content: bytes) -> zs.ZstdCompressor:
    parameters = zs.ZstdCompressionParameters(
        window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=6, target_length=64, strategy=zs.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS,
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content + _PADDING, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=parameters)


FIGURES = 2 * LEVELS


@dataclass
class Distances:
    """Compression-length differences of windows by a toxic and an ordinary dictionary; a bounded memory of those seen."""

    toxic: bytes
    ordinary: bytes
    _memo: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._toxic, self._ordinary = _compressor(self.toxic), _compressor(self.ordinary)

    def difference(self, word: bytes) -> int:
        """How many bytes the toxic dictionary saves more than the ordinary one; at least 0, at most LEVELS."""
        x = recode(b" " + word + b" ")
        return min(max(len(self._ordinary.compress(x)) - len(self._toxic.compress(x)), 0), LEVELS)

    def of(self, text: str | None) -> np.ndarray:
        """Figures of a document: for each level, how many of its different windows save as many bytes or more, as a logarithm and as a share."""
        memo = self._memo
        if len(memo) > _MEMO:
            memo.clear()
        counts = np.zeros(LEVELS + 1)
        found = set(words_of(text or ""))
        for w in found:
            d = memo.get(w)
            if d is None:
                d = memo[w] = self.difference(w)
            counts[d] += 1
        at_least = counts[:0:-1].cumsum()[::-1]
        return np.concatenate([np.log1p(at_least), np.sqrt(at_least / max(len(found), 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, weights) by Newton steps that are halved until the loss falls."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        s = z @ w
        return float(np.logaddexp(0, s).sum() - (y * s).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        t = 1.0
        while t > 1e-4 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if now - (now := loss(w)) < 1e-7:
            break
    return mean, spread, w


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, figures: np.ndarray) -> np.ndarray:
        s = self.weights[0] + ((figures - self.mean) / self.spread) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


SAMPLE = "text string, label int, cal boolean, at int, key long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest five-word shingle hash, which near copies share, so that copies count once."""
    for batch in sliced(batches, 500):
        keys = np.zeros(batch.num_rows, np.int64)
        for row, h, at in word_hashes(batch.column(0)):
            s, out = shingles(h, at, 5)
            for i in range(len(at) - 1):
                if out[i + 1] > out[i]:
                    keys[row + i] = int(s[out[i] : out[i + 1]].min() >> np.uint64(1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"])


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, draw, window) of every window of the sample; the draw depends on the document's place in the sample and the window's in the document."""
    for batch in sliced(batches, 20):
        for text, label, at in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = words_of(text.as_py() or "")
            draws = mix64(np.arange(len(words), dtype=np.uint64) + (np.uint64(at) << np.uint64(32))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.repeat(label, len(words)), pa.array(draws), pa.array(words, pa.binary())], names=["label", "draw", "word"])


def train_dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from (text, label, at); the driver gets a bounded draw of windows, the same however rows are dealt."""
    drawn = sample.select("text", "label", "at").mapInArrow(_drawn, "label int, draw long, word binary")
    samples = {}
    for label in (1, 0):
        words = drawn.where(F.col("label") == label).orderBy("draw", "word").limit(TRAINING_WINDOWS).select("word").toArrow().column(0)
        samples[label] = [recode(b" " + w + b" ") for w in words.to_pylist()]
    if not samples[0] or not samples[1]:
        return b"", b""
    ordinary = train_dictionary(samples[0], *ORDINARY)
    toxic = contrast([train_dictionary(samples[1], size, k) for size, k in TOXIC], samples[1], samples[0])
    _codes.clear()
    return b"".join(toxic), ordinary


def figures_of(sample: DataFrame, toxic: bytes, ordinary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(figures, labels) of a bounded sample, computed on the executors, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(toxic, ordinary)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([distances.of(t.as_py()).tolist() for t in batch.column(0)], pa.list_(pa.float64()))], names=["label", "figures"])

    rows = sample.select("text", "label").mapInArrow(run, "label int, figures array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.figures))
    return np.array([r.figures for r in rows]).reshape(-1, FIGURES), np.array([r.label for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and threshold from a bounded sample of labelled rows.

    The model depends on the rows alone, not on how they are dealt to tasks. Of near copies
    in the sample the first is used. Without rows of both labels the model scores the share
    of label 1. Empty tables, null ids, texts and labels teach nothing and don't fail.
    """
    scope = Staging(docs.sparkSession, "toxicity")
    rows = training_rows(docs, labels).mapInArrow(_keyed, SAMPLE)
    first = F.min_by(F.struct("text", "cal", "at"), "at").alias("r")
    sample = scope.write(rows.groupBy("label", "key").agg(first).select("r.text", "label", "r.cal", "r.at"), "sample")
    toxic, ordinary = train_dictionaries(sample.where("not cal"))
    x, y = figures_of(sample.where("cal"), toxic, ordinary)
    if len(set(y.tolist())) < 2:
        x, y = figures_of(sample, toxic, ordinary)
    scope.close()
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        bias = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(toxic, ordinary, np.zeros(FIGURES), np.ones(FIGURES), np.array([bias, *np.zeros(FIGURES)]))
    return Model(toxic, ordinary, *fit_logistic(x, y))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, cal, at): a bounded sample of labelled rows that aren't held out, picked and numbered by an order that only depends on the ids.

    An id that several labels name is toxic if one says so; of several texts of an id the
    smallest is used.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picks: list[tuple[int, int, bool, int]] = []
    for y in (1, 0):
        first, more = DICTIONARY_ROWS[1 - y], CALIBRATION_ROWS[1 - y]
        ids = usable.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(first + more).select("doc_id").collect()
        # Where labels are few, the last quarter calibrates.
        cut = min(first, len(ids) * 3 // 4)
        picks += [(r.doc_id, y, i >= cut, len(picks) + i) for i, r in enumerate(ids)]
    wanted = docs.sparkSession.createDataFrame(picks, "doc_id long, label int, cal boolean, at int")
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return found.groupBy("label", "cal", "at").agg(F.min("text").alias("text")).select("text", "label", "cal", "at")


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """Adds the score to every row; null text scores as empty. A column of the same name gives way to it.

    Whole texts are scored, whatever their length; repeated rows stay repeated, rows are
    scored alone, so order and ties don't matter; an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c != column]
    src = docs.select(*rest)
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in sliced(batches):
            figures = np.array([distances.of(t.as_py()) for t in batch.column(at)]).reshape(-1, FIGURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(figures))], names=[*batch.schema.names, column])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(column, T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_toxicity": op10_toxicity}
