"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed byte n-grams. One-versus-one linear support vector
machines first vote for a language family; those of the family then separate its closely
related languages. Where a decision has many classes, groups of classes that lie near each
other are decided first, so that the number of machines follows the number of languages,
not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import read, sliced

#: Labelled rows used at most: for each language, and for all (one of each where there are more languages).
ROWS_PER_LANGUAGE, ROWS = 800, 3200
#: Hash buckets of the n-grams; bytes worked on at a time.
DIM, SLICE = 1 << 12, 1 << 16

#: Classes up to which a decision is taken one versus one; more are first cut into so many groups.
PAIRWISE, GROUPS = 16, 8

#: Families by language code; a code that isn't listed is a family of its own.
FAMILIES = {
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "finnic": ("et", "fi"),
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
}
_FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes}
#: Lower-cases A-Z and turns other ASCII characters into the word boundary 0.
_CLASS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's letter categories is in the text; fractions, exponents and Roman numerals are none."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of counts of hashed 1- to 4-byte grams of a whole text, at unit length."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(DIM)
    for at in range(0, len(raw), SLICE):
        b = _CLASS[raw[max(0, at - 3) : at + SLICE]]
        b = np.concatenate([np.zeros(3 if at == 0 else 0, np.uint32), b, np.zeros(1 if at + SLICE >= len(raw) else 0, np.uint32)])
        h = np.zeros(len(b) - 3, np.uint32)
        for n in range(4):
            h = h * np.uint32(0x01000193) + b[3 - n : len(b) - n] + np.uint32(n)
            inside = b[3:] > 0 if n == 0 else np.ones(len(h), bool)
            key = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            counts += np.bincount(key[inside], minlength=DIM)
    counts = np.sqrt(counts).astype(np.float32)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights with a bias at the end; squared hinge loss, accelerated gradient steps, classes weighed alike."""
    z = np.c_[x, np.ones(len(x), np.float32)]
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c * 10
    w = v = np.zeros(z.shape[1], np.float32)
    rate = 1.0 / (1.0 + 4 * weight.sum())
    for k in range(steps):
        margin = np.maximum(0, 1 - y * (z @ v))
        grad = v - 2 * (z.T @ (weight * y * margin))
        new = v - rate * grad
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Level:
    """One-versus-one machines of one decision; classes in order."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes = np.zeros(len(self.classes))
        total = np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = int(np.lexsort((total, votes))[-1])
        own = [m if a == best else -m for (a, b), m in zip(self.pairs, margins, strict=True) if best in (a, b)]
        return self.classes[best], float(1 / (1 + np.exp(-4 * min(own))))


def _level(x: np.ndarray, names: list[str]) -> Level:
    classes = sorted(set(names))
    y = np.array([classes.index(n) for n in names])
    pairs = list(combinations(range(len(classes)), 2))
    weights = [fit_svm(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1.0, -1.0)) for a, b in pairs]
    return Level(classes, pairs, np.array(weights) if weights else np.zeros((0, x.shape[1] + 1)))


@dataclass
class Node:
    """A decision, and the decisions below those of its classes that stand for several."""

    level: Level
    below: dict[str, Node]

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        name, sure = self.level.decide(x)
        if name not in self.below:
            return name, sure
        found, among = self.below[name].decide(x)
        return found, sure * among

    def machines(self) -> int:
        return len(self.level.pairs) + sum(n.machines() for n in self.below.values())


def _groups(x: np.ndarray, names: np.ndarray) -> dict[str, str]:
    """The group of each class: classes in order along the direction in which their means differ most, cut evenly."""
    classes = sorted(set(names.tolist()))
    means = np.array([x[names == c].mean(axis=0) for c in classes], np.float64)
    means -= means.mean(axis=0)
    along = np.sin(np.arange(1, means.shape[1] + 1))
    for _ in range(30):
        new = means.T @ (means @ along)
        length = np.linalg.norm(new)
        if not length:
            break
        along = new / length
    order = np.lexsort((np.arange(len(classes)), np.round(means @ along, 9)))
    return {classes[c]: f"group {i * GROUPS // len(classes)}" for i, c in enumerate(order)}


def _decision(x: np.ndarray, names: np.ndarray) -> Node:
    if len(set(names.tolist())) <= PAIRWISE:
        return Node(_level(x, names.tolist()), {})
    group = _groups(x, names)
    mask = np.array([group[n] for n in names])
    return Node(_level(x, mask.tolist()), {g: _decision(x[mask == g], names[mask == g]) for g in sorted(set(group.values()))})


@dataclass
class Model:
    family: Node | None
    languages: dict[str, Node]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.family is None or not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, sure = self.family.decide(x)
        language, among = self.languages[family].decide(x)
        return language, sure * among

    def machines(self) -> int:
        return sum(n.machines() for n in (*self.languages.values(), *([self.family] if self.family else [])))


def fit(rows: list[tuple[np.ndarray, str]]) -> Model:
    """From (features, language). Without rows every text is undetermined."""
    if not rows:
        return Model(None, {})
    x = np.array([f for f, _ in rows])
    names = np.array([g for _, g in rows], object)
    mask = np.array([_FAMILY.get(g, g) for g in names], object)
    return Model(_decision(x, mask), {f: _decision(x[mask == f], names[mask == f]) for f in sorted(set(mask.tolist()))})


def fit_texts(rows: list[tuple[str, str]]) -> Model:
    """From (text, language); texts without a letter teach nothing."""
    return fit([(features(t), g) for t, g in rows if has_letter(t)])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 200):
        keep = [has_letter(t.as_py()) for t in batch.column(2)]
        held = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array([features(t.as_py()).tobytes() for t in held.column(2)], pa.binary())], names=["doc_id", "lang", "features"])


def training_rows(docs: DataFrame) -> list[tuple[np.ndarray, str]]:
    """(features, language) of at most ROWS_PER_LANGUAGE rows of each language, and ROWS in all, but one of every language.

    Held-out rows, null ids, texts and languages, and texts without a letter are left out;
    of several texts of an id the smallest is used. The order only depends on the ids.
    Features are made on the executors, so a row that reaches the driver is of fixed size.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").count().collect()
    each = max(1, min(ROWS_PER_LANGUAGE, ROWS // max(1, len(sizes))))
    # A share of each language by its own count, so that one pass collects about as many rows of each.
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (1.15 * each + 8) / r["count"])) for r in sizes], "lang string, share double")
    u = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where(u < F.col("share")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = drawn.mapInArrow(_featured, "doc_id long, lang string, features binary").collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(found, key=lambda r: (r.doc_id, r.lang)):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= each:
            out.append((np.frombuffer(r.features, np.float32), r.lang))
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row; no shuffle.

    Null and empty texts, and texts without a letter, are ``und`` with score 0. Texts of any
    length are read whole, in stretches. Ids may be null or repeat, and repeated rows stay
    repeated; votes that tie go by the sum of margins. An empty table gives an empty
    result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(training_rows(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_language_id": op6_language_id}
