"""Language ID by hierarchical discrimination.

A text becomes hashed byte trigrams of its lower-cased letters (square roots of counts, unit length).
Linear support vector machines first decide between language families, then, within the family that
won, between each pair of its languages; most votes win, the sum of margins breaks ties. The score
is the logistic of the family margin times the mean logistic of the winner's pair margins.

The machines are fitted on the driver over a bounded sample: of each labelled language the documents
with the smallest hashes, about SAMPLE_PER_LANGUAGE of them and never more, and SAMPLE of all. Features
of the sample are made on executors, so the driver gets 16 kB a document. Labels beyond the
MAX_LANGUAGES with most documents (dirty ones, as a rule) are not learned, which bounds the pairs. Prediction reads the whole of each text
and nothing but the text.

Defined results for odd input: null text and text without a letter get `und` and score 0, as does
every text if no labelled document may be learned from; null languages are not learned from; a null
doc_id is neither held out nor learned from; rows that repeat are predicted alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from . import common

SAMPLE_PER_LANGUAGE, FEATURES, EPOCHS, PENALTY, SHARPNESS, SEED = 400, 4096, 20, 1e-4, 4.0, 11
#: The languages that are learned, those with most documents first, and the sample of all of them together.
MAX_LANGUAGES, SAMPLE = 100, 16_000
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Families of language codes. A code that none lists is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_ASCII_LETTER, _LETTER = re.compile("[A-Za-z]"), regex.compile(r"\p{L}")
#: ASCII other than letters becomes a space; bytes of other characters stay.
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(text: str) -> np.ndarray | None:
    """The unit vector of a text; None without a letter."""
    if not _ASCII_LETTER.search(text) and not _LETTER.search(text):
        return None
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", np.uint8).astype(np.uint32)
    codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    counts = np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    counts[(0x202020 * 2654435761 & 0xFFFFFFFF) >> 20] = 0  # runs of blanks say nothing
    root = np.sqrt(counts.astype(np.float32))
    return root / max(float(np.linalg.norm(root)), 1e-9)


def fit_svm(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A linear SVM (weights, then bias) by averaged stochastic subgradients, classes weighed alike."""
    rng, n = np.random.default_rng(SEED), len(x)
    x = np.hstack([x, np.full((n, 1), 0.2, np.float32)])
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, n / 2 / max(1, positive.sum()), n / 2 / max(1, (~positive).sum()))
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(n):
            step += 1
            rate = 1 / (PENALTY * (step + 1e4))
            if y[i] * (x[i] @ w) < 1:
                w += rate * weight[i] * y[i] * x[i]
            w *= 1 - rate * PENALTY
            if epoch >= EPOCHS // 2:
                mean += w
    return mean / max(1, step - n * (EPOCHS // 2))


class Hierarchy:
    """Pairwise machines among families, and among the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        lang, fam = np.array(langs, object), np.array([family_of(v) for v in langs], object)
        self.families = sorted(set(fam))
        self.members = {f: sorted(set(lang[fam == f])) for f in self.families}
        self.family_rows = self._pairs(x, fam, self.families)
        self.lang_rows = {f: self._pairs(x, lang, self.members[f]) for f in self.families}

    @staticmethod
    def _pairs(x: np.ndarray, labels: np.ndarray, names: list[str]) -> np.ndarray:
        rows = [fit_svm(x[own], labels[own] == a) for a, b in combinations(names, 2) for own in [(labels == a) | (labels == b)]]
        return np.array(rows) if rows else np.zeros((0, FEATURES + 1))

    @staticmethod
    def _vote(rows: np.ndarray, names: list[str], x: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        margins = rows[:, :-1] @ x + 0.2 * rows[:, -1]
        votes, sums, sure = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for (a, b), m in zip(combinations(range(len(names)), 2), margins):
            votes[a if m > 0 else b] += 1
            for k, signed in ((a, m), (b, -m)):
                sums[k] += signed
                sure[k] += 1 / (1 + np.exp(-SHARPNESS * np.clip(signed, -50, 50)))
        best = max(range(len(names)), key=lambda k: (votes[k], sums[k]))
        return names[best], float(sure[best] / (len(names) - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text and self.families else None
        if x is None:
            return UNKNOWN, 0.0
        family, first = self._vote(self.family_rows, self.families, x)
        lang, second = self._vote(self.lang_rows[family], self.members[family], x)
        return lang, min(1.0, max(0.0, first * second))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column("text")]
        kept = [k for k, f in enumerate(found) if f is not None]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(kept, pa.int32())), batch.column("mixed").take(pa.array(kept, pa.int32())), pa.array([found[k].tobytes() for k in kept], pa.binary())], ["lang", "mixed", "x"])


def train(docs: DataFrame) -> Hierarchy:
    """Fits on a bounded sample of the labelled rows that aren't held out."""
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    common_first = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common_first.collect()}
    if not counts:
        return Hierarchy(np.zeros((0, FEATURES), np.float32), [])
    size = min(SAMPLE_PER_LANGUAGE, SAMPLE // len(counts))
    shares = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(int(min(1.0, 1.2 * size / n) * (1 << 40))))])
    sample = known.select("lang", mixed.alias("mixed"), F.col("text").cast("string").alias("text")).filter(F.col("mixed") < shares[F.col("lang")])
    # Vectors are made where the texts are; the limit only guards the driver against ids that repeat.
    rows = sample.mapInArrow(lambda batches: common.handing_back(_feature_rows(batches)), "lang string, mixed long, x binary").limit(2 * size * len(counts)).collect()
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["mixed"], r["x"])):
        own = by_lang.setdefault(r["lang"], [])
        if len(own) < size:
            own.append(np.frombuffer(r["x"], np.float32))
    langs = [lang for lang, own in by_lang.items() for _ in own]
    return Hierarchy(np.array([x for own in by_lang.values() for x in own], np.float32).reshape(-1, FEATURES), langs)


def with_language(docs: DataFrame, model: Hierarchy, key: list[str], lang: str, score: str) -> DataFrame:
    """The key columns of docs, and what the model says in two columns of these names, for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES languages, 16 kB a pair
    own = [F.col(f"`{c}`") for c in key]
    rows = docs.select(*own) if "text" in key else docs.select(*own, F.col("text"))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(at)]
            kept = [batch.column(k) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[: len(key)], lang, score])

    return rows.mapInArrow(lambda batches: common.handing_back(run(batches)), rows.select(*own).schema.add(lang, "string").add(score, "double"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    labelled = docs.select("doc_id", "text", "lang")
    return with_language(labelled, train(labelled), ["doc_id"], "lang_pred", "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The rows of docs that aren't `und`, whatever their score; its own columns only."""
    lang, score = common.unused(docs, "maskwell_lang"), common.unused(docs, "maskwell_score")
    found = with_language(docs, train(docs.select("doc_id", "text", "lang")), docs.columns, lang, score)
    return found.filter(F.col(lang) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
