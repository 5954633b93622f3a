"""Language identification with string kernels.

The kernel of two texts is the cosine of the presence vectors of their blended spectrum, which is
all byte n-grams of one to three bytes, hashed. Nyström landmarks stand for the training texts,
one-versus-rest ridge regression is solved in the space they span, and whole texts are scored by
products of presence matrices with the landmarks' matrix, a batch at a time.

Training takes at most about ``TRAIN_PER_LANGUAGE`` labelled rows of each language, chosen by a
hash of their ids; only their packed presence bits reach the driver.

Cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every
text is; ties go to the language that sorts first; rows without a language are never learned from;
repeated rows get the same result; clashing input columns are replaced.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted
from .ngrams import hashed, sample_mark

SIZES = (1, 2, 3)
BITS = 14
TRAIN_PER_LANGUAGE = 600
LANDMARKS = 96
RIDGE = 1e-2
UNKNOWN = "und"

#: Unicode's category L; number forms such as ² and ½ are none.
_LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str | None]) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams each text has."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(out, texts):
        row[hashed((text or "").lower(), SIZES, BITS)] = 1
    return out


class KernelRidge:
    """Landmarks, scaled, with the weights of each language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        norms = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return ((x @ self.landmarks.T) / norms) @ self.weights


def fit(x: np.ndarray, labels: list[str]) -> KernelRidge | None:
    """Fit on presence rows with their languages; landmarks are dealt over the languages in turn."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(v) for v in labels])
    unit = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    turn = np.zeros(len(y), int)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[: max(LANDMARKS, len(languages))]
    marks = unit[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (unit @ marks.T).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    return KernelRidge(languages, marks.astype(np.float32), (root @ beta).astype(np.float32))


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> KernelRidge | None:
    """Learn from the rows that ``learn`` marks and that have a language."""
    rows = docs.where(learn & quoted(lang_col).isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(quoted(lang_col).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen |= (quoted(lang_col).cast("string") == lang) & sample_mark(quoted(id_col), per_language / n)
    picked = rows.where(chosen).select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"))

    def pack(texts: list[str | None]) -> dict[str, list]:
        return {"bits": [r.tobytes() for r in np.packbits(presence(texts) > 0, axis=1)]}

    found = sorted((r["lang"], bytes(r["bits"])) for r in map_texts(picked, "text", pack, [T.StructField("bits", T.BinaryType())], ["lang"]).collect())
    if not found:
        return None
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in found]), axis=1).astype(np.float32)
    return fit(x, [lang for lang, _ in found])


def predict(docs: DataFrame, model: KernelRidge | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str | None]) -> dict[str, list]:
        fitted = box.value
        lettered = [t is not None and _LETTER.search(t) is not None for t in texts]
        if fitted is None:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
        margins = fitted.scores(presence(texts))
        best = margins.argmax(axis=1)
        score = np.clip((margins.max(axis=1) + 1) / 2, 0, 1)
        return {
            "lang_pred": [fitted.languages[b] if yes else UNKNOWN for b, yes in zip(best, lettered)],
            "score": [float(s) if yes else 0.0 for s, yes in zip(score, lettered)],
        }

    return map_texts(docs, text_col, compute, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)
