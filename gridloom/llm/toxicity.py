"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained with numpy from confirmed toxic texts and unlabelled ones: the
risk of the negatives is the unlabelled risk less the share of positives in it, by the class
prior, and is kept from going below zero. Features are the presence of hashed words; the
ones that tell positives from unlabelled texts best are selected by their log-likelihood ratio.

Words are counted over all learning rows, and those of toxic ones over all confirmed rows. The classifier is fitted on
at most about ``POSITIVES`` toxic rows and ``UNLABELLED`` of all, chosen by a hash of their ids; only their selected
words' packed presence bits reach the driver. The weight of the regulariser is the one of ``L2`` of the least
non-negative risk of verdicts (zero-one loss) on rows of these that it was not fitted on, over
``FOLDS`` folds; other rows have no part in it.

Cases: null and empty texts have no words and get the score of the bias; without confirmed
toxic rows every score is 0; a document labelled more than once is toxic if any label says so;
repeated rows get the same result; clashing input columns are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted
from .ngrams import hashed_words, sample_mark

BITS = 20
POSITIVES, UNLABELLED = 3000, 9000
#: Ids of confirmed rows that are sent to every task; 16 MB.
MOST_SENT = 2_000_000
SELECTED = 512
#: Least log-likelihood ratio of a selected word; chance alone seldom gives it among all words.
LEAST_RATIO = 4.0
EPOCHS, RATE = 300, 0.05
#: Weights of the regulariser that are tried, and the folds of the learning rows that they are tried on.
L2, FOLDS = (1e-5, 1e-4, 1e-3), 3


class Linear:
    """Weights of the selected words, and a table from word to weight."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float):
        self.grams, self.weights, self.bias = grams, weights, bias

    @functools.cached_property
    def table(self) -> np.ndarray:
        """Made once a worker."""
        out = np.full(1 << BITS, -1, np.int16)
        out[self.grams] = np.arange(len(self.grams))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """Indices of the selected words that a text has."""
    found = table[hashed_words(text, BITS)]
    return np.unique(found[found >= 0])


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' share of the risk under the logistic loss, and the negatives', before it is kept from below zero."""
    soft = lambda z: np.logaddexp(0, z)
    return prior * float(soft(-zp).mean()), float(soft(zu).mean()) - prior * float(soft(zp).mean())


def slope(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The direction of steepest ascent that a step goes down: of the risk, or back up that of overfitted negatives."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = p @ w, u @ w
    negative = u.T @ sig(zu) / len(u) - prior * (p.T @ sig(zp)) / len(p)
    if risk(zp, zu, prior)[1] < 0:
        return -negative
    return negative - prior * (p.T @ sig(-zp)) / len(p)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk under the logistic loss, by Adam."""
    w = np.zeros(positive.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = _with_one(positive), _with_one(unlabelled)
    for step in range(1, epochs + 1):
        g = slope(w, p, u, prior) + np.float32(l2) * np.append(w[:-1], np.float32(0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = (w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(float), float(w[-1])


def choose_l2(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The weight of least non-negative zero-one risk on left-out folds of the rows; the larger of ties."""
    if min(len(positive), len(unlabelled)) < 2 * FOLDS:
        return max(L2)
    total = dict.fromkeys(L2, 0.0)
    for fold in range(FOLDS):
        p_out, u_out = np.arange(len(positive)) % FOLDS == fold, np.arange(len(unlabelled)) % FOLDS == fold
        for l2 in L2:
            w, bias = nnpu(positive[~p_out], unlabelled[~u_out], prior, l2)
            caught, flagged = (positive[p_out] @ w + bias >= 0).mean(), (unlabelled[u_out] @ w + bias >= 0).mean()
            total[l2] += prior * (1 - caught) + max(0.0, flagged - prior * caught)
    return min(L2, key=lambda x: (total[x], -x))


def _log_ratio(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Signed log-likelihood ratio of presence in ``a`` of ``n`` against ``b`` of ``m`` rows."""
    both = (a + b) / (n + m)
    part = lambda k, size, rate: k * np.log(np.maximum(rate, 1e-12)) + (size - k) * np.log(np.maximum(1 - rate, 1e-12))
    ratio = part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both)
    return np.where(a / n > b / m, ratio, -ratio)


def train(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", toxic_col: str = "toxic") -> Linear | None:
    """Fit on rows that ``learn``, a filter on the id, marks; both tables are joined by the id."""
    own = labels.where(learn & quoted(toxic_col).isNotNull()).groupBy(quoted(id_col).alias("__id")).agg(F.max((quoted(toxic_col) == 1).cast("int")).alias("toxic"))
    n, hit = own.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    total = docs.where(learn).count()
    if not n or not hit or not total:
        return None
    prior = hit / n
    known = own.where(F.col("toxic") == 1).select("__id", F.lit(True).alias("p"), sample_mark(F.col("__id"), POSITIVES / hit).alias("fitted"))
    texts = docs.where(learn).select(quoted(id_col).alias("__id"), quoted(text_col).cast("string").alias("text"))
    # The ids of all confirmed rows go to the texts if they are few enough; else both are shuffled.
    known = F.broadcast(known) if hit <= MOST_SENT else known
    no = F.lit(False)
    marked = texts.join(known, "__id", "left").select("__id", "text", F.coalesce("p", no).alias("p"), F.coalesce("fitted", no).alias("fitted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        sizes = [0, 0]
        for batch in batches:
            for text, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashed_words(text, BITS)
                for k in (0, 1) if p else (0,):
                    sums[k, words] += 1
                    sizes[k] += 1
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[1, at], sizes[1])), pa.array(np.append(sums[0, at], sizes[0]))], names=["gram", "p", "u"])

    counted = marked.select("text", "p").mapInArrow(count, "gram bigint, p bigint, u bigint").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    chosen = F.col("fitted") | sample_mark(F.col("__id"), UNLABELLED / total)
    rows = marked.where(chosen).select("text", F.col("fitted").alias("p"), sample_mark(F.col("__id"), UNLABELLED / total).alias("u"))
    found = counted.where("gram < 0 OR p >= 2").toPandas().sort_values("gram")
    sizes = found[found["gram"] < 0]
    n_p, n_u = int(sizes["p"].sum()), int(sizes["u"].sum())
    found = found[found["gram"] >= 0]
    if not n_p or not n_u or not len(found):
        return None
    ratio = _log_ratio(found["p"].to_numpy(), n_p, found["u"].to_numpy(), n_u)
    best = np.lexsort((found["gram"].to_numpy(), -ratio))[:SELECTED]
    grams = found["gram"].to_numpy()[best[ratio[best] > LEAST_RATIO]]
    if not len(grams):
        return None
    table = Linear(grams, np.zeros(0), 0.0).table

    def pack(texts: list[str | None]) -> dict[str, list]:
        bits = np.zeros((len(texts), len(grams)), np.uint8)
        for row, text in zip(bits, texts):
            row[features(text, table)] = 1
        return {"bits": [r.tobytes() for r in np.packbits(bits, axis=1)]}

    packed = sorted((bytes(r["bits"]), r["p"], r["u"]) for r in map_texts(rows, "text", pack, [T.StructField("bits", T.BinaryType())], ["p", "u"]).collect())
    if not packed:
        return None
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b, _, _ in packed]), axis=1)[:, : len(grams)]
    positive, unlabelled = x[np.array([p for _, p, _ in packed])], x[np.array([u for _, _, u in packed])]
    # Rows are in the order of their bits; folds deal them by a fixed shuffle.
    rng = np.random.default_rng(3)
    positive, unlabelled = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    if not len(positive) or not len(unlabelled):
        return None
    return Linear(grams, *nnpu(positive, unlabelled, prior, choose_l2(positive, unlabelled, prior)))


def score(docs: DataFrame, model: Linear | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` and ``predicted`` to every row."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str | None]) -> dict[str, list]:
        fitted = box.value
        if fitted is None:
            made = [0.0] * len(texts)
        else:
            table = fitted.table
            z = np.array([fitted.weights[features(t, table)].sum() + fitted.bias for t in texts])
            made = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
        return {"score": made, "predicted": [int(s >= 0.5) for s in made]}

    return map_texts(docs, text_col, compute, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)
