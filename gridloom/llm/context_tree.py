"""Language-model scores by context-tree weighting of bytes, beside a smoothed word model.

A text is the UTF-8 bytes of its lower-cased form (A-Z) and one end, the byte 255 that no text has; before it
stand ends. Every byte is eight binary decisions. Each decision (a prefix of the byte's bits) has its own
tree of contexts, of the 0 to ``DEPTH`` bytes before. A node estimates the next bit by Krichevsky and Trofimov, and
its weighted probability is half its own estimate of all bits it has seen and half the product of its children's, so
the root mixes all depths and all prunings of the tree. What is learned is frozen: a text's score uses the weights
that the learning texts have left, and never changes them.

All of this follows from how often every gram of ``DEPTH + 1`` bytes occurs, which is counted over the whole corpus
and shuffled by gram. Contexts with the same last ``SHARED`` bytes meet in one task, which is bounded by the grams
that there can be, and are weighed there depth by depth on sorted arrays; shallower depths, one row a node, are
summed by Spark. Down again, each node adds its part to what its parents leave, which ends in one code length for
every gram, of texts that are not learned from as well. Code lengths are whole multiples of
2**-``PRECISION`` bits, so sums do not depend on their order.

Texts are scored against the most frequent grams and words, of which every task holds a number bounded by
``HOT_GRAMS`` and ``HOT_WORDS``; the others of a text are joined with the tables, in which none is frequent.

Results for hard cases: a null text is empty (one end is scored); null ids are not learned from; repeated rows are
learned and scored each; of an empty table nothing remains; with nothing learned every bit costs one bit and every
token has the same probability; other columns are kept where their names do not clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CHUNK_ROWS, materialize, other_columns, quoted

#: Bytes of the longest context; a gram of one more fits a long integer up to 6.
DEPTH = 5
#: Bytes of context that grams share which are weighed together.
SHARED = 3
#: Binary places of a code length.
PRECISION = 24
#: Grams and words that a task of the scoring holds at most.
HOT_GRAMS, HOT_WORDS = 2**19, 2**17
#: Grams and words that a counting task holds before it hands them on, and bytes that are handled at once.
HELD_GRAMS, HELD_WORDS, PIECE = 2**21, 250_000, 2**20
#: Smoothing of the word model.
ADD = 0.1

END = b"\xff"
#: The end as a token; no word has white space.
END_TOKEN = "\n"
#: Bytes of a word from which on its digest stands for it.
LONG_WORD = 64

RESULTS = ("n_tokens", "n_known", "base_score", "n_bytes", "score", "bits_per_byte")


@dataclass
class Model:
    """Written tables: grams with their code lengths, words with their counts; and the word model's totals."""

    grams: DataFrame
    words: DataFrame
    train_tokens: int
    train_types: int
    depth: int


# --- texts ----------------------------------------------------------------------------------------


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(data: bytes) -> list[str]:
    """Words between ASCII white space; a long one is a space and its digest."""
    return [w.decode("utf-8", "surrogatepass") if len(w) <= LONG_WORD else " " + sha256(w).hexdigest() for w in data.split()]


def spans(texts: Sequence[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of bytes with ends between, and where each one's symbols start and stop (its end included)."""
    pad = END * depth
    data = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = depth + np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]).astype(np.int64)
    return data, starts, starts + sizes + 1


def pieces(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, the gram that ends at each place, whether it is a text's) for stretches of bounded length."""
    for a in range(depth, len(data), PIECE):
        b = min(len(data), a + PIECE)
        part = data[a - depth : b].astype(np.int64)
        gram = np.zeros(b - a, np.int64)
        for k in range(depth + 1):
            gram = (gram << 8) | part[k : k + b - a]
        edge = np.zeros(b - a + 1, np.int32)
        np.add.at(edge, np.clip(starts, a, b) - a, 1)
        np.add.at(edge, np.clip(stops, a, b) - a, -1)
        yield a, gram, np.cumsum(edge[:-1]) > 0


# --- counting -------------------------------------------------------------------------------------


def _merged(grams: list[np.ndarray], learned: list[np.ndarray], seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate(grams)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(np.concatenate(learned)[order], first), np.add.reduceat(np.concatenate(seen)[order], first)


def count(df: DataFrame, learn: Column, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(gram, word, learned, seen): how often each gram or word occurs in the texts to learn from, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [np.zeros(0, np.int64)] * 3
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def gram_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams[0]), pa.nulls(len(grams[0]), pa.string()), pa.array(grams[1]), pa.array(grams[2])], names=names)

        def word_rows() -> Iterator[pa.RecordBatch]:
            for known, held in enumerate(words):
                n = np.array(list(held.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), pa.array(list(held), pa.string()), pa.array(n * known), pa.array(n)], names=names)
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                known = np.array(part.column(1).to_pylist(), bool)
                texts = [as_bytes(t) for t in part.column(0).to_pylist()]
                for t, k in zip(texts, known.tolist()):
                    words[k].update(words_of(t))
                    words[k][END_TOKEN] += 1
                for k in (False, True):
                    own = [t for t, x in zip(texts, known.tolist()) if x == k]
                    for _, gram, real in pieces(*spans(own, depth), depth) if own else ():
                        found, n = np.unique(gram[real], return_counts=True)
                        fresh.append((found, n * k, n))
                if sum(len(f[0]) for f in fresh) >= PIECE:
                    grams = list(_merged(*(list(x) for x in zip(grams, *fresh))))
                    fresh.clear()
                    if len(grams[0]) >= HELD_GRAMS:
                        yield gram_rows()
                        grams = [np.zeros(0, np.int64)] * 3
                if len(words[0]) + len(words[1]) >= HELD_WORDS:
                    yield from word_rows()
        if fresh:
            grams = list(_merged(*(list(x) for x in zip(grams, *fresh))))
        yield gram_rows()
        yield from word_rows()

    names = ["gram", "word", "learned", "seen"]
    source = df.select(quoted(text_col).cast("string").alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    counted = source.mapInArrow(run, "gram bigint, word string, learned bigint, seen bigint")
    return counted.groupBy("gram", "word").agg(F.sum("learned").alias("learned"), F.sum("seen").alias("seen"))


# --- weighing -------------------------------------------------------------------------------------


def log_gamma(x, log):
    """Stirling's series, eight steps up; for numpy arrays and Spark's columns alike."""
    y, steps = x + 8.0, x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - log(steps)


def log_kt(a, b, log):
    """Logarithm of the Krichevsky-Trofimov probability of any one sequence of a zeros and b ones."""
    return log_gamma(a + 0.5, log) + log_gamma(b + 0.5, log) - math.log(math.pi) - log_gamma(a + b + 1.0, log)


class Level:
    """The nodes of one depth whose grams are at hand: for each of the eight decisions sorted keys (context, bits before),
    zeros and ones, the share of the node's own estimate, and the logarithm of its weighted probability.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, below: Level | None):
        self.grams, self.n, self.depth = grams, n, depth
        self.keys, self.of, self.p1, self.share, self.log_w, self.a, self.b = [], [], [], [], [], [], []
        for k in range(8):
            key = grams >> (8 - k)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ones = np.add.reduceat(n * ((grams >> (7 - k)) & 1), first)
            a = np.add.reduceat(n, first) - ones
            kt = log_kt(a, ones, np.log)
            if below is None:
                share, log_w = np.ones(len(first)), kt
            else:
                up = below.up(k, key[first])
                children = np.bincount(up, weights=below.log_w[k], minlength=len(first))
                share, log_w = 1 / (1 + np.exp(np.minimum(children - kt, 700))), np.logaddexp(kt, children) - math.log(2)
            self.keys.append(key[first])
            self.of.append(np.repeat(np.arange(len(first)), np.diff(first, append=len(key))))
            self.p1.append((ones + 0.5) / (a + ones + 1.0))
            self.share.append(share)
            self.log_w.append(log_w)
            self.a.append(a)
            self.b.append(ones)

    def up(self, k: int, parents: np.ndarray) -> np.ndarray:
        """Where the parent of each of this level's nodes is among ``parents``."""
        return np.searchsorted(parents, self.keys[k] & ((1 << (8 * (self.depth - 1) + k)) - 1))

    def above(self) -> Level:
        cut = self.grams & ((1 << (8 * self.depth)) - 1)
        order = np.argsort(cut, kind="stable")
        cut = cut[order]
        first = np.flatnonzero(np.diff(cut, prepend=-1))
        return Level(cut[first], np.add.reduceat(self.n[order], first), self.depth - 1, self)


def levels_of(grams: np.ndarray, n: np.ndarray, depth: int, shared: int) -> list[Level]:
    """From the deepest to the one whose contexts are the shared bytes; ``grams`` are sorted."""
    out = [Level(grams, n, depth, None)]
    while out[-1].depth > shared:
        out.append(out[-1].above())
    return out


def code_lengths(levels: list[Level], done: Sequence[np.ndarray], left: Sequence[np.ndarray]) -> np.ndarray:
    """Bits of each gram of the deepest level. ``done`` and ``left`` are, for the nodes of the shallowest one and each
    decision, the part of the probability of a one that shallower nodes give, and the weight that they leave.
    """
    bits = np.zeros(len(levels[0].grams))
    for k in range(8):
        part, rest = done[k], left[k]
        for j, level in enumerate(levels[::-1]):
            if j:
                up = level.up(k, levels[::-1][j - 1].keys[k])
                part, rest = part[up], rest[up]
            part, rest = part + rest * level.share[k] * level.p1[k], rest * (1 - level.share[k])
        p1 = np.clip(part, 1e-15, 1 - 1e-15)[levels[0].of[k]]
        one = (levels[0].grams >> (7 - k)) & 1
        bits -= np.log2(np.where(one == 1, p1, 1 - p1))
    return bits


def _whole(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut where it changes, into tables of at least ``least`` rows but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        changes = np.flatnonzero(np.diff(keys)) + 1
        if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != keys[0]:
            changes = np.concatenate([[0], changes])
        if len(changes) and sum(b.num_rows for b in held) + changes[-1] >= least:
            held.append(batch.slice(0, int(changes[-1])))
            yield pa.Table.from_batches([h for h in held if h.num_rows]).combine_chunks()
            held, batch = [], batch.slice(int(changes[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def weigh(counts: DataFrame, depth: int = DEPTH, shared: int = SHARED, chunk: int = 100_000) -> DataFrame:
    """(gram, seen, bits): the code length of every gram of ``counts``, a written table (gram, learned, seen)."""
    if not 1 <= shared < depth <= 6:
        raise ValueError("the shared bytes are fewer than the depth, which is 6 at most")
    mask = (1 << (8 * shared)) - 1
    together = F.shiftright("gram", 8).bitwiseAND(F.lit(mask))
    grams = counts.select(together.alias("shared"), "gram", "learned", "seen")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches, chunk):
            gram, n = (np.asarray(part.column(k)) for k in (1, 2))
            order = np.argsort(gram)
            top = levels_of(gram[order], n[order], depth, shared)[-1]
            for k in range(8):
                keys = top.keys[k]
                # The bits before, behind a one, number the 255 decisions.
                node = (keys & ((1 << k) - 1)) | (1 << k)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> k), pa.array(node), pa.array(top.a[k]), pa.array(top.b[k]), pa.array(top.log_w[k]), pa.array(top.share[k])], names=["ctx", "node", "a", "b", "log_w", "share"])

    nodes = "ctx bigint, node bigint, a bigint, b bigint, log_w double, share double"
    level = materialize(grams.select("shared", "gram", "learned").repartition("shared").sortWithinPartitions("shared").mapInArrow(up, nodes), "ctw-nodes")
    levels = [level]
    for d in range(shared - 1, -1, -1):
        parent = F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        summed = levels[-1].groupBy(parent.alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log_w").alias("children"))
        kt = log_kt(F.col("a").cast("double"), F.col("b").cast("double"), F.log)
        both = summed.withColumn("kt", kt)
        most = F.greatest("kt", "children")
        log_w = most + F.log(F.exp(F.col("kt") - most) + F.exp(F.col("children") - most)) - math.log(2)
        share = 1 / (1 + F.exp(F.least(F.col("children") - F.col("kt"), F.lit(700.0))))
        levels.append(materialize(both.select("ctx", "node", "a", "b", log_w.alias("log_w"), share.alias("share")), "ctw-nodes"))
    p1 = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    told = levels[-1].select("ctx", "node", (F.col("share") * p1).alias("part"), (1 - F.col("share")).alias("rest"))
    for d, level in zip(range(1, shared + 1), levels[-2::-1]):
        child = level.withColumn("parent", F.col("ctx").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1)))
        # No more than 255 rows in the whole for each context of d - 1 bytes: 65,280 rows for one byte.
        given = told.select(F.col("ctx").alias("parent"), F.col("node"), "part", "rest")
        child = child.join(F.broadcast(given) if d <= 2 else given, ["parent", "node"])
        if d < shared:
            told = child.select("ctx", "node", (F.col("part") + F.col("rest") * F.col("share") * p1).alias("part"), (F.col("rest") * (1 - F.col("share"))).alias("rest"))
        else:
            told = child.select("ctx", "node", "part", "rest")

    # Grams and what their shallower contexts say meet in the partition of the shared bytes.
    tops = told.select(F.col("ctx").alias("shared"), F.col("node").alias("gram"), F.lit(-1).cast("bigint").alias("learned"), F.lit(0).cast("bigint").alias("seen"), "part", "rest")
    nothing = F.lit(None).cast("double")
    mixed = grams.select("*", nothing.alias("part"), nothing.alias("rest")).unionByName(tops)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches, chunk):
            ctx, gram, n, seen = (np.asarray(part.column(k)) for k in range(4))
            is_top = n < 0
            own = np.flatnonzero(~is_top)
            own = own[np.argsort(gram[own])]
            levels = levels_of(gram[own], n[own], depth, shared)
            done, left = [], []
            share, rest = (np.asarray(part.column(k).combine_chunks().fill_null(0.0)) for k in (4, 5))
            for k in range(8):
                rows = np.flatnonzero(is_top & (gram >= 1 << k) & (gram < 2 << k))
                keys = (ctx[rows] << k) | (gram[rows] - (1 << k))
                rows = rows[np.argsort(keys)]
                done.append(share[rows])
                left.append(rest[rows])
            bits = np.rint(code_lengths(levels, done, left) * 2.0**PRECISION).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[own]), pa.array(seen[own]), pa.array(bits)], names=["gram", "seen", "bits"])

    return mixed.repartition("shared").sortWithinPartitions("shared").mapInArrow(down, "gram bigint, seen bigint, bits bigint")


def train(df: DataFrame, learn: Column, text_col: str = "text", depth: int = DEPTH) -> Model:
    """The model of the rows that ``learn`` marks, with code lengths for the grams of all rows of ``df``."""
    counts = materialize(count(df, learn, text_col, depth), "ctw-counts")
    words = counts.where("word IS NOT NULL").select("word", "learned", "seen")
    totals = words.agg(F.sum("learned").alias("n"), F.count(F.when(F.col("learned") > 0, 1)).alias("v")).first()
    grams = materialize(weigh(counts.where("gram IS NOT NULL").select("gram", "learned", "seen"), depth), "ctw-grams")
    return Model(grams, words, totals["n"] or 0, totals["v"], depth)


# --- scoring --------------------------------------------------------------------------------------


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """Rows by their ``seen`` from the least bound on that keeps at most ``most``; the bound is found from a short histogram."""
    fine = F.floor(F.log2(F.col("seen").cast("double")) * 16)
    bins = sorted(((r[0], r[1]) for r in table.where("seen > 0").groupBy(fine).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in bins:
        if total + n > most:
            break
        total, least = total + n, at
    return table.where(F.lit(False)) if least is None else table.where((F.col("seen") > 0) & (fine >= least))


class HotGrams:
    """Code lengths by gram in hashed arrays; what finds its place taken goes to the next, smaller one, and the last few stay out."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, grams: np.ndarray, bits: np.ndarray):
        self.tables: list[tuple[int, int, np.ndarray]] = []
        for by in self.MULTIPLIERS:
            if not len(grams):
                break
            size = max(4, int(4 * len(grams)).bit_length())
            slots = np.full((1 << size, 2), -1, np.int64)
            at = self._place(grams, by, size)
            slots[at, 0] = grams
            won = slots[at, 0] == grams
            slots[at[won], 1] = bits[won]
            self.tables.append((by, size, slots))
            grams, bits = grams[~won], bits[~won]

    @staticmethod
    def _place(grams: np.ndarray, by: int, size: int) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(by)) >> np.uint64(64 - size)).astype(np.int64)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths; -1 for those that are not held."""
        out, open_ = np.full(len(grams), -1, np.int64), np.arange(len(grams))
        for by, size, slots in self.tables:
            row = slots[self._place(grams[open_], by, size)]
            hit = row[:, 0] == grams[open_]
            out[open_[hit]] = row[hit, 1]
            open_ = open_[~hit]
        return out


def score(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``RESULTS`` to rows that were among those given to ``train``, learned from or not.

    ``base_score`` and ``score`` are logarithms to base 10 of the word model's and the byte model's probability of the text.
    """
    spark, depth = df.sparkSession, model.depth
    hot = most_frequent(model.grams, HOT_GRAMS).select("gram", "bits").toArrow()
    own_grams = spark.sparkContext.broadcast(HotGrams(*(hot.column(k).to_numpy() for k in (0, 1))))
    words = most_frequent(model.words, HOT_WORDS).select("word", "learned").toArrow()
    own_words = spark.sparkContext.broadcast(dict(zip(words.column(0).to_pylist(), words.column(1).to_pylist())))

    kept = other_columns(df, (*RESULTS, "__rid", "__text"), keep)
    fields = [T.StructField("__rid", T.LongType()), *[T.StructField(f"__keep{k}", df.schema[c].dataType) for k, c in enumerate(kept)]]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "known", "n_bytes", "bits")] + [T.StructField("base", T.DoubleType())]
    fields += [T.StructField("rare_grams", T.ArrayType(T.LongType())), T.StructField("rare_words", T.ArrayType(T.StringType())), T.StructField("rare_counts", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, learned = own_grams.value, own_words.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts = [as_bytes(t) for t in part.column(len(kept) + 1).to_pylist()]
                data, starts, stops = spans(texts, depth)
                bits = np.zeros(len(texts), np.int64)
                rare: list[list[np.ndarray]] = [[] for _ in texts]
                for a, gram, real in pieces(data, starts, stops, depth):
                    found = table.bits(gram)
                    out = real & (found < 0)
                    found[~real | out] = 0
                    summed = np.concatenate([[0], np.cumsum(found)])
                    lo, hi = np.clip(starts, a, a + len(gram)) - a, np.clip(stops, a, a + len(gram)) - a
                    bits += summed[hi] - summed[lo]
                    places = np.flatnonzero(out)
                    for k in np.unique(np.searchsorted(starts - a, places, "right") - 1).tolist() if len(places) else ():
                        rare[k].append(gram[lo[k] : hi[k]][out[lo[k] : hi[k]]])
                n_tokens, known, base, rare_words, rare_counts = [], [], [], [], []
                for t in texts:
                    counts = Counter(words_of(t))
                    counts[END_TOKEN] += 1
                    sure, total, others = 0, 0.0, {}
                    for w, n in counts.items():
                        c = learned.get(w)
                        if c is None:
                            others[w] = n
                        else:
                            sure += n if c else 0
                            total += n * math.log10(c + ADD)
                    n_tokens.append(sum(counts.values()))
                    known.append(sure)
                    base.append(total)
                    rare_words.append(list(others))
                    rare_counts.append(list(others.values()))
                made = [n_tokens, known, (stops - starts).tolist(), bits.tolist(), base, [np.concatenate(r) if r else np.zeros(0, np.int64) for r in rare], rare_words, rare_counts]
                columns = [part.column(k).cast(arrow.field(k).type) for k in range(len(kept) + 1)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, type=arrow.field(len(columns) + k).type) for k, x in enumerate(made)], schema=arrow)

    source = df.select(F.monotonically_increasing_id().alias("__rid"), *[quoted(c).alias(f"__keep{k}") for k, c in enumerate(kept)], quoted(text_col).cast("string").alias("__text"))
    held = materialize(source.mapInArrow(run, schema), "ctw-texts")
    rare_grams = held.select("__rid", F.explode("rare_grams").alias("gram")).join(model.grams.select("gram", F.col("bits").alias("more")), "gram")
    rare_grams = rare_grams.groupBy("__rid").agg(F.sum("more").alias("more_bits"))
    pairs = held.select("__rid", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("x")).select("__rid", F.col("x.rare_words").alias("word"), F.col("x.rare_counts").alias("n"))
    rare_words = pairs.join(model.words.select("word", "learned"), "word").groupBy("__rid").agg(
        F.sum(F.when(F.col("learned") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.col("learned") + ADD)).alias("more_base")
    )
    every = math.log10(model.train_tokens + ADD * (model.train_types + 1))
    out = held.drop("rare_grams", "rare_words", "rare_counts").join(rare_grams, "__rid", "left").join(rare_words, "__rid", "left")
    bits = (F.col("bits") + F.coalesce("more_bits", F.lit(0))) / 2.0**PRECISION
    return out.select(
        *[F.col(f"__keep{k}").alias(c) for k, c in enumerate(kept)],
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        "n_bytes",
        (-bits * math.log10(2)).alias("score"),
        (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
