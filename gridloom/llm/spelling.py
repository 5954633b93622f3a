"""Spelling variants by anagram hashing.

Words are counted over all texts. A word's key is the sum of the fifth powers of its letters' code points, so
that words of the same letters have the same key, and words a letter apart have keys that differ by one power
(a letter added or removed) or by the difference of two (a letter exchanged). Such keys are found by an
equi-join: every word gives its key less each of its letters; where that is another word's whole key, a letter
was removed, and where two words come to the same rest, one letter was exchanged. Candidates then have their
letters' order verified.

A key that many words share (permutations of the same letters) would make many candidates. Words of such keys
also give the text that remains, and meet where keys, texts and places agree; as words that meet there are a letter
apart at one place, they are no more than the alphabet has letters. Both ways find the same pairs.

Every word then takes the most frequent near word as its form, if that is much more frequent; counts grow
tenfold from form to form, so the last form is reached in a bounded number of joins.

Results for hard cases: a null text has no words; a null id counts as an empty one; repeated rows count
again; ties of frequency go to the smallest word in code-point order; of an empty table nothing remains;
columns other than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_ROWS, materialize, quoted

#: Code points of the shortest word, and occurrences of the rarest.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: How many times as frequent as the word its form is.
FORM_RATIO = 10
#: One run in so many has a letter dropped, chosen by its checksum.
DROP_ONE_IN = 31
#: Power of the code points in a key.
POWER = 5
#: Words that share a rest from which on they also give their texts.
HOT = 64
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 200_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(text: str, least: int) -> list[str]:
    """Maximal runs of letters, of at least ``least`` of them, A-Z in lower case."""
    return re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text.translate(_LOWER))


def with_dropped(run: str, doc: str, one_in: int = DROP_ONE_IN) -> str:
    """The run, or where the checksum of ``doc:run`` says so the run without one letter."""
    h = crc32(f"{doc}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts. Tasks count before they shuffle, so a word's rows are no more than tasks times its flushes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    front = crc32(f"{doc or ''}:".encode())
                    for w, n in Counter(runs_of(text or "", least)).items():
                        h = crc32(w.encode(), front)
                        if h % DROP_ONE_IN == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < least:
                                continue
                        held[w] += n
                    if len(held) >= HELD_WORDS:
                        yield out()
        yield out()

    source = df.select(quoted(id_col).cast("string").alias("__doc"), quoted(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- near words -----------------------------------------------------------------------------------


def _letters(word: Column) -> Column:
    return F.split(word, "")


def power(letter: Column) -> Column:
    # ``ascii`` gives the first code point, whatever it is.
    out = code = F.ascii(letter).cast("bigint")
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_key(word: Column) -> Column:
    """The sum of the powers of a word's letters."""
    return F.aggregate(F.transform(_letters(word), power), F.lit(0).cast("bigint"), lambda a, x: a + x)


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, other, other_n): every ordered pair of words that are one inserted, deleted or replaced letter apart. ``words`` is a written table."""
    keyed = words.select("word", "n", anagram_key(F.col("word")).alias("key"))
    less = F.transform(F.array_distinct(_letters(F.col("word"))), lambda c: F.struct((F.col("key") - power(c)).alias("key"), c.alias("letter")))
    rest = keyed.select("word", "n", F.explode(less).alias("x")).select("x.key", "word", "n", "x.letter")
    # A row without a letter has the word's whole key.
    rests = materialize(rest.unionByName(keyed.select("key", "word", "n", F.lit(None).cast("string").alias("letter"))), "spelling-keys")
    rests = rests.withColumn("whole", F.col("letter").isNull())
    sizes = rests.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bool_or(~F.col("whole")).alias("any_rest"))
    # Keys of one word meet nothing.
    sizes = materialize(sizes.where(F.col("any_rest") & (F.col("size") > 1)).select("key", "size"), "spelling-sizes")
    few, many = sizes.where(F.col("size") <= hot).select("key"), sizes.where(F.col("size") > hot).select("key")

    meet = rests.join(few, "key")
    a, b = (meet.select("key", F.col("word").alias(w), F.col("n").alias(f"{w}_n"), F.col("whole").alias(f"{w}_whole")) for w in ("word", "other"))
    # Both rests: a letter exchanged; one whole: a letter removed.
    fits = F.when(F.col("word_whole"), ~F.col("other_whole") & (F.length("other") == F.length("word") + 1))
    fits = fits.when(F.col("other_whole"), F.length("word") == F.length("other") + 1).otherwise(F.length("word") == F.length("other"))
    found = a.join(b, "key").where(fits & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")
    if many.isEmpty():
        return found
    return found.unionByName(_hot_pairs(rests.join(many, "key")))


def _hot_pairs(rests: DataFrame) -> DataFrame:
    """The pairs of the keys of ``rests``, met by key, remaining text and place: at most as many a word and place as there are letters."""
    word, at = F.col("word"), F.col("at")
    of = lambda i: F.substring(word, i, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: of(i) == F.col("letter"))
    left = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))
    # In a run of one letter the first place stands for all when a letter was removed.
    first = (at == 1) | (of(at - 1) != F.col("letter"))
    cut = rests.where(~F.col("whole")).select("key", "word", "n", "letter", F.explode(places).alias("at"))
    cut = materialize(cut.select("key", "word", "n", left.alias("rest"), "at", first.alias("first")), "spelling-hot")
    a, b = (cut.select("key", "rest", "at", F.col("word").alias(w), F.col("n").alias(f"{w}_n")) for w in ("word", "other"))
    exchanged = a.join(b, ["key", "rest", "at"]).where("word <> other").select("word", "other", "other_n")
    whole = rests.where("whole").select("key", F.col("word").alias("rest"), F.col("n").alias("rest_n"))
    removed = cut.where("first").join(whole, ["key", "rest"])
    longer = removed.select("word", F.col("rest").alias("other"), F.col("rest_n").alias("other_n"))
    shorter = removed.select(F.col("rest").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return exchanged.unionByName(longer).unionByName(shorter)


# --- forms ----------------------------------------------------------------------------------------


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = materialize(count_words(df, id_col, text_col), "spelling-words")
    return group_words(words, hot)


def group_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """The same of a written table (word, n) of distinct words."""
    best = F.min_by(F.struct(F.col("other").alias("form"), F.col("other_n").alias("form_n")), F.struct(-F.col("other_n"), F.col("other")))
    near = near_pairs(words, hot).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = F.col("best.form_n") >= FORM_RATIO * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, F.col("best.form_n")).alias("form_n")
    )
    found = materialize(found, "spelling-forms")
    forms = found.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("next"))
    # Each step multiplies the count by the ratio, so this many steps reach every last form.
    most, steps = found.agg(F.max("n")).first()[0] or 0, 0
    while most >= FORM_RATIO * LEAST_COUNT:
        most, steps = most // FORM_RATIO, steps + 1
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("at"))
    for _ in range(steps - 1):
        roots = roots.join(forms, "at", "left").select("word", F.coalesce("next", "at").alias("at"))
    out = found.join(roots.withColumnRenamed("at", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
