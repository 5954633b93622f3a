"""Host-level quality rules, in DataFrame functions only.

Each document is measured on its own (words, symbols, repeated lines, repeated eight-word
windows). Rule failures are then aggregated by host, every host's failure rate is shrunk by a
beta prior fitted to all hosts by the method of moments, and the host's verdict is joined back
to its documents, where it decides how strict the remaining rules are.

Cases: a null or empty text has no words and fails; a null host is the host ``''``; repeated
rows count and are judged one by one; an empty table gives an empty result; input columns that
clash with a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, other_columns, quoted

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Symbols per 100 word characters that a document may have, by its host's verdict.
SYMBOL_PERCENT = {"trusted": 30, "watch": 10}
#: Lines repeating an earlier one, per 100 words, that a document may have.
DUP_LINES_PER_100_WORDS = {"trusted": 20, "watch": 5}
#: A host is watched, or blocked, from these shrunk failure rates on.
WATCH_RATE, BLOCK_RATE = 0.5, 0.9
#: Hosts up to this many (about 100 bytes each) are broadcast; more are joined by salted keys.
BROADCAST_HOSTS = 100_000
SALTS = 64

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
VERDICT = ["host", "host_rate", "host_verdict", "kept"]

_SPACES, _WORD = "[ \\x09-\\x0D]+", "[^ \\x09-\\x0D]"


def _joined_with_next(step: int):
    return lambda x, i: F.xxhash64(x, F.get(F.col("__h"), i + step))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns of ``MEASURES`` to every document.

    Windows are compared by the 64-bit hash of their words, within one text only.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rest = other_columns(df, MEASURES)
    lines = F.filter(F.split(F.col("__t"), "\n", -1), lambda x: x.rlike(_WORD))
    staged = (
        df.select(*[quoted(c) for c in rest], text.alias("__t"))
        .withColumn("__w", F.array_remove(F.split(F.col("__t"), _SPACES, -1), ""))
        .withColumn("__l", lines)
    )
    # A window's mark is made of the marks of its halves: 1, 2, 4, then 8 words.
    staged = staged.withColumn("__h", F.when(F.size("__w") >= WINDOW, F.transform("__w", lambda x: F.xxhash64(x))))
    for half in (1, 2, 4):
        staged = staged.withColumn("__h", F.transform("__h", _joined_with_next(half)))
    staged = staged.withColumn("__h", F.slice("__h", F.lit(1), F.size("__w") - (WINDOW - 1)))
    # Sorting is paid only by texts in which a window comes twice.
    twice = F.size("__h") > F.size(F.array_distinct("__h"))
    pairs = F.when(twice, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    staged = staged.withColumn("__p", pairs)
    same = lambda x, k: (k >= 0) & (k < F.size("__p")) & (F.get(F.col("__p"), k)["h"] == x["h"])
    found = F.sort_array(F.transform(F.filter("__p", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    staged = staged.withColumn("__r", found)
    covered = F.aggregate(
        F.col("__r"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    n_words = F.size("__w").cast("bigint")
    word_chars = F.length(F.array_join("__w", "")).cast("bigint")
    symbols = F.length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("bigint")
    dup = (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint")
    made = F.struct(
        n_words.alias("n_words"),
        word_chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        dup.alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )
    # inline() keeps later filters from being pushed below it, which would repeat the expressions above.
    measured = staged.select(*[quoted(c) for c in rest], F.inline(F.array(made)))
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats)


def _over(percent: dict[str, int], verdict: str, what: str, of: str) -> Column:
    return 100 * F.col(what) > percent[verdict] * F.col(of)


def rules_failed(verdict: str) -> Column:
    """Whether a measured document fails the rules that follow the base ones."""
    return _over(SYMBOL_PERCENT, verdict, "n_symbols", "word_chars") | _over(DUP_LINES_PER_100_WORDS, verdict, "n_dup_lines", "n_words")


def host_verdicts(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """One row a host: documents, failures, shrunk failure rate and verdict.

    The beta prior has the mean of all documents' failures; its strength follows from the
    variance of the hosts' rates. With one host, or hosts that do not differ, the prior is as
    strong as all documents together and every host gets the common rate.
    """
    host = F.coalesce(quoted(host_col).cast("string"), F.lit(""))
    failed = F.col("base_failed") | rules_failed("trusted")
    hosts = measured.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(failed.cast("bigint")).alias("host_failed"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    mean = F.sum("host_failed") / F.sum("host_docs")
    prior = hosts.agg(mean.alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.sum("host_docs").cast("double").alias("n"))
    strength = F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.greatest(F.lit(0.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.col("n"))
    first = prior.select("m", strength.alias("s")).first()
    m, s = (first["m"] or 0.0, first["s"] or 0.0) if first else (0.0, 0.0)
    shrunk = (F.col("host_failed") + F.lit(float(m * s))) / (F.col("host_docs") + F.lit(float(s)))
    verdict = F.when(F.col("host_rate") >= BLOCK_RATE, "blocked").when(F.col("host_rate") >= WATCH_RATE, "watch").otherwise("trusted")
    return hosts.withColumn("host_rate", shrunk).withColumn("host_verdict", verdict)


def apply_verdicts(measured: DataFrame, verdicts: DataFrame, host_col: str = "source", salt_col: str | None = None) -> DataFrame:
    """Join every host's verdict to its documents and decide which are kept.

    Few hosts are broadcast. Beyond ``BROADCAST_HOSTS`` each host row is repeated ``SALTS``
    times and a document takes one by a hash of its id, so that a hot host is spread.
    """
    rest = [c for c in measured.columns if c.lower() not in VERDICT]
    host = F.coalesce(quoted(host_col).cast("string"), F.lit(""))
    left = measured.select(*[quoted(c) for c in rest], host.alias("__host"))
    right = verdicts.select("host", "host_rate", "host_verdict")
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = left.join(F.broadcast(right), F.col("__host") == F.col("host"))
    else:
        salt = F.pmod(F.xxhash64(*[quoted(c) for c in ([salt_col] if salt_col else MEASURES)]), F.lit(SALTS)).cast("int")
        right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.withColumn("__salt", salt).join(right, (F.col("__host") == F.col("host")) & (F.col("__salt") == F.col("__s")))
    fails = F.when(F.col("host_verdict") == "blocked", True).when(F.col("host_verdict") == "watch", rules_failed("watch")).otherwise(rules_failed("trusted"))
    return joined.withColumn("kept", ~(F.col("base_failed") | fails)).select(*[quoted(c) for c in rest], *VERDICT)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Measure ``docs`` once and return every row, without its text, with measures and verdict."""
    slim = docs.select(*{c: quoted(c) for c in (id_col, host_col, text_col)}.values())
    measured = materialize(measure(slim, text_col).drop(text_col), "quality")
    return apply_verdicts(measured, host_verdicts(measured, host_col), host_col, id_col)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The text is measured in two passes: once for the hosts, once beside the rows to keep, which
    is cheaper than shuffling every text to its verdict.
    """
    slim = docs.select(*{c: quoted(c) for c in (host_col, text_col)}.values())
    verdicts = host_verdicts(measure(slim, text_col), host_col)
    own = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("__row"), quoted(text_col).alias("__text"), quoted(host_col).alias("__source"), quoted(id_col).alias("__id"))
    judged = apply_verdicts(measure(own, "__text"), verdicts, "__source", "__id")
    return judged.where("kept").select("__row.*")
