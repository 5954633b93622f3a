"""Toxicity, language and chat roles against versions by hand: risks and slopes, the kernel solved whole, all role paths."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, language_id, toxicity
from gridloom.llm.ngrams import hashed
from tests.llm.test_operators import DOCS


def _log1pexp(x):
    return math.log1p(math.exp(x)) if x < 30 else x


def test_risk_is_the_sum_over_rows():
    rng = np.random.default_rng(1)
    zp, zu, prior = rng.normal(size=7), rng.normal(size=11), 0.3
    positive = prior * sum(_log1pexp(-z) for z in zp) / 7
    negative = sum(_log1pexp(z) for z in zu) / 11 - prior * sum(_log1pexp(z) for z in zp) / 7
    a, b = toxicity.risk(zp, zu, prior)
    assert abs(a - positive) < 1e-12 and abs(b - negative) < 1e-12


def test_slope_is_the_risk_s_or_back_up_the_negatives():
    rng = np.random.default_rng(2)
    p, u, prior, step = rng.integers(0, 2, (9, 4)).astype(float), rng.integers(0, 2, (13, 4)).astype(float), 0.4, 1e-6
    seen = set()
    for _ in range(60):
        w = rng.normal(size=4) * 3
        overfitted = toxicity.risk(p @ w, u @ w, prior)[1] < 0
        seen.add(overfitted)
        for k in range(4):
            up, down = w.copy(), w.copy()
            up[k], down[k] = w[k] + step, w[k] - step
            rise = [(x - y) / (2 * step) for x, y in zip(toxicity.risk(p @ up, u @ up, prior), toxicity.risk(p @ down, u @ down, prior))]
            want = -rise[1] if overfitted else sum(rise)
            assert abs(toxicity.slope(w, p, u, prior)[k] - want) < 1e-4
    assert seen == {True, False}


def _words(text):
    return {zlib.crc32(w.encode()) & ((1 << toxicity.BITS) - 1) for w in re.findall(r"[^\W\d_]+", (text or "").lower())}


def test_toxicity_of_a_small_table(spark):
    bad, good = ["vile", "awful", "nasty", "rotten", "foul"], [f"good{chr(97 + k)}" for k in range(26)]
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        words = [*rng.choice(good, 12)] + ([*rng.choice(bad, 4, replace=False)] if k % 8 == 0 else [])
        rows.append((k, " ".join(rng.permutation(words)), "en", "s", 0))
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "Vile! " + "gooda " * 60_000, "en", "s", 0), (1003, "VILE awful nasty rotten foul", None, None, 1), (1003, "VILE awful nasty rotten foul", None, None, 1)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert set(model.grams) >= {zlib.crc32(w.encode()) & ((1 << toxicity.BITS) - 1) for w in bad}
    weight = dict(zip(model.grams.tolist(), model.weights.tolist()))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        z = model.bias + sum(weight.get(w, 0.0) for w in _words(r["text"]))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)
    found = {r["doc_id"]: r["predicted"] for r in got}
    assert found[1003] == 1 and found[1000] == found[1001] == 0
    assert all(found[k] == int(k % 8 == 0) for k in range(200, 400))


def test_words_are_counted_over_all_rows(spark, monkeypatch):
    """Selected words do not change if fewer unlabelled rows are fitted on: they are counted over all."""
    rows = [(k, ("vile foul " if k % 10 == 0 else "") + f"plain words here {'rare' if k % 3 else 'common'}", None, None, None) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels, F.lit(True)).grams.tolist()
    monkeypatch.setattr(toxicity, "UNLABELLED", 60)
    assert sorted(toxicity.train(docs, labels, F.lit(True)).grams.tolist()) == sorted(whole)


def test_kernel_ridge_solved_whole():
    """With every row a landmark, scores are those of the kernel system (K + ridge / weight) a = y over all rows."""
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list(a), 4)) for _ in range(12)) for a in ("abcdeo", "fghijo", "klmnoe") for _ in range(14)]
    labels = [x for x in ("aa", "bb", "cc") for _ in range(14)]
    grams = [set(hashed(t.lower(), language_id.SIZES, language_id.BITS).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    y = np.array([[1.0 if x == c else -1.0 for c in ("aa", "bb", "cc")] for x in labels])
    alpha = np.linalg.solve(kernel + language_id.RIDGE * 14 * np.eye(len(texts)), y)
    model = language_id.fit(language_id.presence(texts), labels)
    asked = ["abco fghj", "klmn eo " * 9, "zz", "fg hij"]
    new = [set(hashed(t.lower(), language_id.SIZES, language_id.BITS).tolist()) for t in asked]
    want = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in new]) @ alpha
    assert np.abs(model.scores(language_id.presence(asked)) - want).max() < 5e-3


def test_language_of_odd_rows(spark):
    rows = [(k, ("abc dab cabd " if k % 2 else "xyz zyxy xzz ") * (1 + k % 5), "aa" if k % 2 else "xx", "s", 0) for k in range(80)]
    odd = [(100, None, "aa", None, None), (101, "", None, "s", 0), (102, "12345 !?", None, None, 1), (103, "abc dab " * 40_000, None, None, 1), (104, "XYZ zyx", "aa", None, 1), (104, "XYZ zyx", "aa", None, 1)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    model = language_id.train(docs, F.col("doc_id") < 80)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect() if r["doc_id"] >= 100)
    assert got == [(100, "und"), (101, "und"), (102, "und"), (103, "aa"), (104, "xx"), (104, "xx")]
    assert {r["score"] for r in language_id.predict(docs, model).collect() if r["lang_pred"] == "und"} == {0.0}


def _best_path(model, texts):
    """The best roles of all lines, by trying all paths."""
    lines = [(emit, opens == 0, bool(mark)) for t in texts for e, m in [model.emission(t)] for opens, (emit, mark) in enumerate(zip(e, m))]

    def value(path):
        out = model.first[path[0]] + lines[0][0][path[0]]
        for k in range(1, len(path)):
            emit, opens, mark = lines[k]
            out += model.step(opens, mark)[path[k - 1], path[k]] + emit[path[k]]
        return out

    return max(itertools.product(range(3), repeat=len(lines)), key=value)


def test_roles_are_the_best_of_all_paths(spark):
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat_format.counted(chats, "conv_id", "turn", "text", "role")
    pool = ["hello there", "User: what is it?", "Assistant: this.\nand more", "System: be kind", None, "", "ok?", "one\nHuman: two"]
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for conv in range(12):
        texts = [pool[k] for k in rng.integers(0, len(pool), 5)]
        rows += [(conv, k, t, None) for k, t in enumerate(texts)]
        path, at = _best_path(model, texts), 0
        for k, t in enumerate(texts):
            want[conv, k] = chat_format.ROLES[path[at]]
            at += len(chat_format.lines_of(t))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for some in (rows, [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]):
            df = spark.createDataFrame(some, "conv_id int, turn int, text string, role string")
            got = {(r["conv_id"], r["turn"]): r["role_found"] for r in chat_format.format_chats(df, model).collect()}
            assert got == {k: v for k, v in want.items() if k in got} and len(got) == len(some)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_turns_over_partitions(spark):
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat_format.counted(chats, "conv_id", "turn", "text", "role")
    rows = [(1, 3, "the same words", None)] * 40 + [(1, 4, "Assistant: yes", None)] * 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, text string, role string"), model).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 43
    roles = chat_format._decode(model, [r[2] for r in rows], None, np.zeros(3))
    assert sorted(r["role_found"] for r in got) == sorted(chat_format.ROLES[p[0]] for p in roles)


def test_toxic_words_are_counted_over_all_toxic_rows(spark, monkeypatch):
    """Selected words do not change if fewer toxic rows are fitted on, and ids may be shuffled instead of sent."""
    rows = [(k, ("vile foul " if k % 4 == 0 else "") + f"plain words here {'rare' if k % 3 else 'common'}", None, None, None) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels, F.lit(True)).grams.tolist()
    monkeypatch.setattr(toxicity, "POSITIVES", 20)
    monkeypatch.setattr(toxicity, "MOST_SENT", 0)
    assert sorted(toxicity.train(docs, labels, F.lit(True)).grams.tolist()) == sorted(whole)


@pytest.mark.parametrize("text, is_letter", [("²½Ⅷ", False), ("½ ³ ①", False), ("é", True), ("ß 1", True), ("日", True)])
def test_number_forms_are_no_letters(spark, text, is_letter):
    model = language_id.fit(language_id.presence(["some words", "quelques mots"]), ["en", "fr"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert (language_id.predict(df, model).first()["lang_pred"] != "und") == is_letter


def test_emissions_of_a_role_sum_to_one():
    rng = np.random.default_rng(3)
    for seen in (np.zeros((3, chat_format.SYMBOLS)), rng.integers(0, 50, (3, chat_format.SYMBOLS))):
        emit = chat_format.emissions(seen)
        assert np.allclose(emit.sum(axis=1), 1) and (emit > 0).all()
        for m in range(3):
            own = emit[:, (m + 1) * chat_format.PER_MARKER : (m + 2) * chat_format.PER_MARKER].sum(axis=1)
            assert own.argmax() == m
    # Length counts on lines with a marker too.
    seen = np.zeros((3, chat_format.SYMBOLS))
    short, long = chat_format.symbol("user: ok", True), chat_format.symbol("user: " + "word " * 60, True)
    seen[1, long] = 50
    emit = chat_format.emissions(seen)
    assert emit[1, long] > 10 * emit[1, short]


def test_turns_that_start_at_one_and_have_gaps(spark):
    rows = [(c, t, "x", r) for c in range(20) for t, r in ((1, "system"), (5, "user"), (6, "assistant"), (90, "user"))] + [(None, None, "x", "user"), (None, 3, "y", "assistant")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string, role string")
    model = chat_format.counted(df, "conv_id", "turn", "text", "role")
    assert np.allclose(np.exp(model.first), np.array([21, 2, 1]) / 24)
    turn = np.ones((3, 3))
    turn[0, 1] += 20
    turn[1, 2] += 21
    turn[2, 1] += 20
    assert np.allclose(np.exp(model.turn), turn / turn.sum(axis=1, keepdims=True))


def test_roles_of_conversations_left_out(spark):
    """Counted from half of the conversations, found in the others."""
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    half = F.crc32(F.col("conv_id").cast("string")) % 2 == 0
    model = chat_format.counted(chats.where(half), "conv_id", "turn", "text", "role")
    got = chat_format.format_chats(chats.where(~half), model).toPandas()
    assert len(got) > 200 and (got["role"] == got["role_found"]).mean() > 0.9
