"""Context-tree weighting, the Merkle manifest and spelling variants against plain versions."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import context_tree, merkle, queries, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
ODD = [(1, "Abc abd  ABC\nabc", "a", "x", 3), (2, None, None, None, None), (3, "", "", "", 0), (2, "żółw \U0001f600 abc " * 3, "a", "x", 3), (2, "żółw \U0001f600 abc " * 3, "a", "x", 3),
       (None, "abc only here", None, "y", 1), (5, "b" * 70 + " " + "q" * 3000, "a", "z", 9), (6, " \t\n ", "a", "x", 2), (7, "\x00\x1f~ ab", "a", "x", 2)]


# --- op11 -----------------------------------------------------------------------------------------


def plain_ctw(learned, depth):
    """log2 of the probability of any text, by one dictionary of nodes."""
    ends = bytes([255]) * depth
    counts = defaultdict(lambda: [0, 0])
    for t in learned:
        data = ends + t + b"\xff"
        for p in range(depth, len(data)):
            for k in range(8):
                bit, node = (data[p] >> (7 - k)) & 1, (256 | data[p]) >> (8 - k)
                for d in range(depth + 1):
                    counts[data[p - d : p], node][bit] += 1
    children = defaultdict(list)
    for c, node in counts:
        if c:
            children[c[1:], node].append((c, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    own, below, log_w = {}, {}, {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own[key] = kt(*counts[key])
        below[key] = sum(log_w[x] for x in children[key])
        log_w[key] = own[key] if len(key[0]) == depth else np.logaddexp(own[key], below[key]) - math.log(2)

    def p1(context, node, d):
        key = (context[len(context) - d :] if d else b"", node)
        if key not in counts:
            return 0.5
        a, b = counts[key]
        mine = (b + 0.5) / (a + b + 1)
        if d == depth:
            return mine
        share = 1 / (1 + math.exp(min(700, below[key] - own[key])))
        return share * mine + (1 - share) * p1(context, node, d + 1)

    def score(t):
        data, total = ends + t + b"\xff", 0.0
        for p in range(depth, len(data)):
            for k in range(8):
                one = p1(data[p - depth : p], (256 | data[p]) >> (8 - k), 0)
                total += math.log2(one if (data[p] >> (7 - k)) & 1 else 1 - one)
        return total

    return score


def plain_base(rows, learn):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for (d, t), k in zip(rows, learn) if k for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(w := tokens(t)), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for _, t in rows]


def check_scores(spark, rows, depth):
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "row bigint, doc_id bigint, text string")
    learned = [r[0] is not None and crc32(str(r[0]).encode()) % 10 != 0 for r in rows]
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(-1))
    model = context_tree.train(df, rest > 0, depth=depth)
    got = {r["row"]: r for r in context_tree.score(df, model, keep=["row", "doc_id"]).collect()}
    assert len(got) == len(rows)
    plain = plain_ctw([context_tree.as_bytes(r[1]) for r, k in zip(rows, learned) if k], depth)
    n, base = plain_base([r[:2] for r in rows], learned)
    assert model.train_tokens == n
    for k, (r, want) in enumerate(zip(rows, base)):
        assert (got[k]["n_tokens"], got[k]["n_known"]) == want[:2]
        assert math.isclose(got[k]["base_score"], want[2], rel_tol=1e-12)
        data = context_tree.as_bytes(r[1])
        assert abs(got[k]["score"] - plain(data) * math.log10(2)) < 1e-6 * (len(data) + 1)
        assert got[k]["n_bytes"] == len(data) + 1 and math.isclose(got[k]["bits_per_byte"], -got[k]["score"] / math.log10(2) / (len(data) + 1))


@pytest.mark.parametrize("depth, hot", [(4, 2**19), (5, 40), (6, 0)])
def test_context_trees(spark, depth, hot, monkeypatch):
    monkeypatch.setattr(context_tree, "HOT_GRAMS", hot)
    monkeypatch.setattr(context_tree, "HOT_WORDS", hot // 4)
    monkeypatch.setattr(context_tree, "PIECE", 211)
    monkeypatch.setattr(context_tree, "HELD_GRAMS", 500)
    monkeypatch.setattr(context_tree, "HELD_WORDS", 7)
    some = [(10 + k, f"the cat {k % 5} sat on the mat and The dog {k % 3} ran", None) for k in range(30)]
    check_scores(spark, ODD + some, depth)


def test_context_trees_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 400)).limit(60).collect()
    check_scores(spark, [tuple(r) for r in rows], 5)


def test_context_trees_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert context_tree.score(df, context_tree.train(df, F.lit(True))).count() == 0
    one = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    found = context_tree.score(one, context_tree.train(one, F.lit(False))).first()
    assert (found["bits_per_byte"], found["n_known"], found["n_tokens"]) == (8.0, 0, 2)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "ab", 5, 6)], "doc_id bigint, text string, Score bigint, rare_words bigint")
    found = context_tree.score(df, context_tree.train(df, F.lit(True)))
    assert found.columns[:3] == ["doc_id", "text", "rare_words"] and isinstance(found.first()["score"], float)


def test_probabilities_of_a_context_sum_to_one(spark):
    """After any five bytes the 256 next bytes share all probability."""
    texts = ["abcabcabd"] * 3 + [f"abcab{chr(c)}" for c in range(32, 127) if not chr(c).isupper()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    model = context_tree.train(df, F.col("doc_id") < 3)
    known = {g: b for g, b in model.grams.select("gram", "bits").collect()}
    front = int.from_bytes(b"abcab", "big") << 8
    held = sum(2 ** (-known[front | c] / 2**context_tree.PRECISION) for c in range(32, 127) if not chr(c).isupper())
    assert 0.5 < held < 1


# --- op12 -----------------------------------------------------------------------------------------

H = lambda x: sha256(x.encode()).hexdigest()


def plain_manifest(rows, fanout=3):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: H("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(nodes):
        """(root, per leaf the siblings before and after at every level)"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(at):
                s = p - p % fanout
                paths[k].append(("".join(nodes[s:p]), "".join(nodes[p + 1 : s + fanout])))
            nodes = [H("".join(nodes[s : s + fanout])) for s in range(0, len(nodes), fanout)]
            at = [p // fanout for p in at]
        return nodes[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees.append(tree([x[2] for x in by[s]]))
    root, upper = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), over in zip(sources, trees, upper):
        for (_, _, own, r), path in zip(by[s], paths):
            changed = leaf(r, r[1].replace("\n", "")) if r[1] is not None and r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 else own
            now = changed
            for a, b in path + over:
                now = H(a + now + b)
            out.append((r[0], own, subroot, root, H("".join(a + b for a, b in path + over)), now, now == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, levels):
    df = spark.createDataFrame(rows, SCHEMA)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return sorted((tuple(r) for r in merkle.manifest(df, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")), levels=levels).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_manifest(spark, levels):
    many = [(100 + k, f"text {k}\nline", "l", "hot" if k % 3 else f"s{k % 7}", k) for k in range(95)]
    assert manifest_rows(spark, ODD + many, levels) == plain_manifest(ODD + many)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9, 10, 28])
def test_one_source(spark, n):
    rows = [(k, f"{k}\n", None, "s", None) for k in range(n)]
    assert manifest_rows(spark, rows, 2) == (plain_manifest(rows) if rows else [])


def test_many_sources_and_clashing_names(spark):
    rows = [(k, "t", None, f"s{k}", 1) for k in range(31)]
    assert manifest_rows(spark, rows, 1) == plain_manifest(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Root", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("other", F.lit(3))
    assert merkle.manifest(df, keep=df.columns).columns == ["doc_id", "text", "lang", "source", "n_chars", "other", *merkle.RESULTS]


# --- op13 -----------------------------------------------------------------------------------------


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = crc32(f"{'' if doc is None else doc}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(n):
    near = defaultdict(list)
    for a, b in combinations(n, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("hot", [64, 1])
def test_words_of_few_letters(spark, hot, monkeypatch):
    """Permutations and repeats of few letters share keys; chains of forms; letters beyond ASCII."""
    rng = np.random.default_rng(5)
    n = {"".join(rng.choice(list("abé"), rng.integers(7, 10))): int(10 ** rng.uniform(0.4, 5)) for _ in range(400)}
    n |= {"kitchens": 40_000, "kitchenz": 4_000, "kitcheny": 400, "kitcheyy": 40, "kittheyy": 4, "Ààààààà": 5, "ààààààà": 50, "àààààààà": 500}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = sorted((tuple(r) for r in spelling.group_words(df, hot).collect()), key=lambda r: r[0])
    assert got == plain_groups(n)
    assert max(len(r) for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    rows = [(k, "Kitchens kitchens kitchenz Straße STRASSEN strassen déjàvus × naïvetés naïvetés" + " excellence" * (k % 4)) for k in range(60)]
    rows += [(None, "excellence excellenc"), (3, None), (4, ""), (5, "excellence " * 40), (5, "excellence " * 40), (6, "z" * 30_000 + " " + "z" * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, word int, N int")
    assert sorted(tuple(r) for r in spelling.variants(df).collect()) == plain_groups(plain_words(rows))
    assert spelling.variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_spelling_variants"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    rows = [tuple(r[k] for k in order) for r in found.collect()]
    plain = [tuple(r[want.columns.index(k)] for k in order) for r in want.fetchall()]
    assert sorted(rows, key=str) == sorted(plain, key=str)
