"""Null and repeated ids: what a row is does not depend on its id alone."""

from gridloom.llm import decontaminate, simhash
from tests.llm.test_operators import DOCS


def test_null_item_ids_count_their_hits(spark):
    named, nameless = " ".join(f"p{k}" for k in range(15)), " ".join(f"q{k}" for k in range(15))
    docs = spark.createDataFrame([(1, named + " " + nameless, None, None, 0), (2, nameless, None, None, 0)], DOCS)
    bench = spark.createDataFrame([("a", named), (None, nameless), (None, "zz")], "item_id string, text string")
    for shard in (10, 100_000):
        got = {r["doc_id"]: r for r in decontaminate.verdicts(decontaminate.scan(docs, bench, shard_words=shard)).collect()}
        assert (got[1]["n_hit"], got[1]["n_items"], got[1]["item_ids"]) == (30, 1, ["a"])
        assert (got[2]["n_hit"], got[2]["n_items"], got[2]["contaminated"]) == (15, 0, True)
        assert decontaminate.remove(docs, bench).count() == 0


def test_keep_one_row_of_each_component(spark):
    a, b, c, d = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue black white grey pink", "sun moon star sky cloud rain wind")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, c), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(1, a), (5, b), (9, c), (None, d)]))
