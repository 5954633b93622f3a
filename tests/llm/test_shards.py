"""However many shards the benchmark has, a plan holds a bounded number of them."""

import re

from gridloom.llm import decontaminate
from tests.llm.test_operators import DOCS


def test_many_shards_in_bounded_stages(spark):
    items = [(f"i{k:02d}", " ".join(f"w{k}x{n}" for n in range(14))) for k in range(11)]
    docs = spark.createDataFrame([(k, f"see {t} there", None, None, 0) for k, (_, t) in enumerate(items)] + [(99, " ".join(t for _, t in items), None, None, 0)], DOCS)
    found = decontaminate.scan(docs, spark.createDataFrame(items, "item_id string, text string"), shard_words=14)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[k]["item_ids"] == [i] and got[k]["hit_spans"] == [(1, 15)] for k, (i, _) in enumerate(items))
    assert got[99]["item_ids"] == [i for i, _ in items] and got[99]["hit_spans"] == [(0, 14 * 11)]
