"""Benchmark passages that documents hold but for their end, and items without an id."""

import pytest

from quillspark.llm import decontaminate

BODY = " ".join(f"term{i}" for i in range(30))
ITEMS = [(0, f"{BODY} doez. Ñ."), (1, f"{BODY.replace('term', 'word')}. Answer: the Danube"), (None, BODY.replace("term", "none")), (None, BODY.replace("term", "other"))]


@pytest.mark.parametrize("shard", [20_000, 2])
def test_the_end_decides_only_where_it_is_the_answer(spark, shard):
    filler = " ".join(f"plain{i % 40}" for i in range(200))
    texts = {0: f"{filler} {BODY} doez. {filler}", 1: f"{BODY} {filler}", 2: f"{BODY.replace('term', 'word')}. Answer: {filler}", 3: f"{filler} {ITEMS[1][1]}", 4: f"{ITEMS[2][1]} {ITEMS[3][1]}", 5: " ".join(BODY.split()[:20]) + " doez. Ñ."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decontaminate.search(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), shard_items=shard).collect()
    hits = sorted((r.doc_id, -1 if h.item_id is None else h.item_id, round(h.answer_overlap, 2)) for r in rows for h in r.hits)
    assert hits == [(0, 0, 0.0), (1, 0, 0.0), (3, 1, 1.0), (4, -1, 1.0), (4, -1, 1.0)]
