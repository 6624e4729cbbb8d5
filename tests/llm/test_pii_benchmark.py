"""Personal data and benchmark passages against plain loops."""

import re

import numpy as np
import pytest

from quillspark.llm import decontaminate, pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    for kind, (pattern, ok) in rules.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return out


TEXTS = [None, "", "é a@b.co x@y.z.w, +1 (017) 555-7713 1.2.3.4.5.6.7.8 999.1.1.1 007.1.2.3", "a@b.c@d.e a@b.cd+x@e.f 4111111111111111 4111 1111-1111 1111 x4539578763621486", "+12345678 +1(2)..--  34567890", "a@b.co " * 700, "1" * 5000 + " " + "1 " * 3000 + "a" * 20_000 + "@" + "b" * 100 + ".c" * 300, " a@b.co", 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" end']


def test_base_spans(spark):
    rng = np.random.default_rng(0)
    parts = ["1", "23", ".", "-", " ", "+", "(", ")", "a", "@", "b.c", "4111111111111111", "255.1.2.3", "é", "x@y.z"]
    texts = TEXTS + ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.detect(docs.selectExpr("doc_id", "text", "'x' AS spans_")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base(texts[r.doc_id]), texts[r.doc_id]
    added = next(r for r in rows if r.doc_id == 8).spans
    assert [(s.kind, texts[8][s.start : s.end]) for s in added] == [("secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda")]
    assert pii.detect(docs.limit(0)).count() == 0


ITEMS = [(0, "What is the colour of the quiet northern sky at dawn? It is a pale and silver blue."), (1, "Short one."), (2, "Which of these rivers runs east? Answer: the Danube"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(300))), (5, " ".join(f"w{i}" for i in range(300)))]


@pytest.mark.parametrize("shard", [20_000, 2])
def test_items_are_found(spark, shard):
    filler = " ".join(f"plain{i % 40}" for i in range(200))
    texts = {0: f"{filler} {ITEMS[0][1].upper()} {filler}", 1: f"say: short ONE! {filler}", 2: filler, 3: None, 4: "", 5: f"{filler} {ITEMS[5][1]}", 6: "What is the colour of the quiet", 7: ITEMS[2][1].replace("Danube", "Rhine"), 8: ITEMS[2][1], 9: f"{filler} " * 300 + ITEMS[0][1]}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, hits string")
    rows = decontaminate.search(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), shard_items=shard).collect()
    assert {(r.doc_id, h.item_id) for r in rows for h in r.hits} == {(0, 0), (1, 1), (5, 5), (8, 2), (9, 0)}
    assert decontaminate.search(docs, spark.createDataFrame([], "item_id long, text string")).where("size(hits) > 0").count() == 0


def test_bounds_hide_no_segment():
    """Retrieval with block bounds gives all that scoring every segment gives."""
    rng = np.random.default_rng(0)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 40_000) if x < 3000]
    items = [(i, " ".join(rng.choice(words, rng.integers(3, 90)))) for i in range(300)]
    index = decontaminate.Index(items)
    texts = [" ".join(rng.choice(words, 400)) + " " + (items[i][1] if i % 3 else "") for i in range(60)]
    docs = [np.array([index.vocabulary[w] for w in decontaminate.words(t)]) for t in texts]
    for codes, got in zip(docs, index.retrieve(docs, 0.5), strict=True):
        best: dict[int, float] = {}
        for a in range(0, max(1, len(codes)), index.half):
            query = np.unique(codes[a : a + 2 * index.half])
            score = np.zeros(len(index.owner))
            for t in query[query >= 0]:
                own = slice(index.first[t], index.first[t + 1])
                score[index.seg[own]] += index.weight[own]
            for s in np.flatnonzero(score >= 0.5):
                best[int(index.owner[s])] = max(best.get(int(index.owner[s]), 0), score[s])
        assert got.keys() == best.keys() and all(got[k] == pytest.approx(best[k]) for k in got)
