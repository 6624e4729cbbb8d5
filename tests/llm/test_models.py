"""Models: exact parts against loops, the rest by held-out quality and by laws of probability."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import langid, pitman_yor, quality


@pytest.mark.parametrize("few", [256, 1])
def test_scores(spark, corpus, few):
    rows = pitman_yor.score(corpus.withColumnRenamed("lang", "score"), few=few).collect()
    texts = Counter((r.doc_id, r.text) for r in corpus.collect())
    words = {k: [*(k[1] or "").encode().lower().split(), None] for k in texts}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for k, n in texts.items() if not held(k[0]) for w in words[k] * n)
    n, v = sum(seen.values()), len(seen)
    by_id = {k[0]: k for k in texts}
    assert len(rows) == corpus.count()
    for r in rows:
        own = words[by_id[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(seen[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own)) and r.score < 0
    out = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert pitman_yor.score(corpus.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    """Each word scored behind a known context, in one-word texts: start and word, then word and end."""
    docs = [(i, t) for i, t in enumerate(["a b", "a b", "a c", "b a c", "c"] * 6)]
    fit = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 7 != 2]
    ask = [(i, w) for i, w in zip([i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2], ["a", "b", "c", "", "new"], strict=False)]
    rows = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(fit + ask, "doc_id long, text string")).collect()}
    first = pitman_yor.score(spark.createDataFrame(fit + [(ask[0][0], "")], "doc_id long, text string")).where(f"doc_id = {ask[0][0]}").first().score
    assert 10**first < 1 and rows[ask[3][0]] == pytest.approx(first, abs=0.3)
    assert rows[ask[4][0]] < min(rows[i] for i, _ in ask[:3])


def test_seating_follows_its_law():
    """Tables of three customers, against the law worked out by hand."""
    theta, d, base = 1.0, 0.5, 0.2
    table = pitman_yor.stirling(pitman_yor.EXACT, d)
    weight = np.array([theta * base * (1 - d) * (2 - d), 0.0, 0.0])
    weight[1] = theta * (theta + d) * base**2 * ((1 - d) + (2 - 2 * d))
    weight[2] = theta * (theta + d) * (theta + 2 * d) * base**3
    n = 200_000
    t = pitman_yor.draw_tables(np.random.default_rng(0), np.full(n, 3), np.zeros(n), np.full(n, base), theta, d, table)
    assert np.allclose(np.bincount(t, minlength=4)[1:] / n, weight / weight.sum(), atol=0.005)
    big = pitman_yor.draw_tables(np.random.default_rng(0), np.array([1, 100, 101, 100_000]), np.zeros(4), np.full(4, base), theta, d, table)
    assert big[0] == 1 and (big[1:] >= 1).all() and big[3] > big[1]


def test_packed_arrays():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0), np.array([True])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True))


def languages(spark):
    rng = np.random.default_rng(0)
    of = {"aa": list("abcdefg "), "bb": list("nopqrst "), "cc": list("abnopxy ")}
    rows = [(i, "".join(rng.choice(of[k], 120)), k) for i, k in enumerate(list(of) * 60)]
    return spark.createDataFrame(rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "aa"), (903, "abc", None), (904, "qrst " * 30_000, None)], "doc_id long, text string, lang string")


def test_languages(spark):
    docs = languages(spark)
    rows = {r.doc_id: r for r in langid.fit(docs.where("doc_id % 4 <> 2")).identify(docs.withColumnRenamed("lang", "score")).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert all(rows[i].lang_pred == true[i] and 0 < rows[i].score <= 1 for i in range(180))
    assert [rows[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "bb"] and rows[900].score == 0
    assert langid.fit(docs.limit(0)).identify(docs).where("lang_pred <> 'und'").count() == 0


def test_kneser_ney_is_a_distribution():
    model = langid.build(["x", "y"], [(lang, g, n) for lang, gs in (("x", ["   a", "  ab", " ab ", "   b", "  b "]), ("y", ["   c", "  c "])) for g, n in zip(gs, [3, 2, 2, 1, 1], strict=False)])
    letters = ["a", "b", "c", " ", "?"]
    for context in ("   ", "  a", "zzz"):
        codes = np.concatenate([np.frombuffer((context + c).encode("utf-32-le"), np.uint32) for c in letters]).astype(np.uint64)
        p = 10.0 ** model.log10(codes, np.arange(3, len(codes), 4))
        assert np.allclose(p.sum(0), 1, atol=1e-5), context


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)).capitalize() + ".", 1) for i in range(300)]
    bad = [(1000 + i, " ".join("".join(rng.choice(list("ABCDEFGH"), 5)) + "!!" for _ in range(60)), 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None), (5001, ""), (5002, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad if i % 3] + [(1, None), (2, 1), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.fit(docs, labels).score(docs.withColumnRenamed("text", "t"), "t").collect()}
    assert all(rows[i].predicted == y for i, _, y in good + bad if i % 3 == 0) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert {r.score for r in quality.fit(docs, labels.limit(0)).score(docs).collect()} == {0.5}
    assert quality.fit(docs.limit(0), labels).score(docs.limit(0)).count() == 0


def test_isotonic():
    assert np.allclose(quality.isotonic(np.array([1.0, 3, 2, 4]), np.array([1.0, 1, 3, 1])), [1, 2.25, 2.25, 4])


def test_languages_of_tables_of_one_fold(spark):
    """Documents that all calibrate, one document, one language: no crash, and what was seen is learned."""
    kinds = "doc_id long, text string, lang string"
    for rows in ([(7, "only one text", "en")], [(i, f"text {i} of few", "en") for i in (7, 10, 14)], [(i, "one language alone", "de") for i in range(40)]):
        model = langid.fit(spark.createDataFrame(rows, kinds))
        found = model.identify(spark.createDataFrame([*rows, (99, "12 34", None), (98, None, None)], kinds)).collect()
        assert model.languages == [rows[0][2]] and all(r.lang_pred == ("und" if r.doc_id in (98, 99) else rows[0][2]) for r in found)
        assert all(0 <= r.score <= 1 for r in found) and len(found) == len(rows) + 2
