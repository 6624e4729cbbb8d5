"""The registered corpus queries themselves: columns, held-out rules, accuracy on rows that were not learned from."""

import zlib

import numpy as np
import pytest

from quillspark.llm import decontaminate, embeddings, langid, mixing, pii, quality, sharding
from quillspark.llm import registry
from quillspark.llm.pitman_yor import op1_pitman_yor

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = {
    "op1_pitman_yor": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    found = [f"{n} {t}" for n, t in registry.QUERIES[name](spark, SMALL).dtypes]
    assert found[: len(COLUMNS[name].split(", "))] == COLUMNS[name].split(", ")


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_model_scores_rows_it_did_not_learn_from(spark):
    rows = op1_pitman_yor(spark, SMALL).collect()
    assert all(r.held_out == held(r.doc_id, 7, 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in rows)


def test_languages_of_held_out_rows(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op6_language(spark, MEDIUM).collect()
    assert len(rows) == len(true) and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and true[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in out]) > 0.97 and len(out) > 100


def test_quality_ranks_held_out_rows(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality").collect()}
    rows = quality.op9_quality(spark, MEDIUM).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and label.get(r.doc_id) == v] for v in (1, 0))
    assert len(good) > 10 and len(bad) > 10 and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_every_language_is_learned(spark):
    rows = [(i, " ".join(f"{chr(97 + i)}{chr(98 + i)}{chr(97 + (i * 5 + k) % 24)}" for k in range(60)), f"l{i:02}") for i in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:02}" for i in range(12)]


def test_extreme_vectors_link(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e200, 1.0]), (3, [1e-200, 1e-200]), (4, [1e-200, 1e-200]), (5, [5e-324, 0.0]), (6, [0.0, 0.0]), (7, [float("inf"), 1.0]), (8, [1e308, 1e308])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (2, 3), 4: (2, 3), 8: (2, 3), 6: (0, 6), 7: (0, 7)}


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(3)
    for good, bad, n in ((900, 1100, 300), (3, 5, 4), (10, 1_000_000, 500), (7, 0, 3)):
        drawn, law = np.array([sharding.inverted(rng, good, bad, n) for _ in range(4000)]), rng.hypergeometric(good, bad, n, 40_000)
        assert abs(drawn.mean() - law.mean()) < 5 * (law.std() + 1e-9) / 4000**0.5 + 1e-9 and drawn.min() >= max(0, n - bad) and drawn.max() <= min(n, good)
        assert law.std() == 0 or abs(drawn.std() / law.std() - 1) < 0.1
    big = [sharding.inverted(rng, 4 * 10**9, 96 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 40_000) < 60


def test_clashing_columns_come_back(spark):
    names = ["_source", "_p", "_range", "_a", "_b", "_rank", "_in", "_before", "_at", "_clean", "_digit", "_base", "_extra", "_found", "_hits0", "row", "of", "target", "n"]
    docs = spark.createDataFrame([(i, f"mail a{i}@example.com 10.0.0.{i}", "s", "en", *[f"{n}{i}" for n in names]) for i in range(30)], "doc_id long, text string, source string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for made, added in ((mixing.mix(docs), mixing.ADDED), (sharding.shard_rows(docs), ()), (pii.detect(docs), ()), (langid.fit(docs).identify(docs), ()), (decontaminate.search(docs, items), ())):
        rows = made.collect()
        assert len(rows) == 30 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names if n not in added)


def test_planted_personal_data(spark):
    """Spans of the added kinds: true ones beside strings of the same form that are something else."""
    rng = np.random.default_rng(5)
    code = lambda n: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    rows, planted = [], {}
    for i in range(400):
        kind, value = [("secret", code(32)), ("ssn", f"{rng.integers(100, 665)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"), (None, ""), (None, "")][i % 4]
        before = {"secret": "the api key is ", "ssn": "her social security number is ", None: "nothing to see in order "}[kind]
        text = f"some words stand here {before}{value} and others follow"
        rows.append((i, text))
        if kind:
            planted[i] = (kind, text.index(value), text.index(value) + len(value))
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([planted[i] in found[i] for i in planted]) > 0.9 and not any(found[i] for i in range(400) if i not in planted)
