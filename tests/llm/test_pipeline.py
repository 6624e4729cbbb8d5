"""The pipeline against a brute-force version of each stage's decisions."""

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import decontaminate, mixing, quality
from tests.llm.test_near import plain_fingerprint, united


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = np.random.default_rng(3), tmp_path_factory.mktemp("sf")
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(60)).capitalize() + "." for _ in range(200)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(100)]
    item = " ".join(word() for _ in range(30)) + "."
    texts = good + bad + [good[0], good[0], good[1].upper().lower(), good[2] + " " + item, None, ""]
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_decide_as_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    kept = stages["quality"](spark, docs, folder).cache()
    scores = {r.doc_id: r.predicted for r in quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).score(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scores.items() if p) and not {r.doc_id for r in kept.collect()} & set(range(200, 300))
    unique = stages["near_dedup"](spark, kept, folder).cache()
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in kept.collect())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4]
    assert sorted(r.doc_id for r in unique.collect()) == sorted({rows[c][0] for c in united(len(rows), links)})
    clean = stages["decontaminate"](spark, unique, folder).cache()
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    plain = lambda t: b" ".join(decontaminate.words(t))
    assert {r.doc_id for r in unique.collect()} - {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect() if plain(item) in plain(r.text)} == {303}
    mixed = stages["mix"](spark, clean, folder).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    done = stages["tokens"](spark, mixed, folder).orderBy("start").collect()
    assert [r.doc_id for r in done] == sorted(r.doc_id for r in mixed.collect())
    assert [r.start for r in done] == np.cumsum([0] + [r.n_tokens for r in done])[:-1].tolist()
    assert all(df.columns == docs.columns for df in (kept, unique, clean, mixed))


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_nothing_in_nothing_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
