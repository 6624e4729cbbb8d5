"""Mixing against exact water filling, sharding against its laws."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import mixing, sharding
from quillspark.llm.common import components


def filled(sizes, weights, cap):
    """Targets by resharing until none is above its cap."""
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [k for k in sizes if k not in capped]
        rest = total - sum(cap * sizes[k] for k in capped)
        share = {k: Fraction(weights[k] * rest, sum(weights[j] for j in open_)) for k in open_}
        over = {k for k in open_ if share[k] > cap * sizes[k]}
        if not over:
            return {k: Fraction(cap * sizes[k]) if k in capped else share[k] for k in sizes}
        capped |= over


def test_mix(spark, corpus):
    rows = mixing.mix(corpus).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size and r.copies <= 3
    order = sorted((k for k in sizes if k is not None)) + [None]
    want = filled(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, 3)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), abs=1e-6)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies in (int(rate), int(rate) + 1)
    assert sum(want.values()) == sum(sizes.values())
    assert sorted(rows, key=str) == sorted(mixing.mix(corpus.repartition(7)).collect(), key=str)


def test_mix_reaches_targets_and_keeps_columns(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 6) END AS source", "'x' AS size", "1 AS copies")
    sums = {r.source: (r.a, r.b) for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "first"}).toDF("source", "a", "b").collect()}
    assert all(abs(a - b) < 0.03 * b for a, b in sums.values())
    out = mixing.emitted(docs)
    assert out.columns == docs.columns and out.count() == mixing.mix(docs).agg({"copies": "sum"}).first()[0]


def test_empty_mix(corpus):
    assert mixing.mix(corpus.limit(0)).count() == 0 and mixing.emitted(corpus.where("size(split(text, ' ')) < 0")).count() == 0


def test_matrix_has_exact_margins_and_the_hypergeometric_mean():
    counts = [0, 5, 1000, 333, 1]
    total = np.zeros((5, 7))
    for seed in range(300):
        m = sharding.communication(counts, 7, seed)
        assert m.sum(1).tolist() == counts and m.sum(0).max() - m.sum(0).min() <= 1 and (m >= 0).all()
        total += m
    assert np.allclose(total[2] / 300, 1000 / 7, rtol=0.03)


def test_shards(spark, corpus):
    rows = sharding.shard_rows(corpus.withColumnRenamed("lang", "shard"), partitions=8).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == corpus.count() and set(n) <= set(range(24)) and max(n.values()) - min(n[s] for s in range(24)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)
    where = {r.doc_id: (r.shard, r.slot) for r in rows if r.doc_id is not None and r.doc_id < 300}
    assert where == {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(corpus.repartition(5).withColumnRenamed("lang", "shard"), partitions=8).collect() if r.doc_id is not None and r.doc_id < 300}
    assert sharding.shard_rows(corpus.limit(0)).count() == 0


def test_shuffle_is_even(spark):
    rows = sharding.shard_rows(spark.range(24_000).withColumnRenamed("id", "doc_id")).collect()
    cells = Counter((r.doc_id // 6000, r.shard) for r in rows)
    assert sum((v - 250) ** 2 / 250 for v in cells.values()) < 150  # chi-squared with about 69 degrees of freedom
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.shard * 1000 + r.slot for r in rows])[0, 1]) < 0.03


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
