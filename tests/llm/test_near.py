"""Near-duplicate search against all pairs."""

import tracemalloc

import numpy as np
import pytest
import xxhash

from quillspark.llm import embeddings, simhash


def united(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_clusters_match_all_pairs(spark, corpus):
    rows = simhash.cluster(corpus.withColumnRenamed("lang", "fp")).collect()
    texts = {r.doc_id: r.text for r in corpus.collect()}
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
    fps = [plain_fingerprint(texts[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = {i: ids[c] for i, c in zip(ids, united(len(ids), links), strict=True)}
    assert all(r.component_id == want[r.doc_id] and r.fp & (2**64 - 1) == plain_fingerprint(texts[r.doc_id]) for r in rows if r.doc_id is not None)
    assert want[303] == 0 and want[304] == 1 and want[301] == want[302] == 300 and len(rows) == corpus.count()


def test_dense_groups_lose_no_link(spark):
    rng = np.random.default_rng(0)
    centres, found = rng.integers(0, 2**63, 20), set()
    for i in range(4000):
        x = int(centres[0] if i < 2500 else centres[i % 20])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        found.add(x)
    fps = np.array(sorted(found), dtype=np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1]
    assert united(len(fps), [(place[e.a], place[e.b]) for e in edges]) == united(len(fps), near)


@pytest.mark.parametrize("n", [100, 300_000, 20_000_000])
def test_allocation_keeps_the_pigeonhole(n):
    plan = simhash.allocate(np.random.default_rng(0).integers(0, 2, (500, 64)).astype(float), n)
    assert sum(t + 1 for _, t in plan) == simhash.DISTANCE + 1 and len({b for p, _ in plan for b in p}) == sum(len(p) for p, _ in plan)


def test_allocation_needs_little_of_the_drivers_memory():
    on = np.random.default_rng(0).integers(0, 2, (simhash.SAMPLE, 64)).astype(float)
    tracemalloc.start()
    try:
        simhash.allocate(on, 100_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6


def test_near_pairs_of_a_part_are_counted_bit_by_bit():
    on = (np.random.default_rng(0).random((200, 64)) < 0.02).astype(float)
    pairs, part = np.random.default_rng(1).integers(0, 200, (2, 500)), [0, 7, 8, 31, 32, 63]
    packed = np.array([sum(1 << b for b in np.flatnonzero(row).tolist()) for row in on], dtype=np.uint64)
    apart = (on[pairs[0]][:, part] != on[pairs[1]][:, part]).sum(1)
    got = simhash._near(on, part, 4, packed[pairs[0]] ^ packed[pairs[1]])
    assert (apart == 1).any() and all(got[t] >= (apart <= t).mean() for t in range(5)) and got[4] == 1.0 == (apart <= 4).mean()


def test_one_document_of_each_group_stays(spark, corpus):
    docs = corpus.withColumnRenamed("lang", "fp").withColumnRenamed("source", "row")
    kept = simhash.deduplicate(docs)
    groups = {r.component_id for r in simhash.cluster(corpus).collect()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(g for g in groups if g is not None)
    assert kept.where("doc_id IS NULL").count() == 1 and simhash.deduplicate(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "f g h i j")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.deduplicate(repeated).collect()) == ["a b c d e", "f g h i j"]


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x[:700] = x[0] + rng.normal(size=(700, 16)) * 0.15
    x[1400:] = x[1300:1400] + rng.normal(size=(100, 16)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] * 16), (5004, [float("inf")] * 16), (5005, [1.0]), (5006, rows[3][1]), (5006, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in embeddings.cluster(df, window=64).collect():
        got.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    u = np.vstack([x, x[3], x[3]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    comp = united(len(u), zip(*np.nonzero(linked), strict=True))
    miss = [i for i in range(1500) if got[i] != (int(linked[i].sum()), comp[i], comp[i] == i)]
    assert not miss and got[5006][:2] == (int(linked[1500].sum()), comp[1500])
    assert all(got[i] == (0, i, True) for i in range(5000, 5006))
    assert embeddings.cluster(df.limit(0)).count() == 0


def fixture(kind, n=12_000, dim=64):
    """Vectors spread evenly, or in one cone around cosine 0.85, or in twelve such cones; some with a planted partner."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, dim)))
    if kind != "even":
        axes = unit(rng.normal(size=(1 if kind == "cone" else 12, dim)))
        x = unit(np.sqrt(0.85) * axes[rng.integers(0, len(axes), n)] + np.sqrt(0.15) * x)
    near = unit(rng.normal(size=(300, dim)))
    near = unit(near - (near * x[:300]).sum(1, keepdims=True) * x[:300])
    return np.vstack([x, unit(0.91 * x[:300] + np.sqrt(1 - 0.91**2) * near)])


@pytest.mark.parametrize("kind", ["even", "cone", "cones"])
def test_crowded_vectors_keep_their_links(spark, tmp_path, kind):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = fixture(kind)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), tmp_path / "v.parquet")
    got = {r.vec_id: r for r in embeddings.cluster(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    pairs = [(i + int(a), int(b)) for i in range(0, len(x), 2000) for a, b in np.argwhere(x[i : i + 2000] @ x.T >= 0.9) if i + a != b]
    true, comp = np.bincount([a for a, _ in pairs], minlength=len(x)), united(len(x), pairs)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() and true.sum() >= 600
    probed = np.arange(0, len(x), 50)
    assert found[probed].sum() >= 0.98 * true[probed].sum()
    assert sum(got[i].component_id != comp[i] for i in range(len(x))) <= 0.01 * len(x)


def test_passes_grow_slowly():
    assert [embeddings.passes(n) for n in (10, 50_000, 10**9)] == sorted(embeddings.passes(n) for n in (10, 50_000, 10**9)) and embeddings.passes(10**9) < 100
