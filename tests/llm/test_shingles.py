"""Similar texts against all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import shingles
from tests.llm.test_near import united


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def firsts(rows):
    """The doc_ids that stay of sorted (doc_id, text)."""
    sets = [plain_shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0]
    return sorted({rows[c][0] for c in united(len(rows), links)})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 3000)}"
    line = [word() for _ in range(12)]
    out = [[word() for _ in range(rng.randrange(1, 150))] + (line if i % 3 == 0 else []) for i in range(250)]
    for i in range(150):  # copies with up to a few words changed, put in or cut
        own = list(out[i])
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(0, 3)] = [word()] * rng.randrange(0, 2)
            own = own or [word()]
        out.append(own)
    base = [word() for _ in range(120)]
    for i in range(150):  # one large group of near copies
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(120)] = word()
        out.append(own)
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(900, None), (901, ""), (902, out[7][0].upper()), (903, "\t ".join(out[3]).upper())]


def test_stage_keeps_one_of_each_similar_group(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == firsts(texts)


def test_any_order_and_stars_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(shingles, "HOT", 3)
    monkeypatch.setattr(shingles, "COMMON", 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.deduplicate(docs).collect()) == firsts(texts)


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "f g h i j"), (None, "f G h i j"), (None, "k")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in shingles.deduplicate(docs).collect()) == [(0, "k"), (1, "a b c d e"), (1, "f g h i j")]
    assert shingles.deduplicate(docs.limit(0)).count() == 0


def test_fingerprints_come_first(spark, texts, monkeypatch):
    from quillspark.llm import simhash

    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: seen.append(1) or links(*a))
    docs = spark.createDataFrame(texts[:20], "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.deduplicate(docs).collect()) == firsts(texts[:20]) and seen


def test_parities_never_differ_in_more_places_than_sets(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 3, 1000, 1030, 5000)]
    sets += [np.unique(np.concatenate([sets[2], sets[1], rng.integers(0, 1 << 63, 40, dtype=np.uint64)]))]
    rows = [(shingles.parities(x).tolist(), shingles.parities(y).tolist(), len(np.setxor1d(x, y))) for x in sets for y in sets]
    found = spark.createDataFrame(rows, "a array<long>, b array<long>, n int").select(shingles._apart("a", "b").alias("m"), "n").collect()
    assert all(r.m <= r.n for r in found) and any(r.m > 30 for r in found)


def changed(n, seed):
    """One text n times with 2 to 6 words changed: most pairs are close to the overlap, few reach it."""
    rng = random.Random(seed)
    base, out = [f"b{i}" for i in range(120)], []
    for i in range(n):
        own = list(base)
        for k in range(rng.randrange(2, 7)):
            own[rng.randrange(120)] = f"n{i}x{k}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("block", [512, 20])
def test_a_group_does_not_make_all_its_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block, raising=False)
    tried, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *a: tried.append(pairs.select("a", "b").distinct().count()) or verified(pairs, *a))
    rows = changed(450, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.deduplicate(docs).collect()) == firsts(rows)
    assert sum(tried) <= len(rows), tried


def test_blocks_link_what_is_similar():
    import numpy as np

    rng, own = np.random.default_rng(4), []
    for n in (40, 1000, 1040, 5000):  # parities of 1024, 2048 and 8192 bits
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(12):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.15])]
            own.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(n * rng.choice([0, 0.05, 0.1])), dtype=np.uint64)])))
    ids, every = np.arange(len(own)), np.arange(len(own))
    similar = lambda a, b: 9 * len(np.intersect1d(own[a], own[b])) >= 4 * (len(own[a]) + len(own[b]))
    for left, right in ((every, every), (every[::2], every[1::2])):
        links = shingles._forest(ids, ids, own, left, right, 0.8)
        wanted = [(a, b) for a in left.tolist() for b in right.tolist() if a != b and similar(a, b)]
        assert all(similar(a, b) for a, b in links) and len(links) < len(own)
        assert set(united(len(own), links)) == set(united(len(own), wanted)) and 20 < len(wanted) < len(own) ** 2 / 4


def test_sets_do_not_go_where_they_have_no_partner(spark, monkeypatch):
    """Texts that share frequent shingles and little else: their sets are neither all on disk at once nor copied a hub."""
    monkeypatch.setattr(shingles, "HOT", 8)
    monkeypatch.setattr(shingles, "COMMON", 0)
    rng, rows = random.Random(3), []
    lines = [[f"l{k}w{i}" for i in range(9)] for k in range(40)]
    for i in range(300):  # some of 40 lines of nine words in 120 of a text's own
        rows.append((i, " ".join([f"t{i}w{k}" for k in range(120)] + [w for line in rng.sample(lines, 8) for w in line])))
    rows += [(300 + i, t.replace("w119", "z")) for i, t in rows[:20]]
    held, stored = {}, shingles.stored

    def seen(df, name, *compression):
        table = stored(df, name, *compression)
        longs = [c for c, kind in table.dtypes if c in ("shingles", "keys", "bits")]
        held[name] = max(held.get(name, 0), sum(len(r[c]) for r in table.select(*longs).collect() for c in longs)) if longs else table.count()
        return table

    monkeypatch.setattr(shingles, "stored", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.deduplicate(docs).collect()) == firsts(rows)
    every = sum(len(plain_shingles(t)) for _, t in rows)
    assert "shingles" not in held and held["sets"] - 16 * len(rows) < 0.25 * every, held
    assert held["hubs"] > 200 and held["meetings"] < 100 and held["whole"] < 0.3 * every, held
