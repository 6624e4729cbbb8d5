"""Divergence audit, Merkle manifest and prefix counts against brute force."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import divergence, manifest, prefixes, registry

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}

        def shares(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pair = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            term = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def mixed(corpus):
    return [(r.doc_id, r.text, r.lang, r.source) for r in corpus.collect()] + [(None, None, None, None), (400, "ÄÖ äö Äö\x00ÄÖ a_b don't", "xx", "only"), (401, "…", "", "z")]


def test_audit(spark, mixed):
    docs = spark.createDataFrame([(t, l, s, 1, "x") for _, t, l, s in mixed], "text string, lang string, source string, rank int, item string")  # noqa: E741
    want = plain_audit([(l, s, t) for _, t, l, s in mixed])  # noqa: E741
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want and len(want) > 200
    assert sorted(map(tuple, divergence.audit(docs, shard=20, read=5000).collect())) == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_in_small_slices(spark, mixed, monkeypatch):
    for name, value in (("PAIRS", 7), ("SMALL", 0), ("KEEP", 50)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(l, s, t) for _, t, l, s in mixed], "lang string, source string, text string")  # noqa: E741
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit([(l, s, t) for _, t, l, s in mixed])  # noqa: E741


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        whole = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, whole)
        assert int(divergence.share(np.array([count]), np.array([whole]))[0]) == 1 + 10**9 * (count + 1) // whole


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and for each leaf its siblings from the bottom up."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 8, len(nodes)))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for leaf in at[i]:
                    paths[leaf].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        nodes, at = [h(*(nodes[j] for j in run)) for run in runs], [[leaf for j in run for leaf in at[j]] for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(row):
        return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: plain_tree([leaf(r) for r in own[g]]) for g in langs}
    root, tops = plain_tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for r, path in zip(own[g], trees[g][1], strict=True):
            path = path + top
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((*r[:4], lower(r[4]) if struck and r[4] is not None else r[4]))
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), trees[g][0], root, h(*(x for left, right in path for x in left + right)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, part", [(5, 200_000), (1, 40), (2, 97)])
def test_manifest(spark, mixed, monkeypatch, levels, part):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "PART", part)
    rows = [(i, s, l, len(t or "") if i != 5 else None, t) for i, t, l, s in mixed]  # noqa: E741
    rows += [(2000 + i, "many", "zz", 3, f"A{i}") for i in range(700)] + [(7, "same", "same", 1, "Same text")] * 80 + [(1, None, "one", 0, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, run string, level int")
    assert sorted(map(tuple, manifest.proofs(docs).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_little(spark):
    kinds = "doc_id long, source string, lang string, n_chars int, text string"
    assert manifest.proofs(spark.createDataFrame([], kinds)).count() == 0
    for rows in ([(3, "s", None, 1, "A")], [(i, "s", "en", 1, "A") for i in range(9)], [(i, "s", "en", 1, "A") for i in range(65)]):
        assert sorted(map(tuple, manifest.proofs(spark.createDataFrame(rows, kinds)).collect()), key=repr) == plain_manifest(rows)


def test_unaligned_ranges_leave_few_edges():
    done, edges = [], []
    part = manifest.Range(1000, lambda *a: done.append(a), lambda *a: edges.append(a))
    for i in range(3, 803):
        part.push(0, i, str(i))
    part.close()
    assert len(edges) <= 14 * 4 and len({(a, b) for a, b, _ in done}) == len(done) > 100
    assert all(run == [str(i) for i in range(8 * at, 8 * at + 8)] for level, at, run in done if level == 0)


def test_every_prefix(spark):
    counter = prefixes.Counter(MODEL)
    rng = random.Random(4)
    signs = ["abc de  fghi\t\n", "日本語中国 かな漢字", "é́ àüñ <s></s>▁ 🙂🇩🇪\x00ｆ", "   ", "0123456789.,-() ", "aaaa bbb", "हिन्दी العربية עברית", "«l’été», “x”. "]
    for k in range(400):
        kind = rng.choice(signs) + rng.choice(signs)
        text = "".join(rng.choice(kind) for _ in range(rng.randrange(0, 50))) + " " * rng.choice((0, 0, 0, 40))
        got = prefixes.prefix_counts(counter.changes(text))
        assert got.tolist() == [len(x) for x in counter.model.encode([text[:i] for i in range(len(text) + 1)])], text
    with pytest.raises((RuntimeError, ValueError, OSError)):
        prefixes.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, corpus):
    model = prefixes.Counter(MODEL).model
    found = prefixes.index(corpus.withColumn("prefix", corpus.lang), MODEL)
    assert found.columns == ["doc_id", "text", "lang", "source", "prefix"]
    from pyspark.sql import functions as F

    budget, at = F.lit(20), F.lit(33)
    rows = found.select("text", prefixes.tokens(F.col("prefix"), (20,)).alias("t"), prefixes.counts(F.col("prefix"), at).alias("at"), prefixes.longest(F.col("prefix"), budget).alias("cut")).collect()
    for r in rows:
        text = r.text or ""
        assert r.t.n_tokens == len(model.encode(text)) and r.at == len(model.encode(text[:33]))
        fits = [i for i in range(min(len(text), 400) + 1) if len(model.encode(text[:i])) <= 20]
        assert r.cut == r.t.cut_20 == fits[-1]


def test_token_counts_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    model = prefixes.Counter(MODEL).model
    for r in registry.QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").collect():
        text = docs[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(model.encode(text)), len(model.encode(text)) > 4096)
        assert len(model.encode(text[: r.cut])) <= 4096 and (r.over_limit or r.cut == len(text))
