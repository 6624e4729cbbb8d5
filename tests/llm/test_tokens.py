"""Directly addressable codes and the token files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import dac, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000), st.data())
def test_codes_round_trip(values, data):
    a = np.array(values, dtype=np.uint32)
    reader = dac.Reader(dac.encode(a))
    assert len(reader) == len(a) and (reader.slice(0, len(a)) == a).all()
    if len(a):
        i = data.draw(st.integers(0, len(a) - 1))
        j = data.draw(st.integers(i, len(a)))
        assert reader[i] == a[i] and (reader.slice(i, j) == a[i:j]).all()


def test_ranks_cross_blocks():
    a = np.random.default_rng(0).integers(0, 70_000, 20_000).astype(np.uint32)
    reader = dac.Reader(dac.encode(a))
    assert [reader[i] for i in range(0, 20_000, 37)] == a[::37].tolist()


def test_pieces_give_what_whole_texts_give():
    rng, encoder = random.Random(3), tokens.Encoder(PATH, limit=500)
    parts = [" ", "a", "B", "\n", "\t", "'s", "1", ".", "é", "  ", "\xa0", "中", "\r\n", "<|endoftext|>", "\0", "!", ".,", "x*", ")\u0027"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    for a in range(0, len(texts), 700):
        batch = texts[a : a + 700]
        ids, counts = encoder.encode(batch)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(batch, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["\n", "x" * 300, "a<|endoftext|>b", "", " ", "\0", "y " * 400_000, " \n" * 1000])
def test_first_texts_of_an_encoder(text):
    """Each meets an encoder that has kept nothing yet, and again one that has."""
    encoder, plain = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, counts = encoder.encode([text])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_other_tokenizers_see_whole_texts():
    encoder, plain = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello  wOrld", "a b c", "", "<|startoftext|> x"]
    ids, counts = encoder.encode(texts)
    assert not encoder.splits and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_rare_cases_each_in_a_partition(spark, tmp_path):
    rows = [(1, "\n"), (2, "z" * 300), (3, "a<|endoftext|>b"), (4, "w " * 500_000 + "end"), (5, None), (5, None)]
    folder, plain = str(tmp_path / "t"), Tokenizer.from_file(PATH)
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.documents(spark, folder).collect())
    at, want = 0, []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_files_hold_all_documents(spark, corpus, tmp_path):
    docs = corpus.withColumnRenamed("lang", "part").withColumnRenamed("source", "n_tokens")
    tokens.write(docs, str(tmp_path / "t"), PATH, segment=3000)
    got = sorted(tuple(r) for r in tokens.documents(spark, str(tmp_path / "t")).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    tokenizer, at = Tokenizer.from_file(PATH), 0
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in corpus.collect()), key=lambda r: r[:2])
    assert len(got) == len(rows) and [g[1] for g in got] == [r[1] if r[0] else None for r in rows]
    for (_, _, text), (start, _, n, crc) in zip(rows, got, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n


def test_no_documents(spark, corpus, tmp_path):
    tokens.write(corpus.limit(0), str(tmp_path / "t"), PATH)
    assert tokens.documents(spark, str(tmp_path / "t")).count() == 0
