"""Token ids of a corpus in directly addressable files.

Documents are range-partitioned by doc_id, encoded, and written as segments of about a million ids. A segment is one
row of a Parquet table (the container that Spark can write to and read from any store): the segment's place, its
documents' ids and ends, and the ids as directly addressable codes (``dac``). Any token of any document is read from
its segment without decoding others.

Defined cases: a null or empty text is the end id alone; documents with a null doc_id come first; repeated rows are
written as often as they occur, rows of one doc_id in the order of their texts' hashes; an empty table gives an empty
file. Whole texts are encoded, whatever their length; the string of an added token in a text is that token, as the
library has it. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dac
from .common import load, release, shared_dir, text_batches

END_ID = 2
SEGMENT = 1_000_000
SCHEMA = "part int, seq int, start_in_part long, n_tokens long, doc_ids array<bigint>, doc_ends array<bigint>, codes binary"


#: Longer pieces are not kept: their texts are encoded whole.
LONGEST = 256


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _splits(tokenizer: str) -> bool:
    """Whether a tokenizer file's texts may be cut before every space that a non-space follows: byte-level BPE with its
    usual pattern, without normalizer or dropout, and no added token that holds a space."""
    kind = json.loads(tokenizer)
    before, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = not (kind.get("normalizer") or kind.get("truncation") or kind.get("padding") or model.get("dropout"))
    return bool(level and plain and model.get("type") == "BPE" and not any(" " in t["content"] for t in kind.get("added_tokens", [])))


class Encoder:
    """A tokenizer with a cache of its results for space-separated pieces.

    Byte-level BPE never merges across a space between two other characters, so a text is the concatenation of its
    pieces, each with the space before it, unless a piece is white space only or holds an added token; such texts are
    encoded whole, and so are all texts of a tokenizer of another kind. New pieces are encoded many in a string: a
    token that starts with a space starts a piece. The cache changes speed only.
    """

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.splits = _splits(file.read())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # byte-level for a space
        self.limit = limit
        # Codes of pieces behind a space and of pieces that begin a text. Code 0 is an empty text's piece, so places of
        # pieces that are not kept point at something.
        self.spaced: dict[str, int] = {}
        self.heads: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint16 if len(self.opens) <= 1 << 16 else np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), self.flat.dtype, int(sizes.sum())), sizes

    def _add(self, spaced: list[str], heads: list[str]) -> None:
        """Encodes and keeps new pieces, the spaced ones without their space."""
        runs = [" " + " ".join(spaced[i : i + 512]) for i in range(0, len(spaced), 512)]
        ids, lengths = self._ids(runs + heads)
        many = int(lengths[: len(runs)].sum())
        sizes = np.concatenate([np.diff(np.flatnonzero(self.opens[ids[:many]]), append=many), lengths[len(runs) :]]).astype(np.int32)
        codes = itertools.count(len(self.sizes))
        self.spaced.update(zip(spaced, codes, strict=False))
        self.heads.update(zip(heads, itertools.count(len(self.sizes) + len(spaced)), strict=False))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return self.flat[:0].astype(np.uint32), np.zeros(0, np.int64)
        whole = np.full(len(texts), not self.splits)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        first = cut.offsets.to_numpy()[:-1].astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        behind = np.ones(len(index), bool)
        behind[first] = False
        used = np.zeros(len(names), bool)
        used[index[behind]] = True
        heads = [names[i] for i in index[first].tolist()]
        code = np.fromiter(map(self.spaced.get, names, itertools.repeat(-1)), np.int64, len(names))
        kept = lambda w: len(w) <= LONGEST and not w.isspace()
        new = [w for w in (names[i] for i in np.flatnonzero((code < 0) & used).tolist()) if w and kept(w)]
        new_heads = [w for w in dict.fromkeys(heads) if w not in self.heads and kept(w)]
        if new or new_heads:
            self._add(new, new_heads)
            again = np.flatnonzero(code < 0)
            code[again] = np.fromiter((self.spaced.get(names[i], -1) for i in again.tolist()), np.int64, len(again))
        at = code[index]
        at[first] = np.fromiter(map(self.heads.get, heads, itertools.repeat(-1)), np.int64, len(heads))
        sizes = np.where(at < 0, 0, self.sizes[at])
        ids = self.flat[_places(self.starts[at], sizes)]
        counts = np.add.reduceat(sizes, first).astype(np.int64)
        whole |= np.logical_or.reduceat(at < 0, first)
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            again, lengths = self._ids([texts[i].as_py() for i in np.flatnonzero(whole).tolist()])
            for i, x in zip(np.flatnonzero(whole).tolist(), np.split(again, np.cumsum(lengths)[:-1]), strict=True):
                parts[i] = x
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        self.trim()
        return ids.astype(np.uint32), counts

    def trim(self) -> None:
        """Forgets what came after the cache was full: the words met first are mostly the frequent ones."""
        if len(self.sizes) > self.limit:
            for codes in (self.spaced, self.heads):
                for key in list(itertools.takewhile(lambda k: codes[k] >= self.limit, reversed(codes))):  # noqa: B023
                    del codes[key]
            self.starts, self.sizes = self.starts[: self.limit].copy(), self.sizes[: self.limit].copy()
            self.flat = self.flat[: int((self.starts + self.sizes).max(initial=0))].copy()


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which its later tasks use again."""
    return Encoder(path)


def _batches(batches: Iterable[pa.RecordBatch], size: int = 6_000_000) -> Iterator[tuple[list, pa.Array]]:
    """(doc ids, texts) of about so many bytes or a batch more."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield _columns(held)
            held, total = [], 0
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    texts = pa.concat_arrays([b.column("text") for b in batches])
    return [i for b in batches for i in b.column("doc_id").to_pylist()], pc.fill_null(texts, "")


def _pack(path: str, end_id: int, segment: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, begun = encoder_of(path), TaskContext.get().partitionId(), 0, 0
        ids, docs, ends, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([begun], pa.int64()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([np.concatenate(ends)], pa.list_(pa.int64())), pa.array([dac.encode(np.concatenate(ids))], pa.binary())], names=["part", "seq", "start_in_part", "n_tokens", "doc_ids", "doc_ends", "codes"])

        for names, texts in _batches(batches):
            flat, counts = encoder.encode(texts)
            lasts = np.cumsum(counts)
            flat = np.insert(flat, lasts, end_id)
            ids.append(flat)
            docs += names
            ends.append(n + lasts + np.arange(1, len(names) + 1))
            n += len(flat)
            if n >= segment:
                yield row()
                seq, begun, ids, docs, ends, n = seq + 1, begun + n, [], [], [], 0
        if docs:
            yield row()
        release()

    return pack


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encodes docs(doc_id, text) in ascending doc_id order into a table of segments at folder."""
    text_batches(docs.sparkSession)
    # The text's hash splits a doc_id that holds many rows; equal documents are interchangeable.
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_pack(tokenizer_path, end_id, segment), SCHEMA).write.parquet(folder)


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples(index=False):
            ids = dac.Reader(r.codes).slice(0, int(r.n_tokens)).astype("<u4")
            ends = np.asarray(r.doc_ends, dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": pd.array(r.doc_ids, dtype="Int64"), "part": np.int32(r.part), "start_in_part": starts + int(r.start_in_part), "n_tokens": ends - starts, "ids_crc32": np.array(crcs, dtype=np.int64)})


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document read from the segments at folder: doc_id, start, n_tokens and the checksum of its ids."""
    table = spark.read.schema(SCHEMA).parquet(folder)
    # One row a written partition: that bound lets the parts' first places be broadcast.
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_base"))
    read = table.mapInPandas(_unpack, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(parts), "part").select("doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op2_tokens(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents written as token ids, and what the files hold of each."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(load(spark, sf_dir, "documents"), folder, tokenizer_path)
    return documents(spark, folder)
