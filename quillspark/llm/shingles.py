"""Near-duplicates by SimHash and by exact similarity of word shingles.

Texts whose sets of five-word shingles (XXH64 of lower-cased words) have a Jaccard similarity of ``overlap`` or more are
linked. Those whose fingerprints differ in at most four bits are found by `simhash` (generalised pigeonhole) and checked
exactly; most similar ones have fingerprints further apart, and a prefix-filtered set join misses none of these:

1. Equal sets become one class, so a group of copies is compared once. What passes by fingerprints is not compared again.
2. All sets are put in one order, rare shingles first. A bounded sample of texts tells the common ones; the order only
   changes the cost. Sets of a and b shingles that are linked share at least overlap (a + b) / (1 + overlap), so one of
   the first of each that leave fewer than that, and differ in size by at most 1 / overlap: an equi-join on (shingle,
   size class) in which each pair's own sizes tell how far its first shingles go.
3. A pair stays a candidate if what follows the last shingle it shares there could still reach the overlap, and if the
   parities of its sets' shingles by their low bits differ in no more places than the sets may. Such candidates are
   verified on the whole sets.
4. Shingles that many sets start with are first compared as stars around the least changed set; what these unite is not
   compared again, so a group of near copies doesn't make all its pairs.
5. What still shares such a shingle is compared in blocks of whole sets against blocks. Each set has a hub, its most
   frequent first shingle. Parities tell which sets have a possible partner in which hub: only these go there as whole
   sets, as many sets share frequent shingles and nothing else. A block pair emits at most a forest over what it links, so
   candidates of a large group of not quite similar texts never become rows; the pairs of blocks grow with the square of
   such a group, their memory does not.
6. Whole sets take more disk than the texts, so they are not stored: those that candidates need are hashed again.

Defined cases: null or empty texts are one class; texts below the shingle's words are one shingle; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import components, forget, release, stored, text_batches
from .simhash import first_rows

WORDS, OVERLAP, SEED = 5, 0.8, 42
HOT, SHARE, SAMPLE, COMMON, TRIES, EPS = 64, 8, 40_000, 500_000, 16, 1e-9
BLOCK, CELLS, MEET = 512, 500_000, 2048


def hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest as xxh

    found = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    firsts = np.concatenate([[0], ends[: n - 1] + 1])
    lasts = ends[words - 1 :] if len(found) >= words else ends[-1:]
    return np.unique(np.fromiter((xxh(line[s:e], seed) for s, e in zip(firsts.tolist(), lasts.tolist(), strict=True)), np.uint64, n))


def _class(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as xxh

    return int(np.uint64(xxh(own.tobytes(), 1)).astype(np.int64))


def class_id(text, words: int = WORDS):
    """Column of the numbers of the texts' sets."""

    @F.pandas_udf("long")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([_class(hashes(t, words)) for t in texts], dtype="int64")
        release()

    return made(text)


def common(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a bounded sample, sorted, and their numbers of texts."""
    every = max(SHARE, docs.count() // SAMPLE)

    def exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": np.concatenate([hashes(t, words) for t in frame["text"]] or [np.zeros(0, np.uint64)]).view(np.int64)})

    some = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(every)) == 0).dropDuplicates()
    counted = stored(some.mapInPandas(exploded, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON), "common")
    found = counted.toPandas()
    forget(counted)
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy(np.int64)[order]


def parities(own: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of hashes have the low bits i; there are at least as many bits as hashes."""
    bits = max(1024, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(text, order, words: int, overlap: float):
    """Struct column of each text's class, its fingerprint, its shingles' number and parities, and the first of them in the
    common order: those of which similar sets share one."""

    @F.pandas_udf("class_id long, fp long, n int, bits array<long>, keys array<long>")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, counts = order.value
        for texts in parts:
            ids, sizes, bits, keys = [], [], [], []
            for t in texts:
                own = hashes(t, words)
                ids.append(_class(own))
                sizes.append(n := len(own))
                bits.append(parities(own))
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == own, counts[at], 0), kind="stable")]
                keys.append(own[: n - ceil(n * overlap - EPS) + 1].view(np.int64))
            yield pd.DataFrame({"class_id": ids, "fp": simhash.fingerprints(list(texts)).view(np.int64), "n": sizes, "bits": bits, "keys": keys})
        release()

    return made(text)


def _whole(text, words: int):
    """Struct column of each text's class and all of its shingles."""

    @F.pandas_udf("class_id long, shingles array<long>")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [hashes(t, words) for t in texts]
            yield pd.DataFrame({"class_id": [_class(x) for x in sets], "shingles": [x.view(np.int64) for x in sets]})
        release()

    return made(text)


def whole_sets(texts: DataFrame, named: DataFrame, words: int) -> Callable[[DataFrame], DataFrame]:
    """A function that makes of wanted(class_id) a stored table (class_id, shingles).

    Sets are hashed again from texts(doc_id, text), as all of them would take several times the input on disk. named(fp, rep)
    has a doc_id of each class; texts that share it are told apart by their class.
    """

    def made(wanted: DataFrame) -> DataFrame:
        wanted = stored(wanted.select("class_id").distinct(), "wanted")
        ids = stored(named.join(wanted, F.col("fp") == F.col("class_id"), "left_semi").select("rep").distinct(), "ids")
        found = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select(_whole("text", words).alias("s")).select("s.*")
        # Null-safe: from a plain join Spark infers a filter by class, and pushes it with the hashing below the join of doc_ids.
        found = found.join(wanted.withColumnRenamed("class_id", "own"), F.col("class_id").eqNullSafe(F.col("own")), "left_semi")
        found = found.groupBy("class_id").agg(F.any_value("shingles").alias("shingles"))
        found = stored(found, "whole", "none")
        forget(wanted)
        forget(ids)
        return found

    return made


def _least(na, nb, overlap: float):
    """Column: how many shingles similar sets of na and nb share at least."""
    return F.ceil((na + nb) * (overlap / (1 + overlap)) - EPS)


def _apart(a: str, b: str):
    """Column: in how many places two sets' parities differ, the longer ones folded to the shorter. Sets differ in as many
    shingles or more."""
    size = F.least(F.size(a), F.size(b))
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    fold = lambda c: F.when(F.size(c) == 2 * size, half(c)).otherwise(F.col(c))
    odd = F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.greatest(F.size(a), F.size(b)) > 2 * size, 0).otherwise(F.aggregate(odd, F.lit(0), lambda n, x: n + x))


def _verified(pairs: DataFrame, classes: DataFrame, whole: Callable, overlap: float) -> DataFrame:
    """Those of pairs(a, b, na, nb) whose whole sets are similar."""
    pairs = stored(pairs.select("a", "b", "na", "nb").distinct(), "pairs")
    few = classes.select("class_id", "bits").join(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct(), "class_id", "left_semi")
    bits = lambda c: few.select(F.col("class_id").alias(c), F.col("bits").alias(f"of_{c}"))
    most = F.col("na") + F.col("nb") - 2 * _least(F.col("na"), F.col("nb"), overlap)
    before, pairs = pairs, stored(pairs.join(bits("a"), "a").join(bits("b"), "b").where(_apart("of_a", "of_b") <= most).select("a", "b"), "pairs")
    forget(before)
    own = whole(pairs.select(F.explode(F.array("a", "b")).alias("class_id")))
    side = lambda c: own.select(F.col("class_id").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    total = F.size("of_a") + F.size("of_b")
    similar = stored(both.where(shared * (1 + overlap) >= overlap * total - EPS).select("a", "b"), "similar")
    forget(pairs)
    forget(own)
    return similar


def _early(na, at, nb, bt, overlap: float):
    """Column: places at and bt of a shared shingle are among the first of which sets of na and nb shingles, if similar, must
    share one. Similar sets share at least `least`; all but the first n - least + 1 are fewer than that."""
    least = _least(na, nb, overlap)
    return (F.least(na, nb) >= F.greatest(na, nb) * overlap - EPS) & (at <= na - least) & (bt <= nb - least)


def _stars(met: DataFrame, overlap: float) -> DataFrame:
    """Pairs (a, b, na, nb) of a first cut: sets of hot shingles with one set for each shingle and size class.

    That set is the one with the fewest rarer shingles, so the one least changed in a group of near copies; equal ones are
    drawn by hash, anew for each shingle. A set tries about TRIES of its shingles, so candidates grow with the sets and
    not with the square of a group. What is left out here is met later.
    """
    hot = met.where(f"m > {HOT}")
    root = F.min(F.struct(F.col("at").alias("bt"), F.xxhash64("key", "class_id").alias("h"), F.col("class_id").alias("b"), F.col("n").alias("nb"))).alias("root")
    roots = hot.groupBy("key", "sizes").agg(root).select("key", "sizes", "root.b", "root.nb", "root.bt")
    every = F.greatest(F.lit(1), F.ceil(F.col("n") * (1 - overlap) / TRIES))
    tried = hot.where(F.pmod(F.xxhash64(F.lit(3), "key", "class_id"), every) == 0)
    tried = tried.select("key", F.explode(F.array("sizes", F.col("sizes") + 1)).alias("sizes"), F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("at"))
    near = (F.col("a") != F.col("b")) & _early(F.col("na"), F.col("at"), F.col("nb"), F.col("bt"), overlap)
    return tried.join(roots, ["key", "sizes"]).where(near).select("a", "b", "na", "nb")


def _possible(bits: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, overlap: float) -> Iterator[tuple]:
    """By runs of left, for bounded memory: places in left, in right, in how many bits parities differ, and which of these
    pairs of sets sizes and parities leave possible."""
    width = np.array([len(x) for x in bits])
    for wide in np.unique(width[left]):
        for other in np.unique(width[right]):
            rows, cols = np.flatnonzero(width[left] == wide), np.flatnonzero(width[right] == other)
            size = min(wide, other)
            fold = lambda places: np.bitwise_xor.reduce(np.stack([bits[k] for k in places]).reshape(len(places), -1, size), axis=1)
            b, nb = fold(right[cols]), n[right[cols]]
            step = max(1, 2_000_000 // (len(cols) * size))
            for at in range(0, len(rows), step):
                a, na = fold(left[rows[at : at + step]]), n[left[rows[at : at + step]]][:, None]
                apart = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                most = na + nb - 2 * np.ceil((na + nb) * (overlap / (1 + overlap)) - EPS)
                yield rows[at : at + step], cols, apart, (np.minimum(na, nb) >= np.maximum(na, nb) * overlap - EPS) & (apart <= most)


def _close(own: list[np.ndarray], left: np.ndarray, right: np.ndarray, overlap: float) -> np.ndarray:
    """Places in left and right, nearest parities first, of the pairs of sets that sizes and parities leave possible."""
    n = np.array([len(x) for x in own])
    out = [np.zeros((3, 0), np.int64)]
    for rows, cols, apart, fits in _possible([parities(x).view(np.uint64) for x in own], n, left, right, overlap):
        i, j = np.nonzero(fits)
        out.append(np.stack([rows[i], cols[j], apart[i, j]]))
    found = np.concatenate(out, axis=1)
    return found[:2, np.argsort(found[2], kind="stable")]


def _forest(ids: np.ndarray, labels: np.ndarray, own: list[np.ndarray], left: np.ndarray, right: np.ndarray, overlap: float) -> list[tuple[int, int]]:
    """Links (a, b) of similar sets of left and right that unite all labels which such links connect."""
    above, out = {}, []

    def top(x: int) -> int:
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x

    pairs = _close(own, left, right, overlap)
    i, j = left[pairs[0]], right[pairs[1]]
    twice = len(left) == len(right) == len(own)  # a block against itself
    open_ = (labels[i] != labels[j]) & ((i < j) | (not twice))
    for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
        x, y = top(int(labels[a])), top(int(labels[b]))
        if x == y:
            continue
        total = len(own[a]) + len(own[b])
        shared = total - len(np.unique(np.concatenate([own[a], own[b]])))
        if shared * (1 + overlap) >= overlap * total - EPS:
            above[x] = y
            out.append((int(ids[a]), int(ids[b])))
    return out


def _partners(hot: DataFrame, own: DataFrame, classes: DataFrame, overlap: float) -> DataFrame:
    """Rows (class_id, other): a set of hot(key, class_id, m), and the hub of sets that share a key with it, have another
    label and are not ruled out by sizes and parities. own(class_id, n, label, hub) has all sets of hot."""
    rows = own.join(classes.select("class_id", "bits"), "class_id").join(hot.select("key", "class_id", "m"), "class_id")
    blocks = F.ceil(F.col("m") / F.lit(MEET)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(13), "class_id"), blocks).cast("int")).withColumn("their", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("block") == F.col("their"), 2).when(F.col("block") < F.col("their"), 0).otherwise(1).alias("side")
    rows = rows.select("key", F.least("block", "their").alias("i"), F.greatest("block", "their").alias("j"), side, "class_id", "n", "label", "hub", "bits")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        side, ids, n, label, hub = (frame[c].to_numpy() for c in ("side", "class_id", "n", "label", "hub"))
        bits = [np.asarray(x, np.int64).view(np.uint64) for x in frame["bits"]]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out = [np.zeros((2, 0), np.int64)]
        for x, y, _, fits in _possible(bits, n, left, right, overlap) if len(left) and len(right) else ():
            a, b = left[x], right[y]
            fits &= label[a][:, None] != label[b]
            for these, those, fit in ((a, b, fits), (b, a, fits.T)):
                order = np.argsort(hub[those], kind="stable")
                hubs, first = np.unique(hub[those[order]], return_index=True)
                i, k = np.nonzero(np.logical_or.reduceat(fit[:, order], first, axis=1))
                out.append(np.unique(np.stack([ids[these[i]], hubs[k]]), axis=1))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pd.DataFrame({"class_id": found[0], "other": found[1]})

    return rows.groupBy("key", "i", "j").applyInPandas(meet, "class_id long, other long").distinct()


def _crowded(met: DataFrame, classes: DataFrame, whole: Callable, overlap: float) -> DataFrame:
    """Pairs (a, b) of similar sets that unite all labels of met(class_id, n, key, m, label) which similar sets sharing a
    hot shingle connect: blocks of whole sets against blocks. Whole sets go only where parities leave a partner possible."""
    hot = met.where(f"m > {HOT}")
    own = hot.groupBy("class_id").agg(F.max(F.struct("m", "key")).alias("hub"), F.any_value("n").alias("n"), F.any_value("label").alias("label"))
    own = stored(own.select("class_id", "n", "label", F.col("hub.key").alias("hub")), "hubs")
    partners = stored(_partners(hot, own, classes, overlap), "partners")
    before, own = own, stored(own.join(partners, "class_id"), "meetings")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(CELLS))).cast("int")
    size = own.select("class_id", "n", "hub").distinct().groupBy("hub").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(11), "class_id"), F.col("blocks")).cast("int")
    dealt = own.join(size, "hub").join(size.toDF("other", "others"), "other")
    dealt = dealt.withColumn("own", block).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    # A pair of blocks goes by its lesser one: side 0 is that one, side 1 the other, and 2 a block against itself.
    mine, their = F.struct("hub", F.col("own").alias("block")), F.struct(F.col("other").alias("hub"), F.col("theirs").alias("block"))
    dealt = dealt.select("class_id", "label", F.least(mine, their).alias("i"), F.greatest(mine, their).alias("j"), F.when(mine == their, 2).when(mine < their, 0).otherwise(1).alias("side"))
    sets = whole(own)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        side, every = frame["side"].to_numpy(), [np.asarray(x, np.int64).view(np.uint64) for x in frame["shingles"]]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found = _forest(frame["class_id"].to_numpy(), frame["label"].to_numpy(), every, left, right, overlap) if len(left) and len(right) else []
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    found = stored(dealt.join(sets, "class_id").groupBy("i", "j").applyInPandas(compare, "a long, b long"), "crowded")
    for table in (sets, own, partners, before):
        forget(table)
    return found


def _near(classes: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of classes(class_id, fp, n) whose fingerprints `simhash` links."""
    own = classes.select("class_id", "fp", "n")
    named = stored(own.groupBy("fp").agg(F.min(F.struct("class_id", "n")).alias("first")), "named")
    side = lambda by, c: named.select(F.col("fp").alias(by), F.col("first.class_id").alias(c), F.col("first.n").alias(f"n{c}"))
    equal = own.select("fp", F.col("class_id").alias("a"), F.col("n").alias("na")).join(side("fp", "b"), "fp").where("a <> b")
    near = simhash.links(named.select("fp")).toDF("x", "y").join(side("x", "a"), "x").join(side("y", "b"), "y")
    return equal.select("a", "b", "na", "nb").unionByName(near.select("a", "b", "na", "nb"))


def links(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], overlap: float = OVERLAP) -> DataFrame:
    """Pairs (a, b) of classes of sets(class_id, fp, n, bits, keys) that keep all components of the similar ones.

    whole(wanted(class_id)) gives the whole sets. sets is a stored table, which goes once its keys have met.
    """
    classes = stored(sets.groupBy("class_id", "n").agg(F.min("fp").alias("fp"), F.any_value("bits").alias("bits")), "classes", "none")
    firsts = sets.where("n > 0").groupBy("class_id", "n").agg(F.any_value("keys").alias("keys"))
    members = firsts.select("class_id", "n", F.posexplode("keys").alias("at", "key"))
    met = members.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
    met = stored(met.withColumn("sizes", F.floor(F.log(F.col("n")) / F.lit(log(1 / overlap))).cast("int")), "met")
    forget(sets)
    found = _verified(_near(classes).unionByName(_stars(met, overlap)), classes, whole, overlap)
    label = components(found).select(F.col("node").alias("class_id"), F.col("component").alias("label"))
    met = met.join(label, "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    several = met.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    before, met = met, stored(met.join(several, "key", "left_semi"), "open")
    forget(before)
    crowded, met = _crowded(met, classes, whole, overlap), met.where(f"m <= {HOT}")
    # A smaller set shares one of fewer first shingles.
    smaller = F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * overlap / (1 + overlap)) - EPS)
    left = met.where(smaller).select("key", F.explode(F.array("sizes", F.col("sizes") + 1)).alias("sizes"), F.col("class_id").alias("a"), F.col("n").alias("na"), "at", F.col("label").alias("la"))
    right = met.select("key", "sizes", F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("bt"), F.col("label").alias("lb"))
    later = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = (F.col("la") != F.col("lb")) & later & _early(F.col("na"), F.col("at"), F.col("nb"), F.col("bt"), overlap)
    counts = [F.count("*").alias("c"), F.max("at").alias("at"), F.max("bt").alias("bt")]
    shared = left.join(right, ["key", "sizes"]).where(near).groupBy("a", "b", "na", "nb").agg(*counts)
    # What a pair shares besides comes after the last of these shingles in both sets. One that shares a hot shingle is crowded.
    after = F.least(F.col("na") - F.col("at"), F.col("nb") - F.col("bt")) - 1
    least = _least(F.col("na"), F.col("nb"), overlap)
    similar = _verified(shared.where(F.col("c") + after >= least), classes, whole, overlap)
    forget(met)
    forget(classes)
    return found.unionByName(crowded).unionByName(similar)


def deduplicate(docs: DataFrame, text: str = "text", words: int = WORDS, overlap: float = OVERLAP) -> DataFrame:
    """docs with one row of each component of similar texts: that of the smallest doc_id, or any without doc_ids."""
    text_batches(docs.sparkSession, 200)
    order = docs.sparkSession.sparkContext.broadcast(common(docs, text, words))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    sets = stored(rows.select("row.doc_id", _sets(F.col("row")[text], order, words, overlap).alias("s")).select("doc_id", "s.*"), "sets", "none")
    marked = stored(sets.select("doc_id", F.col("class_id").alias("fp")), "marked")
    named = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    whole = whole_sets(rows.select("row.doc_id", F.col("row")[text].alias("text")), named, words)
    member = components(links(sets, whole, overlap)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    groups = named.join(member, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return first_rows(rows, marked, groups, class_id(F.col("row")[text], words))
