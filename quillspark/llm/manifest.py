"""A Merkle manifest of a dataset: one digest a row, a tree a group, a root over all groups, a proof for every row.

A tree has fanout 8 and no padding: every 8 neighbouring nodes of a level, or the fewer that are left at its end (even
one), become their digest, until one node remains. Rows are ordered by range partitions and numbered; then

1. Each task reads a run of numbered leaves as a mountain range: a stack of the unfinished peaks of each level. A peak
   that reaches the fanout, or the end of its level, is carried up and its node written; peaks that began before the run or
   end after it stay unaligned edges.
2. Edges are merged in groups below a common ancestor ``LEVELS`` levels up by the same stack, then the ancestors again, so
   a group holds at most 8^LEVELS leaves' nodes and the rounds are ceil(log8(rows) / LEVELS).
3. Subroots, ordered by group, are the leaves of one more tree of the same kind.
4. Paths go down the same way: the nodes below a common ancestor meet the ancestor's own path and their leaves in one
   group of bounded size. No join carries whole paths of all rows.

Defined cases: null columns are '-' in a leaf; a null doc_id comes first and is never tampered with; rows of one doc_id
are ordered by their leaves; equal rows are leaves of their own, in any order, as they are alike; a null lang is a group
of its own, before all others; texts of any length are hashed whole; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, lower_ascii, stored

FANOUT, LEVELS = 8, 5
#: Rows of a range partition about; groups whose number of (partition, group) rows is broadcast.
PART, SMALL = 200_000, 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def leaf(*columns: Column) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and itself, or '-' where it is null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def heights(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


class Range:
    """The unfinished peaks of one group's tree, level by level; nodes are pushed in ascending order of place."""

    def __init__(self, n: int, done: Callable[[int, int, list[str]], None], edge: Callable[[int, int, str], None]):
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.open: list[tuple[int, list[str]]] = [(0, [])] * len(self.sizes)
        self.done, self.edge = done, edge

    def push(self, level: int, at: int, node: str) -> None:
        while True:
            start, run = self.open[level]
            if run and at != start + len(run):
                self._spill(level)
                run = []
            if not run:
                start, run = at, []
                self.open[level] = start, run
            run.append(node)
            if level == len(self.sizes) - 1:  # the root
                return
            if at % FANOUT != FANOUT - 1 and at != self.sizes[level] - 1:
                return
            if start % FANOUT:  # the peak's beginning lies elsewhere
                self._spill(level)
                return
            self.open[level] = 0, []
            self.done(level, at // FANOUT, run)
            level, at, node = level + 1, at // FANOUT, digest(*run)

    def _spill(self, level: int) -> None:
        start, run = self.open[level]
        for i, node in enumerate(run):
            self.edge(level, start + i, node)
        self.open[level] = 0, []

    def close(self) -> None:
        for level in range(len(self.sizes)):
            self._spill(level)


_NODES = "grp string, n long, level int, at long, digest string, run array<string>"
_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))


def _table(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    return _table(rows, ["grp", "n", "level", "at", "digest", "run"], _KINDS)


def _climb(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves (grp, n, at, digest) -> finished runs (level of their nodes, place of their parent, run) and edges (level,
    place, digest). Any order of leaves is right; leaves in ascending order leave few edges."""
    out: list[tuple] = []
    now, key = None, None

    def begun(grp: str, n: int) -> Range:
        return Range(n, lambda level, at, run: out.append((grp, n, level, at, None, run)), lambda level, at, node: out.append((grp, n, level, at, node, None)))

    for part in parts:
        for grp, n, at, node in zip(*(part[c].to_pylist() for c in ("grp", "n", "at", "digest")), strict=True):
            if now is None or grp != key:
                if now is not None:
                    now.close()
                now, key = begun(grp, n), grp
            now.push(0, at, node)
        yield _nodes(out)
        out.clear()
    if now is not None:
        now.close()
    yield _nodes(out)


def _merge(below: int):
    """Edges under one ancestor of level `below` -> the runs they make and that ancestor (or the root below it)."""

    def merged(table: pa.Table) -> pa.Table:
        grp, n = table["grp"][0].as_py(), table["n"][0].as_py()
        top, out = heights(n), []
        levels: list[dict[int, str]] = [{} for _ in range(below + 1)]
        for level, at, node in zip(*(table[c].to_pylist() for c in ("level", "at", "digest")), strict=True):
            levels[level][at] = node
        for level in range(min(below, top)):
            for up in sorted({at // FANOUT for at in levels[level]}):
                run = [levels[level][at] for at in range(up * FANOUT, up * FANOUT + FANOUT) if at in levels[level]]
                out.append((grp, n, level, up, None, run))
                levels[level + 1][up] = digest(*run)
        last = min(below, top)
        out += [(grp, n, last, at, node, None) for at, node in levels[last].items()]
        return pa.Table.from_batches([_nodes(out)])

    return merged


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(grp, ...) with n, the rows of the group, and at, the place in it by `order`; they are stored in range partitions."""
    total = rows.count()
    parts = max(1, -(-total // PART), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 4096)))
    # `tie` parts equal rows, which could fill a partition; any order of them is right.
    key = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("tie")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "row"])
            at += n

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(ranged.mapInArrow(numbered, f"{kinds}, part int, row long"), "leaves")
    # One row for each group in each partition.
    sizes = placed.groupBy("part", "grp").agg(F.count("*").alias("own"), F.min("row").alias("first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("first")
    sizes = stored(sizes.select("part", "grp", base.alias("base"), F.sum("own").over(whole).alias("n")), "sizes")
    near = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    return placed.join(near, ["part", "grp"]).select(*rows.columns, "n", (F.col("base") + F.col("row")).alias("at"))


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaves(grp, n, at, digest): all runs (grp, n, level, at of the parent, run) and the roots (grp, n, root)."""
    made = stored(leaves.select("grp", "n", "at", "digest").mapInArrow(_climb, _NODES), "nodes")
    runs, nodes = made.where("run IS NOT NULL"), made.where("run IS NULL")
    for below in _rounds(leaves):
        up = F.expr(f"shiftright(at, 3 * ({below} - level))")
        low = nodes.where(F.col("level") < below).groupBy("grp", up.alias("up")).applyInArrow(_merge(below), _NODES)
        step = stored(low, "nodes")
        nodes = step.where("run IS NULL").unionByName(nodes.where(F.col("level") >= below))
        runs = runs.unionByName(step.where("run IS NOT NULL"))
    return runs.select("grp", "n", "level", "at", "run"), stored(nodes.select("grp", "n", F.col("digest").alias("root")), "roots")


def _rounds(leaves: DataFrame) -> range:
    """The levels of the ancestors of each round, from the leaves up; always one at least."""
    top = heights(int(leaves.agg(F.max("n")).first()[0] or 1))
    return range(LEVELS, max(top, 1) + LEVELS, LEVELS)


def _descend(level: int, finish: Callable[[dict, tuple | None, dict], tuple], names: list[str], kinds: tuple):
    """Nodes of `level` under one ancestor, LEVELS up, and the runs between: finish(node, path, ancestor's record).

    A path is linked upwards, (left siblings, right siblings, path of the parent), and None at the root.
    """

    def told(nodes: pa.Table, records: pa.Table) -> pa.Table:
        runs, upper = {}, {}
        for r in records.to_pylist():
            if r["run"] is None:
                upper = r
            else:
                runs[r["level"], r["at"]] = r["run"]
        above = None
        for left, right in zip(reversed(upper["lefts"]), reversed(upper["rights"]), strict=True):
            above = left, right, above
        known: dict[tuple[int, int], tuple | None] = {}

        def path(on: int, at: int) -> tuple | None:
            run = runs.get((on, at // FANOUT))
            if run is None:  # the ancestor, or a root below it
                return above
            if (on, at) not in known:
                known[on, at] = "".join(run[: at % FANOUT]), "".join(run[at % FANOUT + 1 :]), path(on + 1, at // FANOUT)
            return known[on, at]

        rows = [finish(node, path(level, node["at"]), upper) for node in nodes.to_pylist()]
        return pa.Table.from_batches([_table(rows, names, kinds)])

    return told


def _links(path: tuple | None) -> Iterator[tuple[str, str]]:
    while path:
        left, right, path = path
        yield left, right


def _passed(node: dict, path: tuple | None, upper: dict) -> tuple:
    return node["grp"], node["n"], node["at"], [a for a, _ in _links(path)], [b for _, b in _links(path)], upper["subroot"]


_UPPER = "grp string, n long, at long, lefts array<string>, rights array<string>, subroot string"
_UPPER_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())


def told_below(leaves: DataFrame, runs: DataFrame, roots: DataFrame, tops: DataFrame, finish, schema: str, names: list[str], kinds: tuple) -> DataFrame:
    """finish(leaf, path, upper) of every leaf; tops(grp, n, at 0, lefts, rights, subroot) are the paths of the roots."""
    uppers = tops
    for below in reversed(_rounds(leaves)):
        level = below - LEVELS
        between = runs.where((F.col("level") >= level) & (F.col("level") < below))
        up = F.expr(f"shiftright(at, 3 * ({below} - 1 - level))")
        lists = [F.lit(None).cast(t).alias(c) for c, t in (("lefts", "array<string>"), ("rights", "array<string>"), ("subroot", "string"))]
        records = between.select("grp", up.alias("up"), "level", "at", "run", *lists)
        records = records.unionByName(uppers.select("grp", F.col("at").alias("up"), F.lit(below).alias("level"), "at", F.lit(None).cast("array<string>").alias("run"), "lefts", "rights", "subroot"))
        nodes = leaves
        if level:  # nodes of this level are the parents of the runs below; a lower tree has its root only
            nodes = runs.where(F.col("level") == level - 1).select("grp", "n", "at")
            nodes = nodes.unionByName(roots.where(F.col("n") <= FANOUT ** (level - 1)).select("grp", "n", F.lit(0).cast("long").alias("at")))
        at = F.shiftright("at", 3 * LEVELS)
        both = nodes.withColumn("up", at).groupBy("grp", "up").cogroup(records.groupBy("grp", "up"))
        if level:
            uppers = stored(both.applyInArrow(_descend(level, _passed, [f.split()[0] for f in _UPPER.split(", ")], _UPPER_KINDS), _UPPER), "paths")
        else:
            return both.applyInArrow(_descend(0, finish, names, kinds), schema)
    raise AssertionError("unreachable")


def trees(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str | None]:
    """The manifest of docs: numbered leaves (grp, key, digest, other, n, at), runs and roots of the groups' trees, their
    paths to the root over all (grp, n, at, lefts, rights, subroot), and that root (None without rows).

    `other` is the leaf of the row with its text's A-Z in lower case, where 3 divides the key's CRC-32.
    """
    columns = [F.col(c) for c in fields]
    lower = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in fields]
    struck = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 0
    grp = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = stored(docs.select(grp.alias("grp"), F.col(key).alias("key"), leaf(*columns).alias("digest"), F.when(struck, leaf(*lower)).alias("other")), "digests")
    leaves = stored(_numbered(rows, ["key", "digest"]), "numbered")
    runs, roots = build(leaves)
    subs = stored(_numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("digest")), ["key"]), "numbered")
    top_runs, top_roots = build(subs)
    root = top_roots.first()
    none = F.array().cast("array<string>")
    tops = top_roots.select("grp", "n", F.lit(0).cast("long").alias("at"), none.alias("lefts"), none.alias("rights"), F.col("root").alias("subroot"))
    one = lambda node, path, upper: (node["key"], 0, 0, [a for a, _ in _links(path)], [b for _, b in _links(path)], node["digest"])
    paths = told_below(subs, top_runs, top_roots, tops, one, _UPPER, [f.split()[0] for f in _UPPER.split(", ")], _UPPER_KINDS)
    return leaves, runs, roots, stored(paths, "paths"), root["root"] if root else None


def proofs(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, key: str = "doc_id") -> DataFrame:
    """One row a row of docs: key, leaf, subroot, root, proof_sha256, folded_root and verified."""
    leaves, runs, roots, tops, root = trees(docs, group, fields, key)

    def proved(node: dict, path: tuple | None, upper: dict) -> tuple:
        now, siblings = node["other"] or node["digest"], []
        for left, right in _links(path):
            now = digest(left, now, right)
            siblings += [left, right]
        return node["key"], node["digest"], upper["subroot"], root, digest(*siblings), now, now == root

    kind = leaves.schema["key"].dataType
    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = f"{key} {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = (to_arrow_type(kind), *[pa.string()] * 5, pa.bool_())
    return told_below(leaves, runs, roots, tops, proved, schema, names, kinds)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a tampered text is found out."""
    return proofs(load(spark, sf_dir, "documents"))


def _sql(low: int = 12, high: int = 5) -> str:
    """The same rows by plain SQL: `low` levels of the groups' trees and `high` of the one over them."""
    fields = " || ".join(f"COALESCE(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
    lower = fields.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"
    out = [f"d AS (SELECT doc_id, lang, sha256({fields}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({lower}) END AS other FROM documents)"]
    out.append("l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)")
    # Levels of the groups, then of the roots. A level's nodes know their siblings; a lone node has none and stays.
    side = "COALESCE(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {}), '')"
    near = f"{side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r"
    up = "(SELECT g, i // 8 AS i, CASE WHEN ANY_VALUE(n) = 1 THEN ANY_VALUE(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {} GROUP BY g, i // 8)"
    first = "(SELECT COALESCE('1' || lang, '0') AS g, i, leaf AS h FROM l)"
    for k in range(low):
        out.append(f"a{k} AS (SELECT *, {near} FROM (SELECT *, COUNT(*) OVER (PARTITION BY g) AS n FROM {first if not k else up.format(f'a{k - 1}')}))")
    out.append(f"s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS si FROM {up.format(f'a{low - 1}')})")
    for k in range(high):
        out.append(f"b{k} AS (SELECT *, {near} FROM (SELECT *, COUNT(*) OVER (PARTITION BY g) AS n FROM {'(SELECT 0 AS g, si AS i, subroot AS h FROM s)' if not k else up.format(f'b{k - 1}')}))")
    out.append(f"t AS (SELECT h AS root FROM {up.format(f'b{high - 1}')})")
    out.append("f0 AS (SELECT l.doc_id, l.leaf, l.i, s.si, s.g, s.subroot, COALESCE(l.other, l.leaf) AS h, '' AS p FROM l JOIN s ON s.g = COALESCE('1' || l.lang, '0'))")
    for k in range(low + high):
        name, at, on = (f"a{k}", f"f.i // {8**k}", "x.g = f.g AND ") if k < low else (f"b{k - low}", f"f.si // {8 ** (k - low)}", "")
        out.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN x.n = 1 THEN f.h ELSE sha256(x.l || f.h || x.r) END AS h, f.p || x.l || x.r AS p) FROM f{k} f JOIN {name} x ON {on}x.i = {at})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, h AS folded_root, h = root AS verified FROM f{low + high}, t"


OP12_SQL = _sql()
