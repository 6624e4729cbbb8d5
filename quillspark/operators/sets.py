"""Set, interval and as-of operators that the recognisers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids."""
    return rows.join(ids, key, "left_semi")


def covers(outer: Column, inner: Column) -> Column:
    """True where inner is not empty and all of it is in outer."""
    return (F.size(inner) > 0) & (F.size(F.array_except(inner, outer)) == 0)


def asof(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the value of the last mark of their key at or before them, the highest value where marks tie.

    Both sides are united and sorted once by key and place: no pairs of rows and marks arise.
    """
    both = rows.withColumn("_side", F.lit(1)).unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs (first < second) of spans(key, id, start, end) of one document that overlap."""
    a, b = spans.alias("a"), spans.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("first"), F.col("b.id").alias("second"))


def containing(texts: DataFrame, text_key: str, values: DataFrame, value_key: str, text: str = "text", words: int = 5) -> DataFrame:
    """(text_key, value_key) of all pairs where a value's words stand in a text one after the other; white space aside.

    A value is looked up by the hash of the run of five of its words (fewer: all) that the fewest values share, an
    equi-join with the runs of the texts; what meets is verified on whole texts. Values without words stand nowhere.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = lambda c: F.when(c != "", F.split(c, " "))
    v = values.select(F.col(value_key).alias("_v"), plain(F.col(text)).alias("_value")).where("_value <> ''").withColumn("_words", cut(F.col("_value"))).withColumn("_n", F.least(F.size("_words"), F.lit(words)))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1))), lambda i: F.xxhash64(n, F.array_join(F.slice("_words", i, n), " ")))
    each = v.select("_v", "_value", "_n", F.posexplode(runs(F.col("_n"))).alias("_at", "_run"))
    shared = each.groupBy("_run").agg(F.count("*").alias("_shared"))
    rarest = each.join(shared, "_run").groupBy("_v", "_value", "_n").agg(F.min_by("_run", F.struct("_shared", "_at")).alias("_run"))
    lengths = sorted(r["_n"] for r in v.select("_n").distinct().collect())  # at most `words` numbers
    t = texts.select(F.col(text_key).alias("_t"), plain(F.col(text)).alias("_text")).where("_text <> ''")
    cutted = t.withColumn("_words", cut(F.col("_text")))
    own = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[F.when(F.size("_words") >= n, runs(F.lit(n))).otherwise(F.array().cast("array<bigint>")) for n in lengths]))
    met = cutted.select("_t", F.explode(own).alias("_run")).join(rarest, "_run").select("_t", "_v", "_value").distinct()
    found = met.join(t, "_t").where(F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_value", F.lit(" "))))
    return found.select(F.col("_t").alias(text_key), F.col("_v").alias(value_key)).distinct()


def accepted_in_order(spans: Column) -> Column:
    """Of an array of spans (start, end, ...), in order, those that overlap none accepted before."""
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(s))))


def containing_owner(spans: Column, at: Column) -> Column:
    """The owner of a place among spans (start, end, owner): the only one around it, else the only one that begins or
    ends there, else the only owner there is, else null."""
    pick = lambda cond: F.filter(spans, cond)
    inside, begins, ends = pick(lambda s: (s["start"] < at) & (at < s["end"])), pick(lambda s: s["start"] == at), pick(lambda s: s["end"] == at)
    owners = F.array_distinct(F.transform(spans, lambda s: s["owner"]))
    one = lambda xs: F.size(xs) == 1
    first = lambda xs: F.get(xs, F.lit(0))["owner"]
    return F.when(one(inside), first(inside)).when(one(begins), first(begins)).when(one(ends), first(ends)).when(one(owners), F.get(owners, F.lit(0)))


def first_of(rows: DataFrame, key: Column, order: str | Column) -> DataFrame:
    """The first row, by order, of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def exclusively_owned(refs: DataFrame, mine: Column, key: list[str]) -> DataFrame:
    """Keys that only rows of mine refer to."""
    return refs.groupBy(*key).agg(F.bool_and(mine).alias("_only")).where("_only").select(*key)


def superseded(before: DataFrame, after: DataFrame, key: str, retryable: Column) -> DataFrame:
    """before, with its retryable rows of a key that after holds replaced by those of after."""
    kept = before.where(~retryable).unionByName(before.where(retryable).join(after, key, "left_anti"))
    return kept.unionByName(after.join(before.where(~retryable), key, "left_anti"))


def failed_checks(checks: list[tuple[str, Column]]) -> Column:
    """Array of the codes whose condition holds, in the order of the list."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in checks]), lambda x: x.isNotNull())


def merged_candidates(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row a key: source_ids united in the order met, of every other column the first value that is not null."""
    key = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in (*key, order, "source_ids")]
    united = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "source_ids"))), lambda x: x["source_ids"])))
    return rows.groupBy(*key).agg(united.alias("source_ids"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])


def failures(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(source_id, failure) of log(source_id, seq, what, failure): what is failed, cleared or unresolved; key may name
    more columns than source_id.

    The first failure after the last clearing stays; something unresolved after it takes its place.
    """
    key = key or ["source_id"]
    whole = Window.partitionBy(*key)
    at = log.withColumn("_cleared", F.coalesce(F.max(F.when(F.col("what") == "cleared", F.col("seq"))).over(whole), F.lit(-1)))
    live = F.col("seq") > F.col("_cleared")
    named = lambda pick, w: pick("failure", F.when(live & (F.col("what") == w), F.col("seq")))
    return at.groupBy(*key).agg(F.coalesce(named(F.max_by, "unresolved"), named(F.min_by, "failed")).alias("failure"))
