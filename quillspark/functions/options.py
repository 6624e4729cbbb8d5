"""Markers inside a text: inline options, image owners and other places found by pattern, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# What marks an option, a question and other fields inside a text.
OPTION_MARKER = r"([A-Ha-h])\s*[.．、:：)）]\s*"
OWNER_QUESTION = r"(?:^|[\r\n\s])(?:(?:第\s*)?\d{1,6}\s*题|[（(]\s*\d{1,6}\s*[）)]|\d{1,6}\s*[.．、)）])"
OWNER_OPTION = r"(?:^|[\r\n\s])([A-Ha-h])\s*[.．、:：)）]"
OWNER_OTHER = r"(?:^|[\r\n\s])(答案|正确答案|参考答案|标准答案|解析|解释|题解|知识点|考点|题型)\s*[:：]?"
BEFORE_FIRST = r"[\s。；;，,、：:（）()\[\]【】　]$"
LEADING_MARKER = r"(?s)^\s*([A-Ha-h])\s*[.．、:：)）]\s*(.*)$"
_OPEN, _SHUT = "", ""


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as array of (start, end, text, before): places in code points."""
    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT, "")
    parts = F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("last"), F.array().cast("array<struct<start:int,end:int,text:string,before:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        found = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), p.alias("text"), acc["last"].alias("before"))))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(p == "", acc["last"]).otherwise(F.right(p, F.lit(1))).alias("last"), F.when(acc["inside"], found).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,before:string>>"))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def sequential_markers(text: Column) -> Column:
    """The option markers from the first plausible A on, strictly in order; a jump ahead ends them, lower ones pass."""
    kind = "array<struct<key:string,start:int,end:int>>"
    zero = F.struct(F.lit("A").alias("next"), F.lit(False).alias("stop"), F.array().cast(kind).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        key = F.upper(F.substring(m["text"], 1, 1))
        likely = (m["start"] == 0) | m["before"].rlike(BEFORE_FIRST)
        take = ~acc["stop"] & (key == acc["next"]) & ((F.size(acc["out"]) > 0) | likely)
        taken = F.concat(acc["out"], F.array(F.struct(key.alias("key"), m["start"].alias("start"), m["end"].alias("end"))))
        return F.struct(F.when(take, F.char(F.ascii(acc["next"]) + 1)).otherwise(acc["next"]).alias("next"), (acc["stop"] | ((F.size(acc["out"]) > 0) & (key > acc["next"]))).alias("stop"), F.when(take, taken).otherwise(acc["out"]).alias("out"))

    return F.aggregate(matches(text, OPTION_MARKER), zero, step)["out"]


def inline_options(text: Column) -> Column:
    """(leading, options array of (key, text)) of a line that holds at least two options in order, else null."""

    def split(marks: Column) -> Column:
        own = F.transform(marks, lambda m, i: F.struct(m["key"].alias("key"), T.trim(_between(text, m["end"], F.coalesce(F.get(marks, i + 1)["start"], F.length(text)))).alias("text")))
        leading = T.trim(_between(text, F.lit(0), F.get(marks, F.lit(0))["start"])).alias("leading")
        return T.once(F.filter(own, lambda o: o["text"] != ""), lambda kept: F.when((F.size(marks) >= 2) & (F.size(kept) >= 2), F.struct(leading, kept.alias("options"))))

    return T.once(sequential_markers(text), split)


def option_from_raw(raw: Column, fallback: Column) -> Column:
    """(key, text): the marker a text opens with, else the fallback key."""
    t = T.trim(raw)
    body = T.trim(T.group(t, LEADING_MARKER, 2))
    return F.struct(F.coalesce(F.upper(T.group(t, LEADING_MARKER, 1)), fallback).alias("key"), F.when(F.coalesce(body, F.lit("")) == "", t).otherwise(body).alias("text"))


def normalized_options(options: Column) -> Column:
    """Array of (key, text): markers stripped, options that hold several split, blanks dropped, first of a key kept,
    sorted by key. Keys other than A to H go."""
    known = F.filter(F.transform(options, lambda o: F.struct(F.upper(T.trim(o["key"])).alias("key"), T.trim(o["text"]).alias("text"))), lambda o: o["key"].rlike("^[A-H]$"))

    def spread(o: Column) -> Column:
        source = F.when(o["text"].rlike(LEADING_MARKER), o["text"]).otherwise(F.concat(o["key"], F.lit("、"), o["text"]))
        split = inline_options(source)
        return F.when(split.isNotNull() & (split["leading"] == ""), split["options"]).otherwise(F.array(F.struct(o["key"].alias("key"), F.coalesce(T.trim(T.group(o["text"], LEADING_MARKER, 2)), o["text"]).alias("text"))))

    flat = F.filter(F.flatten(F.transform(known, spread)), lambda o: o["text"] != "")
    first = F.filter(flat, lambda o, i: ~F.exists(F.slice(flat, 1, i), lambda p: p["key"] == o["key"]))
    return F.array_sort(first)


def image_owner(text: Column, offset: Column) -> Column:
    """The nearest field marker at or before the offset: stem, option:X or other; null without an offset.

    Before every marker stands the stem; of markers at one place the first kind listed wins.
    """
    shifted = lambda m: m["start"] + F.when(m["text"].rlike(r"^\s"), 1).otherwise(0)
    key = lambda m: F.upper(F.regexp_extract(m["text"], r"([A-Ha-h])", 1))
    at = lambda place, rank, owner: F.struct(place.alias("at"), F.lit(-rank).alias("rank"), owner.alias("owner"))
    marks = F.concat(
        F.array(at(F.lit(-1), 0, F.lit("stem"))), F.transform(matches(text, OWNER_QUESTION), lambda m: at(m["start"], 1, F.lit("stem"))),
        F.transform(matches(text, OWNER_OPTION), lambda m: at(shifted(m), 2, F.concat(F.lit("option:"), key(m)))), F.transform(matches(text, OWNER_OTHER), lambda m: at(shifted(m), 3, F.lit("other"))))
    return F.when(offset.isNotNull(), F.array_max(F.filter(marks, lambda m: m["at"] <= offset))["owner"])
