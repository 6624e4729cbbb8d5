"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans of eight kinds. Five labelers (format, gazetteer, left context, counter context, edges) vote
+1, 0 or -1 on each. Votes are counted by pattern, expectation-maximisation turns the counts into reliabilities and
posteriors, and a logistic span classifier is trained on those posteriors; it also sees a span's length, the classes
of its characters and a hash of the word before it. Only the table of vote patterns and features, at most kinds x 3^5
x 4 x SHAPES x NEAR rows whatever the corpus, reaches the driver. Spans of the four base kinds always stay; spans of
the other kinds are added where the classifier accepts them and no base span overlaps.

Offsets are code points, end exclusive. Defined cases: a null text counts as empty; an empty table gives no rows and
an untrained classifier that accepts nothing; repeated rows are rows of their own; a score of exactly 0.5 accepts;
a column named spans is replaced; the texts' private-use characters
U+E000 and U+E001, which mark matches here, are read as U+E002, so no offset moves. Patterns are written without
nested backtracking (possessive groups, matches starting where a run starts), so long runs stay linear.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "national_phone", "ssn", "iban")
KINDS = BASE + EXTRA
VOTES = ("v_format", "v_gazetteer", "v_context", "v_counter", "v_edge")
#: Features of the classifier beside the votes: classes of a span's characters, hash values of the word before it.
SHAPES, NEAR = 12, 16

_LOCAL = "[A-Za-z0-9._%+-]"
_CODE = "[A-Za-z0-9_/+=-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<!{_CODE}){_CODE}{{20,}}+",
    "national_phone": r"(?<![0-9+(])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|credit|carte|tarjeta|karte|payment",
    "phone": "phone|call|tel|mobile|fax|anruf|llam",
    "secret": "token|key|secret|password|passwd|pwd|credential|bearer",
    "national_phone": "phone|call|tel|mobile|fax|anruf|llam",
    "ssn": "ssn|social security",
    "iban": "iban|account|konto|compte|cuenta",
}
COUNTER = "version|figure|fig\\.|page|isbn|chapter|section|build|release|sha256|checksum|commit|digest"
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "ch", "it", "nl")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "91")
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
_BLOCK = 256


def _starts(parts: Column) -> Column:
    """The code point at which each part begins; summed in blocks, so the copies stay far below n^2."""
    size = F.size(parts)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / _BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(parts, b * _BLOCK + 1, _BLOCK))
    zero = lambda: F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def run(xs: Column, step) -> Column:
        return F.aggregate(xs, zero(), lambda acc, x: F.struct((acc["at"] + step(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    lengths = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    bases = run(blocks, lengths)
    inner = F.transform(blocks, lambda b: run(b, lambda x: F.length(x).cast("long")))
    return F.flatten(F.zip_with(inner, bases, lambda xs, base: F.transform(xs, lambda x: x + base)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """What the base definitions and the proposals demand of a match."""
    n = F.length(_digits(m))
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _format(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    good = {
        "email": m.rlike(r"\.[A-Za-z]{2,}$") & ~m.rlike(r"\.\.|^\.|\.@"),
        "ip": ~m.rlike(r"(^|\.)0[0-9]"),
        "card": m.rlike("^[2-6]"),
        "phone": n >= 10,
        "secret": (F.size(F.array_distinct(F.split(F.lower(m), ""))) >= 10) & m.rlike("[0-9].*[A-Za-z].*[0-9]"),
        "national_phone": ~m.rlike(r"^\(?[01]"),
        "ssn": ~m.rlike("^(000|666|9)"),
        "iban": F.length(F.regexp_replace(m, " ", "")).between(15, 34),
    }[kind]
    return F.when(good, 1).otherwise(-1)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.element_at(F.split(m, r"\."), -1)).isin(*TLDS), 1).otherwise(0)
    if kind == "phone":
        d = _digits(m)
        return F.when(F.substring(d, 1, 1).isin(*CALLING_CODES) | F.substring(d, 1, 2).isin(*CALLING_CODES), 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.rlike(r"^(0|127|255)\."), -1).otherwise(0)
    if kind == "iban":
        return F.when(F.substring(m, 1, 2).isin(*IBAN_COUNTRIES), 1).otherwise(-1)
    return F.lit(0)


def _shape(m: Column) -> Column:
    """Which of SHAPES classes a match is of: quarters of digits, and whether it has capitals, small letters or neither."""
    digits = F.least((F.length(_digits(m)) * 4 / F.greatest(F.length(m), F.lit(1))).cast("int"), F.lit(3))
    return digits * 3 + F.when(m.rlike("[A-Z]"), 2).when(m.rlike("[a-z]"), 1).otherwise(0)


def _spans(text: Column, kind: str, gate: Column) -> Column:
    """Array of the kind's valid matches, with the labelers' votes."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], "\ue000$0\ue001"), "[\ue000\ue001]")
    made = F.transform(F.arrays_zip(parts.alias("p"), _starts(parts).alias("s")), lambda x, i: F.struct(x["p"].alias("p"), x["s"].alias("s"), i.alias("i")))
    around = F.filter(made, lambda x: (x["i"] % 2) == 1)

    def span(x: Column) -> Column:
        m, left, right = x["p"], F.element_at(parts, x["i"]), F.element_at(parts, x["i"] + 2)
        near = F.lower(F.right(left, F.lit(40)))
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(m)).alias("end"), F.least(F.length(m), F.lit(63)).alias("length"),
            _shape(m).alias("shape"), F.pmod(F.xxhash64(F.regexp_extract(near, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)), F.lit(NEAR)).cast("int").alias("near"),
            _format(kind, m).alias("v_format"), _gazetteer(kind, m).alias("v_gazetteer"), F.when(near.rlike(rf"(^|[^a-z])({CUES[kind]})"), 1).otherwise(0).alias("v_context"),
            F.when(near.rlike(rf"(^|[^a-z])({COUNTER})"), -1).otherwise(0).alias("v_counter"), F.when(F.right(left, F.lit(1)).rlike("[A-Za-z0-9]") | F.left(right, F.lit(1)).rlike("[A-Za-z0-9]"), -1).otherwise(1).alias("v_edge"),
        )

    found = F.transform(F.filter(around, lambda x: _valid(kind, x["p"])), span)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,length:int,shape:int,near:int,v_format:int,v_gazetteer:int,v_context:int,v_counter:int,v_edge:int>>")
    return F.when(gate & text.rlike(PATTERNS[kind]), found).otherwise(none)


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (docs without the text), _base and _extra: arrays of proposed spans, their votes and features."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), "\ue000\ue001", "\ue002\ue002")
    # The row goes on whole, so none of its columns can clash with those added here.
    kept = [c for c in docs.columns if c != text]
    at = docs.select((F.struct(*kept) if kept else F.lit(None).cast("int")).alias("row"), clean.alias("_clean")).withColumns({"_digit": F.col("_clean").rlike("[0-9]"), "_at": F.contains(F.col("_clean"), F.lit("@"))})
    gate = {"email": F.col("_at"), "phone": F.col("_digit") & F.contains(F.col("_clean"), F.lit("+"))}
    spans = {k: _spans(F.col("_clean"), k, gate.get(k, F.col("_digit"))) for k in KINDS}
    return at.select("row", F.concat(*[spans[k] for k in BASE]).alias("_base"), F.concat(*[spans[k] for k in EXTRA]).alias("_extra"))


@dataclass
class SpanModel:
    """Labelers' reliabilities (probability of a vote given the truth) and the span classifier's coefficients."""

    reliability: dict[str, dict[str, list[float]]]
    prior: dict[str, float]
    intercept: dict[str, float]
    weights: list[float]

    def score(self, span: Column) -> Column:
        z = F.coalesce(F.element_at(F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(float(self.intercept[k])))]), span["kind"]), F.lit(0.0))
        for w, v in zip(self.weights, VOTES, strict=False):
            z = z + span[v] * F.lit(float(w))
        z = z + (span["length"] / 16).cast("int") * F.lit(float(self.weights[len(VOTES)]))
        rest = self.weights[len(VOTES) + 1 :]
        for name, own in (("shape", rest[:SHAPES]), ("near", rest[SHAPES:])):
            z = z + F.element_at(F.array(*[F.lit(float(w)) for w in own]), span[name] + 1)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(proposed: DataFrame, rounds: int = 40) -> SpanModel:
    """Expectation-maximisation over counted vote patterns, then a logistic classifier on the posteriors."""
    spans = proposed.select(F.explode(F.concat("_base", "_extra")).alias("s"))
    features = ["size", "shape", "near"]
    rows = spans.groupBy("s.kind", *[f"s.{v}" for v in VOTES], (F.col("s.length") / 16).cast("int").alias("size"), "s.shape", "s.near").agg(F.count("*").alias("n")).orderBy("kind", *VOTES, *features).collect()
    if not rows:
        return SpanModel({}, {}, dict.fromkeys(KINDS, -20.0), [0.0] * (len(VOTES) + 1 + SHAPES + NEAR))
    n = np.array([r["n"] for r in rows], float)
    votes = np.array([[r[v] for v in VOTES] for r in rows])
    kind = np.array([KINDS.index(r["kind"]) for r in rows])
    size = np.array([r["size"] for r in rows], float)
    post = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    for _ in range(rounds):
        prior = np.array([(1 + (n * post)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        like = np.ones((len(rows), 2)) * np.stack([1 - prior[kind], prior[kind]], 1)
        tables = []
        for j in range(len(VOTES)):
            table = np.array([[1 + (n * w)[votes[:, j] == v].sum() for v in (-1, 0, 1)] for w in (1 - post, post)])
            table /= table.sum(1, keepdims=True)
            tables.append(table)
            like *= table[:, votes[:, j] + 1].T
        post = like[:, 1] / like.sum(1)
    of = lambda name, many: np.eye(many)[[r[name] for r in rows]]
    x = np.hstack([np.eye(len(KINDS))[kind], votes, size[:, None], of("shape", SHAPES), of("near", NEAR)])
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the ridge-penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (n * (post - p)) - w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    k = len(KINDS)
    return SpanModel({v: {"absent": t[0].tolist(), "present": t[1].tolist()} for v, t in zip(VOTES, tables, strict=True)}, dict(zip(KINDS, prior.tolist(), strict=True)), dict(zip(KINDS, w[:k].tolist(), strict=True)), w[k:].tolist())


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with spans: array of (kind, start, end, base, score), base kinds first, then by place."""
    proposed = stored(propose(docs if text == "spans" else docs.drop("spans"), text), "spans")
    model = fit(proposed)
    mark = lambda base: lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), model.score(s).alias("score"))
    free = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter(F.transform(F.filter(F.col("_extra"), free), mark(False)), lambda s: s["score"] >= 0.5)
    spans = F.concat(F.transform("_base", mark(True)), added).alias("spans")
    found = proposed.select("row", spans)
    return found.select("row.*", "spans") if any(c not in (text, "spans") for c in docs.columns) else found.select("spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's spans of personal data."""
    found = detect(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[of_kind(k) for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))
