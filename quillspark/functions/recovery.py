"""Questions out of damaged or lenient JSON, and compatibility normalisation: what no built-in function expresses.

Pandas functions over Arrow batches; each value is parsed once, by Python's own decoder, which tells where it stopped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FALSE_WORDS, TRUE_WORDS

_DECODER = json.JSONDecoder(strict=False)
QUESTION = "struct<original_id:int,kind:string,question:string,options:array<struct<key:string,text:string,image:string,image_uri:string>>,answer:array<string>,explanation:string,knowledge:string,image:string,image_uri:string>"
_MARKER = re.compile(r"([A-Ha-h])\s*[.．、:：)）]\s*")
_LEADING = re.compile(r"\s*([A-Ha-h])\s*[.．、:：)）]\s*(.*)", re.DOTALL)
_KINDS = {"single": "single", "multiple": "multiple", "multi": "multiple", "judge": "truefalse", "truefalse": "truefalse", "true_false": "truefalse", "boolean": "truefalse"}


def strip_fence(raw: str) -> str:
    raw = raw.strip()
    return re.sub(r"```$", "", re.sub(r"^```(?:json|JSON)?", "", raw)).strip() if raw.startswith("```") else raw


def likely_truncated(raw: str) -> bool:
    """Whether a text that opens like JSON ends inside a string or an open bracket."""
    raw = raw.strip()
    if raw[:1] not in ("{", "["):
        return False
    bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", raw, flags=re.DOTALL)
    return '"' in bare or bare.count("{") > bare.count("}") or bare.count("[") > bare.count("]")


def first_object(raw: str) -> dict | None:
    """The first complete JSON object of a text."""
    at = raw.find("{")
    try:
        return _DECODER.raw_decode(raw, at)[0] if at >= 0 else None
    except ValueError:
        return None


def objects(raw: str) -> tuple[list[dict], bool]:
    """The objects of the first array of a text, and whether any of it was lost.

    An array that decodes is complete. Otherwise its elements are decoded one by one; what does not decode is passed
    over up to the next opening brace.
    """
    raw = strip_fence(raw)
    at = raw.find("[")
    if at < 0:
        return [], True
    try:
        return [x for x in _DECODER.raw_decode(raw, at)[0] if isinstance(x, dict)], False
    except ValueError:
        pass
    out, at = [], at + 1
    while (at := raw.find("{", at)) >= 0:
        try:
            value, at = _DECODER.raw_decode(raw, at)
            out.append(value)
        except ValueError:
            at += 1
    return out, True


def _text(value) -> str | None:
    return None if value is None or isinstance(value, (dict, list)) else str(value).lower() if isinstance(value, bool) else str(value)


def _whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def normalized_answer(raw: str) -> list[str]:
    raw = raw.strip()
    if raw in TRUE_WORDS or raw in FALSE_WORDS:
        return ["A" if raw in TRUE_WORDS else "B"]
    keys: set[str] = set()
    for token in re.split("[,，、]", raw.replace(" ", "")):
        token = token.strip().upper()
        keys.update(token if re.fullmatch("[A-H]{2,}", token) else token[:1])
    return sorted(keys & set("ABCDEFGH"))


def answers(value) -> list[str]:
    """A scalar or a list of answers, normalised."""
    values = value if isinstance(value, list) else [value]
    return normalized_answer(",".join(t for t in map(_text, values) if t is not None))


def inline(line: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Text before, and options of, a line that holds at least two options in order from A."""
    chosen: list[re.Match] = []
    for m in _MARKER.finditer(line):
        key = m[1].upper()
        if not chosen:
            if key == "A" and (m.start() == 0 or line[m.start() - 1].isspace() or line[m.start() - 1] in "。；;，,、：:（）()[]【】"):
                chosen.append(m)
        elif (step := ord(key) - ord(chosen[-1][1].upper())) == 1:
            chosen.append(m)
        elif step > 1:
            break
    if len(chosen) < 2:
        return None
    ends = [m.start() for m in chosen[1:]] + [len(line)]
    found = [(m[1].upper(), t) for m, e in zip(chosen, ends, strict=True) if (t := line[m.end() : e].strip())]
    return (line[: chosen[0].start()].strip(), found) if len(found) > 1 else None


def options(kind: str, value) -> list[dict]:
    """Options given as a list, as a map of keys, or as one text; the judgement pair where a judgement has none."""
    if value is None:
        return [{"key": k, "text": t} for k, t in (("A", "对"), ("B", "错"))] if kind == "truefalse" else []
    raw: list[dict] = []
    if isinstance(value, dict):
        raw = [value] if "key" in value else [{"key": k, "text": _text(v)} for k, v in value.items()]
    else:
        for i, item in enumerate(value if isinstance(value, list) else [value]):
            key = chr(ord("A") + i)
            if isinstance(item, dict):
                raw.append(item | {"key": _text(item.get("key")) or key, "text": _text(item.get("text")) or _text(item.get("label"))})
            elif item is not None:
                m = _LEADING.fullmatch(_text(item) or "")
                raw.append({"key": m[1].upper() if m else key, "text": (m[2].strip() if m else "") or _text(item)})
    out: dict[str, dict] = {}
    for o in raw:
        key, text = (_text(o.get("key")) or "").strip().upper(), (_text(o.get("text")) or "").strip()
        if not re.fullmatch("[A-H]", key) or not text:
            continue
        m = _LEADING.fullmatch(text)
        split = inline(text if m else f"{key}、{text}")
        parts = split[1] if split and not split[0] else [(key, m[2].strip() if m else text)]
        for k, t in parts:
            if t:
                own = {"image": _text(o.get("image")), "image_uri": _text(o.get("imageUri"))} if k == key else {}
                out.setdefault(k, {"key": k, "text": t} | own)
    return [out[k] for k in sorted(out)]


def question(item: dict, strict: bool = False) -> dict | None:
    """A question out of a lenient object, null where it lacks a part; strict adds the invariants of a repair."""
    raw = (_text(item.get("type")) or "").lower()
    kind = _KINDS.get(raw) if strict else _KINDS.get(raw, "single")
    stem = (_text(item.get("question")) or "").strip()
    if kind is None or not stem or item.get("answer") is None:
        return None
    own, given = options(kind, item.get("options")), answers(item["answer"])
    if not own or (kind != "truefalse" and len(own) < 2) or not given or not set(given) <= {o["key"] for o in own}:
        return None
    if strict:
        if (len(given) < 2) if kind == "multiple" else (len(given) != 1):
            return None
        if kind == "truefalse":
            if [o["key"] for o in own] != ["A", "B"] or own[0]["text"] not in TRUE_WORDS or own[1]["text"] not in FALSE_WORDS:
                return None
            own = options("truefalse", None)
    keep = lambda name: (_text(item.get(name)) or None) if not strict else ((_text(item.get(name)) or "").strip() and _text(item.get(name))) or None
    full = [{"key": o["key"], "text": o["text"], "image": o.get("image"), "image_uri": o.get("image_uri")} for o in own]
    return {"original_id": _whole(item.get("id")), "kind": kind, "question": stem, "options": full, "answer": given, "explanation": keep("explanation"), "knowledge": keep("knowledge"), "image": _text(item.get("image")), "image_uri": _text(item.get("imageUri"))}


def parse_questions(raw: str) -> tuple[list[dict], bool]:
    """All usable questions of a text, and whether anything was lost."""
    found, partial = objects(raw)
    return [q for q in map(question, found) if q], partial


def parse_repaired(raw: str) -> dict | None:
    """The one question of a repair reply, null where any invariant fails."""
    text = strip_fence(raw)
    item = None if text.lower() in ("", "null") else first_object(text)
    return question(item, strict=True) if item else None


def annotations(raw: str) -> list[dict] | None:
    """Annotations of a label reply; null where it holds other keys or offsets that are not whole numbers."""
    known = {"sourceId", "label", "start", "end", "optionKey"}
    try:
        root = _DECODER.decode(strip_fence(raw))
    except ValueError:
        return None
    rows = root.get("annotations") if isinstance(root, dict) and set(root) <= {"annotations"} else None
    if not isinstance(rows, list):
        return None
    out = []
    for r in rows:
        if not isinstance(r, dict) or not set(r) <= known or not isinstance(r.get("sourceId"), str) or not isinstance(r.get("label"), str):
            return None
        places = [r.get("start"), r.get("end")]
        if any(isinstance(p, bool) or not isinstance(p, (int, float)) or p % 1 for p in places):
            return None
        out.append({"source_id": r["sourceId"], "label": r["label"].strip().upper(), "start": int(places[0]), "end": int(places[1]), "option_key": r.get("optionKey")})
    return out


def _mapped(kind: str, f):
    def column(c: Column) -> Column:
        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in parts:
                yield pd.Series([None if v is None else f(v) for v in values], dtype=object)

        return run(c)

    return column


def recovered(raw: Column) -> Column:
    """struct(objects array of JSON texts, partial)."""

    @F.pandas_udf("objects array<string>, partial boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in parts:
            found = [objects(v) if v is not None else ([], True) for v in values]
            yield pd.DataFrame({"objects": [[json.dumps(o, ensure_ascii=False) for o in xs] for xs, _ in found], "partial": [p for _, p in found]})

    return run(raw)


questions = _mapped(f"array<{QUESTION}>", lambda v: parse_questions(v)[0])
repaired = _mapped(QUESTION, parse_repaired)


def _plain(v: str) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", v)).replace("，", ",").replace("：", ":")


nfkc = _mapped("string", _plain)
nfkc_each = _mapped("array<string>", lambda values: [None if v is None else _plain(v) for v in values])


def truncated(raw: Column) -> Column:
    """Whether a text that opens like JSON ends inside a string or an open bracket; null for null."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*"', "")
    more = lambda a, b: F.regexp_count(bare, F.lit(a)) > F.regexp_count(bare, F.lit(b))
    return raw.rlike(r"^\s*[{\[]") & (F.contains(bare, F.lit('"')) | more(r"\{", r"\}") | more(r"\[", r"\]"))


labelled = _mapped("array<struct<source_id:string,label:string,start:int,end:int,option_key:string>>", annotations)


def completion(body: Column) -> Column:
    """struct(content, finish_reason, prompt_tokens, completion_tokens, total_tokens) of a chat reply."""
    reply = F.from_json(body, "choices array<struct<message:struct<content:string>,delta:struct<content:string>,finish_reason:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
    first = F.get(reply["choices"], F.lit(0))
    return F.struct(first["message"]["content"].alias("content"), first["finish_reason"].alias("finish_reason"), reply["usage"]["prompt_tokens"].alias("prompt_tokens"), reply["usage"]["completion_tokens"].alias("completion_tokens"), reply["usage"]["total_tokens"].alias("total_tokens"))


def stream_delta(line: Column) -> Column:
    """The text of one line of an event stream; null for its end and for other lines."""
    body = F.when(line.startswith("data:"), F.regexp_replace(line, r"^data:\s*", ""))
    return F.when(body != "[DONE]", F.get_json_object(body, "$.choices[0].delta.content"))
