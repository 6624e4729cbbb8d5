"""Text patterns of question documents, as columns that stay inside the JVM.

Offsets are code points. Trimming removes all Unicode white space, which Spark's own trim does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and words by which a question document is recognised.
SPACE = r"[\s\x1c-\x1f\u0085   -     　]"
QUESTION_PREFIX = r"^\s*(?:(?:第\s*(\d{1,6})\s*题)|(?:[（(]\s*(\d{1,6})\s*[）)])|(?:(\d{1,6})\s*[.．、)）]))\s*"
OPTION_LINE = r"^\s*([A-Ha-h])\s*[.．、:：)）]\s*(.+?)\s*$"
ANSWER_LINE = r"^\s*(?:答案|正确答案|参考答案|标准答案)\s*[:：]?\s*(.*?)\s*$"
EXPLANATION_LINE = r"^\s*(?:解析|解释|题解)\s*[:：]?\s*(.*?)\s*$"
KNOWLEDGE_LINE = r"^\s*(?:知识点|考点)\s*[:：]?\s*(.*?)\s*$"
TYPE_LINE = r"^\s*题型\s*[:：]?\s*(\S+)\s*$"
TAGGED_HEADER = r"^\s*\[(判断题|单选题|多选题)](?:\[[^]\r\n]*])*\s*$"
TRAILING_ANSWER = r"^\s*(.*?)\s*[（(]\s*([A-Ha-h]+|对|错|正确|错误|√|×)\s*[）)]\s*[。.!！?？]?\s*$"
NUMBERED_DISPLAY = r"^[（(]?\s*(\d{1,6})"
LETTERED_DISPLAY = r"^([A-Ha-h])(?:[.．、:：)）]|$)"
TRUE_WORDS = ("对", "正确", "√")
FALSE_WORDS = ("错", "错误", "×")
TYPE_LABELS = {"单选题": "single", "多选题": "multiple", "判断题": "truefalse"}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(~c.rlike(rf"[^\s\x1c-\x1f\u0085   -     　]"), F.lit(True))


def lines(c: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\n|\r"), trim), lambda x: x != "")


def once(value: Column, f) -> Column:
    """f of a value that it names many times, worked out once a row: an expression alone would be evaluated at each mention."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def normalize_answer(raw: Column) -> Column:
    """Sorted distinct option keys A to H of a written answer.

    Judgement words map to A and B. Tokens between commas give all their letters when all are keys, else the first
    character alone.
    """
    t = trim(raw)
    tokens = F.split(F.translate(t, "，、 ", ",,"), ",")
    keys = F.flatten(F.transform(tokens, lambda x: F.when(F.upper(trim(x)).rlike("^[A-H]{2,}$"), F.split(F.upper(trim(x)), "")).otherwise(F.array(F.upper(F.substring(trim(x), 1, 1))))))
    kept = F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.rlike("^[A-H]$"))))
    return F.when(t.isin(*TRUE_WORDS), F.array(F.lit("A"))).when(t.isin(*FALSE_WORDS), F.array(F.lit("B"))).when(t == "", F.array().cast("array<string>")).otherwise(kept)


def normalize_answers(values: Column) -> Column:
    """normalize_answer over the parts of a list."""
    return F.when(F.size(values) > 0, normalize_answer(F.array_join(values, ","))).otherwise(F.array().cast("array<string>"))


def question_number(line: Column) -> Column:
    """The number a line opens with, null where it opens no question."""
    found = [F.nullif(F.regexp_extract(line, QUESTION_PREFIX, i), F.lit("")) for i in (1, 2, 3)]
    return F.coalesce(*found).cast("int")


def without_question_prefix(line: Column) -> Column:
    return trim(F.regexp_replace(line, QUESTION_PREFIX, ""))


def option_key(line: Column) -> Column:
    return F.upper(group(line, OPTION_LINE, 1))


def option_text(line: Column) -> Column:
    return trim(group(line, OPTION_LINE, 2))


def tagged_type(line: Column) -> Column:
    """Question kind of a bracketed header line such as [单选题][难度2]."""
    label = group(line, TAGGED_HEADER, 1)
    out = F.lit(None).cast("string")
    for name, kind in TYPE_LABELS.items():
        out = F.when(label == name, F.lit(kind)).otherwise(out)
    return out


def automatic_question_number(level: Column, display: Column) -> Column:
    return F.when(level == 0, group(trim(display), NUMBERED_DISPLAY, 1).cast("int"))


def automatic_option_key(display: Column) -> Column:
    return F.upper(group(trim(display), LETTERED_DISPLAY, 1))


def estimated_tokens(text: Column, images: Column | None = None) -> Column:
    """Half of the characters rounded up, 80 a slice and 8 an image."""
    n = F.floor((F.length(text) + 1) / 2) + 80
    return (n + 8 * images if images is not None else n).cast("int")


def canonical(c: Column) -> Column:
    """White space removed, full-width comma and colon made plain; compatibility forms need ``recovery.nfkc``."""
    return F.translate(F.regexp_replace(c, SPACE, ""), "，：", ",:")


def strip_fences(c: Column) -> Column:
    """The text without a Markdown code fence around it."""
    return trim(F.regexp_replace(F.regexp_replace(trim(c), r"^```(?:json|JSON)?\s*", ""), r"\s*```$", ""))


def media_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def media_type(name: Column) -> Column:
    """Content type by extension."""
    ext, out = media_extension(name), F.lit("application/octet-stream")
    for kind, names in {"image/png": ("png",), "image/jpeg": ("jpg", "jpeg"), "image/gif": ("gif",), "image/bmp": ("bmp",), "image/webp": ("webp",), "image/emf": ("emf",), "image/wmf": ("wmf",)}.items():
        out = F.when(ext.isin(*names), F.lit(kind)).otherwise(out)
    return out


def displayable(name: Column) -> Column:
    return F.coalesce(media_extension(name).isin("png", "jpg", "jpeg", "gif", "bmp", "webp"), F.lit(False))


def media_path(target: Column) -> Column:
    """A relationship target as a path inside the archive."""
    clean = F.regexp_replace(F.regexp_replace(target, r"\\", "/"), r"^(\.\./|\./|/)+", "")
    return F.when(clean.startswith("word/"), clean).otherwise(F.concat(F.lit("word/"), clean))


def unescape_xml(c: Column) -> Column:
    """The five XML entities; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def letters(n: Column) -> Column:
    """Bijective base 26: 1 is A, 27 is AA."""
    v = F.greatest(n, F.lit(1)).cast("int")
    start = F.struct(v.alias("v"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(acc["v"] > 0, F.struct(F.floor((acc["v"] - 1) / 26).cast("int").alias("v"), F.concat(F.char(F.lit(65) + (acc["v"] - 1) % 26), acc["s"]).alias("s"))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step)["s"]


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999; other numbers are clamped."""
    v = F.greatest(F.least(n, F.lit(3999)), F.lit(1))
    digits = [("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]
    pick = lambda i, unit: F.element_at(F.array(*map(F.lit, digits[i])), (F.floor(v / unit) % 10).cast("int") + 1)
    return F.concat(pick(0, 1000), pick(1, 100), pick(2, 10), pick(3, 1))


def rendered_number(n: Column, kind: Column) -> Column:
    """A counter in a list's number format; unknown formats are decimal."""
    return F.when(kind == "upperLetter", letters(n)).when(kind == "lowerLetter", F.lower(letters(n))).when(kind == "upperRoman", roman(n)).when(kind == "lowerRoman", F.lower(roman(n))).when(kind == "bullet", F.lit("•")).otherwise(n.cast("string"))


def expanded_template(template: Column, values: list[Column]) -> Column:
    """%1 to %9 of a level text replaced by the rendered counters."""
    for i, value in enumerate(values[:9], 1):
        template = F.replace(template, F.lit(f"%{i}"), F.coalesce(value, F.lit("1")))
    return template
