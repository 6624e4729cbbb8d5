"""Question kinds, practice modes, clamps and other conditional functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("sequential", "random", "wrong")


def kind(raw: Column) -> Column:
    """Lenient: unknown words mean a single choice."""
    return F.coalesce(kind_strict(raw), F.lit("single"))


def kind_strict(raw: Column) -> Column:
    """Null for unknown words."""
    x = F.lower(raw)
    return F.when(x == "single", F.lit("single")).when(x.isin("multiple", "multi"), F.lit("multiple")).when(x.isin("judge", "truefalse", "true_false", "boolean"), F.lit("truefalse"))


def inferred_kind(answers: Column, options: Column, judged: Column) -> Column:
    """From the number of answers, and whether options are missing behind a judgement word."""
    return F.when((F.size(options) == 0) & judged, F.lit("truefalse")).when(F.size(answers) > 1, F.lit("multiple")).otherwise(F.lit("single"))


def mode(route: Column) -> Column:
    return F.when(route.isin(*MODES), route).otherwise(F.lit("sequential"))


def model_tier(stored: Column) -> Column:
    """The stored model tier; unknown values mean the quick one."""
    return F.when(stored == "high_quality", F.lit("high_quality")).otherwise(F.lit("quick"))


def model_name(stored: Column, catalog: dict[str, str]) -> Column:
    """The model of a tier, by a catalog of tier to name."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(catalog.items()) for x in pair]), model_tier(stored))


def clamp(c: Column, low, high) -> Column:
    at = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(c, at(low)), at(high))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; null where there is nothing to share."""
    return F.when(whole > 0, F.floor(part * 100 / whole).cast("int"))


def accuracy_text(correct: Column, answered: Column) -> Column:
    return F.when(answered == 0, F.lit("未开始")).otherwise(F.concat(percent(correct, answered).cast("string"), F.lit("%")))


def resume_index(saved: Column, total: Column) -> Column:
    """The saved place if it is inside the questions, else the first."""
    return F.when((total > 0) & (saved >= 0) & (saved < total), saved).otherwise(F.lit(0)).cast("int")


def action_text(saved: Column, total: Column) -> Column:
    at = F.coalesce(saved, F.lit(0))
    return F.when((total <= 0) | (at <= 0) | (at >= total), F.lit("顺序")).otherwise(F.concat(F.lit("继续 "), (at + 1).cast("string"), F.lit("/"), total.cast("string")))


def now_millis(clock: Column | None = None) -> Column:
    """Epoch milliseconds of the clock, which tests may fix."""
    return F.unix_millis(clock if clock is not None else F.current_timestamp())


def equal_answers(a: Column, b: Column) -> Column:
    """Equal as multisets of upper-cased keys."""
    norm = lambda x: F.array_sort(F.transform(x, F.upper))
    return norm(a) == norm(b)
