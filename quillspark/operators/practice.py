"""Practice statistics over banks, questions, attempts and progress.

Shapes: banks(id, name, created_at, updated_at, last_practiced_at), questions(id, bank_id, ...),
attempts(question_id, bank_id, is_correct, answered_at), progress(bank_id, mode, current_index, updated_at). Child
tables are aggregated by bank before they meet the banks, so each is scanned once and a hot bank sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import kinds


def bank_summaries(banks: DataFrame, questions: DataFrame, attempts: DataFrame, progress: DataFrame, mode: str = "sequential") -> DataFrame:
    """Counts of each bank, its accuracy and where practice goes on; the last practised first."""
    asked = questions.groupBy("bank_id").agg(F.count("*").cast("int").alias("question_count"))
    right = F.col("is_correct")
    tried = attempts.groupBy("bank_id").agg(F.count("*").cast("int").alias("answered_count"), F.count_if(right).cast("int").alias("correct_count"), F.count_if(~right).cast("int").alias("wrong_count"))
    place = progress.where(F.col("mode") == mode).groupBy("bank_id").agg(F.max("current_index").alias("sequential_index"))
    out = banks.join(asked, banks["id"] == asked["bank_id"], "left").drop("bank_id")
    out = out.join(tried, out["id"] == tried["bank_id"], "left").drop("bank_id").join(place, out["id"] == place["bank_id"], "left").drop("bank_id")
    out = out.fillna(0, ["question_count", "answered_count", "correct_count", "wrong_count"])
    out = out.withColumns({"accuracy_text": kinds.accuracy_text(F.col("correct_count"), F.col("answered_count")), "action_text": kinds.action_text(F.col("sequential_index"), F.col("question_count"))})
    return out.orderBy(F.coalesce("last_practiced_at", "updated_at").desc(), "id").select("id", "name", "question_count", "answered_count", "correct_count", "wrong_count", "last_practiced_at", "sequential_index", "accuracy_text", "action_text")


def latest_attempts(events: DataFrame, order: tuple[str, ...] = ("answered_at",)) -> DataFrame:
    """One row a question: the last attempt, with all attempts counted right and wrong."""
    at = F.struct(*order)
    return events.groupBy("question_id").agg(F.max_by("bank_id", at).alias("bank_id"), F.max_by("is_correct", at).alias("is_correct"), F.max("answered_at").alias("answered_at"), F.count_if("is_correct").cast("int").alias("correct_count"), F.count_if(~F.col("is_correct")).cast("int").alias("wrong_count"))


def upserted_attempts(previous: DataFrame, events: DataFrame, order: tuple[str, ...] = ("answered_at",)) -> DataFrame:
    """The attempts table after a batch of new attempts: the counts add up, the newer answer stays."""
    now = latest_attempts(events, order)
    p = lambda c: F.col(f"p.{c}")
    n = lambda c: F.col(f"n.{c}")
    newer = n("answered_at").isNotNull() & (p("answered_at").isNull() | (n("answered_at") >= p("answered_at")))
    pick = lambda c: F.when(newer, n(c)).otherwise(p(c)).alias(c)
    add = lambda c: (F.coalesce(p(c), F.lit(0)) + F.coalesce(n(c), F.lit(0))).alias(c)
    both = previous.alias("p").join(now.alias("n"), p("question_id") == n("question_id"), "full")
    return both.select(F.coalesce(p("question_id"), n("question_id")).alias("question_id"), pick("bank_id"), pick("is_correct"), pick("answered_at"), add("correct_count"), add("wrong_count"))


def wrong_book(questions: DataFrame, attempts: DataFrame, bank_id: int | None = None) -> DataFrame:
    """Questions whose last answer is wrong, the last answered first."""
    wrong = attempts.where(~F.col("is_correct")).select(F.col("question_id").alias("id"), "answered_at")
    if bank_id is not None:
        questions = questions.where(F.col("bank_id") == bank_id)
    return questions.join(wrong, "id").orderBy(F.col("answered_at").desc(), "id")


def questions_for(questions: DataFrame, attempts: DataFrame, bank_id: int, mode: str, seed: int | None = None) -> DataFrame:
    """A practice round: sequential by id, random and wrong ones shuffled anew (by the seed, if one is given)."""
    own = wrong_book(questions, attempts, bank_id).drop("answered_at") if mode == "wrong" else questions.where(F.col("bank_id") == bank_id)
    return own.orderBy("id") if mode not in ("random", "wrong") else own.orderBy(F.rand(seed) if seed is None else F.xxhash64(F.lit(seed), "id"))


def questions_except(questions: DataFrame, bank_id: int) -> DataFrame:
    return questions.where(F.col("bank_id") != bank_id)


def latest_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_reports(reports: DataFrame) -> DataFrame:
    return latest_by(reports.where("bank_id IS NOT NULL"), "bank_id", [F.col("finished_at").desc(), F.col("report_id").desc()])


def progress_after(events: DataFrame) -> DataFrame:
    """The last saved place of each bank and mode; random and wrong rounds are never saved; places start at 0."""
    kept = events.where(~F.col("mode").isin("random", "wrong"))
    return kept.groupBy("bank_id", "mode").agg(F.greatest(F.max_by("current_index", "updated_at"), F.lit(0)).alias("current_index"), F.max("updated_at").alias("updated_at"))


def session_accuracy(attempts: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("answered_at",)) -> DataFrame:
    """Running answered and correct counts inside each session."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = attempts.withColumns({"answered": F.count("*").over(w), "correct": F.sum(F.col("is_correct").cast("int")).over(w)})
    return out.withColumn("percent", kinds.percent(F.col("correct"), F.col("answered")))


def submitted_once(submissions: DataFrame, key: tuple[str, ...] = ("session_id", "question_id"), order: tuple[str, ...] = ("answered_at",)) -> DataFrame:
    """The first submission of each question in a session: repeated taps count once."""
    return submissions.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
