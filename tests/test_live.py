"""Live summaries equal the batch ones after every batch; submissions count once; a ledger unlocks what failed."""

import random

from pyspark.sql import functions as F

from quillspark.operators import practice as P
from quillspark.streaming import live

MODES = ("sequential", "random")


def changes(seed=3, batches=6):
    """Random changes by batch: attempts that come late, questions that move or go, banks that are renamed or go."""
    rng, at, out = random.Random(seed), 0, []
    for b in range(batches):
        rows = []
        for bank in range(4) if b == 0 else []:
            rows.append(("bank", bank, None, None, at, f"bank {bank}", None, None, False, False))
        for _ in range(rng.randrange(10, 30)):
            at += rng.randrange(1, 5)
            question = rng.randrange(25)
            bank = question % 5
            kind = rng.choice(("attempt", "attempt", "attempt", "question", "question", "progress", "gone", "name"))
            if kind == "attempt":
                when = at - rng.randrange(0, 40) * 1000 - 1 if rng.random() < 0.2 else at
                rows.append(("attempt", (bank + (rng.random() < 0.1)) % 5, question, rng.random() < 0.6, when, None, None, None, None, None))
            elif kind == "question":
                rows.append(("question", bank, question, None, at, None, None, None, None, False))
            elif kind == "gone":
                rows.append(("question", bank, question, None, at, None, None, None, None, True))
            elif kind == "progress":
                rows.append(("progress", rng.randrange(5), None, None, at, None, rng.choice(MODES), rng.randrange(0, 9), None, False))
            elif bank != 4:
                rows.append(("bank", bank, None, None, at, f"name {at}", None, None, rng.random() < 0.5, False))
        out.append(rows)
    return out


def tables(rows):
    """The store's tables after the changes, by a plain loop; attempts of a batch are met question by question."""
    banks, questions, attempts, places = {}, {}, {}, {}
    for batch in rows:
        for kind, bank, question, right, at, name, mode, index, practiced, removed in sorted(batch, key=lambda r: r[4]):
            if kind == "attempt":
                if question not in attempts or at >= attempts[question][2]:
                    attempts[question] = (bank, right, at)
                old = banks.get(bank, [None, None, None])
                banks[bank] = [old[0], max(old[1] or at, at), at if old[2] is None else max(old[2], at)]
            elif kind == "question" and removed:
                questions.pop(question, None)
                attempts.pop(question, None)
            elif kind == "question":
                questions[question] = bank
            elif kind == "progress":
                places[bank, mode] = index
            else:
                old = banks.get(bank, [None, None, None])
                banks[bank] = [name, max(old[1] or at, at), (at if old[2] is None else max(old[2], at)) if practiced else old[2]]
    return banks, questions, attempts, places


def test_summaries_follow_every_batch(spark, tmp_path):
    rows = changes()
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, live.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(live.CHANGE).parquet(str(tmp_path / "in"))
        live.into_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(180)
        banks, questions, attempts, places = tables(rows[: i + 1])
        named = spark.createDataFrame([(b, v[0], 0, v[1], v[2]) for b, v in banks.items() if v[0] is not None], "id long, name string, created_at long, updated_at long, last_practiced_at long")
        want = P.bank_summaries(
            named,
            spark.createDataFrame([(q, b) for q, b in questions.items()], "id long, bank_id long"),
            spark.createDataFrame([(q, *a) for q, a in attempts.items()], "question_id long, bank_id long, is_correct boolean, answered_at long"),
            spark.createDataFrame([(b, m, x, 0) for (b, m), x in places.items()], "bank_id long, mode string, current_index int, updated_at long"),
        )
        assert live.current(spark, str(tmp_path / "out")).collect() == want.collect()
    assert live.current(spark, str(tmp_path / "out"), until=0).count() == 4


def test_removed_banks_leave(spark, tmp_path):
    rows = [("bank", 1, None, None, 1, "a", None, None, False, False), ("bank", 2, None, None, 1, "b", None, None, False, False), ("bank", 1, None, None, 2, None, None, None, False, True), ("attempt", None, None, True, 3, None, None, None, None, None)]
    spark.createDataFrame(rows, live.CHANGE).write.parquet(str(tmp_path / "in"))
    live.into_table(spark.readStream.schema(live.CHANGE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [r.id for r in live.current(spark, str(tmp_path / "out")).select(F.col("id")).collect()] == [2]
