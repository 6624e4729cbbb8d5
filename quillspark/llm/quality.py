"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a vector of document statistics. Random cosines of the standardised vector approximate a Gaussian
kernel; the normal equations are summed by partition and solved on the driver. A fold of the learning rows that the
ridge has not seen gives (score, label) counts in a fixed number of bins, on which isotonic regression is fitted.

The classifier learns from at most ``max_labels`` labelled documents (a hash sample over all labels when there are
more), which bounds the broadcast side of the one join; scoring covers every row and whole texts.

Defined cases: null texts count as empty and are scored; null labels are not learned from; several labels of one
document are averaged; documents that share an id are each learned from; without labels every score is 0.5. Columns
named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, stored, text_batches

MAX_LABELS = 20_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|!<>{}[]\\^~_=+@/")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:?'\"()-")] = True


def statistics(text: str | None) -> list[float]:
    """What a document looks like: sizes, character classes, variety and repetition."""
    text = text if isinstance(text, str) else ""
    data = text.encode("utf-8", "replace")
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1.0, h.sum())
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    share = h[h > 0] / n
    return [
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), min(lengths.std(), 50.0), min(lengths.max(), 200.0),
        h[65:91].sum() / n, h[97:123].sum() / n, h[48:58].sum() / n, h[128:].sum() / n, h[_SYMBOLS].sum() / n, h[_PUNCT].sum() / n, h[[9, 10, 13, 32]].sum() / n, h[10] / n * 10,
        len(set(words)) / w, len(pairs) / w, len(set(lines)) / max(1, len(lines)), len(lines) / w, h[46] / w, float(-(share * np.log(share)).sum()) if share.size else 0.0,
        sum(not x[-1].isalnum() for x in words) / w,
    ]


WIDTH = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with score (0 to 1) and predicted (1 from 0.5)."""
        model = self
        text_batches(docs.sparkSession)

        @F.pandas_udf("double")
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, WIDTH)
                yield pd.Series(model.predict(x))
            release()

        return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted means that never fall (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + v * w) / (b[1] + w), b[1] + w, b[2] + k
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def _sums(rows: DataFrame, parts: int, size: int, of) -> np.ndarray:
    """Sum of arrays that `of` makes from batches of (f, y); a fixed number of partitions bounds what is sent."""

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.zeros(size)
        for frame in frames:
            if len(frame):
                at += of(np.stack(frame["f"].to_numpy()), frame["y"].to_numpy())
        yield pd.DataFrame({"sums": [at.tobytes()]})

    got = rows.select("f", "y").repartition(parts).mapInPandas(total, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"]) for r in got], axis=0) if got else np.zeros(size)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labels: int = MAX_LABELS, cosines: int = 256, width: float = 4.0, ridge: float = 1.0, bins: int = 400, seed: int = 5) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, target)."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("y"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(max_labels)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"f": [statistics(t) for t in frame["text"]], "y": frame["y"], "fold": frame["fold"]})

    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(3)).cast("int").alias("fold")
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", fold).mapInPandas(measured, "f array<double>, y double, fold int"), "labelled")
    learn, check = rows.where("fold > 0"), rows.where("fold = 0")
    moments = _sums(learn, 4, 2 * WIDTH + 1, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, rng = max(1.0, moments[0]), np.random.default_rng(seed)
    mean = moments[1 : WIDTH + 1] / n
    scale = np.sqrt(np.maximum(moments[WIDTH + 1 :] / n - mean**2, 0)) + 1e-6
    k = 1 + WIDTH + cosines
    model = Model(mean, scale, rng.normal(size=(WIDTH, cosines)) / width, rng.uniform(0, 2 * np.pi, cosines), np.zeros(k), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not moments[0]:
        return model
    sums = _sums(learn, 4, k * k + k, lambda x, y: np.concatenate([((z := model.features(x)).T @ z).ravel(), z.T @ y]))
    penalty = np.full(k, ridge)
    penalty[0] = 1e-6
    model.weights = np.linalg.solve(sums[: k * k].reshape(k, k) + np.diag(penalty), sums[k * k :])

    def counted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(model.raw(x), -0.5, 1.5)
        at = np.minimum(((raw + 0.5) / 2 * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(at, w, bins) for w in (np.ones(len(y)), y, raw)])

    total, positive, raw = _sums(check if check.head(1) else learn, 4, 3 * bins, counted).reshape(3, bins)
    on = total > 0
    level = isotonic(positive[on] / total[on], total[on])
    if level.size:
        # Between two steps the score rises with the raw score, so ties are few; the ends keep clear of 0 and 1.
        knots = raw[on] / total[on]
        model.knots, model.values = np.concatenate([[knots[0] - 1], knots, [knots[-1] + 1]]), np.clip(np.concatenate([[level[0] - 0.01], level, [level[-1] + 0.01]]), 0, 1)
        slope = (model.knots - model.knots[0]) / (model.knots[-1] - model.knots[0])
        model.values = np.clip(0.98 * model.values + 0.02 * slope, 0, 1)
    return model


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from labels of other documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, load(spark, sf_dir, "labels").where(~held))
    return model.score(docs).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
