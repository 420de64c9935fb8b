"""Quality of documents by a regularised quadratic discriminant over statistics of their text.

Each class has a mean and a covariance, shrunk towards the pooled covariance and the identity; a
document's score compares the two Gaussian log-densities, with Mahalanobis distances from Cholesky
factors that are computed once. The moments are summed by the executors over all training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import text_slices
from newsloom.llm.hashing import text_buffer
from newsloom.shared import materialise

#: Weight of the pooled covariance in a class's, and of the identity in both (features in pooled deviations).
TO_POOLED, TO_IDENTITY = 0.1, 0.05
#: Characters (words / 5) of nothing that shares are taken over besides the text's own, so that short texts say little.
PULL = 40
#: How much worse it is to reject a good document than to keep a poor one, as a log-density. Statistics of one text
#: hang together, so that Gaussian log-densities overstate what they say several times; hence the size.
COST = 26.0

#: Labelled ids up to which they are broadcast (8 bytes each); beyond, a shuffle join does it.
BROADCAST_IDS = 1_000_000

FEATURES = ("words", "word_length", "upper", "digits", "marks", "symbols", "foreign", "repeats", "variety", "line_words", "line_ends")


def _shares(part, whole, pull: int = PULL) -> np.ndarray:
    """Arcsine of the root of a share, which spreads small shares out; shares of little are drawn towards 0."""
    return np.arcsin(np.sqrt(np.minimum(1.0, part / (whole + pull))))


def text_statistics(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES): transformed statistics of each text; null counts as empty."""
    buffer, bounds = text_buffer(texts)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    table = np.bincount(doc * 256 + buffer, minlength=n * 256).reshape(n, 256).astype(np.float64)
    upper, lower = table[:, 65:91].sum(1), table[:, 97:123].sum(1)
    digits, foreign = table[:, 48:58].sum(1), table[:, 192:].sum(1)
    marks = table[:, [ord(c) for c in ".,;:?'\"()-"]].sum(1)
    blanks = table[:, [32, *range(9, 14)]].sum(1)
    chars = table.sum(1) - table[:, 128:192].sum(1)
    letters = upper + lower + foreign
    symbols = chars - letters - digits - marks - blanks
    rest = np.zeros((n, 4))
    for k, text in enumerate(texts.to_pylist()):
        words = (text or "").split()
        if words:
            repeated = sum(map(eq, words, islice(words, 1, None)))
            # distinct words against what a text of this length has at most
            rest[k] = len(words), repeated, len(set(words)) / len(words) ** 0.8, 1
    words = rest[:, 0]
    lines = table[:, 10] + 1
    return np.column_stack([
        np.log1p(words),
        np.log1p(np.divide(chars - blanks, words, out=np.zeros(n), where=words > 0)),
        _shares(upper, letters),
        _shares(digits, chars),
        _shares(marks, chars),
        _shares(symbols, chars),
        _shares(foreign, letters),
        _shares(rest[:, 1], words, PULL // 5),
        np.log(rest[:, 2] + 0.01),
        np.log1p(words / lines),
        _shares(table[:, ord(".")] + table[:, ord("!")] + table[:, ord("?")], words, PULL // 5),
    ])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        x = text_statistics(batch.column("text"))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], [*batch.schema.names[:-1], "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class the count, sums and sums of products of a task's rows, flattened."""
    p = len(FEATURES)
    total = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        x, label = _matrix(batch), batch.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[label == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(list(total), pa.list_(pa.float64()))], ["label", "sums"])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the log of the prior odds with COST."""

    means: np.ndarray
    inverses: np.ndarray
    logdets: np.ndarray
    prior: float

    @classmethod
    def fit(cls, sums: np.ndarray) -> Discriminant:
        """From the flattened moments of class 0 and class 1."""
        p = len(FEATURES)
        n, first, second = sums[:, 0], sums[:, 1 : 1 + p], sums[:, 1 + p :].reshape(2, p, p)
        means = first / n[:, None]
        scatter = second - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / max(1.0, n.sum() - 2)
        unit = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        inverses, logdets = [], []
        for k in (0, 1):
            own = (1 - TO_POOLED) * scatter[k] / max(1.0, n[k] - 1) + TO_POOLED * pooled
            own = (1 - TO_IDENTITY) * own / np.outer(unit, unit) + TO_IDENTITY * np.eye(p)
            factor = np.linalg.cholesky(own)
            inverses.append(np.linalg.inv(factor) / unit)
            logdets.append(2 * np.log(np.diag(factor)).sum())
        return cls(means, np.stack(inverses), np.array(logdets), math.log(n[1] / n[0]) + COST)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with the prior and the cost."""
        logs = [-0.5 * ((((x - self.means[k]) @ self.inverses[k].T) ** 2).sum(1) + self.logdets[k]) for k in (0, 1)]
        return logs[1] - logs[0] + self.prior


def _score(model: Discriminant | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = (model.difference(_matrix(batch)) if model else np.zeros(batch.num_rows)) / len(FEATURES)
            # between 0 and 1 with the sign of the difference, and never flat: far documents still differ
            score = 0.5 + 0.5 * d / (1 + np.abs(d))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's label is kept from the fit: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(statistics: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant of `statistics` (doc_id, x) for `labels` (doc_id, quality 0 or 1), without the held-out rows.

    None if a class has no row. Only the summed moments (2 x 133 numbers) reach the driver.
    """
    train = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label")).where(~held_out(F.col("doc_id")))
    rows = statistics.select("doc_id", "x").join(train, "doc_id").select("label", "x")
    sums = rows.mapInArrow(_moments, "label long, sums array<double>").select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).toPandas()
    if not len(sums):
        return None
    table = sums.pivot(index="label", columns="pos", values="v").to_numpy()
    return Discriminant.fit(table) if (table[:, 0] > 0).all() else None


def quality_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns (doc_id, `keep`, held_out, score, predicted), one row for each row of `docs` (doc_id, text).

    score is from 0 to 1, the higher the likelier label 1; predicted is 1 from 0.5 on. Only the text
    enters a score. Null and empty texts are scored as texts without words. Labels that are null or other
    than 0 and 1 are ignored, repeated label rows count each. Without labels of both classes all scores
    are 0.5. Repeated rows stay, a null doc_id is not held out, an empty table gives an empty result;
    columns other than doc_id, text and `keep` are dropped.
    """
    kept = [c for c in keep if c != "doc_id"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"kept_{c}") for c in kept), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    statistics = materialise(docs.mapInArrow(_statistics, f"{fields}, x array<double>"), "statistics")
    model = fit_quality(statistics, labels)
    scored = statistics.mapInArrow(_score(model), f"{fields}, score double")
    return scored.select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in kept), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep_good(model: Discriminant | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            if model:
                batch = batch.filter(pa.array(model.difference(text_statistics(batch.column("text").cast(pa.string()))) >= 0))
            yield batch

    return run


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, any other columns) that quality_scores would predict as 1.

    Every row is judged by its own text, also where doc_id is null or repeats. Only the statistics of the labelled
    documents are written out; the texts are read twice.
    """
    ids = materialise(labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    model = fit_quality(materialise(labelled.mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics"), labels)
    return docs.mapInArrow(_keep_good(model), docs.schema)
