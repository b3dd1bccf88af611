"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text becomes a short vector of statistics (repetition, duplicate phrases and lines,
symbols, capitals, word lengths, compressibility, vocabulary growth), each smoothed and
log-transformed. Training sums (count, sum, sum of products per class) are added up in
Spark over all labelled rows, first for the mean and then around it, so that no variance is the
difference of two large numbers; from those few numbers the driver makes class means and
covariances, shrunk towards the pooled covariance and then towards a scaled identity, and
their Cholesky factors. A statistic that is constant over the labelled rows tells nothing and has
no weight; the identity's share rises until a factor exists. A score is the difference of the two Mahalanobis log-densities
(plus log priors) through the cached factors, tempered and squashed into (0, 1).

Defined cases: NULL and empty texts have the statistics of an empty text (all counts 0);
any other column is never read; NULL or other labels than 0 and 1 are not learned from;
without two labelled rows of each class (an empty table, say) nothing is learned and every
text scores 0.5; where all labelled texts are equal, the score is the share of class 1 among them
(tempered); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import carry, cut, ship

FEATURES = ("repeated_word", "repeated_phrase", "repeated_line", "symbols", "exclamations", "bars", "capitals",
            "digits", "commonest_word", "word_length", "compressed", "vocabulary", "log_words")

_SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/`"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text.

    Shares are smoothed by a few pseudo-words, so that a short clean text is not judged by
    one chance repetition.
    """
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    size, count = len(data), len(words)
    kinds = Counter(words)

    def without(chars: bytes) -> int:
        return size - len(data.translate(None, chars))

    repeated = sum(map(operator.eq, words, words[1:]))
    phrases = max(count - 3, 0)
    fresh = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    line_bytes = sum(len(line) * n for line, n in lines.items())
    unique_bytes = sum(map(len, lines))
    top = max(kinds.values(), default=0)
    compressed = len(zlib.compress(data, 1)) if size else 0

    def share(part: float, whole: float, pseudo: float) -> float:
        return math.log(part / (whole + pseudo) + 0.01)

    return [
        share(repeated, count, 10), share(phrases - fresh, phrases, 20), share(line_bytes - unique_bytes, line_bytes, 120),
        share(without(_SYMBOLS), count, 10), share(data.count(b"!"), count, 10), share(data.count(b"|"), count, 10),
        share(without(_CAPITALS), size, 60), share(without(_DIGITS), size, 60), share(top, count, 10),
        math.log((size + 60) / (count + 10)), math.log((compressed + 25) / (size + 50)),
        math.log((len(kinds) + 10) / (count + 10) ** 0.9), math.log(count + 10),
    ]


@dataclass(frozen=True)
class Model:
    """Standardisation (weight 0: not used), and mean, Cholesky factor, log-determinant and log-prior by class (0, 1)."""

    centre: np.ndarray
    weight: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) * self.weight
        log_density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            half = np.linalg.solve(factor, (z - mean).T)
            log_density.append(constant - 0.5 * (half * half).sum(axis=0))
        odds = np.clip((log_density[1] - log_density[0]) / self.temper, -700, 700)
        return 1.0 / (1.0 + np.exp(-odds))


def with_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """The frame plus its texts' statistics (array of double); ``text`` is dropped."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([statistics(t) for t in b.column(text).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], values], [*rest, out])

    return df.mapInArrow(work, T.StructType([*[df.schema[c] for c in rest], T.StructField(out, T.ArrayType(T.DoubleType()))]))


def fit(labelled: DataFrame, *, statistics: str = "statistics", label: str = "label", shrink: float = 0.1,
        ridge: float = 0.01, temper: float = 4.0) -> Model:
    """Fit on all labelled rows. Only sums per class come to the driver.

    ``shrink``: weight of the pooled covariance in a class's; ``ridge``: weight of the scaled
    identity; ``temper``: divides the log-odds, which correlated statistics overstate.
    """
    d = len(FEATURES)
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("k"), F.col(statistics).alias("x"))
    rows = cut(rows, "labelled")  # read twice
    first = _class_sums(rows, np.zeros(d))
    n = first[:, 0]
    if n.min() < 2:
        zeros, same = np.zeros(d), np.eye(d)
        return Model(zeros, np.ones(d), (zeros, zeros), (same, same), (0.0, 0.0), temper)
    centre = first[:, 1:1 + d].sum(axis=0) / n.sum()
    around = _class_sums(rows, centre)

    def moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = t[1:1 + d] / t[0]
        return mean, t[1 + d:].reshape(d, d) / t[0] - np.outer(mean, mean)

    pooled = moments(around.sum(axis=0))[1]
    variance = np.diag(pooled)
    varies = variance > 1e-18 * np.maximum(1.0, centre * centre)
    weight = np.where(varies, 1.0 / np.sqrt(np.where(varies, variance, 1.0)), 0.0)
    by = np.outer(weight, weight)
    means, factors, constants = [], [], []
    for c in (0, 1):
        mean, cov = moments(around[c])
        factor = _factor((1 - shrink) * cov * by + shrink * pooled * by, ridge)
        means.append(mean * weight)
        factors.append(factor)
        constants.append(float(math.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()))
    return Model(centre, weight, tuple(means), tuple(factors), tuple(constants), temper)


def _class_sums(rows: DataFrame, around: np.ndarray) -> np.ndarray:
    """By class: count, sums and sums of products of the statistics, less ``around``."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            k = np.asarray(b.column("k"))
            x = np.asarray(b.column("x").flatten()).reshape(-1, d) - around
            for c in (0, 1):
                own = x[k == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        c, at = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(total.ravel())],
                                         ["k", "i", "v"])

    ship(rows.sparkSession)
    table = np.zeros((2, 1 + d + d * d))
    got = rows.mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v"))
    for r in got.collect():  # 2 x (1 + d + d * d) numbers, whatever the input
        table[r["k"], r["i"]] = r["v"]
    return table


def _factor(cov: np.ndarray, ridge: float) -> np.ndarray:
    """Cholesky factor of the covariance mixed with a scaled identity, whose share rises if need be."""
    d = len(cov)
    size = np.trace(cov) / d or 1.0
    while True:
        try:
            return np.linalg.cholesky((1 - ridge) * cov + ridge * size * np.eye(d))
        except np.linalg.LinAlgError:
            if ridge >= 1:
                raise
            ridge = min(1.0, max(10 * ridge, 1e-6))


def score(df: DataFrame, model: Model, *, statistics: str = "statistics", out: str = "score") -> DataFrame:
    """The frame with the statistics replaced by the score of class 1."""
    rest = [c for c in df.columns if c != statistics]
    d = len(FEATURES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(statistics).flatten(), dtype=float).reshape(-1, d)
            s = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(s, pa.float64())], [*rest, out])

    ship(df.sparkSession)
    return df.mapInArrow(work, T.StructType([*[df.schema[c] for c in rest], T.StructField(out, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of ids whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 5 == 0


def learn(statistics_by_id: DataFrame, labels: DataFrame, *, label: str = "quality") -> Model:
    """Fit on the labels of ids that are not held out; ids with several labels count each."""
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("label")).where(
        F.col("doc_id").isNotNull() & ~held_out())
    return fit(statistics_by_id.join(marks, "doc_id"))


def keep_good(df: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
              threshold: float = 0.3) -> DataFrame:
    """The input's rows and columns whose whole text scores at least ``threshold``.

    The model is learned from the input's own labelled rows. Statistics are written beside
    the rows once, so that neither a text nor its statistics are made or moved twice.
    """
    frame, restore = carry(df, text=text, doc_id=doc_id)
    rows = cut(with_statistics(frame), "quality")
    model = learn(rows.select("doc_id", "statistics"), labels)
    kept = score(rows, model).where(F.col("score") >= threshold)
    return restore(kept, [])
