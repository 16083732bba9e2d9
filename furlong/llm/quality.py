"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has its own covariance, shrunk towards the pooled one and a multiple of the identity. It is fitted to all labelled
rows: executors turn texts into statistics and sum these and their products, so only a few hundred sums reach the driver. A document's score is the
logistic of the difference of the classes' log densities, whose Mahalanobis terms are solved with Cholesky factors that are
computed once when the model is fitted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FEATURES = ["words", "word_length", "upper", "digit", "symbol", "marks", "bars", "distinct", "line_repeats", "line_length", "stops", "commas", "high_bytes", "top_word", "sentence_case"]
_SYMBOLS = [b for b in b"#$%&*+/<=>@\\^_`{|}~"]


def features(text: str) -> list[float]:
    data = text.encode()
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    w, size = max(len(words), 1), max(len(data), 1)
    upper, lower = int(n[65:91].sum()), int(n[97:123].sum())
    count = Counter(words)
    log = lambda x: float(np.log(x + 1e-3))
    return [
        np.log1p(len(words)), np.log1p(sum(map(len, words)) / w), log(upper / max(upper + lower, 1)), log(n[48:58].sum() / size), log(n[_SYMBOLS].sum() / size), log(n[33] / w), log(n[124] / w),
        np.log1p(len(count)) / np.log1p(w + 1), log(1 - len(set(lines)) / len(lines)), np.log1p(len(words) / len(lines)), log(n[46] / w), log(n[44] / w), log(n[128:].sum() / size), log(count.most_common(1)[0][1] / w if words else 0.0), log(sum(x[0].isupper() for x in lines if x) / len(lines)),
    ]


def weights(y: np.ndarray, counts: dict[int, int] | None) -> np.ndarray:
    """For each row, how many rows of its class it stands for; 1 without counts."""
    if not counts:
        return np.ones(len(y))
    return np.where(y == 1, counts.get(1, 0) / max((y == 1).sum(), 1), counts.get(0, 0) / max((y == 0).sum(), 1))


def moments(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """For each class in y the sum of z z' over its rows, z being 1 and the row: the count, the sums and the products."""
    z = np.c_[np.ones(len(x)), x]
    return {c: z[y == c].T @ z[y == c] for c in (0, 1) if (y == c).any()}


class Discriminant:
    def __init__(self, sums: dict[int, np.ndarray], shrink: float = 0.3, ridge: float = 1e-2):
        """sums: moments() of rows with classes in {0, 1}. If a class has no rows, the score is that of the other class for all rows, and 0.5 without any."""
        self.only = None if {0, 1} <= set(sums) else float(next(iter(sums), 0.5))
        if self.only is not None:
            return
        n = {c: sums[c][0, 0] for c in (0, 1)}
        both = (sums[0] + sums[1]) / (n[0] + n[1])
        self.mid = both[0, 1:]
        spread = np.sqrt(np.maximum(np.diag(both)[1:] - self.mid**2, 0))
        self.scale = np.where(spread < 1e-5, 1.0, spread)  # of a constant, differences of sums leave only rounding
        means = {c: sums[c][0, 1:] / n[c] for c in (0, 1)}
        own = {c: (sums[c][1:, 1:] / n[c] - np.outer(means[c], means[c])) / np.outer(self.scale, self.scale) for c in (0, 1)}
        share = {c: n[c] / (n[0] + n[1]) for c in (0, 1)}
        pooled = share[0] * own[0] + share[1] * own[1]
        self.means, self.factors, self.level = [], [], []
        for c in (0, 1):
            cov = (1 - shrink) * own[c] + shrink * pooled
            cov += ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.means.append((means[c] - self.mid) / self.scale)
            self.factors.append(np.linalg.inv(factor))
            self.level.append(np.log(share[c]) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.mid) / self.scale
        density = [self.level[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def agreed(labels: DataFrame, label_col: str, allowed, id_col: str = "doc_id") -> DataFrame:
    """(_id, _y) with labels 0 or 1. Rows with a null id or another label are left out, as are ids with both labels. allowed: a
    condition on the column _id."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & allowed)
    return known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed, most: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 8_000_000) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with labels 0 or 1, those with the smallest hash of their id: at most `most` of each label, and of each label at most
    most_chars code points, where texts of over a twentieth of that are not taken; and the counts of all agreed labels, from
    which the priors come."""
    known = agreed(labels, label_col, allowed, id_col)
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    ids = common.bounded_ids(known, "_id", ["_y"], most)
    rows = common.texts(docs, id_col, text_col).join(F.broadcast(ids), F.col("id") == F.col("_id")).where(F.char_length("text") <= most_chars // 20)
    upto = F.sum(F.char_length("text")).over(Window.partitionBy("_y").orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= most_chars)
    return [(r["text"], r["_y"]) for r in rows.select("id", "text", "_y").orderBy("id", "text").collect()], counts


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.rows_of(batches, "id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], names=["id", "x"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "id long, x array<double>")


def fit(statistics: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id") -> Discriminant:
    """From measured() rows and all allowed labels of them. Only statistics are joined with labels, and each task sums its rows."""
    known = agreed(labels, "quality", allowed, id_col)
    width = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x, y in common.rows_of(batches, "x", "_y"):
            for c, m in moments(np.array(x), np.array(y)).items():
                total[c] = total.get(c, 0) + m
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * width**2, pa.int32()), pa.array(range(width**2), pa.int32()), pa.array(m.ravel())], names=["y", "k", "v"])

    rows = statistics.join(known, F.col("id") == F.col("_id")).select("x", "_y").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).orderBy("y", "k").collect()
    return Discriminant({c: np.array([r["v"] for r in rows if r["y"] == c]).reshape(width, width) for c in {r["y"] for r in rows}})


def train(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fitted to all labelled rows for which allowed, a condition on the column _id, holds."""
    return fit(common.stored(measured(docs.where(F.col(id_col).isNotNull()), id_col, text_col)), labels, allowed, id_col)


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id_col, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    A null text counts as empty and an empty text is scored by its statistics like any other. Null and repeated ids pass
    through. Only text is read.
    """
    return scored(measured(docs, id_col, text_col), model, id_col, threshold)


def scored(statistics: DataFrame, model: Discriminant, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """score() of measured() rows."""
    shared = statistics.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in common.rows_of(batches, "id", "x"):
            s = shared.value.score(np.array(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return statistics.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least threshold. A null text is scored as an empty one."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep = []
            for at in range(0, batch.num_rows, 512):
                keep += (shared.value.score(np.array([features(t or "") for t in texts.slice(at, 512).to_pylist()])) >= threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = common.stored(measured(common.read(spark, sf_dir, "documents")))
    model = fit(statistics, common.read(spark, sf_dir, "labels"), common.crc_mod("_id", 3) != 1)
    return scored(statistics, model).select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


SQL = None
