"""Tests, correlations and metrics, each from a few aggregated numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import average_rank, contingency, running_total


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail by the Wilson-Hilferty cube-root approximation, a fixed formula."""
    if dof <= 0 or x <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_z(x: Column, dof: Column) -> Column:
    """The normal deviate of chi2_tail, as a column: the larger, the smaller the tail."""
    part = 2.0 / (9.0 * dof)
    return (F.pow(x / dof, F.lit(1.0 / 3.0)) - (1.0 - part)) / F.sqrt(part)


def anova_kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: f, eta2, df_between, df_within, p_anova (by the tail of f * df_between), h, p_kruskal."""
    row = anova(df, group, value).crossJoin(kruskal(df, group, value)).head()
    tail = lambda x: chi2_tail(x or 0.0, row["df_between"] or 0)
    out = (row["f"], row["eta2"], row["df_between"], row["df_within"], tail((row["f"] or 0.0) * (row["df_between"] or 0)), row["h"], tail(row["h"]))
    return df.sparkSession.createDataFrame([out], "f double, eta2 double, df_between long, df_within long, p_anova double, h double, p_kruskal double")


def chi2_independence(df: DataFrame, row: str, col: str) -> DataFrame:
    """One row: chi2, dof, cramers_v of two columns; empty cells count, null keys do not."""
    expected = F.col("row_total").cast("double") * F.col("col_total") / F.col("total")
    cells = contingency(df, row, col).agg(F.sum(F.pow(F.col("n") - expected, 2) / expected).alias("chi2"), F.countDistinct(row).alias("r"), F.countDistinct(col).alias("c"), F.max("total").alias("n"))
    least = F.least(F.col("r"), F.col("c")) - 1
    return cells.select(F.col("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * least)).alias("cramers_v"))


def with_p(test: DataFrame, stat: str = "chi2", dof: str = "dof") -> DataFrame:
    """A one-row test with its p-value."""
    row = test.head()
    return test.withColumn("p", F.lit(chi2_tail(row[stat] or 0.0, row[dof] or 0)))


def anova(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One row: f, eta2, df_between, df_within; groups of fewer than `least` rows are left out."""
    v = F.col(value).cast("double")  # the square of a sum of many whole numbers is beyond 64 bits
    per = df.where(v.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).where(F.col("n") >= least)
    tot = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return tot.select((F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k")))).alias("f"), F.try_divide(between, between + within).alias("eta2"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def kruskal(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One row: h, dof; average ranks, no correction for ties; groups of fewer than `least` rows are left out, before ranking."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    large = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    per = average_rank(rows.join(large, group, "left_semi"), value, "_r").groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("r"))
    tot = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("x"))
    return tot.select((12.0 / (F.col("n").cast("double") * (F.col("n") + 1)) * F.col("x") - 3 * (F.col("n") + 1)).alias("h"), (F.col("k") - 1).alias("dof"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson and spearman, the latter of average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranks = average_rank(average_rank(both, x, "_rx"), y, "_ry")
    return ranks.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def binary_metrics(df: DataFrame, target: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1."""
    yes, on = F.col(target) == 1, F.col(score) >= threshold
    n = df.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in {"tp": yes & on, "fp": ~yes & on, "fn": yes & ~on, "tn": ~yes & ~on}.items()])
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, target: str, score: str) -> DataFrame:
    """One row: auc, by average ranks."""
    ranks = average_rank(df.select(target, score), score, "_r")
    y = F.col(target).cast("double")  # as p * q is beyond 64 bits for many rows
    n = ranks.agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"), F.sum(F.when(F.col(target) == 1, F.col("_r"))).alias("r"))
    return n.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def average_precision(df: DataFrame, target: str, score: str, key: str) -> DataFrame:
    """One row: ap, the mean precision at each positive row by falling score, then key."""
    rows = df.select(F.col(target).cast("long").alias("_y"), F.col(score).alias("_s"), F.col(key).alias("_k2"), F.lit(1).cast("long").alias("_one"))
    order = [-F.col("_s"), F.col("_k2")]
    seen = running_total(running_total(rows, order, "_y", "_tp"), order, "_one", "_at")
    return seen.where("_y = 1").agg(F.avg(F.col("_tp") / F.col("_at")).alias("ap"))


def bootstrap_auc(df: DataFrame, target: str, score: str, key: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """One row: low, high, a 95% interval; each replicate weights rows by Poisson draws, hashed
    from the row's key, and all are ranked together by replicate; so the result is the same however rows are dealt."""
    u = F.pmod(F.xxhash64(F.lit(seed), "_rep", "_row"), F.lit(1 << 30)) / float(1 << 30)
    # cumulative Poisson(1) chances, a fixed table
    cuts = [0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941, 0.99992]
    draws = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    rows = df.select(F.col(target).alias("_y"), F.col(score).alias("_s"), F.col(key).alias("_row"))
    reps = rows.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", draws)
    per = reps.groupBy("_rep", "_s").agg(F.sum(F.col("_w") * F.col("_y")).alias("p"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("_rep").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = per.withColumn("g", F.col("p") * (below + F.col("q") / 2)).groupBy("_rep").agg(F.try_divide(F.sum("g"), F.sum("p") * F.sum("q")).alias("auc"))
    return auc.agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
