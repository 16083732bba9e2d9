"""Scaling, clustering, projection and classifiers on Spark ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zscores(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """cols by population mean and deviation, of fit_on if given; a deviation of 0 counts as 1."""
    row = (fit_on or df).agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).head()
    return df.withColumns({c: (F.col(c) - (row[f"m_{c}"] or 0.0)) / (row[f"s_{c}"] or 1.0) for c in cols})


def medians_filled(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    row = (fit_on or df).agg(*[F.median(c).alias(c) for c in cols]).head()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c])) for c in cols})


def temporal_split(df: DataFrame, year: str = "year", train_to: int = 2013, valid_to: int = 2015) -> dict[str, DataFrame]:
    y = F.col(year)
    return {"train": df.where(y <= train_to), "valid": df.where((y > train_to) & (y <= valid_to)), "test": df.where(y > valid_to)}


def with_balance(df: DataFrame, target: str) -> DataFrame:
    """df with weight .5/p for positives and .5/(1 - p) for the rest."""
    p = df.agg(F.avg(target)).head()[0] or 0.5
    return df.withColumn("weight", F.when(F.col(target) == 1, 0.5 / max(p, 1e-9)).otherwise(0.5 / max(1 - p, 1e-9)))


def _vector(df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=name).transform(df)


def kmeans(df: DataFrame, cols: list[str], k: int, seed: int = 42) -> DataFrame:
    """df with cluster."""
    v = _vector(df, cols)
    return KMeans(k=k, seed=seed, maxIter=150).fit(v).transform(v).withColumnRenamed("prediction", "cluster").drop("features")


def silhouette(df: DataFrame, key: str, vector: str, label: str, block_rows: int = 8000) -> DataFrame:
    """One row: the mean Euclidean silhouette over all pairs of rows with different keys. A singleton
    has mean distance 0 to its own cluster, so it scores 1; without a second cluster all score 0, as do rows without vector or label.

    Rows are dealt in blocks by their key, and each pair of blocks is one group, of which only sums by row and cluster come out. So
    memory follows a block; the work grows with the square of the rows, as an exact score does, and the rows shuffled with rows x blocks.
    """
    v = df.select(F.col(key).alias("i"), F.col(vector).alias("x"), F.col(label).alias("c")).where("i IS NOT NULL")
    blocks = max(1, -(-v.count() // block_rows))
    full = v.where(F.col("x").isNotNull() & F.col("c").isNotNull() & F.forall("x", lambda e: e.isNotNull())).withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "i", "x", "c")

    def sums(k: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t["x"].combine_chunks()
        if len(set(pc.list_value_length(lists).to_pylist())) > 1:
            raise ValueError("vectors differ in length")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
        x = x - x[:1]  # a common offset would cost digits below
        square = (x**2).sum(1)
        keys, names = (t[n].combine_chunks().dictionary_encode() for n in ("i", "c"))
        same, code = np.asarray(keys.indices), np.asarray(names.indices)
        block = t["block"].to_numpy()
        lo, hi = np.flatnonzero(block == k[0].as_py()), np.flatnonzero(block == k[1].as_py())
        out = []
        for one, two in [(lo, hi)] if k[0] == k[1] else [(lo, hi), (hi, lo)]:
            if not len(one) or not len(two):
                continue
            two = two[np.argsort(code[two], kind="stable")]
            firsts = np.flatnonzero(np.r_[True, code[two][1:] != code[two][:-1]])
            step = max(1, 2_000_000 // len(two))
            for at in range(0, len(one), step):
                rows = one[at : at + step]
                differ = same[rows][:, None] != same[two][None, :]
                dist = np.where(differ, np.sqrt(np.maximum(square[rows][:, None] + square[two][None, :] - 2 * x[rows] @ x[two].T, 0)), 0.0)
                total, count = np.add.reduceat(dist, firsts, 1), np.add.reduceat(differ.astype(np.int64), firsts, 1)
                r, c = np.nonzero(count)
                out.append(pa.table({"i": t["i"].take(rows[r]), "c": t["c"].take(rows[r]), "d": t["c"].take(two[firsts[c]]), "s": total[r, c], "n": count[r, c]}))
        return pa.concat_tables(out)

    kinds = {f.name: f.dataType for f in v.schema}
    schema = T.StructType([T.StructField("i", kinds["i"]), T.StructField("c", kinds["c"]), T.StructField("d", kinds["c"]), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    per = pairs.groupBy("lo", "hi").applyInArrow(sums, schema).groupBy("i", "c", "d").agg((F.sum("s") / F.sum("n")).alias("m"))
    ab = per.groupBy("i").agg(F.max(F.when(F.col("c") == F.col("d"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("d"), F.col("m"))).alias("b"))
    return v.select("i").distinct().join(ab, "i", "left").agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.coalesce("a", F.lit(0.0)), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def pca2(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[float]]:
    """df with pc1 and pc2 of the centred columns, and their shares of the variance."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).head()
    v = _vector(df.withColumns({f"_c{k}": F.col(c) - means[c] for k, c in enumerate(cols)}), [f"_c{k}" for k in range(len(cols))])
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(v)
    out = model.transform(v).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({"pc1": F.col("_pc")[0], "pc2": F.col("_pc")[1]}).select(*df.columns, "pc1", "pc2"), list(model.explainedVariance.toArray())


def centroid_names(df: DataFrame, label: str, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """(label, name): rules (column, name, highest) take, one after another, the cluster left with the highest or lowest mean."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in dict.fromkeys(r[0] for r in rules)]).collect()
    left, out = sorted(means, key=lambda r: r[label]), []
    for col, name, highest in rules:
        if left:
            best = (max if highest else min)(left, key=lambda r: r[col])
            left.remove(best)
            out.append((best[label], name))
    return df.sparkSession.createDataFrame(out, f"{label} {dict(df.dtypes)[label]}, name string")


def logistic(train: DataFrame, cols: list[str], target: str, l2: float = 0.005):
    return LogisticRegression(featuresCol="features", labelCol=target, weightCol="weight", regParam=l2, standardization=False, maxIter=500).fit(_vector(with_balance(train, target), cols))


def tree(train: DataFrame, cols: list[str], target: str, depth: int = 6, leaf: int = 25, seed: int = 42):
    """One tree by weighted Gini impurity; candidate thresholds are seven for each feature, at its quantiles."""
    return DecisionTreeClassifier(featuresCol="features", labelCol=target, weightCol="weight", maxDepth=depth, minInstancesPerNode=leaf, maxBins=8, seed=seed).fit(_vector(with_balance(train, target), cols))


def forest(train: DataFrame, cols: list[str], target: str, trees: int = 45, depth: int = 6, leaf: int = 25, seed: int = 42):
    subset = str(max(3, round(len(cols) ** 0.5 * 1.3)))
    return RandomForestClassifier(featuresCol="features", labelCol=target, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=subset if int(subset) <= len(cols) else "all", seed=seed).fit(_vector(with_balance(train, target), cols))


def scored(model, df: DataFrame, cols: list[str], name: str = "score") -> DataFrame:
    return model.transform(_vector(df, cols)).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def importances(spark, cols: list[str], forest_model, logistic_model) -> DataFrame:
    rows = [(c, float(100 * g), float(abs(w))) for c, g, w in zip(cols, forest_model.featureImportances.toArray(), logistic_model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, gini_importance_pct double, logreg_abs_coef double").orderBy(F.desc("gini_importance_pct"), "feature")
