"""Incremental loading: micro-batches are merged into a keyed table, and keys that are there are skipped or replaced.

The table is a base and the deltas after it, so a micro-batch writes its own rows and no others; after every few deltas they are
merged into a new base. A reader takes the newest complete base and resolves the deltas against it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import keep_first

BATCH = "furlong_batch"


def merge_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, replace: bool = True, order: list[str] | None = None, compact_every: int = 16) -> StreamingQuery:
    """Starts a query that merges each micro-batch into path; read it with latest(), given the same keys and replace.

    Of rows of one batch with one key the last in order counts if they replace, else the first; without an order, in that of all
    their other columns. A batch that is run again writes the same folders, since what it reads is kept until the next base.
    """
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        sort = F.desc_nulls_last if replace else F.asc_nulls_first
        ranked = [sort(c) for c in order or [c for c in batch.columns if c not in keys]]
        keep_first(batch, keys, ranked or list(keys)).write.mode("overwrite").parquet(_folder(path, "delta", n))
        before = max((v for v in _versions(spark, path, "base") if v < n), default=-1)
        if sum(before < v <= n for v in _versions(spark, path, "delta")) >= compact_every:
            _merged(spark, path, keys, replace, before, n).write.mode("overwrite").parquet(_folder(path, "base", n))
            _remove(spark, path, before)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str], replace: bool = True) -> DataFrame | None:
    """The table as of the last complete batch, or None before the first."""
    deltas = _versions(spark, path, "delta")
    return _merged(spark, path, keys, replace, max(_versions(spark, path, "base"), default=-1), deltas[-1]) if deltas else None


def _merged(spark: SparkSession, path: str, keys: list[str], replace: bool, before: int, upto: int) -> DataFrame:
    """The base `before` (-1: none) with the deltas after it up to a batch. Only the side that gives way is filtered by keys, so
    a base is not shuffled where the deltas are small enough to be broadcast."""
    base = spark.read.parquet(_folder(path, "base", before)) if before >= 0 else None
    paths = [_folder(path, "delta", v) for v in _versions(spark, path, "delta") if before < v <= upto]
    if not paths:
        return base
    rows = spark.read.option("basePath", f"{path}/delta").parquet(*paths)
    new = keep_first(rows, keys, [F.desc(BATCH) if replace else F.asc(BATCH)]).drop(BATCH)
    if base is None:
        return new
    return _absent(base, new, keys).unionByName(new) if replace else base.unionByName(_absent(new, base, keys))


def _absent(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is not in others; null equals null."""
    there = others.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    return rows.join(there, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]), "left_anti")


def _folder(path: str, kind: str, n: int) -> str:
    return f"{path}/{kind}/{BATCH}={n:08d}"


def _versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The complete versions, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    done = [s.getPath() for s in fs.listStatus(top) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _remove(spark: SparkSession, path: str, before: int) -> None:
    """Deletes what the base `before` has in it; that base itself stays for readers under way and for a batch that is run again."""
    old = [("base", v) for v in _versions(spark, path, "base") if v < before] + [("delta", v) for v in _versions(spark, path, "delta") if v <= before]
    for kind, v in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, kind, v))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
