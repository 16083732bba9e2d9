"""Joins, aggregations, windows and set operations over any columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True, order: list[str] | None = None) -> DataFrame:
    """Rows of both, one for each key; a new row replaces an old one, or is ignored. Of new rows with one key the last in order
    counts if they replace, else the first; without an order, in that of all their columns."""
    order = order or [c for c in new.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    sort = (F.desc_nulls_last if replace else F.asc_nulls_first)
    return keep_first(both, keys, [F.desc("_new") if replace else F.asc("_new"), *[sort(c) for c in order]]).drop("_new")


def not_loaded(new: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(loaded.select(*keys), keys, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent; a null in the parent's keys hides none of them."""
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def mapped(df: DataFrame, table: DataFrame, key: str, value: str, default: Column, name: str) -> DataFrame:
    """df with a looked-up column; the table is first brought to one row for each key, the least value."""
    one = table.groupBy(key).agg(F.min(value).alias(name))
    return df.join(one, key, "left").withColumn(name, F.coalesce(name, default))


def last_known(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """For each key the last value in order that is not null."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, row_total, col_total, total), zero cells included; rows with a null key are left out."""
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count("*").alias("n"))
    rows, cols = base.groupBy(row).agg(F.sum("n").alias("row_total")), base.groupBy(col).agg(F.sum("n").alias("col_total"))
    total = base.agg(F.sum("n").alias("total"))
    # the table of a test has a cell for each pair of categories: this product is its result
    full = rows.crossJoin(cols).crossJoin(F.broadcast(total))
    return full.join(base, [row, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def average_rank(df: DataFrame, value: str, name: str, keys: list[str] = ()) -> DataFrame:
    """df with ranks from 1, equal values sharing their mean. Values are counted first, and only distinct values are ranked in
    ranges, so no task orders the whole table."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if keys:
        below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value)) - F.col("_n")
        ranks = counts.withColumn(name, below + (F.col("_n") + 1) / 2.0)
    else:
        ranks = running_total(counts, [F.col(value)], "_n", "_upto").withColumn(name, F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0)
    return df.join(ranks.select(*keys, value, name), [*keys, value])


def dealt(df: DataFrame, order: list[Column], name: str = "_part") -> DataFrame:
    """df with the number of its range in a total order of the whole table: ranges of about equal size, as many as there are shuffle
    partitions. The bounds are one broadcast row, looked up in two steps, so the cost follows the root of their number."""
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = math.isqrt(parts) + 1
    key = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)]) if len(order) > 1 else order[0]
    head = df.withColumn("_key", key)
    cuts = head.select("_key").repartitionByRange(parts, "_key").withColumn("_p", F.spark_partition_id()).groupBy("_p").agg(F.min("_key").alias("lo"))
    edges = cuts.agg(F.sort_array(F.collect_list("lo")).alias("_los")).withColumn("_tops", F.filter("_los", lambda x, i: i % step == 0))
    at = F.size(F.filter("_tops", lambda x: x <= F.col("_key")))
    near = F.slice("_los", (F.greatest(at, F.lit(1)) - 1) * step + 1, F.lit(step))
    found = F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + F.size(F.filter(near, lambda x: x <= F.col("_key"))))
    return head.crossJoin(F.broadcast(edges)).withColumn(name, found).drop("_los", "_tops")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the running total of a column in a total order of the whole table: rows are dealt in ranges, each range is summed
    by itself, and the sums of the ranges before it are added."""
    placed = dealt(df, order)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inner = F.sum(value).over(Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_part", "_key")


LARGE_KEY = 2_000_000


def _earlier(df: DataFrame, key: str, value: Column, order: list[str], most: int, counted: DataFrame | None = None) -> DataFrame:
    """df with _y and _n, the sum of a value and the number of earlier rows of the same key. If a key has more than `most` rows,
    rows are dealt in ranges of key and order; a range adds what ranges before it have of its first key, so no task sees a whole key.
    Rows by key are counted in `counted`, if given: a table of the same rows that is cheap to read."""
    back = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_v", value)
    if ((counted or rows).groupBy(key).count().agg(F.max("count")).head()[0] or 0) <= most:
        return rows.withColumns({"_y": F.coalesce(F.sum("_v").over(back(key)), F.lit(0)), "_n": F.count("_v").over(back(key))}).drop("_v")
    placed = dealt(rows.where(F.col(key).isNotNull()), [F.col(key), *map(F.col, order)]).drop("_key")
    sums = placed.groupBy("_part", key).agg(F.sum("_v").alias("_ys"), F.count("_v").alias("_ns"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first key of a range can have come before it, so these are no more rows than ranges
    before = sums.select("_part", key, F.sum("_ys").over(w).alias("_yb"), F.sum("_ns").over(w).alias("_nb")).where("_nb IS NOT NULL")
    out = placed.withColumns({"_y": F.sum("_v").over(back("_part", key)), "_n": F.count("_v").over(back("_part", key))}).join(F.broadcast(before), ["_part", key], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({"_y": zero("_y") + zero("_yb"), "_n": zero("_n") + zero("_nb")}).select(*df.columns, "_y", "_n")
    return out.unionByName(df.where(F.col(key).isNull()).withColumns({"_y": F.lit(0), "_n": F.lit(0)}))


def prior_rate(df: DataFrame, key: str, target: str, order: list[str], weight: float, name: str, prior: float = 0.2, strict: str | None = None, most: int = LARGE_KEY, counted: DataFrame | None = None) -> DataFrame:
    """df with the smoothed share of `target` in earlier rows of the same key; null for a null key.

    Rows of one race see each other, in the given order; with strict, the column of the race, none of them does.
    """
    if strict:
        per = df.where(F.col(key).isNotNull()).groupBy(key, strict, *[c for c in order if c != strict][:1]).agg(F.sum(target).alias("_y"), F.count("*").alias("_n"))
        w = Window.partitionBy(key).orderBy(*[c for c in order if c != strict][:1], strict).rowsBetween(Window.unboundedPreceding, -1)
        rate = (F.coalesce(F.sum("_y").over(w), F.lit(0)) + weight * prior) / (F.coalesce(F.sum("_n").over(w), F.lit(0)) + weight)
        return df.join(per.select(key, strict, rate.alias(name)), [key, strict], "left")
    rows = _earlier(df, key, F.col(target), order, most, counted)
    return rows.withColumn(name, F.when(F.col(key).isNotNull(), (F.col("_y") + weight * prior) / (F.col("_n") + weight))).drop("_y", "_n")


def prior_count(df: DataFrame, key: str, order: list[str], name: str, most: int = LARGE_KEY, counted: DataFrame | None = None) -> DataFrame:
    """df with the number of earlier rows of the same key; null for a null key."""
    return _earlier(df, key, F.lit(1), order, most, counted).withColumn(name, F.when(F.col(key).isNotNull(), F.col("_n"))).drop("_y", "_n")


def unique_suffix(df: DataFrame, candidate: str, order: str, name: str) -> DataFrame:
    """df with a unique name: rows are taken in order, and one whose candidate is in use gets the first free one of _2, _3 and so on.

    Most candidates have no other that looks like them with a suffix, and there a rank is enough. Candidates that differ only in
    numbers at their ends are gone through one after another, family by family.
    """
    rows = df.withColumns({"_root": F.regexp_replace(candidate, "(_[0-9]+)+$", ""), "_c": F.col(candidate)})
    families = rows.groupBy("_root").agg((F.min("_c") != F.max("_c")).alias("_mixed"))
    marked = rows.join(families, "_root")
    k = F.row_number().over(Window.partitionBy("_c").orderBy(order))
    plain = marked.where("NOT _mixed").withColumn(name, F.when(k > 1, F.concat_ws("_", F.col("_c"), k.cast("string"))).otherwise(F.col("_c"))).drop("_root", "_c", "_mixed")

    names = plain.columns

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        used, following, out = set(), {}, []
        rows = rows.sort_values(order)
        for c in rows["_c"]:
            at, new = following.get(c, 2), c
            while new in used:
                new, at = f"{c}_{at}", at + 1
            following[c] = at
            used.add(new)
            out.append(new)
        return rows.assign(**{name: out})[names]

    mixed = marked.where("_mixed").groupBy("_root").applyInPandas(settle, plain.schema)
    return plain.unionByName(mixed)


def purge(tables: dict[str, tuple[DataFrame, str]], bad: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each (table, column) without the rows that name a bad key."""
    return {n: df.join(bad.select(F.col(key).alias("_b")), F.col(c) == F.col("_b"), "left_anti") for n, (df, c) in tables.items()}


def merged_aliases(aliases: DataFrame, entries: DataFrame, horses: DataFrame, pedigree: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, horses, pedigree) after horses that turned out to be one: entries go to the id that stays, the rows of the old
    ids go. aliases: (old_id, id), each old_id once."""
    old = aliases.select(F.col("old_id").alias(key))
    return repoint(entries, aliases, key), horses.join(old, key, "left_anti"), pedigree.join(old, key, "left_anti")


def repoint(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """df with old ids replaced; aliases: (old_id, id)."""
    names = df.columns
    table = aliases.select(F.col("old_id").alias("_old"), F.col("id").alias("_new"))
    return df.join(table, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).select(*names)
