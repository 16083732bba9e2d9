"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application; Spark's own file server carries it. Unless the session says
    otherwise, Arrow batches have at most 512 rows, so that both sides of a Python worker hold a few texts and not thousands."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH[0]) == "10000":  # Spark's own default
        spark.conf.set(*BATCH)
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parents[2]
        path = f"{tempfile.mkdtemp(prefix='furlong-')}/furlong-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((root / "furlong").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOPS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only where that is unset, as in tests, below a local one. All of an application
    are in one folder, which is deleted when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _TOPS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='furlong-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        _TOPS[app] = f"{base.rstrip('/')}/furlong-{uuid.uuid4().hex}"
        top = spark._jvm.org.apache.hadoop.fs.Path(_TOPS[app])
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(top)
        fs.deleteOnExit(top)
    return f"{_TOPS[app]}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so no other column of the input, whatever its name, can clash; null text counts as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(id_col: str | Column, n: int) -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


_HELD: dict[str, tuple] = {}


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """What make() returns, kept in this process under its owner for as long as the key is the same."""
    if _HELD.get(owner, (None,))[0] != key:
        _HELD[owner] = (key, make())
    return _HELD[owner][1]


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, owner: str = "") -> Iterator[list]:
    """Batches as lists of Python columns, at most 512 rows at once, so memory follows a few texts and not the batch. Python
    workers serve one operator after another: what others than owner have held goes first, and freed buffers go back at the end."""
    for other in set(_HELD) - {owner}:
        del _HELD[other]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
    pa.default_memory_pool().release_unused()


SMALL = 100_000


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are stored or aggregated and no more than SMALL; else as they are, for a join by shuffle."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def bounded_ids(rows: DataFrame, id_col: str, key_cols: list[str], most: int) -> DataFrame:
    """At most `most` rows of each key, those of the smallest hash of their id. The counts are aggregated first, and only the
    few rows under a key's hash threshold are shuffled and sorted, so a key that holds a third of all rows costs no more than any
    other. rows may have more columns; they are returned too."""
    counts = rows.groupBy(*key_cols).agg(F.count("*").alias("_count"))
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    near = rows.join(small(counts), key_cols).withColumn("_u", drawn).where(F.col("_u") * F.col("_count") <= 1.5 * most + 50)
    order = Window.partitionBy(*key_cols).orderBy("_u", id_col)
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select(*rows.columns)


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


class BitFilter:
    """A filter over hashed keys; false hits cost work later, never results. It has about 16 slots a key, and at most MOST_BITS
    (16 MB), which bounds what is broadcast: beyond 30 million keys ever more rows pass that have no such key."""

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, 16 * n - 1).bit_length()))
        slot = F.pmod(F.xxhash64(key), F.lit(self.bits)).cast("long")
        self.rows = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))

    def marked(self, rows: DataFrame, key: str | Column) -> DataFrame:
        """(row, key, hit): each row as a struct, so no column of it can clash, and whether its key may be in the filter."""
        key = F.col(key) if isinstance(key, str) else key
        kept = rows.select(F.struct("*").alias("row"), key.alias("key")).withColumn("s", F.pmod(F.xxhash64("key"), F.lit(self.bits)).cast("long"))
        near = kept.withColumn("b", F.bitmap_bucket_number("s")).join(F.broadcast(self.rows), "b", "left")
        byte = F.conv(F.hex(F.expr("substring(bits, CAST(bitmap_bit_position(s) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        mask = F.expr("shiftleft(1, CAST(bitmap_bit_position(s) % 8 AS INT))")
        return near.select("row", "key", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)).alias("hit"))


def bit_filter(keys: DataFrame, key: str) -> BitFilter:
    return BitFilter(keys, key)


def passing(rows: DataFrame, key: str | Column, bits: BitFilter) -> DataFrame:
    """Rows whose key may be in the filter."""
    return bits.marked(rows, key).where("hit").select("row.*")


def split(rows: DataFrame, key: str | Column, bits: BitFilter) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in the filter, rows whose key may be)."""
    marked = bits.marked(rows, key)
    return marked.where("NOT hit").select("row.*"), marked.where("hit").select("row.*")


def without(rows: DataFrame, key: str | Column, dropped: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """rows without those whose key is in dropped, a table of one column; keys that are also in kept keep one row. Rows with a
    null key stay. Only rows that the filter of dropped keys lets pass are shuffled; all others stay where they are. Columns of
    rows may have any names."""
    name = dropped.columns[0]
    marked = bit_filter(dropped, name).marked(rows, key)
    near, gone = marked.where("hit"), dropped.select(F.col(name).alias("key")).distinct()
    out = marked.where("NOT hit").select("row.*").unionByName(near.join(gone, "key", "left_anti").select("row.*"))
    if kept is not None:
        both = kept.select(F.col(kept.columns[0]).alias("key")).join(gone, "key", "left_semi").distinct()
        out = out.unionByName(near.join(both, "key", "left_semi").dropDuplicates(["key"]).select("row.*"))
    return out
