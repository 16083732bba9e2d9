"""Exact dedup by a log-structured merge index.

Memtables hold the texts of one task until they reach a byte limit; a text whose digest is already there is compared byte by
byte and joins that entry. A full memtable flushes as a run sorted by digest, in which a text stands once however often it
came, so a text that fills a third of all rows costs one entry per run. Compaction merges the runs by digest and keeps the
identifier asked for (the smallest or the largest). Of digests that are in several runs, one text of each run
passes a bit filter over the texts; what passes is compared byte by byte across runs. Texts that share a digest but not their bytes are told apart
by a grouping on the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Digests of so many runs are joined by broadcast, at 100 bytes each.
WIDE = 10_000
ENTRY = "digest string, sha string, run long, variant int, ids array<bigint>, best long, n long"


def _runs(memtable_bytes: int, keep_max: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = pa.schema([("digest", pa.string()), ("sha", pa.string()), ("run", pa.int64()), ("variant", pa.int32()), ("ids", pa.list_(pa.int64())), ("best", pa.int64()), ("n", pa.int64())])
    choose = max if keep_max else min

    def flush(table: dict, run: int) -> Iterator[pa.RecordBatch]:
        rows = [(d, sha, run, v, ids) for d in sorted(table) for v, (_, sha, ids) in enumerate(table[d])]
        for at in range(0, len(rows), 4096):
            d, sha, r, v, ids = zip(*rows[at : at + 4096])
            best = [choose((i for i in x if i is not None), default=None) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((d, sha, r, v, ids, best, [len(x) for x in ids]), types.types)], schema=types)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, table, held = TaskContext.get().partitionId() << 24, 0, {}, 0
        for ids, texts, digests, shas in common.rows_of(batches, "id", "text", "digest", "sha"):
            for i, text, d, sha in zip(ids, texts, digests, shas):
                for entry in table.setdefault(d, []):
                    if entry[0] == text:
                        entry[2].append(i)
                        held += 8
                        break
                else:
                    table[d].append((text, sha, [i]))
                    held += len(text) + 400
            if held >= memtable_bytes:
                yield from flush(table, base + seq)
                seq, table, held = seq + 1, {}, 0
        yield from flush(table, base + seq)

    return build


def _compacted(entries: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries whose digest is in one run, the others with what `several` says of their digest). Entries carry the ids of their
    copies, so those that the filter lets by are never shuffled; nor are those of the WIDE digests of the most runs, to which
    the result is broadcast. Any other digest has at most one of WIDE parts of all entries, and goes to one task."""
    alone, near = common.split(entries, "digest", common.bit_filter(several, "digest"))
    wide = common.stored(several.orderBy(F.desc("entries"), "digest").limit(WIDE))
    hot = near.join(F.broadcast(wide), "digest")
    cold = near.join(F.broadcast(wide.select("digest")), "digest", "left_anti").join(several, "digest", "left")
    own = {"entries": F.lit(1), "variants": F.lit(0), "keep_id": F.col("best"), "first_run": F.col("run"), "group_size": F.col("n")}
    missed = F.col("entries").isNull()  # the filter let it pass, but no other run has the digest
    cold = cold.select(*entries.columns, *[F.when(missed, v).otherwise(F.col(c)).alias(c) for c, v in own.items()])
    columns = ["digest", "sha", "run", "ids", "keep_id", "first_run", "group_size"]
    met = common.stored(hot.unionByName(cold).select(*columns, "entries", "variants"))
    return alone.withColumns({c: own[c] for c in columns[4:]}).select(*columns), met


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", memtable_bytes: int = 24 << 20, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, so it equals an empty one. Of rows that repeat the kept id with the same text exactly one is
    kept. A null id never wins over another; a group of null ids alone has keep_id null and one kept row. An empty table gives
    no rows. Other columns are not read. keep: "max" or "min" id. digest: a column's index key, SHA-256 unless a test weakens it.
    """
    base = common.texts(docs, id_col, text_col)
    sha = F.sha2("text", 256)
    key = digest(F.col("text")) if digest else sha
    keep_max = keep == "max"
    entries = common.stored(base.select("id", "text", key.alias("digest"), sha.alias("sha")).mapInArrow(_runs(memtable_bytes, keep_max), ENTRY))
    best, best_run = (F.max, F.max_by) if keep_max else (F.min, F.min_by)
    merged = entries.groupBy("digest").agg(
        F.count("*").alias("entries"), F.max("variant").alias("variants"), best("best").alias("keep_id"),
        F.coalesce(best_run("run", "best"), F.min("run")).alias("first_run"), F.sum("n").alias("group_size"))
    several = common.stored(merged.where("entries > 1 OR variants > 0"))
    alone, met = _compacted(entries, several)
    # one text of each run is enough: inside a run the memtable has compared all of them; only these texts are shuffled
    mark = lambda d, i: F.concat_ws(":", d, i.cast("string"))
    firsts = met.where("entries > 1 AND variants = 0").select(mark(F.col("digest"), F.col("ids")[0]).alias("mark"))
    marked = base.select("text", key.alias("digest"), mark(key, F.col("id")).alias("mark"))
    sides = common.passing(marked, "mark", common.bit_filter(firsts, "mark")).join(firsts, "mark", "left_semi")
    differ = sides.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where(F.col("lo") != F.col("hi")).select("digest")
    clash = common.stored(several.where("variants > 0").select("digest").union(differ))
    if not clash.isEmpty():
        met = met.join(clash, "digest", "left_anti")
    whole = alone.unionByName(met.select(*alone.columns))
    at = F.when(F.col("keep_id").isNull(), F.lit(0)).otherwise(F.array_position("ids", F.col("keep_id")) - 1)
    rows = whole.select("keep_id", "group_size", "sha", "run", "first_run", at.alias("at"), F.posexplode("ids").alias("pos", "id")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("run") == F.col("first_run")) & (F.col("pos") == F.col("at"))).alias("kept"), F.col("sha").alias("text_sha256"))
    if clash.isEmpty():
        return rows
    odd = base.select("id", "text", key.alias("digest"), sha.alias("sha")).join(clash, "digest", "left_semi")
    groups = odd.groupBy("text").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    order = Window.partitionBy("text", "id").orderBy("sha")
    told = odd.withColumn("nth", F.row_number().over(order)).join(groups, "text").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    return rows.unionByName(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, doc_id = MAX(doc_id) OVER g AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY COALESCE(text, ''))
"""
