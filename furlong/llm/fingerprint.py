"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences, in SQL functions alone.

A text is cut at blank lines into sections, these at line ends into paragraphs, and these after ". " into sentences, the
leaves. A node's hash is the SHA-256 of its children's hashes, so equal roots mean equal texts (up to SHA-256), and going
down where hashes differ finds the edited sentences. A fingerprint is the root followed by the leading digits of each leaf's
hash, in the tree's order: `;` between sections, `/` between paragraphs, `,` between sentences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIGITS = 12


def _tree(text: Column) -> Column:
    """Leaf hashes as array<array<array<string>>>."""
    leaf = lambda s: F.sha2(s, 256)
    return F.transform(F.split(text, "\n\n"), lambda section: F.transform(F.split(section, "\n"), lambda par: F.transform(F.split(par, r"\. "), leaf)))


def _root(tree: Column) -> Column:
    par = lambda p: F.sha2(F.array_join(p, ","), 256)
    section = lambda s: F.sha2(F.array_join(F.transform(s, par), "/"), 256)
    return F.sha2(F.array_join(F.transform(tree, section), ";"), 256)


def _print(tree: Column) -> Column:
    short = lambda p: F.array_join(F.transform(p, lambda h: F.substring(h, 1, DIGITS)), ",")
    return F.concat(_root(tree), F.lit(":"), F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, short), "/")), ";"))


def fingerprint(text: Column) -> Column:
    """Null counts as empty."""
    return _print(_tree(F.coalesce(text, F.lit(""))))


def leaves(fp: Column) -> Column:
    """The leaf hashes of a fingerprint, in order."""
    return F.split(F.substring(fp, 66, 1 << 30), "[,/;]")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints' sets of leaves: 1 for equal texts, 0 without a shared sentence."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def differing(a: Column, b: Column) -> Column:
    """Places, from 0, of the leaves of fingerprint a that differ from those of b at the same place; empty for equal roots."""
    x, y = leaves(a), leaves(b)
    found = F.filter(F.transform(x, lambda h, i: F.when(F.get(y, i).eqNullSafe(h), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    return F.when(a == b, F.array().cast("array<int>")).otherwise(found)


def _range_of(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most x, looked up in two steps, so the cost follows the root of their number."""
    if not cuts:
        return F.lit(0)
    size = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    at = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda c: c <= x))
    within = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), at - 1)
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * size + F.size(F.filter(within, lambda c: c <= x)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text): each row with the text of the next in order of id and text, the last with the first's.

    Rows are dealt into ranges of ids of about equal count, so texts are shuffled once and no task sees all of them; the last
    row of a range takes the first of the next range from a table with one row for each range.
    """
    spark = docs.sparkSession
    base = common.texts(docs, id_col, text_col)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = base.select(F.percentile_approx("id", [k / parts for k in range(1, parts)], 20 * parts)).head()[0] or []
    # null ids come first
    dealt = base.withColumn("part", F.when(F.col("id").isNull(), F.lit(0)).otherwise(_range_of(F.col("id"), sorted(set(cuts)))))
    order = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "text")
    heads = dealt.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("at"))).alias("least"))
    heads = heads.select(F.col("part").alias("head_part"), F.when(F.col("least.known"), F.col("least.at")).alias("head_id"))
    first = dealt.join(F.broadcast(heads), (F.col("part") == F.col("head_part")) & F.col("id").eqNullSafe(F.col("head_id"))).groupBy("part").agg(F.min("text").alias("head"))
    # texts of heads are joined by shuffle, not broadcast: each range gets that of the next one, the last that of the first
    places = heads.select(F.col("head_part").alias("part"))
    around = Window.orderBy("part")  # one number for each range
    turn = places.select("part", F.coalesce(F.lead("part").over(around), F.first("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("from"))
    after = first.select(F.col("part").alias("from"), F.col("head").alias("after")).hint("merge").join(F.broadcast(turn), "from").select("part", "after")
    led = dealt.withColumn("within", F.lead("text").over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    return led.join(after.hint("merge"), "part").select("id", "text", F.when(F.col("last"), F.col("after")).otherwise(F.col("within")).alias("next_text"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as many code points from the start of the next row's text (or all, if
    that is shorter); rows are ordered by id, then text, null ids first, and the first follows the last. A null text counts as
    empty. A table of one row is its own next; an empty table gives no rows. Other columns are not read.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = with_next(docs, id_col, text_col).select("id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"))
    printed = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"))
    return printed.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(common.read(spark, sf_dir, "documents"))


_SQL_TREE = "list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda x: sha256(x))))"
_SQL_PRINT = """sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ','))), '/'))), ';')) || ':' ||
array_to_string(list_transform({0}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda h: substr(h, 1, 12)), ',')), '/')), ';')"""
_SQL_LIKE = "CASE WHEN {0} = {1} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}_s, {1}_s)) / (len({0}_s) + len({1}_s)) END"
SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, COALESCE(LEAD(text) OVER (ORDER BY doc_id, text), FIRST_VALUE(text) OVER (ORDER BY doc_id, text)) AS next_text, length(text)::BIGINT AS n_chars FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) AS edited FROM n),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_SQL_TREE.format("text")} AS a, {_SQL_TREE.format("edited")} AS b, {_SQL_TREE.format("next_text")} AS c FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {_SQL_PRINT.format("a")} AS fa, {_SQL_PRINT.format("b")} AS fb, {_SQL_PRINT.format("c")} AS fc FROM t),
s AS (SELECT *, list_distinct(regexp_split_to_array(substr(fa, 66), '[,/;]')) AS fa_s, list_distinct(regexp_split_to_array(substr(fb, 66), '[,/;]')) AS fb_s,
             list_distinct(regexp_split_to_array(substr(fc, 66), '[,/;]')) AS fc_s FROM f)
SELECT doc_id, n_chars, edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, {_SQL_LIKE.format("fa", "fb")} AS near_edited, {_SQL_LIKE.format("fa", "fc")} AS near_next FROM s
"""
