"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power alpha, normalised: 1 keeps the shares, 0 makes all equal. The most
levelling alpha that keeps every source under a repetition limit, or the one that meets an entropy, is found by narrowing an
interval; each step evaluates a grid of alphas in one aggregation over the sources, so sources are never collected. Each
source then spends its weight of the token budget: whole passes, and for the rest a pass over a permutation of its blocks of
documents that ends where the budget does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

GRID = 16
ROUNDS = 8


def alpha_for(sources: DataFrame, budget: int, max_repeats: float | None, entropy: float | None) -> float:
    """sources: (tokens) of each source, above 0. With max_repeats the least alpha in [0, 1] at which no source is repeated
    more often, or 1 if there is none; with entropy (nats) the alpha in [0, 1] that comes closest."""
    total = F.lit(float(sources.agg(F.sum("tokens")).head()[0] or 0))
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        share = F.col("tokens") / total
        aggs = [F.sum(F.pow(share, F.lit(a))).alias(f"z{k}") for k, a in enumerate(grid)]
        if entropy is not None:
            aggs += [F.sum(F.pow(share, F.lit(a)) * F.lit(a) * F.log(share)).alias(f"s{k}") for k, a in enumerate(grid)]
        else:
            aggs += [F.max(F.pow(share, F.lit(a)) / F.col("tokens")).alias(f"m{k}") for k, a in enumerate(grid)]
        row = sources.agg(*aggs).head()
        if row["z0"] is None:
            return 1.0
        if entropy is not None:
            ok = [_log(row[f"z{k}"]) - row[f"s{k}"] / row[f"z{k}"] <= entropy for k in range(GRID + 1)]
        else:
            ok = [budget * row[f"m{k}"] / row[f"z{k}"] <= max_repeats for k in range(GRID + 1)]
        first = next((k for k, x in enumerate(ok) if x), None)
        if first is None:
            return hi
        if first == 0:
            return lo
        lo, hi = grid[first - 1], grid[first]
    return hi


def _log(x: float) -> float:
    import math

    return math.log(x)


def _placed(docs: DataFrame, seed: str, blocks: int, id_col: str, source_col: str, *more: Column) -> DataFrame:
    """(id, key, src, h, block, *more): what a row's place in the mix follows from. key is the source, a null one as well."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key"), F.col(source_col).cast("string").alias("src"),
        F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"), *more)
    return rows.withColumn("block", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % blocks).cast("int"))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _ends(base: DataFrame, budget: float, max_repeats: float | None, entropy: float | None, seed: str) -> DataFrame:
    """Of each block (key, block) its source's weight, whole passes and the tokens that are left for a last pass, and where in
    that pass the block starts and ends."""
    in_blocks = common.stored(base.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens")))
    sources = in_blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    all_tokens = int(sources.agg(F.sum("tokens")).head()[0] or 0)
    most = int(budget * all_tokens)
    alpha = alpha_for(sources, most, max_repeats, entropy)
    power = F.pow(F.col("tokens") / F.lit(float(max(all_tokens, 1))), F.lit(alpha))
    z = float(sources.agg(F.sum(power)).head()[0] or 1.0)
    plan = sources.select("key", "tokens", (power / F.lit(z)).alias("weight"))
    plan = plan.withColumn("own", F.floor(F.col("weight") * F.lit(most) + F.lit(1e-6)).cast("long")).select("key", "weight", F.expr("own DIV tokens").alias("passes"), F.expr("own % tokens").alias("rest"))
    place = F.md5(F.concat_ws("/", F.lit(seed), "key", F.col("block").cast("string")))
    order = Window.partitionBy("key").orderBy(place, "block")  # at most `blocks` rows of each source
    return in_blocks.withColumn("upto", F.sum("tokens").over(order)).join(plan, "key", "left").select(
        "key", "block", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1)).alias("passes"), F.coalesce("rest", F.lit(0)).alias("rest"), F.col("upto"), (F.col("upto") - F.col("tokens")).alias("before"))


CUT = "before < rest AND rest < upto"  # the block in which the budget ends


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of cut blocks with `extra`, whether the last pass takes them. A block goes by h: first by its leading digits, and row
    by row where these end, which are the second rows returned."""
    cells = rows.where(CUT).withColumn("cell", F.substring("h", 1, 4))
    sums = cells.groupBy("key", "block", "cell").agg(F.sum("n_tokens").alias("own"))
    sums = sums.withColumn("from", F.sum("own").over(Window.partitionBy("key", "block").orderBy("cell")) - F.col("own"))
    placed = cells.join(sums, ["key", "block", "cell"]).withColumn("from", F.col("before") + F.col("from"))
    split = (F.col("from") <= F.col("rest")) & (F.col("rest") < F.col("from") + F.col("own"))
    within = Window.partitionBy("key", "block", "cell").orderBy("h", "id", "digest")
    even = placed.where(~split).withColumn("extra", (F.col("from") + F.col("own") <= F.col("rest")).cast("int"))
    odd = placed.where(split).withColumn("extra", (F.col("from") + F.sum("n_tokens").over(within) <= F.col("rest")).cast("int"))
    return even, odd


def _counted(docs: DataFrame, seed: str, blocks: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    n_tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens")
    return common.stored(_placed(docs, seed, blocks, id_col, source_col, n_tokens, _digest(F.col(text_col)).alias("digest")))


def mix(docs: DataFrame, budget: float = 1.0, max_repeats: float | None = 1.25, entropy: float | None = None, seed: str = "mix", blocks: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, source, n_tokens, weight (of its source), and copies (how often the mix takes it).

    budget: tokens of the mix, as a multiple of all tokens. Tokens are words, runs of other characters than white space. A null
    text counts as empty; rows without tokens cost nothing, take part in each whole pass and in the blocks they fall into. A
    null source is a source of its own. A source's budget is rounded down to a whole token. Equal ids are ordered by text. An
    empty table gives no rows. blocks: of each source, permuted by a hash of seed and number; of the block in which the budget
    ends only one in 65,536 parts, by the leading digits of a hash of the id, is sorted by document.
    """
    base = _counted(docs, seed, blocks, id_col, text_col, source_col)
    rows = base.join(_ends(base, budget, max_repeats, entropy, seed), ["key", "block"])
    whole = rows.where(f"NOT ({CUT})").withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int"))
    even, odd = _cut(rows)
    part = even.unionByName(odd).select(*whole.columns)
    return whole.unionByName(part).select(F.col("id").alias(id_col), F.col("src").alias("source"), "n_tokens", F.round("weight", 9).alias("weight"), (F.col("passes") + F.col("extra")).cast("long").alias("copies"))


def mixed(docs: DataFrame, budget: float = 1.0, max_repeats: float | None = 1.25, entropy: float | None = None, seed: str = "mix", blocks: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, whatever these are called, each as often as mix() takes it.

    Rows stay where they are: whether the last pass takes one follows from its block, in a cut block from whether its part comes
    before the one in which the budget ends, and only in that part from a table of documents. These tables are broadcast where
    they are small, as they are unless there are very many sources."""
    base = _counted(docs, seed, blocks, id_col, text_col, source_col)
    ends = common.stored(_ends(base, budget, max_repeats, entropy, seed))
    _, odd = _cut(base.join(ends, ["key", "block"]))
    odd = common.stored(odd.select("key", "block", "cell", "id", "digest", "extra").distinct())  # equal rows have equal sums
    splits = odd.select("key", "block", F.col("cell").alias("split")).distinct()
    ends = common.stored(ends.join(splits, ["key", "block"], "left").select("key", "block", "passes", "split", F.when(F.expr(CUT), F.lit(None)).otherwise(F.col("upto") <= F.col("rest")).cast("int").alias("last")))
    cell = F.substring("h", 1, 4)
    rows = _placed(docs, seed, blocks, id_col, source_col, F.struct("*").alias("row")).join(common.small(ends), ["key", "block"])
    rows = rows.withColumn("digest", F.when(cell == F.col("split"), _digest(F.col("row").getField(text_col))))
    exact = odd.select(F.col("key").alias("k"), F.col("id").alias("i"), F.col("digest").alias("d"), "extra")
    rows = rows.join(common.small(exact), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    copies = F.col("passes") + F.coalesce("last", "extra", (cell < F.col("split")).cast("int"))
    return rows.withColumn("n", copies.cast("long")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE b AS (
  SELECT doc_id AS id, source AS src, COALESCE('=' || source, '') AS key, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         md5('mix/' || doc_id) AS h, md5(COALESCE(text, '')) AS digest FROM documents),
d AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INTEGER AS block FROM b),
k AS (SELECT key, block, SUM(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
s AS (SELECT key, SUM(tokens)::BIGINT AS tokens FROM k GROUP BY key HAVING SUM(tokens) > 0),
t AS (SELECT SUM(tokens)::DOUBLE AS total FROM s),
bisect(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT FLOOR(MAX(total)) * MAX(pow(tokens / total, (lo + hi) / 2) / tokens) / SUM(pow(tokens / total, (lo + hi) / 2)) <= 1.25 FROM s, t) AS ok
        FROM bisect WHERE step < 32)),
a AS (SELECT CASE WHEN (SELECT FLOOR(MAX(total)) * MAX(1.0 / tokens) / COUNT(*) <= 1.25 FROM s, t) THEN 0.0 ELSE hi END AS alpha FROM bisect WHERE step = 32),
w AS (SELECT key, tokens, pow(tokens / total, alpha) / SUM(pow(tokens / total, alpha)) OVER () AS weight, total FROM s, t, a),
p AS (SELECT key, tokens, weight, FLOOR(weight * FLOOR(total) + 1e-6)::BIGINT AS own FROM w),
e AS (SELECT k.key, k.block, COALESCE(weight, 0) AS weight, COALESCE(own // p.tokens, 1) AS passes, COALESCE(own % p.tokens, 0) AS rest,
             SUM(k.tokens) OVER (PARTITION BY k.key ORDER BY md5('mix/' || k.key || '/' || block), block) AS upto, k.tokens AS size
      FROM k LEFT JOIN p USING (key)),
r AS (SELECT d.*, weight, passes, rest, upto, size, SUM(n_tokens) OVER (PARTITION BY d.key, d.block ORDER BY h, id, digest) AS inside FROM d JOIN e USING (key, block))
SELECT id AS doc_id, src AS source, n_tokens, ROUND(weight, 9) AS weight,
       (passes + CASE WHEN upto <= rest OR (upto - size < rest AND upto - size + inside <= rest) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
"""
