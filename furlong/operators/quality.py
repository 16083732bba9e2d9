"""Audit, repair and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import filled, is_blank
from .relational import last_known, orphans, purge

ISSUE = ["severity", "code", "n"]


def _issue(df: DataFrame, severity: str, code: str, always: bool = False) -> DataFrame:
    n = df.agg(F.count("*").alias("n")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "n")
    return n if always else n.where("n > 0")


def empty_table(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("CRITICAL").alias("severity"), F.lit(f"empty_{name}").alias("code"), "n")


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, code: str) -> DataFrame:
    return _issue(orphans(child.where(F.col(child_key).isNotNull()), parent, child_key, parent_key), "ERROR", code)


def blank_fields(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """One pass over all columns."""
    counts = df.agg(*[F.count(F.when(is_blank(F.col(c)), 1)).alias(c) for c in cols])
    return counts.unpivot([], cols, "field", "n").where("n > 0").select(F.lit("ERROR").alias("severity"), F.concat(F.lit(f"blank_{name}_"), F.col("field")).alias("code"), "n")


def few_races(races: DataFrame, year: str, least: int = 10) -> DataFrame:
    return _issue(races.groupBy(year).count().where(F.col("count") < least), "WARNING", "year_with_few_races")


def few_runners(races: DataFrame, entries: DataFrame, race: str, least: int = 5) -> DataFrame:
    sizes = races.select(race).join(entries.groupBy(race).agg(F.count("*").alias("size")), race, "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return _issue(sizes.where("size = 0"), "ERROR", "race_without_entries").unionByName(_issue(sizes.where((F.col("size") > 0) & (F.col("size") < least)), "WARNING", "race_with_few_entries"))


def duplicates(df: DataFrame, key: str, code: str) -> DataFrame:
    return _issue(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1"), "ERROR", code)


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, filled, total, pct, status) of each column; status good over 80, fair over 50, else poor."""
    text = {n for n, t in df.dtypes if t == "string"}
    wide = df.agg(F.count("*").alias("_t"), *[F.count(F.when(filled(F.col(c), c in text), 1)).alias(c) for c in cols])
    long = wide.unpivot(["_t"], cols, "field", "filled")
    pct = F.coalesce(F.try_divide(100.0 * F.col("filled"), F.col("_t")), F.lit(0.0))
    return long.select("field", "filled", F.col("_t").alias("total"), pct.alias("pct"), F.when(pct > 80, "good").when(pct > 50, "fair").otherwise("poor").alias("status"))


def audit(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def verdict(issues: DataFrame) -> DataFrame:
    """One row: passed, errors; passed without ERROR and CRITICAL."""
    return issues.agg(F.count(F.when(F.col("severity").isin("ERROR", "CRITICAL"), 1)).alias("errors")).select((F.col("errors") == 0).alias("passed"), "errors")


def realigned(df: DataFrame, shifted, moves: dict[str, str]) -> DataFrame:
    """Rows for which the condition holds take each column from another; all moves see the row as it was."""
    cond = F.coalesce(shifted, F.lit(False))
    return df.select(*[F.when(cond, F.col(moves[c])).otherwise(F.col(c)).alias(c) if c in moves else F.col(c) for c in df.columns])


def synchronised(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """name from the table of names by key, where it has one."""
    cols = df.columns
    one = names.groupBy(key).agg(F.min(name).alias("_n"))
    return df.join(one, key, "left").withColumn(name, F.coalesce("_n", name)).select(*cols)


def imputed(races: DataFrame, by: str, fields: dict[str, object], order: list[str], manual: DataFrame | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """Blank fields from the last race of the same canonical name that has them, else from the manual table, else a default.

    First pass: what each name is known to be, by its races' values or, where a race has none, by told, expressions for what its
    own name says; second pass: fill. So a later race of the same name can overrule what a race's own name says.
    """
    out = races
    for f, default in fields.items():
        col = F.nullif(F.col(f).cast("string"), F.lit(""))
        value = F.coalesce(col, F.nullif(told[f], F.lit(""))) if told and f in told else col
        known = last_known(races.withColumn("_v", value), by, "_v", order)
        out = out.join(known, by, "left")
        spare = F.lit(None).cast("string")
        if manual is not None and f in manual.columns:
            out = out.join(manual.groupBy(by).agg(F.min(f).cast("string").alias("_m")), by, "left")
            spare = F.col("_m")
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), "_v", spare, F.lit(str(default))).cast(dict(races.dtypes)[f])).select(*races.columns)
    return out


# Names that are no horses, and what is known of races by name
GARBAGE = ["6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "02-07", "02-11", "馬単", "ワイド", "３連複"]
KNOWN_GRADE = {
    "G1": ["ジャパンCダート", "マイルCS南部杯", "JBCクラシック", "JBCスプリント", "JBCレディスクラシック"],
    "G3": ["クリスタルC", "ガーネットS", "カブトヤマ記念", "ラジオたんぱ賞", "ラジオたんぱ杯2歳S", "ラジオNIKKEI杯2歳S", "東京オータムジャンプ", "いちょうS", "朝日チャレンジC"],
}
KNOWN_SURFACE = {
    "Turf": ["クリスタルC", "ラジオたんぱ賞", "カブトヤマ記念", "ラジオたんぱ杯2歳S", "ラジオNIKKEI杯2歳S", "いちょうS", "朝日チャレンジC"],
    "Dirt": [
        "マーチS", "JBCクラシック", "シリウスS", "マイルCS南部杯", "ユニコーンS", "ガーネットS", "JBCレディスクラシック", "武蔵野S", "平安S", "根岸S", "みやこS", "プロキオンS", "ジャパンCダート", "JBCスプリント", "東海S",
        "レパードS", "チャンピオンズC", "エルムS", "アンタレスS", "フェブラリーS", "カペラS",
    ],
}
KNOWN_DISTANCE = {1200: ["クリスタルC", "ガーネットS"], 1800: ["ラジオたんぱ賞", "カブトヤマ記念"], 2000: ["ラジオたんぱ杯2歳S", "ラジオNIKKEI杯2歳S"]}
JUMPS = ["ジャンプ", "大障害"]


def known_races(spark: SparkSession) -> DataFrame:
    """(canonical, grade, surface, distance) of races known by name."""
    rows: dict[str, list] = {}
    for k, table in enumerate((KNOWN_GRADE, KNOWN_SURFACE, KNOWN_DISTANCE)):
        for value, names in table.items():
            for n in names:
                rows.setdefault(n, [None, None, None])[k] = str(value)
    return spark.createDataFrame([(n, *v) for n, v in rows.items()], "canonical string, grade string, surface string, distance string")


def completed_races(races: DataFrame, order: list[str], name: str = "race_name") -> DataFrame:
    """races with grade, surface and distance (texts; null and '' are blank) filled, grade_weight by grade, and date as M/D.

    What a race's own name says (a grade, or that it is over jumps) counts for all races of its canonical name, of which the last
    in order has the say; then come the races known by name, then G3, Turf and 2000. order must be total.
    """
    names = races.columns
    rows = races.withColumns({"canonical": S.canonical_race(F.col(name)), "_raw": S.nfkc(F.coalesce(F.col(name), F.lit("")))})
    over_jumps = F.when(F.col("canonical").contains(JUMPS[0]) | F.col("canonical").contains(JUMPS[1]), "Obstacle")
    told = {"grade": S.roman_grade(F.col("_raw")), "surface": over_jumps}
    out = imputed(rows, "canonical", {"grade": "G3", "surface": "Turf", "distance": "2000"}, order, known_races(races.sparkSession), told)
    return out.withColumns({"grade_weight": S.grade_weight(F.col("grade")), "date": S.race_day(F.coalesce("date", F.lit("")))}).select(*names, *[c for c in ("grade_weight", "date") if c not in names])


def purged(tables: dict[str, tuple[DataFrame, str, str]], horses: str = "horses") -> dict[str, DataFrame]:
    """Each (table, name column, id column) without rows of names that are no horses, or of the ids that such names have in the
    table of horses; what these names are is a fixed list."""
    df, name, key = tables[horses]
    bad = df.where(F.col(name).isin(*GARBAGE) & F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("bad"))
    bad = bad.unionByName(df.sparkSession.createDataFrame([(g,) for g in GARBAGE], "bad string")).distinct()
    clean = purge({n: (t.where(~F.coalesce(F.col(c).isin(*GARBAGE), F.lit(False))), k) for n, (t, c, k) in tables.items()}, bad, "bad")
    return clean


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def realigned_rows(entries: DataFrame) -> DataFrame:
    """Entries (all columns text but age, int) whose cells slipped: age is missing and sex holds sex and age.

    Jockey, time and trainer come from the cells that hold them, or all from one cell where they were run together; body mass
    and its change are put together again, and the carried weight gets its unit.
    """
    shifted = F.col("age").isNull() & F.col("sex").rlike("^[牡牝せセ].*[0-9]")
    sex, age = S.sex_age(F.col("sex"))
    one = S.split_row(_text("finish_time"))
    run_on = one["jockey"].isNotNull()
    trainer = F.when(_text("odds").rlike(r"^\d+(\.\d+)?$"), "").otherwise(_text("odds"))
    new = {
        "finish_time": F.when(run_on, one["finish_time"]).otherwise(_text("margin")),
        "jockey": F.when(run_on, one["jockey"]).otherwise(_text("finish_time")),
        "trainer": F.when(run_on, one["trainer"]).otherwise(trainer),
        "weight": S.with_kg(_text("weight")),
        "odds": F.when(run_on, one["rank"].cast("double").cast("string")),
        "horse_weight": F.when(run_on, F.concat(one["mass"], F.lit("("), one["change"], F.lit(")"))).otherwise(S.rebuilt_mass(_text("horse_weight"), _text("trainer"))),
        "age": age, "sex": F.coalesce(sex, _text("sex")), "margin": F.when(run_on, one["margin"]).otherwise(""),
    }
    return _where(entries, shifted, new)


def realigned_race(entries: DataFrame, race_id: str) -> DataFrame:
    """Entries of one race whose cells slipped by one: age is missing, the weight's cell has it, and the mass stands behind the margin."""
    shifted = F.col("age").isNull() & (F.col("race_id") == race_id)
    form = r"^(.*?)\((\d+Kg)\)$"
    both, change = _text("horse_weight").rlike(form), _text("trainer")
    mass = F.regexp_extract(_text("horse_weight"), form, 2)
    new = {
        "finish_time": _text("margin"), "jockey": _text("finish_time"), "trainer": _text("odds"), "weight": _text("jockey"), "odds": F.lit(None).cast("string"),
        "horse_weight": F.when(~both, _text("horse_weight")).when(change == "", mass).otherwise(F.concat(mass, F.lit("("), change, F.lit(")"))),
        "age": F.col("weight").try_cast("double").cast("int"), "margin": F.when(both, F.trim(F.regexp_extract(_text("horse_weight"), form, 1))).otherwise(""),
    }
    return _where(entries, shifted, new)


def _where(df: DataFrame, cond: Column, new: dict[str, Column]) -> DataFrame:
    """df whose rows under the condition take new values, all made from the row as it was."""
    cond = F.coalesce(cond, F.lit(False))
    return df.select(*[F.when(cond, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def standardised_horses(horses: DataFrame) -> DataFrame:
    """sex without age and in one spelling, birth_date without age, birth_year from the date where it is missing or 0."""
    date, year = S.birth(F.coalesce("birth_date", F.lit("")))
    return horses.withColumns({"sex": S.plain_sex(F.coalesce("sex", F.lit(""))), "birth_date": date, "birth_year": F.coalesce(F.nullif(F.col("birth_year"), F.lit(0)), year)}).select(*horses.columns)
