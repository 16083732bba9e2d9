"""Translation by dictionaries: small literal ones as column expressions, large ones as tables that are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import SEX, country_split, has_japanese, lookup, slug, translated

# Tracks, surfaces, goings, weathers, sexes, coat colours and grades in English
TRACKS = {"東京": "Tokyo", "中山": "Nakayama", "阪神": "Hanshin", "京都": "Kyoto", "中京": "Chukyo", "小倉": "Kokura", "新潟": "Niigata", "福島": "Fukushima", "札幌": "Sapporo", "函館": "Hakodate"}
SURFACES = {"Turf": "Turf", "Dirt": "Dirt", "Obstacle": "Obstacle", "芝": "Turf", "ダート": "Dirt", "ダ": "Dirt", "障害": "Obstacle", "障": "Obstacle"}
GOINGS = {"良": "Firm", "稍重": "Good to Soft", "稍": "Good to Soft", "重": "Soft", "不良": "Heavy", "不": "Heavy"}
WEATHERS = {"晴": "Fine", "曇": "Cloudy", "雨": "Rain", "小雨": "Light Rain", "雪": "Snow"}
SEXES = {"牡": "Male", "牝": "Female", "セン": "Gelding", "セ": "Gelding", "せん": "Gelding"}
COLORS = {"鹿毛": "Bay", "黒鹿毛": "Dark Bay", "栗毛": "Chestnut", "栃栗毛": "Dark Chestnut", "青鹿毛": "Brown", "青毛": "Black", "芦毛": "Grey", "白毛": "White"}
GRADES = {"GⅠ": "G1", "GⅡ": "G2", "GⅢ": "G3", "ＧⅠ": "G1", "ＧⅡ": "G2", "ＧⅢ": "G3"}
# Names of well-known races in English
RACES = {
    "フェブラリーＳ": "February Stakes", "フェブラリーS": "February Stakes", "高松宮記念": "Takamatsunomiya Kinen", "大阪杯": "Osaka Hai", "桜花賞": "Oka Sho (Japanese 1000 Guineas)", "皐月賞": "Satsuki Sho (Japanese 2000 Guineas)",
    "天皇賞（春）": "Emperor's Cup (Spring)", "天皇賞（秋）": "Emperor's Cup (Autumn)", "ＮＨＫマイルＣ": "NHK Mile Cup", "NHKマイルC": "NHK Mile Cup", "オークス": "Yushun Himba (Japanese Oaks)", "日本ダービー": "Tokyo Yushun (Japanese Derby)",
    "安田記念": "Yasuda Kinen", "宝塚記念": "Takarazuka Kinen", "スプリンターズＳ": "Sprinters Stakes", "スプリンターズS": "Sprinters Stakes", "秋華賞": "Shuka Sho", "菊花賞": "Kikuka Sho (Japanese St. Leger)",
    "エリザベス女王杯": "Queen Elizabeth II Cup", "マイルチャンピオンシップ": "Mile Championship", "ジャパンＣ": "Japan Cup", "ジャパンC": "Japan Cup", "ジャパンＣダート": "Japan Cup Dirt", "チャンピオンズＣ": "Champions Cup",
    "チャンピオンズC": "Champions Cup", "阪神ジュベナイルＦ": "Hanshin Juvenile Fillies", "朝日杯フューチュリティＳ": "Asahi Hai Futurity Stakes", "有馬記念": "Arima Kinen", "中山グランドジャンプ": "Nakayama Grand Jump", "中山大障害": "Nakayama Daishogai",
    "日経新春杯": "Nikkei Shinshun Hai", "京都記念": "Kyoto Kinen", "阪神大賞典": "Hanshin Daishoten", "産経大阪杯": "Sankei Osaka Hai", "毎日杯": "Mainichi Hai", "スプリングＳ": "Spring Stakes", "青葉賞": "Aoba Sho", "セントライト記念": "St. Lite Kinen",
    "神戸新聞杯": "Kobe Shimbun Hai", "ローズＳ": "Rose Stakes", "フローラＳ": "Flora Stakes", "中山金杯": "Nakayama Kimpai", "京都金杯": "Kyoto Kimpai", "フェアリーＳ": "Fairy Stakes", "フェアリーS": "Fairy Stakes", "シンザン記念": "Shinzan Kinen",
    "京成杯": "Keisei Hai", "愛知杯": "Aichi Hai", "小倉牝馬Ｓ": "Kokura Himba Stakes",
}


def sex(c: Column) -> Column:
    """A sex in English, with or without an age behind it; other texts stay, trimmed."""
    return lookup(F.regexp_extract(F.trim(c), f"^({SEX})\\d*$", 1), SEXES, F.trim(c))


def ungraded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"^[GＧ][ⅠⅡⅢ123]\s*", ""))


def _joined(df: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    """df with name: the value of a table (key, value) of distinct keys, joined on its rows' key."""
    return df.join(table.select(F.col("key").alias(f"_{name}"), F.col("value").alias(name)), key == F.col(f"_{name}"), "left").drop(f"_{name}")


def names(df: DataFrame, column: str, dictionary: DataFrame, romaji: DataFrame, out: str) -> DataFrame:
    """df with a name in English: its entry in the dictionary (key, value); else, if the name ends in a country, the entry of
    what stands before it with the country behind; else the name itself if it has only ASCII; else its transliteration in romaji
    (key, value), or the name. Each distinct name is looked up once, so work follows names and not rows."""
    one = df.select(F.trim(column).alias("n")).distinct().where("n IS NOT NULL")
    base, country = country_split(F.col("n"))
    one = one.withColumns({"b": F.trim(base), "c": country})
    one = _joined(_joined(_joined(one, F.col("n"), dictionary, "whole"), F.col("b"), dictionary, "part"), F.col("n"), romaji, "sound")
    with_country = F.when(F.col("c") != "", F.concat(F.trim(country_split(F.col("part"))[0]), F.lit(" "), F.col("c")))
    plain = F.when(~F.col("n").rlike(r"[^\x00-\x7F]"), F.col("n"))
    found = one.select(F.col("n"), F.coalesce("whole", with_country, plain, F.trim(F.initcap("sound")), "n").alias(out))
    return df.join(found, F.trim(column) == F.col("n"), "left").drop("n")


def race_names(df: DataFrame, column: str, dictionary: DataFrame, romaji: DataFrame, out: str) -> DataFrame:
    """df with a race's name in English: known races, with and without a grade in front; the dictionary's entries of both; else
    as names() has what stands behind the grade."""
    one = df.select(F.trim(column).alias("r")).distinct().where("r IS NOT NULL").withColumn("u", ungraded(F.col("r")))
    one = _joined(_joined(names(one, "u", dictionary, romaji, "spelt"), F.col("r"), dictionary, "whole"), F.col("u"), dictionary, "rest")
    null = F.lit(None).cast("string")
    found = one.select(F.col("r"), F.coalesce(lookup(F.col("r"), RACES, null), lookup(F.col("u"), RACES, null), "whole", "rest", "spelt").alias(out))
    return df.join(found, F.trim(column) == F.col("r"), "left").drop("r")


def race_ids(df: DataFrame, column: str, dictionary: DataFrame, romaji: DataFrame, out: str) -> DataFrame:
    """df with year_track_name in English and ASCII for an id of three parts; an id of fewer parts is taken for a name."""
    part = F.split(F.trim(column), "_", 3)
    rows = race_names(df.withColumn("_part", part).withColumn("_race", F.get("_part", F.lit(2))), "_race", dictionary, romaji, "_english")
    rows = names(rows, column, dictionary, romaji, "_plain")
    whole = F.concat_ws("_", F.get("_part", F.lit(0)), translated(F.get("_part", F.lit(1)), TRACKS), slug(F.col("_english")))
    return rows.withColumn(out, F.when(F.size("_part") == 3, whole).otherwise(F.col("_plain"))).drop("_part", "_race", "_english", "_plain")


def untranslated(columns: dict[str, list[Column]], rows: dict[str, DataFrame], known: DataFrame, garbage: list[str]) -> DataFrame:
    """(category, text): the distinct Japanese texts of each category that the dictionary known(key) lacks; a text of several
    categories stands in the first. columns: category to the columns in which to look, rows: category to its table."""
    out = None
    for rank, (category, cols) in enumerate(columns.items()):
        for c in cols:
            part = rows[category].select(F.lit(rank).alias("rank"), F.lit(category).alias("category"), F.trim(c).alias("text"))
            out = part if out is None else out.unionByName(part)
    found = out.where(has_japanese(F.col("text")) & ~F.col("text").isin(*garbage)).groupBy("text").agg(F.min(F.struct("rank", "category")).alias("x"))
    return found.join(known.select(F.col("key").alias("text")), "text", "left_anti").select("x.category", "text")
