"""Queries over literal rows in the forms that pages and tables have; their SQL states the rows that must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import translation as L
from ..operators import quality as Q
from ..operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def fixture(columns: str, expected: list[tuple]):
    """Registers a query whose result must be the expected rows; columns: `name type` of each, with DuckDB's types."""
    def add(f):
        QUERIES[f.__name__] = f
        fields = [c.split() for c in columns.split(", ")]
        rows = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in expected)
        SQL[f.__name__] = "SELECT " + ", ".join(f"{n}::{t} AS {n}" for n, t in fields) + f" FROM (VALUES {rows}) v(" + ", ".join(n for n, _ in fields) + ")"
        return f

    return add


def _texts(s: SparkSession, texts: list, name: str = "x") -> DataFrame:
    return s.createDataFrame([(t,) for t in texts], f"{name} string")


@fixture("x VARCHAR, grade VARCHAR, weight DOUBLE", [
    ("第1回 GⅠ", "G1", 1.0), ("ＧⅠ桜花賞", "G1", 1.0), ("GⅡ", "G2", 0.7), ("ＧⅡ青葉賞", "G2", 0.7), ("GⅢ", "G3", 0.5), ("ＧⅢ愛知杯", "G3", 0.5), ("G2 and G1", "G1", 1.0), ("オープン", "", 0.0)])
def grades_in_names(s, d):
    rows = _texts(s, ["第1回 GⅠ", "ＧⅠ桜花賞", "GⅡ", "ＧⅡ青葉賞", "GⅢ", "ＧⅢ愛知杯", "G2 and G1", "オープン"])
    return rows.withColumn("grade", S.grade_of(F.col("x"))).withColumn("weight", S.grade_weight(F.col("grade"), 0.0))


@fixture("x VARCHAR, grade VARCHAR, canonical VARCHAR", [
    ("GⅢ愛知杯", "G3", "愛知杯"), ("ＧⅢ 愛知杯", "G3", "愛知杯"), ("新設GII 青葉賞", "G2", "青葉賞"), ("J・GI中山大障害", "G1", "中山大障害"), ("J.GⅡ x", "G2", "x"), ("JpnIII x", "G3", "x"), ("G2 x", "G2", "x"),
    ("新設重賞GIII x", "G3", "x"), ("重賞 いちょうＳ", "G3", "重賞 いちょうS"), ("GV x", None, "x"), ("gi x", None, "x"), ("ジャパンＣ", None, "ジャパンC"), ("", None, ""), (None, None, "")])
def canonical_races(s, d):
    rows = _texts(s, ["GⅢ愛知杯", "ＧⅢ 愛知杯", "新設GII 青葉賞", "J・GI中山大障害", "J.GⅡ x", "JpnIII x", "G2 x", "新設重賞GIII x", "重賞 いちょうＳ", "GV x", "gi x", "ジャパンＣ", "", None])
    return rows.select("x", S.roman_grade(S.nfkc("x")).alias("grade"), S.canonical_race(F.col("x")).alias("canonical"))


@fixture("x VARCHAR, weather VARCHAR, going VARCHAR, surface VARCHAR, distance INTEGER", [
    ("天候：晴 芝：良 芝1,600m", "Fine", "Firm", "Turf", 1600), ("天候:小雨 ダート：稍重 ダート1800", "Light Rain", "Good to Soft", "Dirt", 1800), ("天候：雨 芝：重 2000", "Rain", "Soft", "Turf", 2000),
    ("天候：雪 ダート:不良", "Snow", "Heavy", "Dirt", None), ("晴 良", "", "", "", None)])
def page_conditions(s, d):
    x = F.col("x")
    rows = _texts(s, ["天候：晴 芝：良 芝1,600m", "天候:小雨 ダート：稍重 ダート1800", "天候：雨 芝：重 2000", "天候：雪 ダート:不良", "晴 良"])
    return rows.select("x", S.weather_of(x).alias("weather"), S.going_of(x).alias("going"), S.course_of(x).alias("surface"), S.distance_of(x).alias("distance"))


@fixture("x VARCHAR, sex VARCHAR, age INTEGER, english VARCHAR", [
    ("牡4", "牡", 4, "Male"), ("牝10", "牝", 10, "Female"), ("セン5", "せん", 5, "Gelding"), ("セ6", "せん", 6, "Gelding"), ("せん7", "せん", 7, "Gelding"), (" 牡 ", "牡", None, "Male"), ("牝a3", "牝a3", None, "牝a3"), ("", "", None, ""), (None, None, None, None)])
def sexes_and_ages(s, d):
    sex, age = S.plain_sex(F.col("x")), S.sex_age(F.col("x"))[1]
    rows = _texts(s, ["牡4", "牝10", "セン5", "セ6", "せん7", " 牡 ", "牝a3", "", None])
    return rows.select("x", sex.alias("sex"), age.alias("age"), L.sex(F.col("x")).alias("english"))


@fixture("x VARCHAR, margin VARCHAR", [
    ("クビ", "Neck"), ("アタマ", "Head"), ("ハナ", "Nose"), ("大差", "Distance"), ("アタマ差", "アタマ差"), ("１／２馬身", "1/2 lengths"), ("3/4馬身", "3/4 lengths"), ("２馬身", "2 lengths"), ("１ １／４馬身", "1/4 lengths"),
    ("1 1/4 馬身", "1 1/4 lengths"), ("同着", "同着"), (None, None)])
def margins_in_english(s, d):
    return _texts(s, ["クビ", "アタマ", "ハナ", "大差", "アタマ差", "１／２馬身", "3/4馬身", "２馬身", "１ １／４馬身", "1 1/4 馬身", "同着", None]).select("x", S.margin(F.col("x")).alias("margin"))


@fixture("x VARCHAR, title VARCHAR", [
    ("DEEP IMPACT", "Deep Impact"), ("symbol li rudolph", "Symboli Rudolf"), ("MacDonald and sons", "MacDonald and Sons"), ("the king of fr", "The King of FR"), ("kitasan black iii", "Kitasan Black III"), ("e.p. taylor", "E.p. Taylor"),
    ("T.M. opera o", "T.M. Opera O"), ("shadai Ltd.", "Shadai Ltd."), ("uokka", "Vodka"), ("", ""), (None, None)])
def titles(s, d):
    return _texts(s, ["DEEP IMPACT", "symbol li rudolph", "MacDonald and sons", "the king of fr", "kitasan black iii", "e.p. taylor", "T.M. opera o", "shadai Ltd.", "uokka", "", None]).select("x", S.title(F.col("x")).alias("title"))


@fixture("x VARCHAR, date VARCHAR, year INTEGER", [("2001.02.03 25歳", "2001.02.03", 2001), ("2001.02.03", "2001.02.03", 2001), ("不明", "不明", None), ("", "", None)])
def births(s, d):
    date, year = S.birth(F.col("x"))
    return _texts(s, ["2001.02.03 25歳", "2001.02.03", "不明", ""]).select("x", date.alias("date"), year.alias("year"))


@fixture("x VARCHAR, day VARCHAR, weight DOUBLE, mass DOUBLE, yen BIGINT", [
    ("1月6日土曜", "1/6", 1.0, None, 10000), ("1/6（土）", "1/6", 1.0, None, 10000), ("56.5kg", "56.5kg", 56.5, None, 565000), ("486Kg(+2)", "486Kg", 486.0, 486.0, 4860000), ("48,153.0万円", "48,153.0万円", 48.0, None, 481530000), ("-", "-", None, None, None)])
def numbers_in_texts(s, d):
    x = F.col("x")
    rows = _texts(s, ["1月6日土曜", "1/6（土）", "56.5kg", "486Kg(+2)", "48,153.0万円", "-"])
    return rows.select("x", S.race_day(x).alias("day"), S.number(x).alias("weight"), S.body_mass(x).alias("mass"), S.man_yen(x).alias("yen"))


@fixture("x VARCHAR, base VARCHAR, country VARCHAR, japanese BOOLEAN, head VARCHAR, slug VARCHAR", [
    ("サンデーサイレンス(USA)", "サンデーサイレンス", "(USA)", True, "サンデーサイレンス(USA)", "USA"), ("Harbinger (GB)", "Harbinger", "(GB)", False, "Harbinger", "Harbinger_GB"), ("Oka Sho (Japanese)", "Oka Sho (Japanese)", "", False, "Oka Sho", "Oka_Sho_Japanese")])
def countries(s, d):
    x = F.col("x")
    base, country = S.country_split(x)
    rows = _texts(s, ["サンデーサイレンス(USA)", "Harbinger (GB)", "Oka Sho (Japanese)"])
    return rows.select("x", base.alias("base"), country.alias("country"), S.has_japanese(x).alias("japanese"), S.before_bracket(x).alias("head"), S.slug(x).alias("slug"))


def _dictionary(s):
    return s.createDataFrame([("サンデーサイレンス", "Sunday Silence(USA)"), ("ディープインパクト", "Deep Impact"), ("弥生賞", "Yayoi Sho"), ("GⅢ毎日杯X", "Mainichi X")], "key string, value string")


def _romaji(s):
    return s.createDataFrame([("武豊", "take yutaka"), ("函館記念", "hakodate kinen")], "key string, value string")


@fixture("x VARCHAR, name VARCHAR", [
    ("ディープインパクト", "Deep Impact"), ("サンデーサイレンス(USA)", "Sunday Silence (USA)"), ("サンデーサイレンス", "Sunday Silence(USA)"), ("Orfevre", "Orfevre"), ("武豊", "Take Yutaka"), ("未知", "未知"), (" 武豊 ", "Take Yutaka"), (None, None)])
def names_in_english(s, d):
    return L.names(_texts(s, ["ディープインパクト", "サンデーサイレンス(USA)", "サンデーサイレンス", "Orfevre", "武豊", "未知", " 武豊 ", None]), "x", _dictionary(s), _romaji(s), "name")


@fixture("x VARCHAR, id VARCHAR, race VARCHAR", [
    ("2002_中山_弥生賞", "2002_Nakayama_Yayoi_Sho", "2002_中山_弥生賞"), ("2003_東京_ＧⅡ青葉賞", "2003_Tokyo_Aoba_Sho", "2003_東京_ＧⅡ青葉賞"), ("2003_大井_天皇賞（春）", "2003_大井_Emperor_s_Cup_Spring", "2003_大井_天皇賞（春）"), ("武豊", "Take Yutaka", "Take Yutaka"), ("弥生賞", "Yayoi Sho", "Yayoi Sho"),
    ("GⅢ毎日杯X", "Mainichi X", "Mainichi X"), ("G1桜花賞", "G1桜花賞", "Oka Sho (Japanese 1000 Guineas)"), ("G3 函館記念", "G3 函館記念", "Hakodate Kinen"), (None, None, None)])
def races_in_english(s, d):
    rows = _texts(s, ["2002_中山_弥生賞", "2003_東京_ＧⅡ青葉賞", "2003_大井_天皇賞（春）", "武豊", "弥生賞", "GⅢ毎日杯X", "G1桜花賞", "G3 函館記念", None])
    return L.race_names(L.race_ids(rows, "x", _dictionary(s), _romaji(s), "id"), "x", _dictionary(s), _romaji(s), "race")


@fixture("x VARCHAR, track VARCHAR, surface VARCHAR, going VARCHAR, weather VARCHAR, color VARCHAR, grade VARCHAR", [
    ("中山", "Nakayama", "中山", "中山", "中山", "中山", "中山"), (" ダ ", " ダ ", "Dirt", " ダ ", " ダ ", " ダ ", " ダ "), ("不良", "不良", "不良", "Heavy", "不良", "不良", "不良"), ("小雨", "小雨", "小雨", "小雨", "Light Rain", "小雨", "小雨"), ("栃栗毛", "栃栗毛", "栃栗毛", "栃栗毛", "栃栗毛", "Dark Chestnut", "栃栗毛"), ("ＧⅢ", "ＧⅢ", "ＧⅢ", "ＧⅢ", "ＧⅢ", "ＧⅢ", "G3")])
def small_dictionaries(s, d):
    x = F.col("x")
    tables = {"track": L.TRACKS, "surface": L.SURFACES, "going": L.GOINGS, "weather": L.WEATHERS, "color": L.COLORS, "grade": L.GRADES}
    return _texts(s, ["中山", " ダ ", "不良", "小雨", "栃栗毛", "ＧⅢ"]).select("x", *[S.translated(x, t).alias(n) for n, t in tables.items()])


@fixture("category VARCHAR, text VARCHAR", [("races", "弥生賞"), ("people", "武豊"), ("horses", "ウオッカ")])
def untranslated_texts(s, d):
    races, people = _texts(s, ["弥生賞", "Derby", "馬単", None]), _texts(s, ["武豊", "弥生賞", " 武豊 "])
    horses, known = _texts(s, ["ウオッカ", "ディープインパクト", "武豊"]), _dictionary(s).where("key = 'ディープインパクト'")
    return L.untranslated({"races": [F.col("x")], "people": [F.col("x")], "horses": [F.col("x")]}, {"races": races, "people": people, "horses": horses}, known, Q.GARBAGE)


_ENTRY = "race_id string, horse_name string, finish_time string, jockey string, trainer string, weight string, odds string, horse_weight string, age int, sex string, margin string"


@fixture(_ENTRY.replace("string", "VARCHAR").replace("int", "INTEGER"), [
    ("r", "whole", "1:33.0", "武豊", "藤沢", "56.0kg", "2.0", "486Kg(+2)", 4, "牡", "クビ"), ("r", "slipped", "1:34.1", "横山", "小桧山", "57.0kg", None, "480Kg(-4)", 5, "せん", ""),
    ("r", "no change", "1:35.0", "福永", "", "55kg", None, "470Kg", 3, "牝", ""), ("r", "run on", "1:10.6", "丸山侯彦", "小桧山悟", "56.0kg", "16.0", "448Kg(+2)", 4, "牡", "クビ"),
    ("k", "one race", "1:36.2", "池添", "伊藤", "54.0", None, "468Kg(+2)", 5, "牝", "アタマ"), ("k", "bare", "1:36.4", "安藤", "松田", "55.0", None, "470", 6, "牝", "")])
def realigned_entries(s, d):
    """Rows whose cells slipped, in the three forms that occur."""
    rows = s.createDataFrame([
        ("r", "whole", "1:33.0", "武豊", "藤沢", "56.0kg", "2.0", "486Kg(+2)", 4, "牡", "クビ"), ("r", "slipped", "横山", "x", "-4", "57.0", "小桧山", "クビ(480)", None, "セン5", "1:34.1"),
        ("r", "no change", "福永", "x", None, "55kg", "3.0", "(470)", None, "牝3", "1:35.0"), ("r", "run on", "丸山侯彦1:10.6クビ448Kg+2小桧山悟16", "x", "", "56.0", "", "", None, "牡4", ""),
        ("k", "one race", "池添", "54.0", "+2", "5", "伊藤", "アタマ(468Kg)", None, "牝", "1:36.2"), ("k", "bare", "安藤", "55.0", "", "6.0", "松田", "470", None, "牝", "1:36.4")], _ENTRY)
    return Q.realigned_rows(Q.realigned_race(rows, "k"))


@fixture("race_id VARCHAR, grade VARCHAR, grade_weight DOUBLE, surface VARCHAR, distance VARCHAR, date VARCHAR", [
    ("a", "G2", 0.7, "Turf", "2400", "1/6"), ("b", "G3", 0.5, "Dirt", "2000", "2/1"), ("c", "G3", 0.5, "Obstacle", "3000", "3/2"), ("c2", "G1", 1.0, "Obstacle", "4250", ""), ("c3", "G1", 1.0, "Obstacle", "4250", ""),
    ("e", "G3", 0.5, "Turf", "1200", ""), ("f", "G3", 0.5, "Dirt", "2000", ""), ("g", "G2", 0.7, "Turf", "2400", ""), ("h", "G1", 1.0, "Dirt", "2000", ""), ("i", "G3", 0.5, "Turf", "2000", "")])
def completed_races(s, d):
    """A race's own values, then those of its name, the last race having the say, then the fixed tables, then the defaults."""
    rows = s.createDataFrame([
        ("a", 2002, "GⅡ 青葉賞", "1月6日土曜", "G2", "Turf", "2400"), ("b", 2003, "GⅢ平安Ｓ", "2/1（土）", "G3", "", ""), ("c", 2003, "東京ジャンプ", "3/2", None, "", "3000"), ("c2", 2004, "J・GI中山大障害", "", "", None, ""),
        ("c3", 2005, "中山大障害", "", None, None, "4250"), ("e", 2006, "重賞 クリスタルＣ", "", "", "Turf", "1200"), ("f", 2006, "重賞根岸Ｓ", "", "", "Dirt", None), ("g", 2007, "青葉賞", "", None, None, None),
        ("h", 2007, "ＪＢＣクラシック", "", None, None, None), ("i", 2008, "だれも知らない", None, None, "", "")], "race_id string, year int, race_name string, date string, grade string, surface string, distance string")
    return Q.completed_races(rows, ["year", "race_id"]).select("race_id", "grade", "grade_weight", "surface", "distance", "date")


@fixture("tab VARCHAR, id VARCHAR", [("horses", "h1"), ("entries", "h1"), ("entries", None), ("tree", "h1")])
def purged_names(s, d):
    """Names that are no horses, and the rows of their ids."""
    make = lambda rows: s.createDataFrame(rows, "name string, id string")
    tables = {"horses": make([("Orfevre", "h1"), ("馬単", "x1"), ("6", "")]), "entries": make([("Orfevre", "h1"), ("other", "x1"), ("ワイド", "h1"), ("nameless", None), ("by id", "02-07")]), "tree": make([("Orfevre", "h1"), (None, "x1")])}
    clean, out = Q.purged({n: (t, "name", "id") for n, t in tables.items()}), None
    for n, t in clean.items():
        part = t.select(F.lit(n).alias("tab"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@fixture("horse_id VARCHAR, sex VARCHAR, birth_date VARCHAR, birth_year INTEGER", [("1", "牡", "2001.02.03", 2001), ("2", "せん", "2002.01.01", 1999), ("3", "", "", None), ("4", "Male", "不明", None)])
def standardised_horses(s, d):
    rows = [("1", "牡4", "2001.02.03 25歳", None), ("2", "セン", "2002.01.01", 1999), ("3", None, None, 0), ("4", "Male", "不明", None)]
    return Q.standardised_horses(s.createDataFrame(rows, "horse_id string, sex string, birth_date string, birth_year int"))


@fixture("k INTEGER, name VARCHAR", [(1, "a"), (2, "a_2"), (3, "a_2_2"), (4, "a_2_3"), (5, "b"), (6, "a_3"), (7, "b_2")])
def unique_ids(s, d):
    """Names in use, whether given or made, are passed over in the order of rows."""
    return R.unique_suffix(s.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a_2"), (5, "b"), (6, "a"), (7, "b")], "k int, c string"), "c", "k", "name").select("k", "name")


@fixture("tab VARCHAR, id VARCHAR, name VARCHAR", [("entries", "h1", "a"), ("entries", "h1", "b"), ("entries", "h3", "c"), ("horses", "h1", "a"), ("horses", "h3", "c"), ("pedigree", "h1", "a")])
def merged_aliases(s, d):
    make = lambda *rows: s.createDataFrame(rows, "id string, name string")
    aliases = s.createDataFrame([("h2", "h1")], "old_id string, id string")
    out = None
    for n, t in zip(("entries", "horses", "pedigree"), R.merged_aliases(aliases, make(("h1", "a"), ("h2", "b"), ("h3", "c")), make(("h1", "a"), ("h2", "b"), ("h3", "c")), make(("h1", "a"), ("h2", "b")), "id")):
        part = t.select(F.lit(n).alias("tab"), "id", "name")
        out = part if out is None else out.unionByName(part)
    return out


@fixture("horse_id VARCHAR, horse_name VARCHAR", [("h1", "New"), ("h2", "Kept"), ("h9", "Unknown"), (None, "No id")])
def synchronised_names(s, d):
    """Names that no horse has are set to those of their ids."""
    rows = s.createDataFrame([("h1", "Old"), ("h2", "Kept"), ("h9", "Unknown"), (None, "No id")], "horse_id string, horse_name string")
    names = s.createDataFrame([("h1", "New"), ("h2", "Kept")], "horse_id string, name string").withColumnRenamed("name", "horse_name")
    return Q.synchronised(rows, names, "horse_id", "horse_name")


@fixture("k INTEGER, v VARCHAR", [(1, "late"), (2, "old"), (3, "new")])
def upserted_rows(s, d):
    """Of new rows with one key the last in order replaces the old one."""
    old = s.createDataFrame([(1, "old", 0), (2, "old", 0)], "k int, v string, at int")
    new = s.createDataFrame([(1, "late", 9), (1, "early", 1), (3, "new", 1)], "k int, v string, at int")
    return R.upsert(old, new, ["k"], order=["at"]).select("k", "v")


@fixture("k INTEGER", [(3,)])
def rows_not_loaded(s, d):
    ids = lambda *k: s.createDataFrame([(x,) for x in k], "k int")
    return R.not_loaded(ids(1, 2, 3), ids(1, 2, 9), ["k"])
