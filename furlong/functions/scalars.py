"""Column functions: bands, labels, parsers and text repairs. All are built-in expressions unless they say otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c.cast("string") == "")


def filled(c: Column, text: bool) -> Column:
    """Not null, not empty and not zero; text columns are compared with '0', so nothing is cast."""
    return c.isNotNull() & ((c != "") & (c != "0") if text else (c != 0))


def distance_band(d: Column, ordinal: bool = False) -> Column:
    """Sprint, mile, intermediate or long; null is long. The upper ends 1400, 1600 and 2200."""
    names = ["Sprint (<=1400m)", "Mile (1401-1600m)", "Intermediate (1601-2200m)", "Long (>=2200m)"]
    a, b, c, e = [f"{k}. {n}" for k, n in enumerate(names, 1)] if ordinal else names
    return F.when(d <= 1400, a).when(d <= 1600, b).when(d <= 2200, c).otherwise(e)


# The eras' last years and labels
ERAS = {2007: "1. Classic Era (2002-2007)", 2013: "2. Golden Transition (2008-2013)", 2019: "3. Deep Impact Dynasty (2014-2019)"}
LAST_ERA = "4. Modern Era (2020-2025)"


def era(year: Column) -> Column:
    """Label of the era; a year of 0 or less, or null, is Unknown."""
    out = F.when(year.isNull() | (year <= 0), "Unknown")
    for last, label in ERAS.items():
        out = out.when(year <= last, label)
    return out.otherwise(LAST_ERA)


# Sires that have a group of their own; all others are "Other Sires"
SIRE_GROUPS = {
    "Deep Impact": "Deep Impact", "Sunday Silence(USA)": "Sunday Silence", "Sunday Silence": "Sunday Silence", "King Kamehameha": "King Kamehameha",
    "Stay Gold": "Stay Gold", "Heart's Cry": "Heart's Cry", "Lord Kanaloa": "Lord Kanaloa", "Kurofune(USA)": "Kurofune", "Kurofune": "Kurofune",
    "Daiwa Major": "Daiwa Major", "Manhattan Cafe": "Manhattan Cafe", "Symboli Kris S(USA)": "Symboli Kris S", "Rulership": "Rulership",
    "Harbinger(GB)": "Harbinger", "Epiphaneia": "Epiphaneia", "Duramente": "Duramente", "Orfevre": "Orfevre", "Gold Allure": "Gold Allure", "Kitasan Black": "Kitasan Black",
}


def sire_group(sire: Column, default: str = "Other Sires") -> Column:
    return lookup(sire, SIRE_GROUPS, default)


def lookup(c: Column, table: dict[str, str], default: Column | str) -> Column:
    """Value of a small literal dictionary, else the default."""
    if not table:
        return default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), default if isinstance(default, Column) else F.lit(default))


def first_hit(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of the first key, in the table's order, that the text contains."""
    out = F.lit(default).cast("string")
    for key, value in reversed(list(table.items())):
        out = F.when(c.contains(key), value).otherwise(out)
    return out


# How grades are written in race names, the higher grade first
GRADE_FORMS = {"G1": ["GⅠ", "ＧⅠ", "G1"], "G2": ["GⅡ", "ＧⅡ", "G2"], "G3": ["GⅢ", "ＧⅢ", "G3"]}


def grade_of(name: Column) -> Column:
    """G1, G2 or G3 by what the name contains, in that order; else ''."""
    return F.coalesce(first_hit(name, {form: grade for grade, forms in GRADE_FORMS.items() for form in forms}), F.lit(""))


def grade_weight(grade: Column, default: float = 0.5) -> Column:
    """1.0, 0.7 and 0.5; any other grade has the default."""
    return F.when(grade == "G1", 1.0).when(grade == "G2", 0.7).when(grade == "G3", 0.5).otherwise(default)


# Words of weather, going and surface on pages
WEATHER = {"晴": "Fine", "曇": "Cloudy", "雨": "Rain", "小雨": "Light Rain", "雪": "Snow"}
GOING = {"良": "Firm", "稍重": "Good to Soft", "重": "Soft", "不良": "Heavy"}
COURSE = {"芝": "Turf", "ダート": "Dirt"}


def weather_of(text: Column) -> Column:
    """Weather after its label and a colon of either width; '' without."""
    return first_hit(F.replace(text, F.lit("："), F.lit(":")), {f"天候:{k}": v for k, v in WEATHER.items()}, "")


def going_of(text: Column) -> Column:
    """Going after any colon; '' without."""
    return first_hit(F.replace(text, F.lit("："), F.lit(":")), {f":{k}": v for k, v in GOING.items()}, "")


def course_of(text: Column) -> Column:
    return first_hit(text, COURSE, "")


def peak_year(mean_year: Column, birth_year: Column) -> Column:
    """The mean year, else four years after birth, else 2015; 0 counts as missing."""
    return F.coalesce(F.nullif(mean_year.cast("int"), F.lit(0)), F.nullif(birth_year, F.lit(0)) + 4, F.lit(2015))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def indicator(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def joined_key(*cols: Column, default: str = "Unknown") -> Column:
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit(default)) for c in cols])


def role(has_results: Column, g1_wins: Column, progeny: Column) -> Column:
    """Node role: runners by their wins, others by the number of their progeny."""
    return F.when(has_results, F.when(g1_wins > 0, "G1 Champion").otherwise("Graded Contender")).when(progeny >= 10, "Foundation Sire/Dam").otherwise("Ancestor")


def generation_weight(generation: Column) -> Column:
    return F.when(generation == 1, 3).when(generation == 2, 2).otherwise(1)


def round_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


# Sexes, and the spellings of a gelding
SEX = "牡|牝|せん|セン|セ"


def plain_sex(c: Column) -> Column:
    """The sex of forms such as 牡 or 牡4, every gelding spelling as せん; other texts stay, trimmed."""
    found = F.regexp_extract(F.trim(c), f"^({SEX})\\d*$", 1)
    return F.when(found.isin("セン", "セ"), "せん").when(found != "", found).otherwise(F.trim(c))


def sex_age(c: Column) -> tuple[Column, Column]:
    """(sex, age) of forms such as 牡4; both null for a text of another form."""
    age = F.regexp_extract(F.trim(c), f"^(?:{SEX})(\\d+)$", 1).try_cast("int")
    return F.when(age.isNotNull(), plain_sex(c)), age


def number(c: Column) -> Column:
    """First decimal number of a text; null without one."""
    return F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def body_mass(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d{3})", 1).try_cast("double")


def rebuilt_mass(base: Column, delta: Column) -> Column:
    """`486Kg(+2)` from a text with a number in brackets and a change; without a change the base alone, without brackets the text as it is."""
    kg, change = F.regexp_extract(base, r"\((\d+)\)", 1), F.trim(F.coalesce(delta, F.lit("")))
    return F.when(kg == "", F.trim(base)).when(change == "", F.concat(kg, F.lit("Kg"))).otherwise(F.concat(kg, F.lit("Kg("), change, F.lit(")")))


def with_kg(c: Column) -> Column:
    """With kg at its end; empty texts stay."""
    return F.when((F.trim(c) == "") | F.lower(F.trim(c)).endswith("kg"), F.trim(c)).otherwise(F.concat(F.trim(c), F.lit("kg")))


def distance_of(c: Column) -> Column:
    """The first run of digits and commas as a number."""
    return F.replace(F.regexp_extract(c, "([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("int")


def man_yen(c: Column) -> Column:
    """Ten-thousands of yen, with commas, as yen."""
    return (F.replace(F.regexp_extract(c, r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double") * 10000).cast("bigint")


def birth(c: Column) -> tuple[Column, Column]:
    """(date without a trailing age, year of its first four digits)."""
    date = F.trim(F.regexp_replace(c, r"\s+\d+歳.*$", ""))
    return date, F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int")


def race_day(c: Column) -> Column:
    """M/D of `M月D日…`, or the text without what stands in brackets."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d+月\d+日"), F.regexp_replace(text, r"^(\d+)月(\d+)日.*$", "$1/$2")).otherwise(F.trim(F.regexp_replace(text, "[（(].*?[）)]", "")))


def slug(c: Column) -> Column:
    """Runs of other characters than ASCII letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


# Fixed value: the fields of a row whose cells were run together; digits are ASCII ones, so full-width ones stay with the margin
ROW = r"^([^\d]+)(\d+:\d+\.\d+)(.*?)\s*(\d+Kg)([+\-]?\d+)([^\d]+)(\d+)$"
ROW_FIELDS = ["jockey", "finish_time", "margin", "mass", "change", "trainer", "rank"]


def split_row(c: Column) -> dict[str, Column]:
    """The fields of a row in one text, trimmed; all null if it has another form."""
    has = c.rlike(ROW)
    return {n: F.when(has, F.trim(F.regexp_extract(c, ROW, k))) for k, n in enumerate(ROW_FIELDS, 1)}


def before_bracket(c: Column) -> Column:
    return F.substring_index(c, " (", 1)


def cross_text(ancestor: Column, s: Column, d: Column, percent: Column) -> Column:
    """`ancestor (3x4: 1.56%)`; ties are rounded to even digits."""
    return F.format_string("%s (%dx%d: %.2f%%)", ancestor.cast("string"), s, d, F.bround(percent, 2))


def first_three(items: Column) -> Column:
    return F.array_join(F.slice(F.sort_array(items), 1, 3), "; ")


# Fixed value: a country in brackets at the end of a name
SUFFIX = r"^(.+?)\s*(\([A-Z]{2,4}\))\s*$"


def country_split(c: Column) -> tuple[Column, Column]:
    return F.when(c.rlike(SUFFIX), F.regexp_extract(c, SUFFIX, 1)).otherwise(F.trim(c)), F.when(c.rlike(SUFFIX), F.regexp_extract(c, SUFFIX, 2)).otherwise("")


def has_japanese(c: Column) -> Column:
    """The ranges of kana, ideographs and full-width forms."""
    return c.rlike("[\\u3000-\\u30ff\\u4e00-\\u9fff\\uff00-\\uffef]")


# What may stand before the number of a grade in a race's name, and the digits of that number
GRADE_PREFIX = r"^(?:新設)?(?:重賞)?(?:J・|J\.)?(?:G|Jpn)"


def roman_grade(c: Column) -> Column:
    """Grade of forms such as GⅢ, J・GII or 新設GIII, of a name after nfkc(); a plain graded race (重賞) is G3; else null."""
    found = F.regexp_extract(c, GRADE_PREFIX + "([IⅠⅡⅢ123]+)", 1)
    digits = F.replace(F.replace(F.translate(found, "ⅠⅡⅢI", "1231"), F.lit("111"), F.lit("3")), F.lit("11"), F.lit("2"))
    return F.when(digits.isin("1", "2", "3"), F.concat(F.lit("G"), digits)).when((found == "") & c.contains("重賞"), "G3")


# Words of margins
MARGINS = {"クビ": "Neck", "ハナ": "Nose", "アタマ": "Head", "大差": "Distance"}


def margin(c: Column) -> Column:
    """Lengths and words in English; other texts stay. Of a mixed number in full-width digits only the fraction is taken, as ever."""
    text = F.trim(c)
    half = lambda x: F.translate(x, "０１２３４５６７８９", "0123456789")
    simple, mixed = "([0-9０-９]+)(?:[／/]([0-9０-９]+))?馬身", r"([0-9１-９]+)\s*([0-9]+)/([0-9]+)\s*馬身"
    whole, part = half(F.regexp_extract(text, simple, 1)), half(F.regexp_extract(text, simple, 2))
    lengths = F.when(part != "", F.concat(whole, F.lit("/"), part, F.lit(" lengths"))).otherwise(F.concat(whole, F.lit(" lengths")))
    long = F.concat(F.regexp_extract(text, mixed, 1), F.lit(" "), F.regexp_extract(text, mixed, 2), F.lit("/"), F.regexp_extract(text, mixed, 3), F.lit(" lengths"))
    return F.when(text.isin(*MARGINS), lookup(text, MARGINS, text)).when(text.rlike(simple), lengths).when(text.rlike(mixed), long).otherwise(text)


# Spellings that literal translation gets wrong, and words with a spelling of their own in titles
TITLE_FIXES = {
    r"\bsymbol\s+li\s*rudolph\b": "Symboli Rudolf", r"\bsymbol\s+li\b": "Symboli", r"\bsymboli\s*rudolph\b": "Symboli Rudolf", r"\bdeep\s+impact\b": "Deep Impact", r"\borf[eè]vre\b": "Orfevre",
    r"\buokka\b": "Vodka", r"\bmaruzenski\b": "Maruzensky", r"\bmeisho\b": "Meisho", r"\bnihon\s+pillow?\b": "Nihon Pillow",
}
TITLE_SMALL = ("of", "in", "the", "and", "to", "for", "on", "at", "by", "de", "la", "du")
TITLE_UPPER = ("II", "III", "IV", "USA", "GB", "IRE", "FR", "AUS", "NZ", "CAN", "GER", "ITY", "JRA", "NHK")
TITLE_KEPT = ("Ltd.", "Co.,", "Inc.", "Corp.")


def title(c: Column) -> Column:
    """Names in title case: known spellings, acronyms and initials in capitals, small words in lower case unless they come
    first, words in one case capitalised; mixed words stay."""
    text = F.trim(c)
    for pattern, value in TITLE_FIXES.items():
        text = F.regexp_replace(text, "(?iU)" + pattern, value)

    def word(w: Column, i: Column) -> Column:
        one_case = (F.upper(w) != F.lower(w)) & ((w == F.upper(w)) | (w == F.lower(w)))
        first = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
        return F.when(F.upper(w).isin(*TITLE_UPPER) | w.rlike(r"^[A-Z]\.[A-Z]?\.?$"), F.upper(w)).when(w.isin(*TITLE_KEPT), w).when((i > 0) & F.lower(w).isin(*TITLE_SMALL), F.lower(w)).when(one_case, first).otherwise(w)

    return F.when(F.trim(c) == "", F.trim(c)).otherwise(F.array_join(F.transform(F.split(F.trim(text), r"\s+"), word), " "))


def translated(c: Column, table: dict[str, str]) -> Column:
    """Dictionary value of the trimmed text, or the text as it is."""
    return lookup(F.trim(c), table, c)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical_race(c: Column) -> Column:
    """A race's name without its grade, after compatibility normalisation; null is ''."""
    return F.trim(F.regexp_replace(F.trim(nfkc(F.coalesce(c, F.lit("")))), "(?i)" + GRADE_PREFIX + r"[IⅠⅡⅢV123]+\s*", ""))
