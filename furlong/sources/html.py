"""Pages as tables: a small element tree, and table functions over it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.scalars import course_of, distance_of, going_of, grade_of, grade_weight, weather_of

# Elements that have no end
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], above: Element | None = None):
        self.tag, self.attrs, self.above, self.inner = tag, attrs, above, []

    def walk(self) -> Iterator[Element | str]:
        for x in self.inner:
            yield x
            if isinstance(x, Element):
                yield from x.walk()

    def all(self, *tags: str) -> list[Element]:
        return [x for x in self.walk() if isinstance(x, Element) and x.tag in tags]

    def children(self, tag: str, mark: str = "") -> list[Element]:
        return [x for x in self.inner if isinstance(x, Element) and x.tag == tag and (not mark or mark in x.classes)]

    def first(self, tag: str, mark: str = "", id_: str = "") -> Element | None:
        return next((x for x in self.all(tag) if (not mark or mark in x.classes) and (not id_ or x.attrs.get("id") == id_)), None)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    @property
    def text(self) -> str:
        return "".join(x.strip() for x in self.walk() if isinstance(x, str))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.at = self.root = Element("", {})

    def handle_starttag(self, tag, attrs):
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inner.append(new)
        if tag not in VOID:
            self.at = new

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.above
        if x is not self.root:
            self.at = x.above

    def handle_data(self, data):
        self.at.inner.append(data)


def tree(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def horse_id(html: Column) -> Column:
    """The first ten-digit id of a horse on a page; null without one."""
    return F.nullif(F.regexp_extract(html, r"/horse/(\d{10})/", 1), F.lit(""))


def searched_id(exact: Column, partial: Column) -> Column:
    """The id that an exact search found, else that of a search by part of the name."""
    return F.coalesce(horse_id(exact), horse_id(partial))


def index_page(graded: Column, g1: Column) -> Column:
    """The page of all graded races, or where that is missing the page of the first grade."""
    return F.coalesce(F.nullif(graded, F.lit("")), F.nullif(g1, F.lit("")))


def index_links(html: str | None, url: str) -> Iterator[tuple]:
    """(url, date, race_name, track, course) of each link to a result; the cells of its row, '' without a row of five cells."""
    for a in tree(html).all("a"):
        href = a.attrs.get("href")
        if href is None or not ("result" in href or re.search(r"\d{2,3}\.html$", href)):
            continue
        row = a
        while row is not None and row.tag != "tr":
            row = row.above
        cells = [c.text for c in row.all("th", "td")] if row else []
        yield (urljoin(url or "", href), *((cells[0], cells[1], cells[2], cells[4]) if len(cells) >= 5 else ("", "", "", "")))


@udtf(returnType="url string, date string, race_name string, track string, course string")
class ParseIndex:
    """parse_index(html, url): one row for each race of a year's index."""

    def eval(self, html: str, url: str):
        yield from index_links(html, url)


def races_of(links: DataFrame, year: Column) -> DataFrame:
    """Races from index rows: the id year_track_name, grade, weight, surface and distance with them."""
    rows = links.withColumns({"year": year, "grade": grade_of(F.col("race_name")), "surface": course_of(F.col("course")), "distance": distance_of(F.col("course"))})
    return rows.withColumns({"grade_weight": grade_weight(F.col("grade"), 0.0), "race_id": F.concat_ws("_", F.col("year").cast("string"), "track", "race_name")}).drop("course")


# Labels of a result table's columns, and where these stand if the label is missing
COLUMNS = {
    "position": ("着順", 0), "horse_name": ("馬名", 4), "sex": ("性", 5), "age": ("齢", 6), "weight": ("負担重量", 7), "jockey": ("騎手", 8), "finish_time": ("タイム", 9), "margin": ("着差", 10),
    "horse_weight": ("馬体重", 11), "trainer": ("調教師", 12), "odds": ("単勝人気", 13),
}
NOT_FINISHED = 99


def _int(text: str, default: int | None) -> int | None:
    try:
        return int(text)
    except ValueError:
        return default


def result_rows(html: str | None) -> Iterator[dict]:
    """The runners of the first table of more than two rows whose header names horses.

    Columns are found by their labels. The body mass has a cell more than the header says, for its change, so what comes behind
    it stands one cell later. A position that is no number is 99. A row that lacks a cell is left out.
    """
    page = tree(html)
    table = next((rows for t in page.all("table") if len(rows := t.children("tr")) > 2 and COLUMNS["horse_name"][0] in rows[0].text), None)
    if not table:
        return
    labels = [c.text for c in table[0].all("th", "td")]
    at = {name: next((k for k, x in enumerate(labels) if label in x), default) for name, (label, default) in COLUMNS.items()}
    for row in table[1:]:
        cells = row.all("th", "td")
        if len(cells) <= max(k for name, k in at.items() if name not in ("trainer", "odds")):
            continue
        text = lambda name, more=0: cells[at[name] + more].text if at[name] + more < len(cells) else ""  # noqa: E731, B023
        link = next((m[1] for a in cells[at["horse_name"]].all("a") if (m := re.search("(/meikan/horse/[^/]+/)", a.attrs.get("href", "")))), None)
        mass, change = text("horse_weight"), text("horse_weight", 1)
        yield {
            "horse_name": text("horse_name"), "horse_id": link or text("horse_name"), "position": _int(text("position"), NOT_FINISHED), "finish_time": text("finish_time"), "jockey": text("jockey"), "trainer": text("trainer", 1),
            "weight": text("weight"), "odds": text("odds", 1), "horse_weight": f"{mass}({change})" if change else mass, "age": _int(text("age"), None), "sex": text("sex"), "passing_positions": "", "margin": text("margin"),
        }


RESULT = "horse_name string, horse_id string, position int, finish_time string, jockey string, trainer string, weight string, odds string, horse_weight string, age int, sex string, passing_positions string, margin string"


@udtf(returnType=RESULT)
class ParseResult:
    """parse_result(html): one row for each runner of a result page."""

    def eval(self, html: str):
        for r in result_rows(html):
            yield tuple(r[c.split()[0]] for c in RESULT.split(", "))


@udtf(returnType="conditions string")
class ParseConditions:
    """parse_conditions(html): the text of a result page's box on weather and going; one row, '' without the box."""

    def eval(self, html: str):
        box = tree(html).first("div", "cell")
        yield (box.text if box else "",)


def conditions(text: Column) -> dict[str, Column]:
    return {"weather": weather_of(text), "going": going_of(text)}


# Labels of a profile's fields
PROFILE = {"birth_date": "生年月日", "color": "毛色", "breeder": "生産牧場", "owner": "馬主", "total_earnings": "総賞金", "record": "戦績"}


def profile_fields(html: str | None) -> dict:
    """Fields of a profile's definition lists, by labels that contain their names; the first name that fits counts, and of several
    such fields the last. Earnings are in ten thousands and come out whole; what is missing is '' or 0."""
    out = {"birth_date": "", "color": "", "breeder": "", "owner": "", "total_earnings": 0, "total_starts": 0, "total_wins": 0}
    for dt in tree(html).all("dt"):
        behind = dt.above.inner[dt.above.inner.index(dt) + 1 :]
        dd = next((x for x in behind if isinstance(x, Element) and x.tag == "dd"), None)
        name = next((n for n, label in PROFILE.items() if label in dt.text), None)
        if dd is None or name is None:
            continue
        if name == "record":
            for key, sign in (("total_starts", "戦"), ("total_wins", "勝")):
                if m := re.search(rf"(\d+){sign}", dd.text):
                    out[key] = int(m[1])
        elif name == "total_earnings":
            if m := re.search(r"([\d,]+(?:\.\d+)?)", dd.text):
                out[name] = int(float(m[1].replace(",", "")) * 10000)
        else:
            out[name] = dd.text
    return out


@udtf(returnType="birth_date string, color string, breeder string, owner string, total_earnings bigint, total_starts int, total_wins int")
class ParseProfile:
    """parse_profile(html): one row."""

    def eval(self, html: str):
        yield tuple(profile_fields(html).values())


def lines(side: str, depth: int = 5) -> list[str]:
    """Paths of one side in pre-order: S, SS, SSS and so on, 2 ** depth - 1 of them."""
    return [side, *lines(side + "S", depth - 1), *lines(side + "D", depth - 1)] if depth else []


# Links on a pedigree page that are no names
NO_NAMES = {"血統", "競走", "種", "繁殖", "English", "産駒", "5代血統表"}


def _names(box: Element) -> list[tuple[str, str]]:
    found = [(re.search(r"/horse/(\d{10})/?$", a.attrs.get("href", "")), a.text) for a in box.all("a")]
    return [(m[1], name) for m, name in found if m and name and name not in NO_NAMES]


def ancestors(html: str | None) -> Iterator[tuple[str, str, int, str]]:
    """(ancestor_id, ancestor_name, generation, line): the names of the sire's and of the dam's box, each in pre-order; without
    two boxes, the halves of all names. What comes after the 31st name of a side is left out."""
    page = tree(html)
    box = page.first("div", "data-3__inner") or page.first("table", "pedigree") or page.first("div", id_="pedigree")
    every = _names(box) if box else []
    if not every:
        return
    boxes = box.children("div", "data-3__items")
    sides = [_names(b) for b in boxes[:2]] if len(boxes) >= 2 else [every[: len(every) // 2], every[len(every) // 2 :]]
    for side, names in zip("SD", sides):
        for (key, name), line in zip(names, lines(side)):
            yield key, name, len(line), line


@udtf(returnType="ancestor_id string, ancestor_name string, generation int, line string")
class ParsePedigree:
    """parse_pedigree(html): one row for each ancestor."""

    def eval(self, html: str):
        yield from ancestors(html)


def two_generations(tree: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each horse with its parents, its sire's sire and its dam's sire, from rows of ParsePedigree."""
    at = {"sire": "S", "dam": "D", "grandsire": "SS", "dam_sire": "DS"}
    pick = lambda c, line: F.max(F.when(F.col("line") == line, F.col(c)))
    return tree.groupBy(*keys).agg(*[pick(f"ancestor_{part}", line).alias(f"{name}_{part}") for name, line in at.items() for part in ("id", "name")])


def register(spark) -> None:
    """The table functions, for use in SQL."""
    for name, f in {"parse_index": ParseIndex, "parse_result": ParseResult, "parse_conditions": ParseConditions, "parse_profile": ParseProfile, "parse_pedigree": ParsePedigree}.items():
        spark.udtf.register(name, f)
