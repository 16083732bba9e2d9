"""Pages, sinks, schemas and the job."""

import json

import pytest
from pyspark.sql import functions as F

from furlong import job
from furlong.operators import graph as G
from furlong.operators import quality as Q
from furlong.operators import stats as T
from furlong.sources import html, io, schema

HEAD = "着順 枠 馬番 ブリンカー 馬名 性 齢 負担重量 騎手 タイム 着差 馬体重 調教師 単勝人気".split()


def cells(*texts, tag="td"):
    return "<tr>" + "".join(f"<{tag}>{t}</{tag}>" for t in texts) + "</tr>"


def result_page(head=HEAD):
    rows = [
        ("1", "2", "3", "", '<a href="/meikan/horse/2001x/">ディープ</a>', "牡", "4", "56.0kg", "武豊", "1:33.0", "", "486Kg", "+2", "藤沢", "1"),
        ("中止", "2", "4", "", "ナイト", "牝", "x", "54.0kg", "横山", "", "", "460Kg", "", "小桧山", "9"),
        ("3", "short"),
        ("2", "1", "5", "", "スター <b>ワン</b>", "セン", "5", "57.0kg", "福永", "1:33.1", "クビ", "480Kg", "-4"),
    ]
    return '<div class="cell line">天候：晴 <span>芝：稍重</span></div><table><tr><td>x</td></tr></table><table>' + cells(*head, tag="th") + "".join(cells(*r) for r in rows) + "</table>"


def test_result_page(spark):
    rows = spark.createDataFrame([("r", result_page()), ("none", None), ("odd", "<table><tr><td>馬名</td></tr></table>")], "race_id string, html string")
    got = {r.horse_name: r for r in rows.lateralJoin(html.ParseResult(F.col("html").outer())).collect()}
    assert list(got) == ["ディープ", "ナイト", "スターワン"]
    first, fell, bare = got.values()
    assert (first.position, first.horse_id, first.age, first.horse_weight, first.trainer, first.odds, first.weight) == (1, "/meikan/horse/2001x/", 4, "486Kg(+2)", "藤沢", "1", "56.0kg")
    assert (fell.position, fell.horse_id, fell.age, fell.horse_weight) == (99, "ナイト", None, "460Kg")
    assert (bare.position, bare.trainer, bare.odds, bare.margin) == (2, "", "", "クビ")
    said = {r.race_id: (r.weather, r.going) for r in rows.lateralJoin(html.ParseConditions(F.col("html").outer())).select("race_id", *[c.alias(n) for n, c in html.conditions(F.col("conditions")).items()]).collect()}
    assert said == {"r": ("Fine", "Good to Soft"), "none": ("", ""), "odd": ("", "")}


def test_result_columns_are_found_by_their_labels():
    head = ["着順", "馬名", "騎手", "性", "齢", "負担重量", "タイム", "着差", "馬体重", "調教師", "単勝人気"]
    page = "<table>" + cells(*head, tag="th") + cells("1", "A", "J", "牡", "3", "55", "1:0", "", "480", "+2", "T", "4") + cells("2", "B", "K", "牝", "4", "54", "1:1", "クビ", "470", "", "U", "5") + "</table>"
    a, b = html.result_rows(page)
    assert (a["jockey"], a["sex"], a["trainer"], a["odds"], b["margin"], b["trainer"]) == ("J", "牡", "T", "4", "クビ", "U")


INDEX = "<table>" + cells("1月5日", "<a href='result/0105.html'>ＧⅢ中山金杯</a>", "中山", "4歳", "芝2,000m") + cells("1月6日", "<a href='068.html'>平安ステークス</a>", "京都", "x", "ダート1,800m") + cells("x", "<a href='about.html'>no</a>", "", "", "") + "</table><a href='/result/x.html'>bare</a>"


def test_index_page(spark):
    rows = spark.createDataFrame([(2005, "", INDEX, "https://host/a/b.html")], "year int, graded string, g1 string, page string").withColumn("html", html.index_page(F.col("graded"), F.col("g1")))
    links = rows.select("year", "page", "html").lateralJoin(html.ParseIndex(F.col("html").outer(), F.col("page").outer())).drop("html", "page")
    got = {r.url: r for r in html.races_of(links, F.col("year")).collect()}
    assert set(got) == {"https://host/a/result/0105.html", "https://host/a/068.html", "https://host/result/x.html"}
    a, b = got["https://host/a/result/0105.html"], got["https://host/a/068.html"]
    assert (a.race_id, a.grade, a.grade_weight, a.surface, a.distance, a.date) == ("2005_中山_ＧⅢ中山金杯", "G3", 0.5, "Turf", 2000, "1月5日")
    assert (b.grade, b.grade_weight, b.surface, b.distance) == ("", 0.0, "Dirt", 1800) and got["https://host/result/x.html"].race_id == "2005__"


def test_search_and_profile(spark):
    rows = spark.createDataFrame([("no", "<a href='/horse/0000012345/'>x</a><a href='/horse/0000099999/'>y</a>"), ("/horse/0000000001/", "/horse/0000000002/"), (None, "")], "e string, p string")
    assert [r[0] for r in rows.select(html.searched_id(F.col("e"), F.col("p"))).collect()] == ["0000012345", "0000000001", None]
    page = "<dl><dt>生年月日（年齢）</dt> <dd>2002.03.25 23歳</dd><dt>毛色</dt><dd>鹿毛</dd><dt>生産牧場</dt><dd>ノーザン</dd><dt>馬主</dt><dd>金子</dd><dt>総賞金（万円）</dt><dd>145,455.1万円</dd><dt>戦績</dt><dd>14戦12勝</dd><dt>他</dt></dl>"
    got = spark.createDataFrame([(page,), (None,)], "html string").lateralJoin(html.ParseProfile(F.col("html").outer())).drop("html").collect()
    assert tuple(got[0]) == ("2002.03.25 23歳", "鹿毛", "ノーザン", "金子", 1454551000, 14, 12) and tuple(got[1]) == ("", "", "", "", 0, 0, 0)


def names(side, n):
    return "".join(f"<a href='/horse/{side}{k:09d}/'>{side}{k}</a>" for k in range(n)) + "<a href='/horse/0000000009/'>血統</a><a href='/other/'>z</a>"


def test_pedigree_page(spark):
    two = f"<div class='data-3__inner'><div class='data-3__items'>{names(1, 3)}</div><div class='data-3__items'>{names(2, 33)}</div></div>"
    halves = f"<table class='pedigree'><tr><td>{names(1, 3)}{names(2, 3)}</td></tr></table>"
    rows = spark.createDataFrame([("a", two), ("b", halves), ("c", "<p>none</p>")], "horse string, html string")
    tree = rows.lateralJoin(html.ParsePedigree(F.col("html").outer())).drop("html")
    got = {h: {r.line: (r.ancestor_name, r.generation) for r in tree.where(F.col("horse") == h).collect()} for h in "abc"}
    assert {k: v for k, v in got["a"].items() if k[0] == "S"} == {"S": ("10", 1), "SS": ("11", 2), "SSS": ("12", 3)}
    assert got["a"]["D"] == ("20", 1) and got["a"]["DDDDD"] == ("230", 5) and len(got["a"]) == 34
    assert set(got["b"]) == {"S", "SS", "SSS", "D", "DS", "DSS"} and got["c"] == {}
    row = html.two_generations(tree, ["horse"]).where("horse = 'a'").head()
    assert (row.sire_name, row.dam_name, row.grandsire_name, row.dam_sire_id) == ("10", "20", "11", "2000000001")
    assert [len(html.lines(s)) for s in "SD"] == [31, 31] and html.lines("S", 3) == ["S", "SS", "SSS", "SSD", "SD", "SDS", "SDD"]


def test_graph_file(spark, tmp_path):
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([("a<", 1.5, 3), ("b", None, 4)], "node string, rank double, wins int")
    edges = spark.createDataFrame([("a<", "b", 0.5, "Sire Line")], "src string, dst string, weight double, relation string")
    io.write_gexf(nodes, edges, str(tmp_path / "g.gexf"), directed=True, ends=("src", "dst"))
    ns = "{http://www.gexf.net/1.2draft}"
    graph = ElementTree.parse(tmp_path / "g.gexf").getroot()[0]
    assert graph.get("defaultedgetype") == "directed" and [n.get("id") for n in graph.iter(f"{ns}node")] == ["a<", "b"]
    assert [a.get("type") for a in graph.iter(f"{ns}attribute")] == ["double", "integer", "string"] and [v.get("value") for v in graph.iter(f"{ns}attvalue")] == ["1.5", "3", "4", "Sire Line"]
    with pytest.raises(ValueError):
        io.write_gexf(nodes, edges, str(tmp_path / "h.gexf"), ends=("src", "dst"), most=1)
    with pytest.raises(ValueError):
        io.write_gexf(nodes, edges.union(edges), str(tmp_path / "h.gexf"), ends=("src", "dst"), most_edges=1)


def test_dictionary_file(spark, tmp_path):
    rows = [("馬", "horse"), ("b", 'quote " and \n'), ("a", "x")]
    io.write_dictionary(spark.createDataFrame(rows, "key string, value string"), str(tmp_path / "d"))
    assert sorted(map(tuple, io.read_dictionary(spark, str(tmp_path / "d")).collect())) == sorted(rows)


def test_schemas(spark, tmp_path):
    assert schema.schema("races", raw=True)["distance"].dataType.simpleString() == "string" and schema.schema("horses")["total_earnings"].dataType.simpleString() == "bigint"
    got = schema.typed(spark.createDataFrame([("r", "2002", "n", "", "x")], "race_id string, year string, race_name string, distance string, more string"), "races").head()
    assert (got.year, got.distance, got.grade, got.grade_weight, got.url) == (2002, None, "G1", 1.0, None) and set(schema.KEYS) == set(schema.TABLES)


def test_databases(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS plain LOCATION '{tmp_path}/plain'")
    try:
        schema.create(spark, "plain")
        spark.sql("INSERT INTO plain.pedigree_tree VALUES ('h', 'n', 'i', '名', 1, 'S')")
        schema.copy(spark, "plain", "english", {"pedigree_tree": lambda t: t.withColumn("ancestor_name", F.lit("Name"))})
        assert {t.name for t in spark.catalog.listTables("english") if not t.isTemporary} == set(schema.TABLES) and spark.table("english.pedigree_tree").head().ancestor_name == "Name"
    finally:
        for name in ("plain", "english"):
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_job(spark, tmp_path):
    pages, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    race = "2005_中山_ＧⅢ中山金杯"
    spark.createDataFrame([(2005, "https://host/a/b.html", INDEX), (1999, "https://host/c.html", INDEX)], "year int, url string, html string").write.parquet(f"{pages}/index")
    spark.createDataFrame([(race, result_page())], "race_id string, html string").write.parquet(f"{pages}/results")
    spark.createDataFrame([("h", "n", f"<div class='data-3__inner'>{names(1, 1)}{names(2, 1)}</div>")], "horse_id string, horse_name string, html string").write.parquet(f"{pages}/pedigrees")
    verdict = job.main(["--pages", pages, "--out", out, "--test", "--analyze"], spark)
    assert not verdict.head().passed  # two races have no entries
    races = {r.race_id: r for r in spark.read.parquet(f"{out}/races").collect()}
    assert len(races) == 3 and (races[race].grade, races[race].surface, races[race].distance, races[race].date, races[race].weather) == ("G3", "Turf", "2000", "1/5", "Fine")
    assert spark.read.parquet(f"{out}/race_entries").count() == 3 and spark.read.parquet(f"{out}/pedigree").head().sire_name == "10"
    rank = {r.node: r["rank"] for r in spark.read.parquet(f"{out}/pagerank").collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["ディープ"] > rank["スターワン"] > 0 and min(rank.values()) == rank["ナイト"]


def test_meetings_leave_out_who_did_not_finish(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "c", 2, None), (1, "d", 99, 1.0), (1, "e", None, 1.0), (1, "f", 0, 1.0)], "race int, runner string, position int, weight double")
    met = G.meetings(rows)
    assert G.undirected(met).count() == 3 and G.prestige(met).count() == 2


def test_lineage_roles(spark):
    nodes = spark.createDataFrame([("champion",), ("runner",), ("old",), ("Deep Impact",)], "node string")
    meta = spark.createDataFrame([("champion", 1, 2, 3.5, 9.0, "Other Sires", 1.5), ("runner", 0, 0, 0.0, 2.0, "Other Sires", 0.0)], "horse_name string, g1_wins long, graded_wins long, total_earnings_m_yen double, pagerank_scaled double, sire_group string, inbreeding_fx_pct double")
    born = spark.createDataFrame([("old", 10), ("Deep Impact", 9)], "parent string, progeny long")
    got = {r.node: (r.node_role, r.pagerank_score, r.progeny_in_dag, r.sire_group) for r in G.lineage_nodes(nodes, meta, born).collect()}
    assert got == {"champion": ("G1 Champion", 9.0, 0, "Other Sires"), "runner": ("Graded Contender", 2.0, 0, "Other Sires"), "old": ("Foundation Sire/Dam", 1.0, 10, "Foundation Bloodline"), "Deep Impact": ("Ancestor", 1.0, 9, "Deep Impact")}


def test_small_groups_are_no_part_of_the_ranks(spark):
    rows = [("a", float(k)) for k in range(5)] + [("b", float(k) + 2.5) for k in range(5)] + [("c", 100.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    with_c, without = (T.kruskal(x, "g", "v").head() for x in (df, df.where("g <> 'c'")))
    assert with_c.h == pytest.approx(without.h) and with_c.dof == 1
    one = T.anova_kruskal(df, "g", "v").head()
    assert one.p_kruskal == pytest.approx(T.chi2_tail(one.h, 1)) and one.p_anova == pytest.approx(T.chi2_tail(one.f, 1))


def test_tail_against_published_values():
    """Statistics and p-values of chi-square tests, to the accuracy of the approximation."""
    for x, dof, p in ((3.841, 1, 0.05), (18.307, 10, 0.05), (23.685, 14, 0.05), (29.141, 14, 0.01), (6.635, 1, 0.01)):
        assert T.chi2_tail(x, dof) == pytest.approx(p, rel=0.12)


def test_verdict_and_garbage(spark):
    issues = spark.createDataFrame([("WARNING", "w", 3)], "severity string, code string, n long")
    assert Q.verdict(issues).head().passed and not Q.verdict(issues.union(spark.createDataFrame([("ERROR", "e", 1)], "severity string, code string, n long"))).head().passed
    assert len(Q.GARBAGE) == 15 and json.dumps(Q.KNOWN_DISTANCE)
