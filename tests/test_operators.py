import pytest
from pyspark.sql import functions as F

from furlong.functions import scalars as S
from furlong.operators import graph as G
from furlong.operators import ml as M
from furlong.operators import quality as Q
from furlong.operators import relational as R
from furlong.operators import stats as T
from furlong.sources import html as H
from furlong.sources import io
from furlong.streaming import upsert as U


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).head()[0]


def test_inbreeding_drops_pairs_that_are_not_minimal(spark):
    tree = spark.createDataFrame([("h", "S", "a"), ("h", "SS", "n"), ("h", "SSS", "o"), ("h", "D", "b"), ("h", "DS", "c"), ("h", "DSS", "n"), ("h", "DSSS", "o"), ("k", "S", "z")], "horse string, line string, ancestor string")
    assert {r.horse: (r.fx, r.crosses) for r in G.inbreeding(tree).collect()} == {"h": (0.0625, 1), "k": (0.0, 0)}


def test_meetings_and_ties(spark):
    e = spark.createDataFrame([(1, "a", 1, 0.7), (1, "b", 2, 0.7), (1, "c", 2, 0.7)], "race int, runner string, position int, weight double")
    met = G.meetings(e)
    assert G.undirected(met).count() == 3 and G.prestige(met).count() == 2
    h = G.head_to_head(met, "b", "a").head()
    assert (h.wins_a, h.wins_b) == (0.0, 0.7)


def test_pagerank_keeps_the_mass_of_dead_ends(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    ranks = {r.node: r["rank"] for r in G.pagerank(edges, nodes).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["b"] > ranks["a"]


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (5, 6, 1.0)], "a long, b long, weight double")
    nodes = spark.range(1, 8).withColumnRenamed("id", "node")
    assert {r.node: r.component for r in G.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    got = {r.node: (r.dist, r.prev) for r in G.shortest_paths(edges, nodes, 1).collect()}
    assert got[3] == (3.0, 2) and got[4] == (None, None)


def test_common_ancestor_takes_the_smaller_maximum(spark):
    d = spark.createDataFrame([("a", "x", 1), ("b", "x", 3), ("a", "y", 2), ("b", "y", 2)], "horse string, ancestor string, depth int")
    assert G.lowest_common_ancestor(d, spark.createDataFrame([("a", "b")], "a string, b string")).head().ancestor == "y"


def test_average_rank_and_prior_rate(spark):
    v = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    assert sorted(r.k for r in R.average_rank(v, "x", "k").collect()) == [1.0, 2.5, 2.5, 4.0]
    p = spark.createDataFrame([("h", 1, 1), ("h", 2, 0), ("h", 3, 1), (None, 4, 1)], "k string, t int, y int")
    got = {r.t: r.rate for r in R.prior_rate(p, "k", "y", ["t"], 3, "rate").collect()}
    assert got[1] == pytest.approx(0.2) and got[2] == pytest.approx(0.4) and got[3] == pytest.approx(0.32) and got[4] is None


def test_prior_rates_of_large_keys_are_the_same(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 8 + ["b", "c", None]), r.randrange(2), r.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "t int, k string, y int, year int").repartition(7)
    for f in (lambda m: R.prior_rate(df, "k", "y", ["year", "t"], 3, "x", most=m), lambda m: R.prior_count(df, "k", ["year", "t"], "x", most=m)):
        one, two = ({q.t: q.x for q in f(m).collect()} for m in (10**6, 5))
        assert one == pytest.approx(two) and len(one) == 400 and sum(v is None for v in one.values()) == sum(k is None for _, k, _, _ in rows)


def test_texts(spark):
    c = F.col("c")
    assert [one(spark, S.distance_band(F.lit(x).cast("int")), c=1)[:4] for x in (1400, 1600, 2200, 2201, None)] == ["Spri", "Mile", "Inte", "Long", "Long"]
    assert one(spark, F.struct(*S.sex_age(c)), c="セン5") == ("せん", 5) and one(spark, S.sex_age(c)[0], c="牝") is None
    assert [one(spark, S.margin(c), c=x) for x in ("１／２馬身", "３馬身", "クビ", "１ １／４馬身")] == ["1/2 lengths", "3 lengths", "Neck", "1/4 lengths"]
    assert one(spark, S.canonical_race(c), c="ＧⅢ中山金杯") == "中山金杯"
    assert [one(spark, S.race_day(c), c=x) for x in ("1月6日土曜", "1/6（土）")] == ["1/6", "1/6"]
    assert one(spark, F.struct(*S.birth(c)), c="2001.02.03 25歳") == ("2001.02.03", 2001)
    assert one(spark, S.body_mass(c), c="486Kg(+2)") == 486.0 and one(spark, S.number(c), c="x") is None
    got = one(spark, F.struct(*[v.alias(k) for k, v in S.split_row(c).items()]), c="丸山侯彦1:10.6１／２馬身448Kg+2小桧山悟16")
    assert (got.jockey, got.finish_time, got.mass, got.trainer, got["rank"]) == ("丸山侯彦", "1:10.6", "448Kg", "小桧山悟", "16")
    assert one(spark, S.title(c), c="prix DE la ROSE jra") == "Prix de la Rose JRA"
    assert one(spark, F.struct(*S.country_split(c)), c="Star (USA)") == ("Star", "(USA)")


def test_chi2_tail_and_tests(spark):
    assert 0.04 < T.chi2_tail(3.84, 1) < 0.06 and T.chi2_tail(0, 3) == 1.0
    x = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "q"), ("b", "q")], "r string, c string")
    row = T.with_p(T.chi2_independence(x, "r", "c")).head()
    assert row.chi2 == pytest.approx(4.0) and row.dof == 1 and row.cramers_v == pytest.approx(1.0)


def test_quality(spark):
    races = spark.createDataFrame([(1, "A", "G1", 2001), (2, "A", None, 2002), (3, "B", "", 2003)], "race int, name string, grade string, year int")
    assert {r.race: r.grade for r in Q.imputed(races, "name", {"grade": "G3"}, ["year", "race"]).collect()} == {1: "G1", 2: "G1", 3: "G3"}
    assert Q.verdict(Q.audit(Q.blank_fields(races, ["grade"], "races"))).head() == (False, 1)
    fixed = Q.realigned(races, F.col("race") == 2, {"name": "grade", "grade": "name"}).where("race = 2").head()
    assert (fixed.name, fixed.grade) == (None, "A")


def test_pages(spark, tmp_path):
    assert len(H.lines("S") + H.lines("D")) == 62 and H.lines("S")[:3] == ["S", "SS", "SSS"]
    blank = "<td></td>" * 12
    page = f"<table><tr><th>着順</th><th>馬名</th></tr><tr><td>1</td><td>甲</td>{blank}</tr><tr><td>2</td><td>乙</td>{blank}</tr><tr><td>3</td><td>no cells</td></tr></table>"
    H.register(spark)
    df = spark.createDataFrame([(page,)], "html string")
    df.createOrReplaceTempView("pages_in")
    assert [r.horse_name for r in spark.sql("SELECT r.horse_name FROM pages_in, LATERAL parse_result(html) r").collect()] == ["甲", "乙"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.html").write_bytes("馬".encode("cp932"))
    assert io.read_pages(spark, str(tmp_path / "p")).head().html == "馬"


def test_csv_mark_round_trip_and_graph_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "k string, v int").collect() == df.collect()
    io.write_gexf(df.withColumnRenamed("k", "node"), spark.createDataFrame([("a", "a", 1.0)], "a string, b string, weight double"), str(tmp_path / "g.gexf"))
    assert "<edge " in (tmp_path / "g.gexf").read_text()


def test_stream_merges_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for v in ("old", "new"):
        spark.createDataFrame([(1, v)], "k int, v string").write.mode("append").parquet(src)
        q = U.merge_stream(spark.readStream.schema("k int, v string").parquet(src), out, ["k"], str(tmp_path / "ck"))
        q.awaitTermination()
    assert [r.v for r in U.latest(spark, out, ["k"]).collect()] == ["new"]


@pytest.mark.parametrize("replace", [True, False])
def test_streamed_batches_are_merged_in_their_order(spark, tmp_path, replace):
    import os

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    assert U.latest(spark, out, ["k"], replace) is None
    want = {}
    for n in range(8):
        rows = [(k, at, f"{n}.{at}") for k in (n, n // 2, None) for at in (2, 1, 3)]
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(src)
        U.merge_stream(spark.readStream.schema("k int, at int, v string").parquet(src), out, ["k"], str(tmp_path / "ck"), replace, ["at"], compact_every=3).awaitTermination()
        for k in (n, n // 2, None):
            want[k] = f"{n}.3" if replace else want.get(k, f"{n}.1")
        got = U.latest(spark, out, ["k"], replace).collect()
        assert len(got) == len(want) and {r.k: r.v for r in got} == want
    assert sorted(os.listdir(f"{out}/base")) == [f"furlong_batch={n:08d}" for n in (2, 5)]
    assert sorted(os.listdir(f"{out}/delta")) == [f"furlong_batch={n:08d}" for n in (3, 4, 5, 6, 7)]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert sorted((r.x, r.y) for r in M.zscores(df, ["x", "y"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def brute_silhouette(rows):
    import numpy as np

    out = []
    for i, x, c in rows:
        by = {}
        for j, y, d in rows:
            if i != j:
                by.setdefault(d, []).append(np.linalg.norm(np.array(x) - np.array(y)))
        a, b = np.mean(by.get(c, [0])), min((np.mean(v) for d, v in by.items() if d != c), default=0)
        out.append((b - a) / max(a, b) if max(a, b) > 0 and len(by) > (c in by) else 0)  # a singleton's own distance is 0
    return np.mean(out)


@pytest.mark.parametrize("block_rows", [7, 8000])
def test_silhouette_in_blocks_is_the_brute_force(spark, block_rows):
    import random

    r = random.Random(5)
    rows = [(i, [r.gauss(i % 3, 1) + 100 for _ in range(4)], i % 3) for i in range(60)] + [(60, [9.0] * 4, 9)]
    df = spark.createDataFrame(rows, "k long, x array<double>, c int")
    got = M.silhouette(df, "k", "x", "c", block_rows=block_rows)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and got.head()[0] == pytest.approx(brute_silhouette(rows))


def test_silhouette_query_scores_ids_of_400_and_more(spark, tmp_path):
    from furlong import plans

    rows = [(395 + i, [float(i % 2) * 5, float(i)], i % 2) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plans.QUERIES["silhouette"](spark, str(tmp_path)).head()[0] == pytest.approx(brute_silhouette(rows), abs=1e-4)


def test_registered_pagerank_and_paths_go_to_the_end(spark, monkeypatch):
    from furlong import plans

    n, at = 12, range(12)
    chain = spark.createDataFrame([(race, race + k, 1 + k, 0.5 + race % 3 / 4) for race in range(n - 1) for k in (0, 1)], "race long, runner long, position int, weight double")
    monkeypatch.setattr(plans.B, "supplier_edges", lambda s, d: chain)
    monkeypatch.setattr(plans, "_nodes", lambda s, d: spark.range(n).withColumnRenamed("id", "node"))
    # runner k + 1 loses to k only, so its whole rank goes there, and 0 is a dead end
    rank = [1 / n] * n
    for _ in range(500):
        rank = [0.15 / n + 0.85 * ((rank[k + 1] if k + 1 < n else 0) + rank[0] / n) for k in at]
    got = {r.node: r["rank"] for r in plans.QUERIES["pagerank"](spark, "").collect()}
    assert [got[k] for k in at] == pytest.approx(rank, abs=1e-6)
    dist = {r.node: r.dist for r in plans.QUERIES["shortest_paths"](spark, "").collect()}
    step = lambda k: 1 / (0.5 + k % 3 / 4)
    assert [dist[k] for k in at] == pytest.approx([sum(map(step, range(1, k))) if k else step(0) for k in at], abs=1e-5)


def test_iteration_that_does_not_converge_is_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(5)], "a long, b long, weight double")
    nodes = spark.range(6).withColumnRenamed("id", "node")
    with pytest.raises(RuntimeError, match="not converged"):
        G.shortest_paths(edges, nodes, 0, most=3)


def test_forest_sweep_and_node_table_are_whole(spark, monkeypatch):
    import os

    from furlong import plans

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    assert sorted(r.k for r in plans.QUERIES["sire_k_sweep"](spark, data).collect()) == list(range(2, 8))
    rows = plans.QUERIES["horse_metadata"](spark, data).select("weighted_degree", "pagerank_raw").collect()
    assert sum(r.pagerank_raw for r in rows) == pytest.approx(1) and max(r.weighted_degree for r in rows) > 0

    class Seen(Exception):
        pass

    def forest(train, cols, target, trees=45):
        raise Seen(trees)

    monkeypatch.setattr(plans.M, "forest", forest)
    with pytest.raises(Seen, match="45"):
        plans.QUERIES["classifiers"](spark, data)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_are_not_broadcast(spark):
    """A tree has 62 rows for each row that it is made from, which the optimiser takes for one."""
    from furlong import plans

    for name in ("common_ancestors", "pedigree_edges", "progeny", "ancestors"):
        assert "Broadcast" not in _exchanges(plans.QUERIES[name](spark, "/root/testdata/sf0.001")), name
    tree = plans.B.tree(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in _exchanges(G.dag_edges(tree)) and "Broadcast" not in _exchanges(G.least_depths(G.dag_edges(tree), tree.select("horse").distinct()))


def test_steps_of_gathered_trees_are_those_of_their_rows(spark):
    rows = [("h", "S", "a"), ("h", "SS", "n"), ("h", "SSD", "o"), ("h", "D", "b"), ("h", "DDS", "x"), ("k", "D", "h"), ("k", "DS", "a"), ("m", "S", None)]
    tree = spark.createDataFrame(rows, "horse string, line string, ancestor string")
    steps = lambda t: {tuple(r) for r in G.tree_steps(t).collect()}
    assert steps(tree) == steps(G.gathered(tree)) == {("h", "S", "h", "a"), ("h", "SS", "a", "n"), ("h", "SSD", "n", "o"), ("h", "D", "h", "b"), ("k", "D", "k", "h"), ("k", "DS", "h", "a")}
    twice = spark.createDataFrame([("h", "S", "a"), ("h", "S", "b"), ("h", "SD", "c")], "horse string, line string, ancestor string")
    assert {(r.child, r.parent) for r in G.dag_edges(twice).collect()} == {("h", "a"), ("h", "b"), ("a", "c"), ("b", "c")}
    assert {tuple(r) for r in G.tree_depths(spark.createDataFrame([("h", "S", "a"), ("h", "DD", "a")], "horse string, line string, ancestor string")).collect()} == {("h", "a", 1)}


def test_head_to_head_of_two_that_never_met(spark):
    e = spark.createDataFrame([(1, "a", 1, 0.7), (1, "c", 2, 0.7)], "race int, runner string, position int, weight double")
    assert tuple(G.head_to_head(G.meetings(e), "a", "b").head()) == ("a", "b", None, 0.0, 0.0)


def test_anova_of_whole_numbers_with_large_sums(spark):
    """The square of the sum is beyond 64 bits."""
    rows = spark.createDataFrame([(g, 1_000_000_000 * g + k) for g in (1, 2) for k in range(5)], "g int, v long")
    r = T.anova(rows, "g", "v").head()
    assert r.df_between == 1 and r.df_within == 8 and r.eta2 == pytest.approx(1)


def test_degrees_without_pairs_are_those_of_pairs(spark):
    rows = [(1, "a", 1, 0.5), (1, "b", 2, 0.5), (1, "c", 2, 0.5), (2, "a", 1, None), (2, "b", 95, None), (2, "d", 3, None), (3, "e", 1, 1.0), (4, "f", 99, 1.0)]
    e = spark.createDataFrame(rows, "race int, runner string, position int, weight double")
    nodes = e.where("position < 90").select(F.col("runner").alias("node")).distinct()
    assert {tuple(r) for r in G.met_degree(e).collect()} == {tuple(r) for r in G.degree(G.undirected(G.meetings(e)), nodes).collect()}


def test_rows_by_key_are_counted_where_told(spark):
    rows = spark.createDataFrame([("h", 1, 1), ("h", 2, 0), ("h", 3, 1)], "k string, t int, y int")
    costly = rows.withColumn("y", F.when(F.raise_error("made again").isNull(), 1))
    assert R.prior_rate(costly, "k", "y", ["t"], 3, "rate", counted=rows).columns == ["k", "t", "y", "rate"]
    assert [r.n for r in R.prior_count(rows, "k", ["t"], "n", counted=rows).orderBy("t").collect()] == [0, 1, 2]
