"""The horse table with all its attributes, what is exported from it, and the tests and models over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import ml as M
from ..operators import relational as R
from ..operators import stats as T
from . import _CROSS, _EDGES, B, big, horse_stats, progeny, sire_specialisation

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {B.SQL} {sql}"
        return f

    return add


# the competition graph of runners, its ranks at convergence, and the horse table
_GRAPH = """, hmet AS (SELECT a.runner AS a, b.runner AS b, a.weight, sign(b.position - a.position) AS sg FROM ran a JOIN ran b ON a.race = b.race AND a.runner < b.runner),
hund AS (SELECT a, b, SUM(weight) AS weight FROM hmet GROUP BY 1, 2),
hpres AS (SELECT CASE WHEN sg > 0 THEN b ELSE a END AS src, CASE WHEN sg > 0 THEN a ELSE b END AS dst, SUM(weight) AS weight FROM hmet WHERE sg <> 0 GROUP BY 1, 2),
hnodes AS (SELECT DISTINCT runner AS node FROM ran), hsize AS (SELECT COUNT(*) AS n FROM hnodes),
hshares AS (SELECT src, dst, weight / SUM(weight) OVER (PARTITION BY src) AS share FROM hpres), hends AS (SELECT node FROM hnodes WHERE node NOT IN (SELECT src FROM hpres)),
hranks(step, node, rank, moved) AS (SELECT 0, node, 1.0::DOUBLE / n, 1.0::DOUBLE FROM hnodes, hsize UNION ALL SELECT * FROM (
  WITH now AS (SELECT * FROM hranks), lost AS (SELECT COALESCE(SUM(rank), 0) AS lost FROM now WHERE node IN (FROM hends)),
  new AS (SELECT now.step + 1 AS step, now.node, 0.15 / n + 0.85 * (COALESCE(got, 0) + lost / n) AS rank, now.rank AS was FROM now CROSS JOIN hsize CROSS JOIN lost
          LEFT JOIN (SELECT dst, SUM(rank * share) AS got FROM now JOIN hshares ON node = src GROUP BY dst) g ON g.dst = now.node)
  SELECT step, node, rank, SUM(ABS(rank - was)) OVER () AS moved FROM new WHERE (SELECT MAX(moved) FROM now) >= 1e-7 AND step <= 100)),
hpr AS (SELECT node, rank FROM hranks WHERE step = (SELECT MAX(step) FROM hranks)),
hdeg AS (SELECT node, SUM(weight) AS degree FROM (SELECT a AS node, weight FROM hund UNION ALL SELECT b, weight FROM hund) GROUP BY node)"""
_GROUPS = "(VALUES " + ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in S.SIRE_GROUPS.items()) + ") g(sire, grp)"
_META = _GRAPH + f""", {_CROSS},
hfx AS (SELECT horse, SUM(share) AS fx, array_to_string(list_slice(list_sort(list(printf('%d (%dx%d: %.2f%%)', ancestor, length(s), length(d), 100 * share))), 1, 3), '; ') AS crosses FROM cross2 GROUP BY horse),
hstat AS (SELECT runner, COUNT(*) AS starts, COUNT(*) FILTER (position = 1) AS wins, COUNT(*) FILTER (position = 1 AND grade = 'G1') AS g1_wins, COUNT(*) FILTER (position = 2 AND grade = 'G1') AS g1_seconds,
  COUNT(*) FILTER (position <= 3 AND grade = 'G1') AS g1_podiums, COUNT(*) FILTER (position <= 3) AS podiums, ROUND(AVG(year))::INTEGER AS peak FROM ran WHERE position < 90 GROUP BY runner),
meta AS (SELECT runner AS horse_name, round_even(COALESCE(rank, 0), 12) AS pagerank_raw, round_even(COALESCE(rank, 0) * 10000, 4) AS pagerank_scaled, round_even(COALESCE(degree, 0), 2) AS weighted_degree,
  COALESCE(starts, 0)::BIGINT AS graded_starts, COALESCE(wins, 0)::BIGINT AS graded_wins, COALESCE(g1_wins, 0)::BIGINT AS g1_wins, COALESCE(g1_seconds, 0)::BIGINT AS g1_seconds, COALESCE(g1_podiums, 0)::BIGINT AS g1_podiums, COALESCE(podiums, 0)::BIGINT AS graded_podiums,
  total_earnings AS total_earnings_yen, round_even(total_earnings / 1e6, 2) AS total_earnings_m_yen, COALESCE(NULLIF(sex, ''), 'Unknown') AS sex, birth_year,
  COALESCE(NULLIF(peak, 0), NULLIF(birth_year, 0) + 4, 2015)::INTEGER AS peak_year, COALESCE(NULLIF(color, ''), 'Unknown') AS color, COALESCE(NULLIF(h.sire, ''), 'Unknown') AS sire, dam, dam_sire, COALESCE(grp, 'Other Sires') AS sire_group,
  round_even(100 * COALESCE(fx, 0), 3) AS inbreeding_fx_pct, COALESCE(crosses, 'Outcross') AS inbreeding_crosses
  FROM horses h LEFT JOIN hpr ON hpr.node = runner LEFT JOIN hdeg ON hdeg.node = runner LEFT JOIN hstat USING (runner) LEFT JOIN hfx ON hfx.horse = runner LEFT JOIN {_GROUPS} ON g.sire = h.sire)"""
_ERA = "CASE WHEN peak_year <= 0 THEN 'Unknown' " + " ".join(f"WHEN peak_year <= {y} THEN '{label}'" for y, label in S.ERAS.items()) + f" ELSE '{S.LAST_ERA}' END AS era"


def metadata(s, d) -> DataFrame:
    """One row for each horse: its 22 attributes and era; results, ranks and inbreeding that are missing count 0. Stored, since much is made from it."""
    ran = B.ran(s, d)
    degrees = G.met_degree(ran)
    ranks = G.pagerank(G.prestige(G.meetings(ran)), degrees)
    crossed = G.crosses(B.paths(s, d)).groupBy(F.col("horse").alias("runner")).agg(
        F.sum("share").alias("fx"), S.first_three(F.collect_list(S.cross_text(F.col("ancestor"), F.length("s"), F.length("d"), 100 * F.col("share")))).alias("crosses"))
    stats = horse_stats(s, d).drop("half").withColumnRenamed("peak_year", "peak")
    out = B.horses(s, d)
    for more in (stats, crossed, degrees.withColumnRenamed("node", "runner"), ranks.withColumnRenamed("node", "runner")):
        out = out.hint("merge").join(more, "runner", "left")  # none of them is small, though what they are made from may be
    zero = lambda c: F.coalesce(c, F.lit(0))
    count = lambda c, name: zero(F.col(c)).cast("long").alias(name)
    rank, sire = F.coalesce("rank", F.lit(0.0)), S.or_unknown(F.col("sire"))
    out = out.select(
        F.col("runner").alias("horse_name"), S.round_even(rank, 12).alias("pagerank_raw"), S.round_even(rank * 10000, 4).alias("pagerank_scaled"), S.round_even(F.coalesce("degree", F.lit(0.0)), 2).alias("weighted_degree"),
        count("starts", "graded_starts"), count("wins", "graded_wins"), count("g1_wins", "g1_wins"), count("g1_seconds", "g1_seconds"), count("g1_podiums", "g1_podiums"), count("podiums", "graded_podiums"),
        F.col("total_earnings").alias("total_earnings_yen"), S.round_even(F.col("total_earnings") / 1e6, 2).alias("total_earnings_m_yen"), S.or_unknown(F.col("sex")).alias("sex"), "birth_year", S.peak_year(F.col("peak"), F.col("birth_year")).alias("peak_year"),
        S.or_unknown(F.col("color")).alias("color"), sire.alias("sire"), S.or_unknown(F.col("dam")).alias("dam"), S.or_unknown(F.col("dam_sire")).alias("dam_sire"), S.sire_group(sire).alias("sire_group"),
        S.round_even(100 * F.coalesce("fx", F.lit(0.0)), 3).alias("inbreeding_fx_pct"), F.coalesce("crosses", F.lit("Outcross")).alias("inbreeding_crosses"))
    return G.stored(out.withColumn("era", S.era(F.col("peak_year"))))


@query(_META + f" SELECT *, {_ERA} FROM meta")
def horse_metadata(s, d):
    """The horse table."""
    return metadata(s, d)


_RANKED = _META + ", numbered AS (SELECT ROW_NUMBER() OVER (ORDER BY pagerank_raw DESC, horse_name)::BIGINT AS pagerank_rank, * FROM meta)"


def ranking(s, d) -> DataFrame:
    """The horse table with rank numbers by falling PageRank, then name."""
    return G.ranked(metadata(s, d), "pagerank_raw", "horse_name", "pagerank_rank")


@query(_RANKED + f" SELECT * EXCLUDE (total_earnings_yen, color), {_ERA} FROM numbered")
def pagerank_full_ranking(s, d):
    return ranking(s, d).drop("total_earnings_yen", "color")


_SLICE = " SELECT pagerank_rank, horse_name, graded_starts, graded_podiums, g1_podiums FROM numbered WHERE {} ORDER BY pagerank_rank LIMIT 50"


@query(_RANKED + _SLICE.format("graded_wins = 0 AND graded_podiums >= 2"))
def underdog_diamonds(s, d):
    """The first 50 by rank without a win but with two podiums."""
    return ranking(s, d).where("graded_wins = 0 AND graded_podiums >= 2").orderBy("pagerank_rank").limit(50).select("pagerank_rank", "horse_name", "graded_starts", "graded_podiums", "g1_podiums")


@query(_RANKED + _SLICE.format("g1_wins = 0 AND g1_podiums >= 2"))
def silver_collectors(s, d):
    """The first 50 by rank without a G1 win but with two G1 podiums."""
    return ranking(s, d).where("g1_wins = 0 AND g1_podiums >= 2").orderBy("pagerank_rank").limit(50).select("pagerank_rank", "horse_name", "graded_starts", "graded_podiums", "g1_podiums")


@query(_RANKED + ", best AS (SELECT horse_name FROM numbered WHERE pagerank_rank <= 150) SELECT src, dst, round_even(weight, 2) AS weight FROM hpres WHERE weight >= 0.5 AND src IN (FROM best) AND dst IN (FROM best)")
def competition_subgraph(s, d):
    """Edges from loser to winner among the 150 horses of the highest rank."""
    best = G.top(metadata(s, d), "pagerank_raw", ["horse_name"], 150).select(F.col("horse_name").alias("node"))
    ran = B.ran(s, d).join(F.broadcast(G.stored(best).withColumnRenamed("node", "runner")), "runner", "left_semi")
    edges = G.prestige(G.meetings(ran)).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    return G.induced(edges, best, 0.5).select(F.col("a").alias("src"), F.col("b").alias("dst"), S.round_even(F.col("weight"), 2).alias("weight"))


_ELITE = _META + """, elite AS (SELECT horse_name FROM meta WHERE g1_wins >= 1 OR pagerank_scaled >= 3.0),
lin AS (SELECT DISTINCT t.ancestor AS src, CASE WHEN length(t.line) = 1 THEN t.horse ELSE c.ancestor END AS dst, CASE WHEN t.line LIKE '%S' THEN 'Sire Line' ELSE 'Dam Line' END AS relation, length(t.line)::INTEGER AS generation_step
  FROM tree t LEFT JOIN tree c ON c.horse = t.horse AND c.line = left(t.line, -1) WHERE length(t.line) <= 3 AND t.horse IN (FROM elite)),
lineage AS (SELECT *, (CASE generation_step WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM lin WHERE dst IS NOT NULL AND src <> dst)"""


def lineage(s, d) -> tuple[DataFrame, DataFrame]:
    """(nodes with their table row and role, edges from ancestor to descendant) of three generations of the elite."""
    meta = metadata(s, d)
    elite = meta.where("g1_wins >= 1 OR pagerank_scaled >= 3.0").select(F.col("horse_name").alias("horse"))
    edges = G.lineage(B.paths(s, d, 3, elite), 3)
    nodes = B.paths(s, d, 1, elite).where(F.size("paths") > 0).select(F.col("horse").alias("node"))
    for c in ("src", "dst"):
        nodes = nodes.unionByName(edges.select(F.col(c).alias("node")))
    return G.lineage_nodes(nodes.distinct(), meta, progeny(s, d)), edges


@query(_ELITE + " SELECT * FROM lineage")
def lineage_edges(s, d):
    return lineage(s, d)[1]


@query(_ELITE + f""", {_EDGES}, born AS (SELECT parent, COUNT(*) AS n FROM edges GROUP BY parent), ln AS (SELECT src AS node FROM lineage UNION SELECT dst FROM lineage UNION SELECT horse_name FROM elite WHERE horse_name IN (SELECT horse FROM tree))
SELECT node, CASE WHEN horse_name IS NOT NULL THEN CASE WHEN g1_wins > 0 THEN 'G1 Champion' ELSE 'Graded Contender' END WHEN n >= 10 THEN 'Foundation Sire/Dam' ELSE 'Ancestor' END AS node_role, COALESCE(g1_wins, 0)::BIGINT AS g1_wins, COALESCE(graded_wins, 0)::BIGINT AS graded_wins,
COALESCE(total_earnings_m_yen, 0) AS earnings_m_yen, COALESCE(pagerank_scaled, 1.0) AS pagerank_score, COALESCE(n, 0)::BIGINT AS progeny_in_dag, COALESCE(sire_group, 'Foundation Bloodline') AS sire_group, COALESCE(inbreeding_fx_pct, 0) AS inbreeding_fx_pct
FROM ln LEFT JOIN meta ON horse_name = node LEFT JOIN born ON parent = node""")
def lineage_nodes(s, d):
    return lineage(s, d)[0]


@query(_META + """, jh AS (SELECT jockey, runner, SUM(weight) AS w FROM ran GROUP BY 1, 2), jt AS (SELECT jockey, stable, SUM(weight) AS w FROM ran GROUP BY 1, 2),
th AS (SELECT * FROM jh ORDER BY w DESC, jockey, runner LIMIT 250), tt AS (SELECT * FROM jt ORDER BY w DESC, jockey, stable LIMIT 150)
SELECT 'Jockey: ' || jockey AS node, 'Jockey' AS entity_type, ROUND(SUM(w), 6) AS size_metric FROM jh WHERE jockey IN (SELECT jockey FROM th UNION SELECT jockey FROM tt) GROUP BY jockey
UNION ALL SELECT DISTINCT 'Horse: ' || runner, 'Horse', ROUND(COALESCE(pagerank_scaled, 2.0) * 10, 6) FROM th LEFT JOIN meta ON horse_name = runner
UNION ALL SELECT 'Trainer: ' || stable, 'Trainer', ROUND(SUM(w), 6) FROM jt WHERE stable IN (SELECT stable FROM tt) GROUP BY stable""")
def tripartite_nodes(s, d):
    """The nodes of the best ties of jockeys with horses and trainers, sized by all their ties, horses by their rank."""
    jh, jt = G.ties(B.ran(s, d), "jockey", "runner", "weight"), G.ties(B.ran(s, d), "jockey", "stable", "weight")
    th, tt = G.top(jh, "weight", ["jockey", "runner"], 250), G.top(jt, "weight", ["jockey", "stable"], 150)
    node = lambda kind, c, size: [F.concat(F.lit(f"{kind}: "), F.col(c).cast("string")).alias("node"), F.lit(kind).alias("entity_type"), F.round(size, 6).alias("size_metric")]
    riders = th.select("jockey").union(tt.select("jockey")).distinct()
    jockeys = G.strength(jh, "jockey").withColumnRenamed("node", "jockey").join(riders, "jockey", "left_semi").select(*node("Jockey", "jockey", F.col("strength")))
    horses = th.select("runner").distinct().join(metadata(s, d), F.col("runner") == F.col("horse_name"), "left").select(*node("Horse", "runner", F.coalesce("pagerank_scaled", F.lit(2.0)) * 10))
    trainers = G.strength(jt, "stable").withColumnRenamed("node", "stable").join(tt.select("stable"), "stable", "left_semi").select(*node("Trainer", "stable", F.col("strength")))
    return jockeys.unionByName(horses).unionByName(trainers)


# the upper tail of chi-square by its cube root, through the normal integral as a power series
_TAIL = """(SELECT CASE WHEN xx <= 0 OR kk <= 0 THEN 1.0 WHEN zz > 5.5 THEN 0.0 WHEN zz < -5.5 THEN 1.0 ELSE 0.5 - list_sum(list_transform(range(90), lambda i: pow(-1.0, i) * pow(zz, 2 * i + 1) / (pow(2.0, i) * gamma(i + 1) * (2 * i + 1)))) / sqrt(2 * pi()) END
  FROM (SELECT xx, kk, (pow(xx / kk, 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * kk))) / sqrt(2.0::DOUBLE / (9 * kk)) AS zz FROM (SELECT greatest(({0})::DOUBLE, 1e-300) AS xx, ({1})::DOUBLE AS kk)))"""


def _chi_sql(name: str, col: str) -> str:
    return f"""{name}c AS (SELECT r.sire, c.v, COALESCE(n, 0) AS n, rt, ct, SUM(COALESCE(n, 0)) OVER () AS t FROM (SELECT sire, COUNT(*) AS rt FROM sub GROUP BY 1) r CROSS JOIN (SELECT {col} AS v, COUNT(*) AS ct FROM sub GROUP BY 1) c
  LEFT JOIN (SELECT sire, {col} AS v, COUNT(*) AS n FROM sub GROUP BY 1, 2) m ON m.sire = r.sire AND m.v = c.v),
{name} AS (SELECT SUM(pow(n - rt * ct / t::DOUBLE, 2) / (rt * ct / t::DOUBLE)) AS x, (COUNT(DISTINCT sire) - 1) * (COUNT(DISTINCT v) - 1) AS k, MAX(t) * (LEAST(COUNT(DISTINCT sire), COUNT(DISTINCT v)) - 1) AS m FROM {name}c)"""


def _groups_sql(name: str, rows: str) -> str:
    return f"""{name}v AS (SELECT * FROM ({rows}) QUALIFY COUNT(*) OVER (PARTITION BY sire) >= 5), {name}g AS (SELECT sire, COUNT(*) AS n, SUM(v) AS s, SUM(v * v) AS q FROM {name}v GROUP BY sire),
{name}a AS (SELECT k - 1 AS db, n - k AS dw, (b / (k - 1)) / (w / (n - k)) AS f, b / (b + w) AS eta FROM (SELECT COUNT(*) AS k, SUM(n) AS n, SUM(s * s / n::DOUBLE) - SUM(s) * SUM(s) / SUM(n)::DOUBLE AS b, SUM(q) - SUM(s * s / n::DOUBLE) AS w FROM {name}g)),
{name}k AS (SELECT 12.0::DOUBLE / (SUM(n) * (SUM(n) + 1)) * SUM(r * r / n) - 3 * (SUM(n) + 1) AS h FROM (SELECT COUNT(*) AS n, SUM(r) AS r FROM (SELECT sire, RANK() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM {name}v) GROUP BY sire))"""


def _top_sires(s, d) -> DataFrame:
    """The 15 sires with most finishers."""
    rows = B.ran(s, d).where("position < 90").join(B.horses(s, d).where("sire <> ''").select("runner", "sire"), "runner")
    return G.top(rows.groupBy("sire").agg(F.count("*").alias("n")), "n", ["sire"], 15).select("sire")


_BAND = "CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1600 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END"


@query(_META + f""", fin AS (SELECT ran.*, sire FROM ran JOIN horses USING (runner) WHERE position < 90 AND sire <> ''), top15 AS (SELECT sire FROM fin GROUP BY sire ORDER BY COUNT(*) DESC, sire LIMIT 15),
sub AS (SELECT *, {_BAND} AS band FROM fin WHERE sire IN (FROM top15) AND surface IN ('Turf', 'Dirt')), {_chi_sql("cs", "surface")}, {_chi_sql("cd", "band")},
{_groups_sql("wd", "SELECT sire, distance::DOUBLE AS v FROM sub WHERE position = 1")}, {_groups_sql("pr", "SELECT sire, pagerank_scaled AS v FROM meta WHERE sire IN (FROM top15)")}
SELECT 'sire by surface' AS test, ROUND(x, 4) AS stat, k::BIGINT AS dof, ROUND(sqrt(x / m), 6) AS effect, ROUND({_TAIL.format("x", "k")}, 6) AS p FROM cs
UNION ALL SELECT 'sire by distance', ROUND(x, 4), k::BIGINT, ROUND(sqrt(x / m), 6), ROUND({_TAIL.format("x", "k")}, 6) FROM cd
UNION ALL SELECT 'anova of winning distance', ROUND(f, 4), db::BIGINT, ROUND(eta, 6), ROUND({_TAIL.format("f * db", "db")}, 6) FROM wda
UNION ALL SELECT 'kruskal of winning distance', ROUND(h, 4), db::BIGINT, ROUND(eta, 6), ROUND({_TAIL.format("h", "db")}, 6) FROM wda, wdk
UNION ALL SELECT 'anova of pagerank', ROUND(f, 4), db::BIGINT, ROUND(eta, 6), ROUND({_TAIL.format("f * db", "db")}, 6) FROM pra
UNION ALL SELECT 'kruskal of pagerank', ROUND(h, 4), db::BIGINT, ROUND(eta, 6), ROUND({_TAIL.format("h", "db")}, 6) FROM pra, prk""")
def hypothesis_tests(s, d):
    """The six tests over the 15 sires with most finishers: statistic, degrees of freedom, effect size and p."""
    top = _top_sires(s, d)
    horses = B.horses(s, d).select("runner", "sire").join(F.broadcast(top), "sire", "left_semi")
    sub = B.ran(s, d).where("position < 90 AND surface IN ('Turf', 'Dirt')").join(horses, "runner").withColumn("band", S.distance_band(F.col("distance"), True))
    sub = G.stored(sub.select("sire", "surface", "band", "position", F.col("distance").cast("double").alias("distance")))
    out = []
    for name, col in (("sire by surface", "surface"), ("sire by distance", "band")):
        r = T.with_p(T.chi2_independence(sub, "sire", col)).head()
        out.append((name, r["chi2"], r["dof"], r["cramers_v"], r["p"]))
    ranks = metadata(s, d).join(F.broadcast(top), "sire", "left_semi").select("sire", "pagerank_scaled")
    for name, rows, col in (("winning distance", sub.where("position = 1"), "distance"), ("pagerank", ranks, "pagerank_scaled")):
        r = T.anova_kruskal(rows, "sire", col).head()
        out += [(f"anova of {name}", r["f"], r["df_between"], r["eta2"], r["p_anova"]), (f"kruskal of {name}", r["h"], r["df_between"], r["eta2"], r["p_kruskal"])]
    done = s.createDataFrame(out, "test string, stat double, dof long, effect double, p double")
    return done.select("test", F.round("stat", 4).alias("stat"), "dof", F.round("effect", 6).alias("effect"), F.round("p", 6).alias("p"))


@query(_META + """, v AS (SELECT pagerank_scaled AS x, graded_podiums::DOUBLE AS a, total_earnings_m_yen AS b FROM meta WHERE graded_starts >= 1),
k AS (SELECT *, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, RANK() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM v)
SELECT 'podiums' AS other, ROUND(corr(x, a), 6) AS pearson, ROUND(corr(rx, ra), 6) AS spearman FROM k UNION ALL SELECT 'earnings', ROUND(corr(x, b), 6), ROUND(corr(rx, rb), 6) FROM k""")
def pagerank_correlations(s, d):
    rows, out = metadata(s, d).where("graded_starts >= 1").withColumn("graded_podiums", F.col("graded_podiums").cast("double")), None
    for name, col in (("podiums", "graded_podiums"), ("earnings", "total_earnings_m_yen")):
        row = T.correlations(rows, "pagerank_scaled", col).select(F.lit(name).alias("other"), F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))
        out = row if out is None else out.unionByName(row)
    return out


CLUSTER = ["turf_share_pct", "avg_distance_m", "win_rate_pct", "podium_rate_pct", "g1_win_share_pct", "mean_progeny_pagerank"]
# What tells the four kinds of sires apart, taken one after another, and their names
ARCHETYPES = [
    ("g1_wins", "Cluster C: Elite Classic & G1 Turf Dynasties", True), ("turf_share_pct", "Cluster A: Dirt & Sand Power Specialists", False),
    ("avg_distance_m", "Cluster B: Speed & Mile Turf Sires", False), ("avg_distance_m", "Cluster D: Classic Stayers & Long-Distance Sires", True),
]


@query(_META + """, spec AS (SELECT sire, COUNT(*) FILTER (position = 1 AND grade = 'G1')::BIGINT AS g1_wins, COUNT(*) FILTER (position = 1) AS wins, ROUND(100.0::DOUBLE * COUNT(*) FILTER (surface = 'Turf') / COUNT(*), 1) AS turf_share_pct, ROUND(AVG(distance), 1) AS avg_distance_m,
ROUND(100.0::DOUBLE * COUNT(*) FILTER (position = 1) / COUNT(*), 2) AS win_rate_pct, ROUND(100.0::DOUBLE * COUNT(*) FILTER (position <= 3) / COUNT(*), 2) AS podium_rate_pct FROM ran JOIN pedigree USING (runner) WHERE position < 90 AND sire <> '' GROUP BY sire HAVING COUNT(*) >= 50)
SELECT sire, g1_wins, turf_share_pct, avg_distance_m, win_rate_pct, podium_rate_pct, CASE WHEN wins > 0 THEN round_even(100.0::DOUBLE * g1_wins / wins, 2) ELSE 0.0 END AS g1_win_share_pct, round_even(COALESCE(m, 1.2), 3) AS mean_progeny_pagerank
FROM spec LEFT JOIN (SELECT sire, AVG(pagerank_scaled) AS m FROM meta GROUP BY sire) USING (sire)""")
def sire_features(s, d):
    """What sires are grouped by; sires whose progeny have no rank get 1.2, those without wins a G1 share of 0."""
    means = metadata(s, d).groupBy("sire").agg(F.avg("pagerank_scaled").alias("m"))
    share = F.when(F.col("wins") > 0, S.round_even(100.0 * F.col("g1_wins") / F.col("wins"), 2)).otherwise(0.0)
    rows = sire_specialisation(s, d).join(means, "sire", "left")
    return rows.select("sire", "g1_wins", *CLUSTER[:4], share.alias(CLUSTER[4]), S.round_even(F.coalesce("m", F.lit(1.2)), 3).alias(CLUSTER[5]))


def _scaled_sires(s, d) -> DataFrame:
    raw = sire_features(s, d)
    return M.zscores(raw, CLUSTER)


@query()
def sire_clusters(s, d):
    """Four kinds of sires with their place in the plane and the variance that this shows; kinds are named by their raw means."""
    raw = G.stored(sire_features(s, d))
    placed, shares = M.pca2(M.zscores(raw, CLUSTER), CLUSTER)
    out = M.kmeans(placed, CLUSTER, 4).select("sire", "cluster", "pc1", "pc2").join(raw, "sire")
    names = M.centroid_names(out, "cluster", ARCHETYPES)
    return out.join(F.broadcast(names), "cluster").withColumns({f"variance{k}": F.lit(float(v)) for k, v in enumerate(shares, 1)})


@query()
def sire_k_sweep(s, d):
    """The silhouette of 2 to 7 clusters of sires."""
    z, out = G.stored(_scaled_sires(s, d)), None
    for k in range(2, 8):
        row = M.silhouette(M.kmeans(z, CLUSTER, k).withColumn("x", F.array(*CLUSTER)), "sire", "x", "cluster").select(F.lit(k).alias("k"), "silhouette")
        out = row if out is None else out.unionByName(row)
    return out


FEATURES = [
    "jockey_rate", "horse_rate", "trainer_rate", "sire_surface_affinity", "sire_distance_affinity", "sire_rate", "damsire_rate", "age", "weight_kg", "mass_kg", "num_runners", "distance", "grade_weight", "prior_starts", "fx_pct", "is_turf", "is_female",
]
_RATES = [("horse_rate", "runner", 3), ("jockey_rate", "jockey", 15), ("trainer_rate", "stable", 15), ("sire_rate", "sire", 20), ("damsire_rate", "dam_sire", 20), ("sire_surface_affinity", "ss", 15), ("sire_distance_affinity", "sd", 15)]
_PRIOR = ", ".join(f"ROUND((COALESCE(SUM(y) OVER {k}, 0) + {w} * 0.2::DOUBLE) / (COUNT(*) OVER {k} + {w}), 9) AS {n}" for n, k, w in _RATES)
_FRAMES = ", ".join(f"{k} AS (PARTITION BY {k} ORDER BY year, race, runner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for _, k, _ in _RATES)


@query(f""", {_CROSS}, base AS (SELECT ran.*, COALESCE(NULLIF(sire, ''), 'Unknown') AS sire, dam_sire, sex, birth_year, (position <= 3)::INTEGER AS y, COUNT(*) OVER (PARTITION BY race) AS num_runners FROM ran JOIN horses USING (runner)),
keyed AS (SELECT *, sire || '_' || surface AS ss, sire || '_' || {_BAND} AS sd FROM base)
SELECT race, runner, year, y, {_PRIOR}, (CASE WHEN birth_year > 0 THEN year - birth_year END)::DOUBLE AS age, (50 + jockey % 9 + 0.5)::DOUBLE AS weight_kg, (CASE WHEN runner % 10 < 9 THEN 400 + runner % 100 END)::DOUBLE AS mass_kg,
num_runners::DOUBLE AS num_runners, distance::DOUBLE AS distance, weight AS grade_weight, (ROW_NUMBER() OVER (PARTITION BY runner ORDER BY year, race) - 1)::DOUBLE AS prior_starts,
ROUND(100 * COALESCE(fx, 0), 3) AS fx_pct, (surface = 'Turf')::INTEGER::DOUBLE AS is_turf, (sex = 'Female')::INTEGER::DOUBLE AS is_female
FROM keyed LEFT JOIN (SELECT horse AS runner, SUM(share) AS fx FROM cross2 GROUP BY horse) USING (runner) WINDOW {_FRAMES}""")
def race_features(s, d):
    """The 17 features of each start, rates from earlier starts only; weights and masses come from texts as tables have them."""
    horses = B.horses(s, d).select("runner", S.or_unknown(F.col("sire")).alias("sire"), "dam_sire", "sex", "birth_year")
    sizes = B.entries(s, d).groupBy("race").agg(F.count("*").cast("double").alias("num_runners"))
    fx = G.inbreeding(B.paths(s, d)).select(F.col("horse").alias("runner"), F.round(100 * F.col("fx"), 3).alias("fx_pct"))
    rows = B.ran(s, d).join(horses, "runner").join(sizes, "race").join(fx, "runner", "left")
    rows = rows.withColumns({
        "y": S.indicator(F.col("position") <= 3), "ss": S.joined_key(F.col("sire"), F.col("surface")), "sd": S.joined_key(F.col("sire"), S.distance_band(F.col("distance"), True)), "age": F.when(F.col("birth_year") > 0, F.col("year") - F.col("birth_year")).cast("double"),
        "weight_kg": S.number(F.concat((50 + F.col("jockey") % 9).cast("string"), F.lit(".5kg"))), "mass_kg": S.body_mass(F.when(F.col("runner") % 10 < 9, F.concat((400 + F.col("runner") % 100).cast("string"), F.lit("Kg(+2)"))).otherwise("-")),
        "distance": F.col("distance").cast("double"), "grade_weight": F.col("weight"), "fx_pct": F.coalesce("fx_pct", F.lit(0.0)), "is_turf": S.indicator(F.col("surface") == "Turf").cast("double"), "is_female": S.indicator(F.col("sex") == "Female").cast("double")})
    order = ["year", "race", "runner"]
    rows = base = G.stored(rows)  # else the count of rows by key makes all rates before it again
    for name, key, w in _RATES:
        rows = R.prior_rate(rows, key, "y", order, w, name, counted=base)
    rows = R.prior_count(rows, "runner", order, "prior_starts", counted=base).withColumn("prior_starts", F.col("prior_starts").cast("double"))
    return rows.select("race", "runner", "year", "y", *[F.round(c, 9).alias(c) if c.endswith(("_rate", "_affinity")) else F.col(c) for c in FEATURES])


def _split(s, d) -> tuple[DataFrame, DataFrame]:
    """(train, test), filled and scaled by the training years alone."""
    parts = M.temporal_split(G.stored(race_features(s, d)), "year", 1998, 1999)
    fill = lambda k: M.medians_filled(parts[k], FEATURES, parts["train"])
    train = fill("train")
    return G.stored(M.zscores(train, FEATURES, train)), G.stored(M.zscores(fill("test"), FEATURES, train))


@query()
def classifiers(s, d):
    """Out-of-time scores of the constant, the linear model, one tree and the forest of 45, with areas under both curves."""
    train, test = _split(s, d)
    models = {"logistic": M.logistic(train, FEATURES, "y"), "tree": M.tree(train, FEATURES, "y"), "forest": M.forest(train, FEATURES, "y")}
    scored = test.withColumn("baseline", F.lit(train.agg(F.avg("y")).head()[0] or 0.0))
    for name, model in models.items():
        scored = M.scored(model, scored, FEATURES, name)
    scored, out = G.stored(scored.withColumn("key", F.concat_ws("/", "race", "runner"))), None
    for m in ("baseline", *models):
        row = T.binary_metrics(scored, "y", m, 0.5 if m == "baseline" else 0.52).crossJoin(T.roc_auc(scored, "y", m)).crossJoin(T.average_precision(scored, "y", m, "key")).withColumn("model", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def feature_importances(s, d):
    """What the forest's splits and the linear model's weights make of each feature."""
    train, _ = _split(s, d)
    return M.importances(s, FEATURES, M.forest(train, FEATURES, "y"), M.logistic(train, FEATURES, "y"))
