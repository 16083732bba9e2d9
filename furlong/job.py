"""The batch job: races and pedigrees from landed pages, the audit, the repaired tables and the exports.

    python -m furlong.job --pages PAGES --out OUT [--start-year Y] [--end-year Y] [--grades G1,G2,G3] [--skip-pedigree] [--analyze]

PAGES has Parquet tables index (year, url, html), results (race_id, html) and pedigrees (horse_id, horse_name, html); fetching
them is not part of this job. OUT gets the tables of the model as Parquet and, with --analyze, the graph's tables.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import quality as Q
from .operators import relational as R
from .sources import html


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--pages", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--start-year", type=int, default=2002)
    p.add_argument("--end-year", type=int, default=2025)
    p.add_argument("--grades", default="G1,G2,G3", help="grades to keep; races whose name says none are kept too")
    p.add_argument("--skip-races", action="store_true")
    p.add_argument("--skip-pedigree", action="store_true")
    p.add_argument("--max-horses", type=int, help="pedigrees to take, for trials")
    p.add_argument("--analyze", action="store_true")
    p.add_argument("--test", action="store_true", help="one year and twenty pedigrees")
    out = p.parse_args(args)
    if out.test:
        out.start_year = out.end_year = 2005
        out.max_horses = 20
    return out


def races(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(races, entries) of the years and grades asked for; a race that is listed twice counts once."""
    pages = spark.read.parquet(f"{o.pages}/index").where(F.col("year").between(o.start_year, o.end_year))
    links = pages.select("year", F.col("url").alias("page"), "html").lateralJoin(html.ParseIndex(F.col("html").outer(), F.col("page").outer()))
    found = html.races_of(links.drop("html", "page"), F.col("year")).where(F.col("grade").isin(*o.grades.split(","), ""))
    found = R.keep_first(found, ["race_id"], ["url"])
    results = spark.read.parquet(f"{o.pages}/results").join(found.select("race_id"), "race_id", "left_semi")
    boxes = results.lateralJoin(html.ParseConditions(F.col("html").outer())).select("race_id", *[c.alias(n) for n, c in html.conditions(F.col("conditions")).items()])
    entries = results.lateralJoin(html.ParseResult(F.col("html").outer())).drop("html")
    entries = R.keep_first(entries, ["race_id", "horse_name"], ["position", "horse_id"])
    return Q.completed_races(found.join(boxes, "race_id", "left").withColumn("distance", F.col("distance").cast("string")), ["year", "race_id"]), Q.realigned_rows(entries)


def pedigrees(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    pages = spark.read.parquet(f"{o.pages}/pedigrees")
    if o.max_horses is not None:
        pages = pages.orderBy("horse_id").limit(o.max_horses)
    tree = pages.lateralJoin(html.ParsePedigree(F.col("html").outer())).drop("html")
    return tree, html.two_generations(tree, ["horse_id", "horse_name"])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Runs the job; returns the audit's verdict if races were read."""
    o = options(args)
    spark = spark or SparkSession.builder.appName("furlong").getOrCreate()
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{o.out}/{name}")
    verdict = None
    if not o.skip_races:
        r, e = races(spark, o)
        save(r, "races"), save(e, "race_entries")
        r, e = (spark.read.parquet(f"{o.out}/{n}") for n in ("races", "race_entries"))
        issues = Q.audit(Q.empty_table(r, "races"), Q.empty_table(e, "race_entries"), Q.few_races(r, "year"), Q.few_runners(r, e, "race_id"), Q.duplicates(r, "url", "duplicate_url"), Q.blank_fields(r, ["race_name", "year"], "races"))
        save(issues, "issues")
        verdict = Q.verdict(issues)
    if not o.skip_pedigree:
        tree, parents = pedigrees(spark, o)
        save(tree, "pedigree_tree"), save(parents, "pedigree")
    if o.analyze:
        e, r = spark.read.parquet(f"{o.out}/race_entries"), spark.read.parquet(f"{o.out}/races")
        met = G.meetings(e.join(r.select("race_id", F.col("grade_weight").alias("w")), "race_id").select(F.col("race_id").alias("race"), F.col("horse_name").alias("runner"), "position", F.col("w").alias("weight")))
        nodes = e.select(F.col("horse_name").alias("node")).distinct()
        save(G.pagerank(G.prestige(met), nodes), "pagerank"), save(G.degree(G.undirected(met), nodes), "degree")
    return verdict


if __name__ == "__main__":
    main()
