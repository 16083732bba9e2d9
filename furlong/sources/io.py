"""Readers and writers."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A byte order mark before the first header is skipped."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """With a byte order mark before the first header name of each file."""
    names = df.columns
    named = df.withColumnRenamed(names[0], ("﻿" if mark else "") + names[0])
    named.write.csv(path, header=True, escape='"')


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")))


def write_dictionary(table: DataFrame, path: str) -> None:
    """(key, value) rows as one flat JSON object; it becomes one value, so this is for dictionaries that fit into a task."""
    one = table.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))).alias("value"))
    one.coalesce(1).write.text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.coalesce(1).write.json(path)


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes of code page 932 as text; what cannot be read is replaced."""
    return content.map(lambda b: None if b is None else bytes(b).decode("cp932", "replace"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("html"))


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False, ends: tuple[str, str] = ("a", "b"), most: int = 5000, most_edges: int = 200_000) -> None:
    """A graph file on the driver, for the top-N graphs that are drawn; fails beyond `most` nodes or most_edges edges. nodes:
    (node, ...), edges: (ends, weight, ...); all further columns become attributes with their types."""
    points, ties = (df.limit(limit + 1).collect() for df, limit in ((nodes, most), (edges, most_edges)))
    for what, rows, limit in (("nodes", points, most), ("edges", ties, most_edges)):
        if len(rows) > limit:
            raise ValueError(f"more than {limit} {what}")
    kind = {"string": "string", "int": "integer", "bigint": "long", "boolean": "boolean"}

    def attributes(df: DataFrame, known: set[str]) -> list[str]:
        return [c for c in df.columns if c not in known]

    def head(what: str, df: DataFrame, names: list[str]) -> str:
        return f'<attributes class="{what}">' + "".join(f'<attribute id="{k}" title={quoteattr(c)} type="{kind.get(dict(df.dtypes)[c], "double")}"/>' for k, c in enumerate(names)) + "</attributes>\n"

    def values(row: Row, names: list[str]) -> str:
        return "<attvalues>" + "".join(f'<attvalue for="{k}" value={quoteattr(str(row[c]))}/>' for k, c in enumerate(names) if row[c] is not None) + "</attvalues>"

    own, tied = attributes(nodes, {"node"}), attributes(edges, {*ends, "weight"})
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="{"directed" if directed else "undirected"}">\n')
        f.write(head("node", nodes, own) + head("edge", edges, tied) + "<nodes>\n")
        f.writelines(f"<node id={quoteattr(str(r['node']))} label={quoteattr(str(r['node']))}>{values(r, own)}</node>\n" for r in points)
        f.write("</nodes>\n<edges>\n")
        f.writelines(f'<edge id="{k}" source={quoteattr(str(r[ends[0]]))} target={quoteattr(str(r[ends[1]]))} weight="{r["weight"]}">{values(r, tied)}</edge>\n' for k, r in enumerate(ties))
        f.write("</edges></graph></gexf>\n")
