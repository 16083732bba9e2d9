"""The pipeline's stages against a brute-force version of each decision."""

import os

import pytest

import corpus_pipeline
from furlong.llm import common, quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = common.read(spark, DATA, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, docs, DATA))
        was, now = docs.toPandas(), out.toPandas()
        if k < 4:
            assert out.columns == names
        if name == "quality classifier":
            model = quality.train(docs, common.read(spark, DATA, "labels"), common.crc_mod("_id", 3) != 1)
            kept = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
            assert set(now.doc_id) == kept and 0 < len(now) < len(was)
        elif name == "exact dedup":
            assert set(now.doc_id) == set(was.groupby(was.text.fillna("")).doc_id.max()) and now.doc_id.is_unique
        elif name == "n-gram Jaccard join":
            from test_llm import links

            want = {i for i, _, c in links(list(zip(was.doc_id.tolist(), was.text.tolist()))) if i == c}
            assert set(now.doc_id) == want
        elif name == "mixing sources":
            tokens = lambda f: f.text.str.split().str.len().sum()
            assert 0.9 * tokens(was) < tokens(now) <= tokens(was) and set(now.doc_id) <= set(was.doc_id)
        else:
            assert sorted(now.doc_id) == sorted(was.doc_id) and (now.n_tokens * 4 == now.ids.map(len)).all()
        docs = out


CLASHES = ["_hit", "_b", "_s", "_key", "row", "key", "hit", "s", "b", "id", "d", "i", "m", "c", "r", "n", "k", "component_id", "kept", "score", "x"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_clashing_columns(spark, k):
    """Nulls, empty and very long texts, ties, repeated rows and columns of any name."""
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(1, "A plain sentence stands here. " * 5, "s"), (1, "A plain sentence stands here. " * 5, "s"), (2, "A plain sentence stands here. " * 5, None), (3, None, "s"), (4, "", "s"), (None, "A null id has this text.", "s"), (None, "A null id has this text.", "s"), (5, long, "t"), (6, long + " end", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: spark_lit(f"was {c}") for c in CLASHES})
    name, stage = corpus_pipeline.STAGES[k]
    out = common.stored(stage(spark, docs, DATA))
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.select("doc_id").collect())
    if k < 4:
        assert out.columns == docs.columns
        assert all(r[c] == f"was {c}" for r in out.collect() for c in CLASHES)
    if name == "exact dedup":
        assert got == [-1, 2, 4, 5, 6]
    elif name == "n-gram Jaccard join":
        assert got == [-1, -1, 1, 1, 3, 4, 5]
    elif name == "byte-level BPE":
        assert got == [-1, -1, 1, 1, 2, 3, 4, 5, 6]
    assert stage(spark, docs.limit(0), DATA).count() == 0


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
