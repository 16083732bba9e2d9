"""A training corpus in five stages: quality, exact dedup, near dedup, mixing, tokens.

Each stage takes all rows of its predecessor, written as Parquet and read again, and all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bpe, common, exact_dedup, jaccard_join, mixing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled documents whose crc32 of the id mod 3 is not 1.

    A null text is scored as an empty one. Rows with null or repeated ids are judged each by its own text. Without labels of both
    kinds all rows have one score. An empty table gives an empty one. Other columns pass through, whatever their names.
    """
    model = quality.train(docs, common.read(spark, sf_dir, "labels"), common.crc_mod("_id", 3) != 1)
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null counts as empty.

    Of rows that repeat that id with the same text one stays. A row with a null id stays only where no row with an id has the
    text, and then one such row stays. Other columns pass through, whatever their names.
    """
    found = common.stored(exact_dedup.exact_dedup(docs))
    key = lambda sha: F.concat_ws(":", sha, F.col("doc_id").cast("string"))
    dropped, kept = (found.where(c).select(key(F.col("text_sha256")).alias("key")) for c in ("NOT kept", "kept"))
    return common.without(docs, key(F.sha2(F.coalesce("text", F.lit("")), 256)), dropped, kept)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id.

    Rows without a word link with nothing and stay, as do rows with a null id. Rows that repeat an id are one document and stay
    or go together. Other columns pass through, whatever their names.
    """
    found = common.stored(jaccard_join.jaccard_components(docs))
    return common.without(docs, "doc_id", found.where("component_id <> doc_id").select("doc_id"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, levelled between the sources as far as no document is needed more than 1.25 times on average.

    A null source is a source of its own. Rows without a word cost nothing. Rows stay in place: only
    places and counts of tokens are shuffled. Other columns pass through, whatever their names.
    """
    return mixing.mixed(docs, max_repeats=1.25)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    import public_tokenizers

    return bpe.bpe_encode(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("mixing sources", mixing_stage), ("byte-level BPE", tokens_stage)]

#: The classifier and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
