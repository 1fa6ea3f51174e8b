"""The corpus pipeline: quality, near duplicates, mixing, packing. Each stage is written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import mixing, ngram_join, packing, quality
from pagelathe.llm.common import as_long, scratch, table, written

#: A worker that packs has run the other stages too, so it remembers less than one that only packs.
MEMO_PIECES = 300_000
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier does not reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels")).select(DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the join on five words and a similarity of 0.8: that with the smallest doc_id.

    Documents without words are in no component with others, and stay. Rows with a null doc_id stay only where their
    component has no document with an id; there, and of rows that share an id and a text, one stays. Rows that share an
    id only are documents of their own.
    """
    with scratch(spark) as tables:
        found = ngram_join.linked_rows(docs, width=5, num=80, den=100)
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
        # rows of equal id and text share a class, so whether they go is one decision; only kept ones may be there twice
        marks = (
            found.where(F.col("n_shingles") > 0)
            .select("doc_id", "text_key", "n_equal", kept.alias("kept"))
            .where("NOT kept OR n_equal > 1")
            .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept")
            .count()
            .where("NOT kept OR count > 1")
        )
        marks = tables.keep(written(marks, "near-duplicates"))
    same = as_long("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    stays = docs.join(marks, same, "left_anti").select(DOCUMENTS)
    repeated = marks.where("kept")
    if repeated.isEmpty():
        return stays
    one = docs.join(repeated, same).groupBy("_id", "_key").agg(F.min(F.struct(DOCUMENTS)).alias("row"))
    return stays.union(one.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all."""
    mixed = mixing.mixed(docs)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, cast(copies AS int))"))).select(DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeats included, and their place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo_pieces=MEMO_PIECES)[1]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier's fit cannot be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
