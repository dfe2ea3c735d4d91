"""A corpus pipeline over the ``documents`` table: five stages, each by one operator of asofgraph.llm.

Language identification and the quality classifier drop what they reject, the n-gram join keeps the
row of the smallest doc_id (null last) of each group of near-duplicates, mixing repeats or drops documents until every
source has its target, and packing puts what is left into bins. Each stage works on all rows that
the one before has kept; all but the last return the columns of ``documents``, the last one row a
packed piece (shard, bin, doc_id, piece, words, start, source, cluster). Nulls, ties and empty
tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm import cotraining, langid, mixing, ngram_join, packing
from asofgraph.llm.common import materialize, read_table, remove

#: The column that numbers the rows of a stage; no column of ``documents`` may have this name.
ROW = "_corpus_row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a number of their own, so repeated and null doc_ids lose and keep nothing more than others."""
    names = docs.columns
    numbered = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    found = ngram_join.jaccard_components(numbered.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    groups = found.join(found.filter(f"component_id <> {ROW}").select("component_id").distinct(), "component_id")
    groups = materialize(groups.join(numbered.select(ROW, "doc_id"), ROW), "groups")  # members of groups of two and more
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    dropped = groups.join(first, "component_id").filter(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW)
    dropped = materialize(dropped, "dropped")  # a table of known size: few numbers needn't shuffle the texts
    return numbered.join(dropped, ROW, "left_anti").select(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The learned stages and the greedy packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            remove(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
