"""From documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import mixing, packing, pii, quality_rules, simhash
from tallyforge.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text is rejected;
    repeated rows are all kept or all rejected; without labels, or in an empty
    table, the base rules alone decide. Texts may be of any length."""
    return quality_rules.judged(docs, table(spark, sf_dir, "labels"), COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest
    doc_id; of rows that repeat it, the least by text and other columns. Rows
    without doc_id can't be named by a group: they stay, one for each text. All
    null and empty texts are one group. An empty table stays empty."""
    named = docs.where("doc_id is not null")
    groups = written(simhash.near_duplicates(named.select("doc_id", "text")), "pipeline-groups")
    first = groups.where(F.col("component_id") == F.col("doc_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    found = named.join(first, "doc_id")
    once = found.where("rows = 1").select(*COLUMNS)
    twice = found.where("rows > 1").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    nameless = docs.where("doc_id is null").groupBy("text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
    return once.unionByName(twice).unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "text", "r.*")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in text; n_chars is the new text's length, null for
    a null text. All rows stay, repeated ones too; an empty table stays empty."""
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that domains meet their targets.
    Repeated rows have equal posteriors, so one fate; texts without words have
    no say; without labels all are of one domain. An empty table stays empty."""
    return mixing.repeated(mixing.mixed(docs.select(*COLUMNS), table(spark, sf_dir, "labels")), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: every row is packed, a null or empty text
    as its end id; an empty table has none."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality_rules", quality), ("simhash_near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mix), ("packing", pack)]

#: Tokenisation and the fitted models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
