"""A training corpus from `documents`: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import packing, quality_rules, simhash, substring_dedup, toxicity
from haulage.llm.queries import WORD_BPE, table
from haulage.llm.ship import ship
from haulage.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.apply_rules(docs, carry=True).where("kept").select("_row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from the labelled documents of the table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates by SimHash.

    Rows that share an id and a text stay once; documents without an id stay once for each text if
    any of them has no near duplicate with an id.
    """
    least = simhash.near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_least")).distinct()
    kept = docs.join(least, docs["doc_id"].eqNullSafe(least["_least"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that start earlier; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs)
    changed = F.col("repeats.n_removed") > 0
    counted = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", counted).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, one row a piece with its ids."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("simhash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("packing", packed),
]

#: SQL can express neither the trained network nor XXH64 fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet under the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
