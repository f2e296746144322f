"""Corpus pipeline: raw documents in, packed token sequences out.

Each stage takes all that its predecessor kept and calls one operator of
palisand.llm.  All but the last return the columns of documents, whichever there are (doc_id, text, lang and source are needed).

Cases: null and empty texts go to the classifier and the rules like any other, which reject them (no word); repeated rows are
judged alike, and the join keeps one of them; null doc_id, lang and source are values like any other; texts that line dedup empties
stay as empty documents, link with nothing and are packed as an end id; very long texts are whole; further columns, whatever
their names, are carried to the end of the fourth stage; an empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from palisand.llm import fm_classifier, jaccard_join, line_dedup, packing, quality_rules
from palisand.llm.queries import quality_machine
from palisand.llm.shared import finished, released, staged


#: Rows that Spark hands to a Python worker at a time; documents are long, and a worker and its executor hold a batch each.
BATCH = 1000


def _short_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, str(BATCH))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    _short_batches(spark)
    return fm_classifier.accepted(docs, quality_machine(spark, docs, sf_dir), 0.7)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the adaptive quality rules."""
    _short_batches(spark)
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them or more share."""
    _short_batches(spark)
    left = line_dedup.cleaned(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _short_batches(spark)
    return jaccard_join.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    _short_batches(spark)
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.pack(staged(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), 1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packed),
]

#: A trained classifier and the packing order can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage written and read again; what a stage has staged, and what it has read, is then removed."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = finished(name.replace(" ", "-"), lambda: stage(spark, before, sf_dir))  # noqa: B023  called at once
        if i:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
