"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data and the mix.

Each stage reads all that the one before kept, and its result is written before the next reads it.

Defined results of every stage: nulls in any column, empty and very long texts and extra columns pass through unless a stage's
rule rejects them; an empty table gives an empty one. Rows that repeat are judged alike: only the near-duplicate stage makes one of
rows of equal id and text. A null id is an id like another, but is never the least of a group; a text without words is no near
duplicate, holds no benchmark item and no personal data, and comes along with its block in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.classifier import fold, train, with_quality_scores
from plumbline.llm.common import read, stored
from plumbline.llm.decontamination import decontaminated
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.ngram_join import jaccard_components
from plumbline.llm.pii import sanitised

#: Stages that hash ids or fit models have no SQL; the run is tested against its operators.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(fold() != 1))
    # the row travels as one column, so that none of its names can clash
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text")
    kept = with_quality_scores(packed, model, keep=["row"]).where("predicted = 1")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked ones; rows of equal id and text are one document."""
    found = jaccard_components(docs)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_k")).distinct()
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(stays["_k"]), "left_semi")
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the personal data in their texts."""
    return sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each take of a document by the mix."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
