"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightframe.llm import decontaminate, packing, quality, substring_dedup
from sightframe.llm.groups import mapped
from sightframe.llm.jaccard_join import jaccard_join
from sightframe.llm.store import cleared, materialize, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; see :func:`quality.keep_good` for nulls, long texts, repeats and empty tables."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the one with the smallest doc_id stays.

    Rows that repeat a doc_id stay or go together, and of those that repeat its text as well one stays, the least as
    JSON; a null doc_id links with nothing.
    """
    groups = jaccard_join(docs, n_words=5, threshold=(4, 5))
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct())
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = mapped(docs, gone, inside=False).union(mapped(docs, gone).join(gone, "doc_id", "left_anti").select(docs.columns))
    if twice.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    rest = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", F.md5("text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(rest.select("row.*"))


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds go; the rest of the text stays.

    ``n_chars`` follows the text. Nulls, short and long texts, repeats and empty tables are as in :func:`substring_dedup.substring_dedup`.
    """
    return substring_dedup.substring_dedup(docs, chars_col="n_chars")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go; nulls, long texts, repeats and empty tables are as in :func:`decontaminate.decontaminate`."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its bin.

    Null and empty texts are one piece of no words; long ones are pieces of at most a bin each; rows that repeat have pieces
    of their own. An empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models and similarity joins: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input.

    Any stage may get an empty table, and then gives one. Columns besides those of documents go through all stages but the
    last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
