"""Raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import best_fit_packing, jaccard_join, quality_classifier, quality_rules, substring_dedup
from pointloom.llm._common import carried, documents, settle


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return carried(quality_classifier.score(docs, model, carry=docs.columns).filter("predicted = 1"), docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the repetition rules go."""
    return carried(quality_rules.quality_rules(docs, carry=docs.columns).filter("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.jaccard_dedup(docs, shingle=5, share=(80, 100))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that are found elsewhere go; a text that loses all its words stays, empty."""
    cut = substring_dedup.substring_dedup(docs, carry=docs.columns)
    kept = {"text": F.col("text")} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_carry.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.select(*[kept.get(c, F.col(f"_carry.{c}")).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 4096 tokens."""
    return best_fit_packing.pack_documents(docs, best_fit_packing.default_tokenizer())


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("best-fit packing", sequences),
]

#: SQL can't express the classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents; each stage's are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
