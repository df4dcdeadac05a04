"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

Every stage works on all that its predecessor kept. Rows without doc_id pass the stages like any other; repeated rows
of one doc_id are copies of each other, of which the near-duplicate stage keeps one, from those that are no copy of a smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm import contamination, near_copies, packing, personal_data, quality
from terrasphere.llm.tables import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the model is learned from the labels outside the held-out fold."""
    model = quality.model(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_quality").where(F.col("_quality") >= quality.CUT).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of near copies; of its rows, that of smallest text which the component has."""
    found = near_copies.near_copies(docs).where("kept AND doc_id IS NOT NULL").select("doc_id", F.col("text_key").alias("_text_key")).distinct()
    row = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    named = docs.withColumn("_text_key", F.xxhash64("text")).join(found, ["doc_id", "_text_key"], "left_semi")
    named = named.groupBy("doc_id").agg(F.min(F.struct(*row)).alias("_row")).select(*[c if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in docs.columns])
    return named.unionByName(docs.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = contamination.hits(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("text_key").alias("_text_key")).distinct()
    return docs.withColumn("_text_key", F.xxhash64("text")).join(found, "_text_key", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted again."""
    found = personal_data.personal_data(docs, docs.columns, redacted=True, into="_spans")
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of 2048 tokens."""
    return packing.describe(packing.pack(docs))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: The learned stages and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
