"""From raw documents to packed training sequences, one operator a stage.

quality -> exact dedup -> near dedup -> PII -> packing. Each stage gets what the one before kept, as a written table,
and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcorder.llm import exact_dedup, ngram_join, packing, pii, quality
from arcorder.llm.common import table, unused_name, written
from arcorder.llm.queries import learn_quality, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.7; it learns as op3 does."""
    model = learn_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused_name(docs.columns, "score")
    return quality.score(docs, model, docs.columns, score_col=score).where(F.col(score) >= 0.7).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the smallest doc_id."""
    return exact_dedup.without_duplicates(docs, "doc_id", "text", keep="smallest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return ngram_join.without_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets."""
    found = pii.find_pii(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    rows = found.withColumn("row", F.col("row").withField("text", pii.redact("text", "spans")))
    return rows.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast("long"))).select("row.*").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, vocabulary(spark))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: No SQL expresses the fitted classifier, the trees or the tokens; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
