"""Replicate projections to a region graph: projections(exp_id, src_region, tgt_region, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcorder.operators.ranking import at_ranks


def clip_negative(df: DataFrame, column: str = "value") -> DataFrame:
    """Values below zero, and NaN, become 0."""
    return df.withColumn(column, F.when(~F.isnan(F.col(column).cast("double")) & (F.col(column) > 0), F.col(column)).otherwise(F.lit(0).cast(df.schema[column].dataType)))


def replicate_mean(projections: DataFrame) -> DataFrame:
    """Mean over a source's experiments; a target that an experiment lacks counts as 0."""
    sums = projections.groupBy("src_region", "tgt_region").agg(F.sum("value").alias("_sum"))
    experiments = projections.groupBy("src_region").agg(F.countDistinct("exp_id").alias("_n"))
    joined = sums.join(experiments, "src_region")
    return joined.select(F.col("src_region").alias("src"), F.col("tgt_region").alias("tgt"), (F.col("_sum") / F.col("_n")).alias("weight"))


def square_submatrix(edges: DataFrame) -> DataFrame:
    """Cells among regions that are both source and target, without the diagonal."""
    both = edges.select(F.col("src").alias("region")).intersect(edges.select(F.col("tgt").alias("region")))
    return edges.join(both.toDF("src"), "src", "left_semi").join(both.toDF("tgt"), "tgt", "left_semi").where("src <> tgt").select("src", "tgt", "weight")


def threshold_to_density(edges: DataFrame, regions: int, density: float) -> DataFrame:
    """The edges that reach the k-th largest weight, k = max(1, int(density * regions * (regions - 1))); all of its ties stay."""
    k = max(1, int(density * regions * (regions - 1)))
    positive = edges.where("weight > 0")
    # with k edges or fewer of positive weight there is no such rank or it is the last: nothing is cut
    least = at_ranks(positive, "weight", {"_least": positive.count() - k})
    return positive.join(F.broadcast(least), F.lit(True), "left").where("_least IS NULL OR weight >= _least").drop("_least")
