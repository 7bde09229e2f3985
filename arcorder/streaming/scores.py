"""The forward weight of a stream of edges against fixed positions of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcorder.operators.score import exact_weight, forward, with_positions


def running_score(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """edges: a stream (src, tgt, weight); one row of score and total_weight so far (update or complete mode)."""
    joined = with_positions(exact_weight(edges), positions)
    return joined.groupBy().agg(F.sum(F.when(forward(), F.col("weight")).otherwise(0)).alias("score"), F.sum("weight").alias("total_weight"))


def windowed_score(edges: DataFrame, positions: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """edges also carry a time: (start, score, total_weight) of each window; edges later than the watermark are dropped, state is bounded."""
    joined = with_positions(exact_weight(edges).withWatermark(time, late), positions)
    out = joined.groupBy(F.window(time, window).alias("w")).agg(F.sum(F.when(forward(), F.col("weight")).otherwise(0)).alias("score"), F.sum("weight").alias("total_weight"))
    return out.select(F.col("w.start").alias("start"), "score", "total_weight")
