"""Exact scores of vertex orderings, and the smooth surrogate with its gradient.

positions(node, pos) or, for several orderings at once, positions(run, node, pos). An edge points forward if
pos[tgt] > pos[src], strictly; NaN is never forward. Whole-number weights are summed as BIGINT, others as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcorder.functions.columns import sigmoid
from arcorder.operators.ranking import global_rank, ranks_by_run


def exact_weight(edges: DataFrame) -> DataFrame:
    whole = edges.schema["weight"].dataType.typeName() in ("byte", "short", "integer", "long")
    return edges.withColumn("weight", F.col("weight").cast("long" if whole else "double"))


def with_positions(edges: DataFrame, positions: DataFrame, check: bool = False) -> DataFrame:
    """Edges with pos_src and pos_tgt (and run); with check, an edge without a position of an end is an error."""
    runs = ["run"] if "run" in positions.columns else []
    p = positions.select(*runs, "node", "pos")
    how = "left" if check else "inner"
    one = edges.join(p.withColumnsRenamed({"node": "src", "pos": "pos_src"}), "src", how)
    both = one.join(p.withColumnsRenamed({"node": "tgt", "pos": "pos_tgt"}), [*runs, "tgt"], how)
    if check:
        missing = F.col("pos_src").isNull() | F.col("pos_tgt").isNull()
        both = both.withColumn("pos_tgt", F.when(missing, F.raise_error(F.lit("an edge has an end without a position")).cast("double")).otherwise(F.col("pos_tgt")))
    return both


def forward():
    s, t = F.col("pos_src").cast("double"), F.col("pos_tgt").cast("double")
    return ~F.isnan(s) & ~F.isnan(t) & (t > s)


def score_runs(edges: DataFrame, positions: DataFrame, check: bool = False) -> DataFrame:
    """One row (for each run): score, total_weight, feedback_weight, pct."""
    joined = with_positions(exact_weight(edges), positions, check)
    grouped = joined.groupBy("run") if "run" in positions.columns else joined.groupBy()
    out = grouped.agg(F.sum(F.when(forward(), F.col("weight")).otherwise(0)).alias("score"), F.sum("weight").alias("total_weight"))
    return out.withColumn("feedback_weight", F.col("total_weight") - F.col("score")).withColumn("pct", F.col("score") * 100 / F.col("total_weight"))


def score_from_positions(edges: DataFrame, positions: DataFrame, check: bool = True) -> DataFrame:
    return score_runs(edges, positions, check)


def score_from_order(edges: DataFrame, order: DataFrame) -> DataFrame:
    """order(node, rank)."""
    return score_runs(edges, order.withColumnRenamed("rank", "pos"), check=True)


def order_nodes(positions: DataFrame) -> DataFrame:
    """(rank, node): the node at each rank, by position, then node."""
    return global_rank(positions, "pos", "node").select("rank", "node")


def node_ranks(positions: DataFrame) -> DataFrame:
    """(node, rank), for each run if there are several."""
    if "run" in positions.columns:
        return ranks_by_run(positions).select("run", "node", "rank")
    return global_rank(positions, "pos", "node").select("node", "rank")


def reverse_order(order: DataFrame) -> DataFrame:
    """rank -> n - 1 - rank."""
    return order.crossJoin(F.broadcast(order.agg(F.count("*").alias("_n")))).select("node", (F.col("_n") - 1 - F.col("rank")).alias("rank"))


def surrogate_loss(edges: DataFrame, positions: DataFrame, beta: float) -> DataFrame:
    """-sum of sigmoid(beta * (pos[tgt] - pos[src])) * norm_weight; edges carry norm_weight."""
    joined = with_positions(edges, positions)
    return joined.agg((-F.sum(sigmoid(beta * (F.col("pos_tgt") - F.col("pos_src"))) * F.col("norm_weight"))).alias("loss"))


def surrogate_gradient(edges: DataFrame, positions: DataFrame, beta) -> DataFrame:
    """(run,) node, grad of the loss: each edge adds to both its ends, summed before the shuffle. beta: a number or a column."""
    runs = ["run"] if "run" in positions.columns else []
    joined = with_positions(edges, positions)
    s = sigmoid(beta * (F.col("pos_tgt") - F.col("pos_src")))
    pull = beta * s * (1 - s) * F.col("norm_weight")
    ends = joined.withColumn("_pull", pull).select(
        *runs, F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("_pull").alias("g")), F.struct(F.col("tgt").alias("node"), (-F.col("_pull")).alias("g")))).alias("e")
    )
    return ends.groupBy(*runs, F.col("e.node").alias("node")).agg(F.sum("e.g").alias("grad"))


def verify_scores(runs: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """runs(run, best_score) against an exact re-score: run, stored, exact, ok."""
    exact = score_runs(edges, positions).select("run", F.col("score").alias("exact"))
    return runs.join(exact, "run", "left").select("run", F.col("best_score").alias("stored"), "exact", F.coalesce(F.col("exact") == F.col("best_score"), F.lit(False)).alias("ok"))
