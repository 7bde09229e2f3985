"""Preparation and statistics of weighted digraphs given as edges(src, tgt, weight)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from arcorder.functions.columns import equal_bins
from arcorder.operators.ranking import at_ranks, global_rank
from arcorder.operators.storage import scratch, written


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct()


def remap_node_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over dense ids from 0, by ascending original id, and the dictionary (idx, node_id)."""
    nodes = global_rank(nodes_of(edges), "node", name="idx").select("idx", F.col("node").alias("node_id"))
    source, target = nodes.toDF("s_idx", "src"), nodes.toDF("t_idx", "tgt")
    renamed = edges.join(source, "src").join(target, "tgt").drop("src", "tgt")
    return renamed.select(F.col("s_idx").alias("src"), F.col("t_idx").alias("tgt"), *[c for c in renamed.columns if c not in ("s_idx", "t_idx")]), nodes


def restore_node_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    source, target = nodes.toDF("src", "s_id"), nodes.toDF("tgt", "t_id")
    joined = edges.join(source, "src").join(target, "tgt").drop("src", "tgt")
    return joined.select(F.col("s_id").alias("src"), F.col("t_id").alias("tgt"), *[c for c in joined.columns if c not in ("s_id", "t_id")])


def normalise_weights(edges: DataFrame) -> DataFrame:
    top = edges.agg(F.max("weight").alias("_top"))
    return edges.crossJoin(F.broadcast(top)).withColumn("norm_weight", F.col("weight") / F.col("_top")).drop("_top")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def matrix_to_edges(df: DataFrame, row: str, values: str) -> DataFrame:
    """Cells above zero of a matrix of one array a row; NaN is none."""
    cells = df.select(F.col(row).cast("long").alias("src"), F.posexplode(values).alias("tgt", "weight"))
    return cells.where(~F.isnan("weight") & (F.col("weight") > 0)).select("src", F.col("tgt").cast("long").alias("tgt"), F.col("weight").cast("double").alias("weight"))


def edges_to_matrix(edges: DataFrame, columns: int) -> DataFrame:
    """One array a source of the weights to targets 0 .. columns - 1, absent cells 0."""
    cells = edges.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("tgt", "weight"))).alias("m"))
    return cells.select("src", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("values"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_deg, out_deg, total_deg, in_w, out_w): one shuffle of both ends, summed before it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("tgt").alias("node"), F.lit(0).alias("out")))).alias("e"), "weight")
    out, w = F.col("e.out"), F.col("weight")
    return (
        ends.groupBy(F.col("e.node").alias("node"))
        .agg(
            F.sum(1 - out).cast("long").alias("in_deg"),
            F.sum(out).cast("long").alias("out_deg"),
            F.sum(F.when(out == 0, w).otherwise(0)).alias("in_w"),
            F.sum(F.when(out == 1, w).otherwise(0)).alias("out_w"),
        )
        .withColumn("total_deg", F.col("in_deg") + F.col("out_deg"))
    )


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact quantile of each name, between two neighbours in proportion; null for no rows.

    The values are written once, as a selection reads them several times.
    """
    with scratch():
        rows = written(df.select(F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL"), "quantile-values")
        n = rows.count()
        places = {name: (n - 1) * share for name, share in shares.items()}
        ends = {f"{side}_{name}": cut(place) for name, place in places.items() for side, cut in (("lo", math.floor), ("hi", math.ceil))}
        found = at_ranks(rows, "_v", ends, n=n).first()
    cuts = [None if found[f"lo_{k}"] is None else found[f"lo_{k}"] + (p - math.floor(p)) * (found[f"hi_{k}"] - found[f"lo_{k}"]) for k, p in places.items()]
    return df.sparkSession.createDataFrame([cuts], ", ".join(f"`{k}` double" for k in shares))


def degree_stats(edges: DataFrame) -> DataFrame:
    d = degrees(edges).agg(
        F.count("*").alias("n_nodes"),
        F.avg("in_deg").alias("mean_in_degree"),
        F.avg("out_deg").alias("mean_out_degree"),
        F.max("in_deg").alias("max_in_degree"),
        F.max("out_deg").alias("max_out_degree"),
        F.count_if(F.col("in_deg") == 0).alias("n_sources"),
        F.count_if(F.col("out_deg") == 0).alias("n_sinks"),
    )
    w = edges.agg(
        F.count("*").alias("n_edges"),
        F.sum("weight").alias("total_weight"),
        F.min("weight").alias("weight_min"),
        F.avg("weight").alias("weight_mean"),
        F.max("weight").alias("weight_max"),
    )
    n = F.col("n_nodes")
    cuts = quantiles(edges, "weight", {"weight_median": 0.5, "weight_p99": 0.99})
    return d.crossJoin(w).crossJoin(cuts).withColumn("density", F.when(n > 1, F.col("n_edges") / (n * (n - 1))).otherwise(0.0))


def sources(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).join(edges.select(F.col("tgt").alias("node")), "node", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def _share(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).withColumn("pct", F.col("n") * 100 / F.col("_all")).drop("_all")


def degree_distribution(edges: DataFrame, side: str = "in") -> DataFrame:
    """Share of all nodes, in percent, at each degree above 0."""
    return _share(degrees(edges).withColumnRenamed(f"{side}_deg", "degree"), "degree").where("degree > 0")


def degree_diff_distribution(edges: DataFrame) -> DataFrame:
    return _share(degrees(edges).withColumn("diff", F.col("out_deg") - F.col("in_deg")), "diff")


def histogram(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """(bin, lo, n) of equal bins from the least to the largest value, the last closed on the right; empty bins are left out."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"), F.count(column).alias("_all"))
    placed = df.crossJoin(F.broadcast(ends)).withColumn("bin", equal_bins(F.col(column).cast("double"), F.col("_lo"), F.col("_hi"), bins))
    out = placed.groupBy("bin", "_lo", "_hi", "_all").agg(F.count("*").alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = out.withColumn("lo", F.col("_lo") + F.col("bin") * width)
    return (out.withColumn("density", F.col("n") / (F.col("_all") * width)) if density else out).drop("_lo", "_hi", "_all")


def reciprocity(edges: DataFrame) -> DataFrame:
    loops = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("tgt")).alias("self_loops"))
    twice = edges.groupBy("src", "tgt").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    swapped = edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    both = edges.join(swapped, ["src", "tgt"], "left_semi").agg(F.count("*").alias("bidirectional"))
    return loops.crossJoin(twice).crossJoin(both).withColumn("bidirectional_pct", F.col("bidirectional") * 100 / F.col("n_edges"))


def hubs(edges: DataFrame, p: float = 0.9) -> DataFrame:
    """Nodes whose in-degree reaches the exact percentile over all nodes."""
    d = degrees(edges).select("node", "in_deg")
    return d.crossJoin(F.broadcast(quantiles(d, "in_deg", {"_cut": p}))).where("in_deg >= _cut").drop("_cut")


def rich_club(edges: DataFrame) -> DataFrame:
    """phi(k) for k from 1 to below int(p95 of total degree), by suffix sums over two histograms."""
    d = degrees(edges).select("node", "total_deg")
    top = quantiles(d, "total_deg", {"p": 0.95}).crossJoin(d.agg(F.count("*").alias("n")))
    m = edges.agg(F.count("*").alias("m"))
    ends = edges.join(d.toDF("src", "_s"), "src").join(d.toDF("tgt", "_t"), "tgt").select(F.least("_s", "_t").alias("k"), F.lit(1).alias("e"), F.lit(0).alias("v"))
    counts = ends.unionByName(d.select(F.col("total_deg").alias("k"), F.lit(0).alias("e"), F.lit(1).alias("v"))).groupBy("k").agg(F.sum("e").alias("e"), F.sum("v").alias("v"))
    wanted = top.select(F.explode(F.when(F.col("p").cast("int") > 1, F.sequence(F.lit(1).cast("long"), F.col("p").cast("long") - 1))).alias("k"))
    # counts above k: totals over the larger keys of one row for each degree
    both = counts.unionByName(wanted.select("k", F.lit(0).alias("e"), F.lit(0).alias("v"))).groupBy("k").agg(F.sum("e").alias("e"), F.sum("v").alias("v"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    sums = both.select("k", F.coalesce(F.sum("e").over(above), F.lit(0)).alias("e_k"), F.coalesce(F.sum("v").over(above), F.lit(0)).alias("n_k"))
    n_k = F.col("n_k")
    out = sums.join(wanted, "k", "left_semi").crossJoin(F.broadcast(top.select("n"))).crossJoin(F.broadcast(m))
    return out.select("k", "n_k", "e_k", F.when(n_k >= 2, F.col("e_k") / (n_k * (n_k - 1))).alias("phi"), (F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


def lognormal_fit(edges: DataFrame) -> DataFrame:
    positive = edges.where(~F.isnan(F.col("weight").cast("double")) & (F.col("weight") > 0)).select(F.ln("weight").alias("lw"))
    return positive.agg(F.avg("lw").alias("mu"), F.stddev_pop("lw").alias("sigma"))


def connectome_stats(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, in_degree_ratio) and (src, tgt, weight_normed): degrees over their mean, weights over their standard deviation."""
    d = degrees(edges).select("node", "in_deg")
    ratio = d.crossJoin(F.broadcast(d.agg(F.avg("in_deg").alias("_m")))).select("node", (F.col("in_deg") / F.col("_m")).alias("in_degree_ratio"))
    positive = edges.where("weight > 0")
    pool = positive.crossJoin(F.broadcast(positive.agg(F.stddev_pop("weight").alias("_s")))).select("src", "tgt", (F.col("weight") / F.col("_s")).alias("weight_normed"))
    return ratio, pool


def ordered_adjacency(edges: DataFrame) -> DataFrame:
    """(row, col, value): cells by descending out-degree (then node) of both ends, value log1p of the weight."""
    ranked = global_rank(degrees(edges).select("node", "out_deg"), F.desc("out_deg"), F.col("node")).select("node", "rank")
    joined = edges.join(ranked.toDF("src", "row"), "src").join(ranked.toDF("tgt", "col"), "tgt")
    return joined.select("row", "col", F.log1p("weight").alias("value"))
