"""Agreement between orderings of the same nodes: positions(run, node, pos)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from arcorder.functions.columns import equal_bins
from arcorder.operators.ranking import global_rank, ranks_by_run
from arcorder.operators.storage import written


def _pairs(ranked: DataFrame, *columns: str) -> DataFrame:
    a = ranked.select(F.col("run").alias("run1"), "node", *[F.col(c).alias(f"{c}1") for c in columns])
    b = ranked.select(F.col("run").alias("run2"), "node", *[F.col(c).alias(f"{c}2") for c in columns])
    return a.join(b, "node").where("run1 < run2")


def spearman_pairs(positions: DataFrame) -> DataFrame:
    """(run1, run2, rho) with mean ranks for ties."""
    return _pairs(ranks_by_run(positions), "tied_rank").groupBy("run1", "run2").agg(F.corr("tied_rank1", "tied_rank2").alias("rho"))


#: Rows of a block of ranks, and blocks of one pair of runs at most.
BLOCK, BLOCKS = 1 << 16, 2048


def inversions(values: np.ndarray) -> int:
    """Pairs of places i < j with values[i] > values[j], bit by bit of the values' ranks; equal values are no inversion."""
    v = np.unique(values, return_inverse=True)[1]
    total = 0
    for bit in reversed(range(int(v.max(initial=0)).bit_length())):
        # in stable order of the higher bits, each 0 counts the 1s before it in its group
        order = np.argsort(v >> (bit + 1), kind="stable")
        one, group = (v[order] >> bit) & 1, v[order] >> (bit + 1)
        before = np.cumsum(one) - one
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = before - np.repeat(before[first], np.diff(np.append(first, len(v))))
        total += int(before[one == 0].sum())
    return total


def kendall_pairs(positions: DataFrame) -> DataFrame:
    """(run1, run2, discordant, tau): tau-b, by inversions of the second order along the first.

    Nodes stand in blocks of the first order (a) and of the second (r). Two nodes are inverted within one block a and
    different r, within one block r, or in different blocks of both: the first two are counted in a task for each block,
    the third from the numbers of nodes by (a, r), at most BLOCKS^2 for each pair of runs.
    """
    ranked = ranks_by_run(positions)
    dense = global_rank(ranked.select("run", "pos").distinct(), "run", "pos", name="_d")
    ranked = ranked.join(dense, ["run", "pos"]).select("run", "node", F.col("_d").alias("d"))
    pairs = written(_pairs(ranked, "d"), "kendall-pairs")
    # in either order ties go by the other one, so equal nodes are never inverted
    one = global_rank(pairs, "run1", "run2", "d1", "d2", "node", name="at")
    both = global_rank(one, "run1", "run2", "d2", "d1", "node", name="to")
    firsts = both.groupBy("run1", "run2").agg(F.min("at").alias("_at"), F.min("to").alias("_to"), F.greatest(F.lit(BLOCK), F.ceil(F.count("*") / BLOCKS)).alias("_size"))
    both = both.join(F.broadcast(firsts), ["run1", "run2"]).withColumns({"at": F.col("at") - F.col("_at"), "to": F.col("to") - F.col("_to")})
    both = written(both.select("run1", "run2", "at", "to", F.expr("at div _size").alias("a"), F.expr("to div _size").alias("r")), "kendall-blocks")

    def inside(along: str, counted: str, name: str):
        def count(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values(along)
            return pd.DataFrame({"run1": t["run1"].iloc[:1], "run2": t["run2"].iloc[:1], "n": inversions(t[counted].to_numpy())})

        return both.groupBy("run1", "run2", name).applyInPandas(count, kinds)

    def between(t: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(t["a"].max()) + 2, int(t["r"].max()) + 2), dtype=np.int64)
        grid[t["a"], t["r"] + 1] = t["c"]
        later = np.cumsum(grid[::-1], axis=0)[::-1][1:]  # rows of later blocks a
        lower = np.cumsum(later, axis=1)[:, :-1]  # of these the ones of lower blocks r
        return pd.DataFrame({"run1": t["run1"].iloc[:1], "run2": t["run2"].iloc[:1], "n": int((grid[:-1, 1:] * lower).sum())})

    kinds = f"run1 {positions.schema['run'].dataType.simpleString()}, run2 {positions.schema['run'].dataType.simpleString()}, n long"
    cells = both.groupBy("run1", "run2", "a", "r").agg(F.count("*").alias("c"))
    parts = inside("at", "r", "a").unionByName(inside("to", "at", "r")).unionByName(cells.groupBy("run1", "run2").applyInPandas(between, kinds))
    inversions_of = parts.groupBy("run1", "run2").agg(F.sum("n").alias("discordant"))

    def tied(*columns: str) -> DataFrame:
        c = pairs.groupBy("run1", "run2", *columns).count()
        return c.groupBy("run1", "run2").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("_".join(("t", *columns))))

    n = pairs.groupBy("run1", "run2").agg(F.count("*").alias("n"))
    out = inversions_of.join(n, ["run1", "run2"])
    for columns in (("d1",), ("d2",), ("d1", "d2")):
        out = out.join(tied(*columns), ["run1", "run2"])
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    concordant = all_pairs - F.col("t_d1") - F.col("t_d2") + F.col("t_d1_d2") - F.col("discordant")
    tau = (concordant - F.col("discordant")) / F.sqrt((all_pairs - F.col("t_d1")) * (all_pairs - F.col("t_d2")))
    return out.select("run1", "run2", F.col("discordant").cast("long").alias("discordant"), tau.alias("tau"))


def end_set_jaccard(positions: DataFrame, k: int) -> DataFrame:
    """(run1, run2, source_jaccard, sink_jaccard) of the first and last k nodes."""
    ends = ranks_by_run(positions).where((F.col("rank") < k) | (F.col("rank") >= F.col("n") - k))
    ends = ends.withColumns({"first": F.col("rank") < k, "last": F.col("rank") >= F.col("n") - k})
    runs = positions.select("run").distinct()
    every = runs.toDF("run1").crossJoin(F.broadcast(runs.toDF("run2"))).where("run1 < run2")  # a row for each run, however many nodes
    shared = _pairs(ends, "first", "last").groupBy("run1", "run2").agg(F.count_if(F.col("first1") & F.col("first2")).alias("s"), F.count_if(F.col("last1") & F.col("last2")).alias("t"))
    out = every.join(shared, ["run1", "run2"], "left").fillna(0, ["s", "t"])
    return out.select("run1", "run2", (F.col("s") / (2 * k - F.col("s"))).alias("source_jaccard"), (F.col("t") / (2 * k - F.col("t"))).alias("sink_jaccard"))


def rank_stability(positions: DataFrame) -> DataFrame:
    """(node, rank_std): standard deviation (ddof 0) over runs of rank / n."""
    return ranks_by_run(positions).groupBy("node").agg(F.stddev_pop(F.col("rank") / F.col("n")).alias("rank_std"))


def mean_stability(positions: DataFrame) -> DataFrame:
    """Mean of the above, and what independent orderings would give."""
    return rank_stability(positions).agg(F.avg("rank_std").alias("mean_rank_std"), (1 / F.sqrt(F.lit(12.0))).alias("independent"))


def rank_density(positions: DataFrame, run1: str, run2: str, grid: int = 80) -> DataFrame:
    """(x, y, n): nodes in each cell of a square grid over the ranks of two runs."""
    ranked = ranks_by_run(positions.where(F.col("run").isin(run1, run2)))
    cells = _pairs(ranked.withColumn("cell", equal_bins(F.col("rank").cast("double"), F.lit(0.0), (F.col("n") - 1).cast("double"), grid)), "cell")
    return cells.groupBy(F.col("cell1").alias("x"), F.col("cell2").alias("y")).agg(F.count("*").alias("n"))


def rank_hexagons(positions: DataFrame, run1: str, run2: str, grid: int = 80) -> DataFrame:
    """(lattice, x, y, n): nodes in each hexagon over the ranks of two runs, `grid` hexagons wide.

    Hexagons are the cells nearest to the points of two lattices, the second one half a step aside and above; there are
    grid / sqrt(3) rows of each, and a step up counts three times a step aside. The ranks' range is widened by 1e-9.
    """
    rows = int(grid / math.sqrt(3))
    ranked = ranks_by_run(positions.where(F.col("run").isin(run1, run2)))
    pairs = _pairs(ranked, "rank", "n")
    pad = (F.col("n1") - 1) * 1e-9
    width = (F.col("n1") - 1) + 2 * pad
    at = pairs.select(((F.col("rank1") + pad) / (width / grid)).alias("u"), ((F.col("rank2") + pad) / (width / rows)).alias("v"))
    u, v = F.col("u"), F.col("v")

    def square(a, b):
        return (u - a) * (u - a) + 3.0 * (v - b) * (v - b)

    first = square(F.rint(u), F.rint(v)) < square(F.floor(u) + 0.5, F.floor(v) + 0.5)
    cells = at.select(F.when(first, 0).otherwise(1).alias("lattice"), *[F.when(first, F.rint(c)).otherwise(F.floor(c)).cast("long").alias(n) for n, c in (("x", u), ("y", v))])
    return cells.groupBy("lattice", "x", "y").agg(F.count("*").alias("n"))
