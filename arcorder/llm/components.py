"""Connected components of an undirected graph given as an edge table, by hooking and jumping.

Each node has a label, a node that it is connected with. In a round a node looks at its neighbours' labels' labels; the
smallest is offered to the node itself and to the node that is its label (hooking), and each node also takes its label's
label (jumping). So whole trees of labels hang onto each other, and the rounds are logarithmic: about log2 n + 2 on paths
and rings in any order. Each round is a written table, and the one before it is deleted; nothing but one bit a round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import scratch, written
from arcorder.operators.storage import discard


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """edges(a long, b long), either way round, loops allowed -> (node, component), component the smallest node reached.

    rounds: a list that gets the number of rounds.
    """
    with scratch() as work:
        links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-links")
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        # a node starts with the smallest of itself and its neighbours; jump is its label's label
        labels = written(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")), "components-labels")
        done = 0
        while True:
            jumps = written(labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("jump")), "label").select("node", "label", "jump"), "components-jumps")
            offered = both.join(jumps.select(F.col("node").alias("other"), "jump"), "other").groupBy("node").agg(F.min("jump").alias("offer"))
            near = written(jumps.join(offered, "node"), "components-offers")
            hooked = near.groupBy(F.col("label").alias("node")).agg(F.min("offer").alias("hook"))
            best = F.least("jump", "offer", F.coalesce("hook", "offer"))
            new = written(near.join(hooked, "node", "left").select("node", best.alias("label"), (best < F.col("label")).alias("moved")), "components-labels")
            discard(labels, jumps, near)
            labels, done = new, done + 1
            if not new.where("moved").limit(1).count():
                break
        if rounds is not None:
            rounds.append(done)
        return work.keep(labels.select("node", F.col("label").alias("component")), "components")
