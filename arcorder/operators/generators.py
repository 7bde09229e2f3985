"""Null models and synthetic graphs, made by Spark at any size; every number depends on its key and the seed only.

The edges of a source come from a random stream of its own, keyed by (seed, source), by skips between hits, so the
work is in proportion to nodes and edges and not to pairs of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcorder.functions.columns import normal, uniform
from arcorder.operators.ranking import global_rank
from arcorder.operators.storage import written

#: Hits that are drawn at once.
STEP = 1 << 16


def hits(rng: np.random.Generator, n: int, p: float) -> Iterator[np.ndarray]:
    """The numbers below n that a coin of probability p picks, each on its own, in ascending order."""
    if p <= 0 or n <= 0:
        return
    if p >= 1:
        yield np.arange(n)
        return
    at = -1
    while at < n:
        many = int(min(STEP, 16 + 1.2 * p * (n - at)))
        place = at + np.cumsum(rng.geometric(p, many))
        at = int(place[-1])
        yield place[place < n]


def framed(pairs: Iterator[tuple[int, np.ndarray]], name: str) -> Iterator[pd.DataFrame]:
    """(src, many) as frames of about STEP rows."""
    held: list[tuple[int, np.ndarray]] = []
    rows = 0
    for src, many in pairs:
        held.append((src, many))
        rows += len(many)
        if rows >= STEP:
            yield pd.DataFrame({"src": np.repeat([h[0] for h in held], [len(h[1]) for h in held]), name: np.concatenate([h[1] for h in held])})
            held, rows = [], 0
    if rows:
        yield pd.DataFrame({"src": np.repeat([h[0] for h in held], [len(h[1]) for h in held]), name: np.concatenate([h[1] for h in held])})


def erdos_renyi(spark: SparkSession, n: int, density: float, seed: int = 42) -> DataFrame:
    """(src, tgt): each ordered pair of distinct nodes with probability `density`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = ((src, tgt + (tgt >= src)) for src in f["id"].tolist() for tgt in hits(np.random.default_rng([seed, src]), n - 1, density))
            yield from framed(pairs, "tgt")

    return spark.range(n).mapInPandas(run, "src long, tgt long")


def power_law_degrees(spark: SparkSession, n: int, seed: int = 42, exponent: float = 2.3) -> DataFrame:
    """(node, degree): round((1 - u) ** (-1 / (exponent - 1))), from 1 to n - 1."""
    raw = F.round(F.pow(1 - uniform(seed, F.col("id")), F.lit(-1 / (exponent - 1))))
    return spark.range(n).select(F.col("id").alias("node"), F.least(F.greatest(raw, F.lit(1)), F.lit(n - 1)).cast("long").alias("degree"))


def synthetic_connectome(spark: SparkSession, n: int, density: float, mu: float, sigma: float, seed: int = 42) -> DataFrame:
    """(src, tgt, weight): power-law out-degrees, the same degrees permuted as in-degrees, log-normal weights.

    P(edge) is the product of the two degrees scaled to the density, at most 0.95, and 0 on the diagonal. Targets of equal
    in-degree are one class; a source picks places in each class, and a join turns places into nodes. The driver holds
    one row for each distinct degree, of which there are fewer than the root of twice the sum of all degrees.
    """
    k = power_law_degrees(spark, n, seed)
    mixed = global_rank(k, F.xxhash64("node", F.lit(seed + 1)), F.col("node")).select(F.col("rank").alias("tgt"), F.col("degree").alias("k_in"))
    placed = written(global_rank(mixed, "k_in", "tgt", name="place").select("place", "tgt"), "connectome-places")
    sizes = sorted(tuple(r) for r in k.groupBy("degree").count().collect())
    degree, size = (np.array([r[j] for r in sizes], dtype=np.int64) for j in (0, 1))
    first = np.cumsum(size) - size
    total = float((degree * size).sum())
    scale = total * total / (float(n) * n * density)
    sent = spark.sparkContext.broadcast((degree, size, first))

    def places(src: int, k_out: int) -> Iterator[tuple[int, np.ndarray]]:
        degree, size, first = sent.value
        rng = np.random.default_rng([seed + 2, src])
        # how many of each class; which of them is drawn for the classes that have any
        many = rng.binomial(size, np.minimum(k_out * degree / scale, 0.95))
        for c in np.flatnonzero(many):
            yield src, first[c] + (rng.choice(int(size[c]), int(many[c]), replace=False) if many[c] > 1 else rng.integers(size[c], size=1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from framed((x for src, k_out in zip(f["node"].tolist(), f["degree"].tolist(), strict=True) for x in places(src, k_out)), "place")

    drawn = k.mapInPandas(run, "src long, place long")
    return drawn.join(placed, "place").where("src <> tgt").select("src", "tgt", F.exp(mu + sigma * normal(seed + 3, "src", "tgt")).alias("weight"))
