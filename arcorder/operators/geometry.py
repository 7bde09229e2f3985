"""Weights sampled from graph statistics, and the geometry of labelled embeddings: features(id, label, e array<double>).

Metrics take any grouping columns (scheme, depth, layer). Vectors cross to Python only for products of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arcorder.functions.columns import inverse_normal, normal, uniform
from arcorder.operators.ranking import global_rank, ranked_values
from arcorder.operators.storage import written

#: Rows in a block of pairwise distances.
BLOCK = 2048


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov test of a column against the normal distribution of its own mean and deviation (ddof 0).

    Nulls are left out. No such distribution has an infinite mean or no deviation: statistic and pValue are NaN, and null for no rows.
    """
    rows = df.select(F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull())
    fit = rows.agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sigma")).first()
    if fit["mu"] is None or not (math.isfinite(fit["mu"]) and math.isfinite(fit["sigma"]) and fit["sigma"] > 0):
        none = None if fit["mu"] is None else math.nan
        return df.sparkSession.createDataFrame([(none, none)], "pValue double, statistic double")
    return KolmogorovSmirnovTest.test(rows, column, "norm", float(fit["mu"]), float(fit["sigma"]))


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """(rank, sample, theoretical): sorted values against medians of normal order statistics."""
    ranked = ranked_values(df.select(F.col(column).alias("sample")), "sample").crossJoin(F.broadcast(df.agg(F.count(column).alias("n"))))
    i, n = F.col("rank") + 1, F.col("n")
    last = F.pow(F.lit(0.5), 1 / n)
    p = F.when(F.col("rank") == 0, 1 - last).when(F.col("rank") == n - 1, last).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.select("rank", "sample", inverse_normal(p).alias("theoretical"))


def standardise(df: DataFrame, vector: str = "e") -> DataFrame:
    """Each dimension less its mean, over its deviation (ddof 0); a constant dimension becomes 0."""
    flat = df.select(F.posexplode(vector).alias("d", "x"))
    stats = flat.groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    arrays = stats.agg(F.sort_array(F.collect_list(F.struct("d", "m", "s"))).alias("_stats"))  # one entry for each dimension
    scaled = F.transform(F.col(vector), lambda x, i: F.when(F.get("_stats", i)["s"] > 0, (x - F.get("_stats", i)["m"]) / F.get("_stats", i)["s"]).otherwise(0.0))
    return df.crossJoin(F.broadcast(arrays)).withColumn(vector, scaled).drop("_stats")


SCHEMES = ("random_normal", "xavier_uniform", "he_normal", "kaiming_uniform", "orthogonal", "lecun_normal", "sparse", "constant_small", "zeros")


def orthogonal_rows(spark: SparkSession, fan_in: int, fan_out: int, seed: int = 42) -> DataFrame:
    """(row, values): orthonormal columns (rows, where there are more inputs) of a random layer, by a QR of blocks of its rows.

    A row is one of the longer side and holds all values of the narrow one.

    Each task factors a block of rows, one task the stacked triangles of all blocks, and each block's factor is multiplied
    by its part of that; so no task holds more than a block, or a triangle of the narrow side for each of 1,024 blocks.
    """
    long, narrow = max(fan_in, fan_out), min(fan_in, fan_out)
    size = max(8192, 4 * narrow, -(-long // 1024))
    blocks = max(1, long // size)  # the last one takes the rest
    numbers = spark.range(0, blocks, 1, min(blocks, 256))

    def factors(block: int) -> tuple[np.ndarray, np.ndarray]:
        rows = (long if block == blocks - 1 else (block + 1) * size) - block * size
        return np.linalg.qr(np.random.default_rng([seed, block]).normal(size=(rows, narrow)))

    def triangles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in f["id"]:
                yield pd.DataFrame({"block": [block], "r": [factors(int(block))[1].ravel()]})

    def stacked(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("block")
        q, r = np.linalg.qr(np.concatenate([np.asarray(x).reshape(narrow, narrow) for x in t["r"]]))
        q = q * np.sign(np.diag(r))
        return pd.DataFrame({"block": t["block"], "r": [q[k * narrow : (k + 1) * narrow].ravel() for k in range(len(t))]})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for block, r in zip(t.column("block").to_pylist(), t.column("r"), strict=True):
                q = factors(block)[0] @ r.values.to_numpy().reshape(narrow, narrow)
                step = max(1, (1 << 20) // narrow)
                for k in range(0, len(q), step):
                    part = q[k : k + step]
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * narrow)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + block * size + k), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["row", "values"])

    schema = "block long, r array<double>"
    parts = numbers.mapInPandas(triangles, schema).groupBy(F.lit(0).alias("_all")).applyInPandas(stacked, schema)
    return parts.repartition(min(blocks, 4096), "block").mapInArrow(rows, "row long, values array<double>")


def _orthogonal(spark: SparkSession, fan_in: int, fan_out: int, seed: int) -> DataFrame:
    cells = orthogonal_rows(spark, fan_in, fan_out, seed).select("row", F.posexplode("values").alias("column", "w"))
    i, j = ("row", "column") if fan_out >= fan_in else ("column", "row")
    return cells.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), "w")


def column_products(rows: DataFrame, vector: str = "values") -> DataFrame:
    """(a, b, dot): the products of all pairs of columns; a task returns one sum for each pair, whatever its rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in batches:
            if t.num_rows:
                x = t.column(0).flatten().to_numpy().reshape(t.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            a, b = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], ["a", "b", "p"])

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(sums, "a long, b long, p double")
    return parts.groupBy("a", "b").agg(F.sum("p").alias("dot"))


def init_weights(spark: SparkSession, scheme: str, fan_in: int, fan_out: int, seed: int = 42) -> DataFrame:
    """(i, j, w): the weight from input j to output i."""
    cells = spark.range(fan_in * fan_out).select(F.expr(f"id div {fan_in}").alias("i"), (F.col("id") % fan_in).alias("j"))
    z, u = normal(seed, "i", "j"), 2 * uniform(seed, "i", "j") - 1
    if scheme == "orthogonal":
        return _orthogonal(spark, fan_in, fan_out, seed)
    if scheme == "sparse":
        # exactly ceil(0.8 * rows) zeros in each column, the rest N(0, 0.01)
        order = F.row_number().over(Window.partitionBy("j").orderBy(uniform(seed + 1, "i", "j"), "i"))
        return cells.withColumn("w", F.when(order <= int(np.ceil(0.8 * fan_out)), 0.0).otherwise(0.01 * z))
    values = {
        "random_normal": 0.01 * z,
        "xavier_uniform": float(np.sqrt(6 / (fan_in + fan_out))) * u,
        "he_normal": float(np.sqrt(2 / fan_in)) * z,
        "kaiming_uniform": float(np.sqrt(6 / fan_in)) * u,
        "lecun_normal": float(np.sqrt(1 / fan_in)) * z,
        "constant_small": F.lit(0.001),
        "zeros": F.lit(0.0),
    }
    return cells.withColumn("w", values[scheme])


def match_variance(weights: DataFrame, he_std: float) -> DataFrame:
    """Rescaled to the wanted deviation by the present one (ddof 0); unchanged if that is below 1e-12."""
    s = weights.agg(F.stddev_pop("w").alias("_s"))
    return weights.crossJoin(F.broadcast(s)).withColumn("w", F.when(F.col("_s") < 1e-12, F.col("w")).otherwise(F.col("w") * (he_std / F.col("_s")))).drop("_s")


def _cells(spark: SparkSession, fan_in: int, fan_out: int) -> DataFrame:
    return spark.range(fan_in * fan_out).select(F.expr(f"id div {fan_in}").alias("i"), (F.col("id") % fan_in).alias("j"))


def _sign(seed: int):
    return F.when(uniform(seed, "i", "j") < 0.5, -1.0).otherwise(1.0)


def sample_marginal(pool: DataFrame, fan_in: int, fan_out: int, seed: int = 42) -> DataFrame:
    """Magnitudes drawn from the pool(value) with replacement, random signs, He variance."""
    numbered, n = ranked_values(pool, "value"), pool.where("value IS NOT NULL").count()
    drawn = _cells(pool.sparkSession, fan_in, fan_out).withColumn("rank", F.floor(uniform(seed, "i", "j") * n))
    # few different values look small enough to broadcast, but their ranks are as many as the pool's rows
    return match_variance(drawn.join(numbered.hint("merge"), "rank").select("i", "j", (F.col("value") * _sign(seed + 1)).alias("w")), float(np.sqrt(2 / fan_in)))


def sample_lognormal(spark: SparkSession, mu: float, sigma: float, fan_in: int, fan_out: int, seed: int = 42) -> DataFrame:
    w = F.exp(mu + sigma * normal(seed, "i", "j")) * _sign(seed + 1)
    return match_variance(_cells(spark, fan_in, fan_out).withColumn("w", w), float(np.sqrt(2 / fan_in)))


def sample_degree(ratios: DataFrame, fan_in: int, fan_out: int, seed: int = 42) -> DataFrame:
    """ratios(in_degree_ratio): each output's scale is the root of a drawn ratio."""
    ratios = ratios.where("in_degree_ratio IS NOT NULL")
    numbered, n = ranked_values(ratios.select(F.col("in_degree_ratio").alias("d")), "d"), ratios.count()
    spark = ratios.sparkSession
    scale = spark.range(fan_out).select(F.col("id").alias("i"), F.floor(uniform(seed, F.col("id")) * n).alias("rank")).join(numbered.hint("merge"), "rank").select("i", F.sqrt(F.greatest("d", F.lit(1e-4))).alias("s"))
    he = float(np.sqrt(2 / fan_in))
    return match_variance(_cells(spark, fan_in, fan_out).join(scale, "i").select("i", "j", (he * F.col("s") * normal(seed + 1, "i", "j")).alias("w")), he)


def layer_matrices(layers: list[DataFrame]) -> list[np.ndarray]:
    """Weight tables as arrays: a network's own size, not the data's."""
    out = []
    for w in layers:
        t = w.toPandas()
        m = np.zeros((int(t["i"].max()) + 1, int(t["j"].max()) + 1))
        m[t["i"], t["j"]] = t["w"]
        out.append(m)
    return out


def forward_layers(df: DataFrame, layers: list[np.ndarray], activation: str = "post", vector: str = "e") -> DataFrame:
    """(id, label, layer, e): embeddings after every layer; 'post' after ReLU, 'pre' before it with ReLU in between."""
    sent = df.sparkSession.sparkContext.broadcast(layers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f[vector].to_numpy()).astype(np.float64)
            for k, w in enumerate(sent.value):
                z = x @ w.T
                x = np.maximum(z, 0)
                yield pd.DataFrame({"id": f["id"], "label": f["label"], "layer": k + 1, "e": list(x if activation == "post" else z)})

    return df.select("id", "label", vector).mapInPandas(run, "id long, label int, layer int, e array<double>")


def dead_fraction(df: DataFrame, by: list[str], vector: str = "e") -> DataFrame:
    zeros = F.size(F.filter(vector, lambda x: x == 0))
    return df.groupBy(*by).agg((F.sum(zeros) / F.sum(F.size(vector))).alias("dead_fraction"))


def collapse(df: DataFrame, by: list[str], vector: str = "e") -> DataFrame:
    """Deviation (ddof 0) of all numbers of a group, and whether it is below 1e-8."""
    flat = df.select(*by, F.explode(vector).alias("x"))
    return flat.groupBy(*by).agg(F.stddev_pop("x").alias("std")).withColumn("collapsed", F.col("std") < 1e-8)


def mean_norm(df: DataFrame, by: list[str], vector: str = "e") -> DataFrame:
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return df.groupBy(*by).agg(F.avg(F.sqrt(square)).alias("mean_norm"))


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def _moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their mean, and their products less the mean."""
    mean = x.mean(0)
    return len(x), mean, (x - mean).T @ (x - mean)


def _merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of two sets of rows together, from those of each."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def gram(df: DataFrame, vector: str = "e") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean, and covariance (ddof 1).

    Each task merges the centred moments of its batches, and lots of tasks are merged in turn, so nothing cancels far from
    the origin; one d x d matrix of the whole comes to the driver.
    """
    schema = "part long, n long, mean array<double>, products array<double>"

    def frame(part: int, m: tuple) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [m[0]], "mean": [m[1]], "products": [m[2].ravel()]})

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                m = _moments(np.stack(f[vector].to_numpy()).astype(np.float64))
                total = m if total is None else _merged(total, m)
        if total is not None:  # a partition may hold no row
            yield frame(TaskContext.get().partitionId(), total)

    def together(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("part")
        total = None
        for n, mean, products in zip(t["n"], t["mean"], t["products"], strict=True):
            m = (int(n), np.asarray(mean), np.asarray(products).reshape(len(mean), -1))
            total = m if total is None else _merged(total, m)
        return frame(int(t["lot"].iloc[0]), total)

    parts = df.select(vector).mapInPandas(own, schema)
    for lot in (F.expr("part div 32"), F.expr("part div 32"), F.lit(0)):  # at most 32 matrices a task, of the first 32,768 tasks' lots
        parts = parts.withColumn("lot", lot.cast("long")).groupBy("lot").applyInPandas(together, schema)
    row = parts.first()
    if row is None:
        raise ValueError("there are no rows")
    n, mean = row["n"], np.array(row["mean"])
    return n, mean, np.array(row["products"]).reshape(len(mean), -1) / max(1, n - 1)


def pca(df: DataFrame, k: int, vector: str = "e") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (k, d), explained ratios of all components."""
    n, mean, cov = gram(df, vector)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    values = values[: min(len(values), max(1, n - 1))]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return mean, (vectors * sign).T[:k], values / max(values.sum(), 1e-300)


def project(df: DataFrame, mean: np.ndarray, components: np.ndarray, vector: str = "e") -> DataFrame:
    """df with the vector in the components' space."""
    sent = df.sparkSession.sparkContext.broadcast((mean, components))

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        m, c = sent.value
        return pd.Series(list((np.stack(x.to_numpy()).astype(np.float64) - m) @ c.T)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(vector, apply(vector))


def effective_rank(ratios: np.ndarray, share: float = 0.9, cap: int | None = None) -> int:
    """Components needed for the share of variance; with a cap that doesn't reach it, one more than the cap."""
    return int(np.searchsorted(np.cumsum(ratios[:cap]), share)) + 1


def silhouette(df: DataFrame, by: list[str] | None = None, vector: str = "e", block: int = BLOCK) -> DataFrame:
    """(by ..., silhouette): mean Euclidean silhouette by label, null where fewer than two labels.

    Rows are dealt to hashed blocks; a task holds two blocks and returns sums of distances by (row, label).
    """
    by = by or []
    rows = df.select(*by, "id", "label", F.transform(vector, lambda x: x.cast("double")).alias("v"))
    counts = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(counts), by) if by else rows.crossJoin(F.broadcast(counts))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})

    def sums(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = np.stack(t["v"].to_numpy())
        x = x - x[0]  # distances stay, and squares are as small as they are
        square = np.einsum("ij,ij->i", x, x)
        a, b = t["a"].iloc[0], t["b"].iloc[0]
        left, right = np.flatnonzero(t["block"] == a), np.flatnonzero(t["block"] == b)
        for mine, others in [(left, right)] + ([(right, left)] if a != b else []):
            if not len(mine) or not len(others):
                continue
            labels, code = np.unique(t["label"].to_numpy()[others], return_inverse=True)
            one = np.eye(len(labels))[code]
            for k in range(0, len(mine), 256):
                part = mine[k : k + 256]
                d = square[part][:, None] + square[others][None, :] - 2 * (x[part] @ x[others].T)
                d[part[:, None] == others[None, :]] = 0  # a row itself, whatever the products round to
                s = np.sqrt(np.maximum(d, 0)) @ one
                i, j = np.indices(s.shape)
                out.append(pd.DataFrame({"id": t["id"].to_numpy()[part][i.ravel()], "label": t["label"].to_numpy()[part][i.ravel()], "other_label": labels[j.ravel()], "total": s.ravel()}))
        result = pd.concat(out) if out else pd.DataFrame({"id": [], "label": [], "other_label": [], "total": []})
        for c in by:
            result[c] = t[c].iloc[0]
        return result[[*by, "id", "label", "other_label", "total"]]

    kinds = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), "id long, label int, other_label int, total double"])
    partial = tiles.groupBy(*by, "a", "b").applyInPandas(sums, kinds)
    totals = partial.groupBy(*by, "id", "label", "other_label").agg(F.sum("total").alias("total"))
    size = df.groupBy(*by, F.col("label").alias("other_label")).agg(F.count("*").alias("n"))
    means = totals.join(F.broadcast(size), [*by, "other_label"])
    own = F.col("label") == F.col("other_label")
    per_row = means.groupBy(*by, "id", "label").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    s = F.when(F.col("b").isNotNull(), F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return per_row.groupBy(*by).agg(F.avg(s).alias("silhouette"))


def fit_probe(df: DataFrame, c: float = 1.0, iterations: int = 300, vector: str = "e") -> tuple[LogisticRegressionModel, DataFrame, int]:
    """An L2 logistic regression fitted on the first four fifths of the rows (by id), the ranked rows, and the number of those."""
    ranked = written(global_rank(df.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")), "id"), "probe")
    cut = int(0.8 * ranked.count())
    return LogisticRegression(maxIter=iterations, tol=1e-9, regParam=1 / (c * max(1, cut)), standardization=False).fit(ranked.where(F.col("rank") < cut)), ranked, cut


def linear_probe(df: DataFrame, c: float = 1.0, iterations: int = 300, vector: str = "e") -> float:
    """Accuracy of the probe on the last fifth of the rows."""
    model, ranked, cut = fit_probe(df, c, iterations, vector)
    test = model.transform(ranked.where(F.col("rank") >= cut))
    return test.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]


def probe_gradient(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """(class, d, gradient): of the penalised mean log loss that the probe minimises, by class and dimension; zero at the optimum."""
    penalty = model.getRegParam()
    weights = model.coefficientMatrix.toArray()
    binary = model.numClasses == 2
    p = vector_to_array("probability")
    scored = model.transform(rows).select("label", vector_to_array("features").alias("x"), p.alias("p"))
    classes = [1] if binary else range(model.numClasses)
    off = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col("p")[k] - (F.col("label") == k).cast("double")).alias("off")) for k in classes]))
    flat = scored.select("x", off.alias("c")).select("c.class", "c.off", F.posexplode("x").alias("d", "v"))
    sums = flat.groupBy("class", "d").agg(F.avg(F.col("off") * F.col("v")).alias("g"))
    w = rows.sparkSession.createDataFrame([(int(k), d, float(weights[0 if binary else k, d])) for k in classes for d in range(weights.shape[1])], "class int, d int, w double")
    return sums.join(F.broadcast(w), ["class", "d"]).select("class", "d", (F.col("g") + penalty * F.col("w")).alias("gradient"))


def geometry_sweep(df: DataFrame, schemes: list[str], depths: list[int], width: int, seed: int = 42, probe: bool = False, curve_depth: int | None = None) -> DataFrame:
    """(scheme, depth, layer, dead_fraction, mean_norm, std, collapsed, effective_rank, silhouette, probe_accuracy).

    Fractions, norms and deviations are given for all layers of all networks, the others for the last layer, and for
    every layer of networks of the curve's depth. A collapsed layer has rank 1 and no silhouette.
    """
    spark = df.sparkSession
    size = len(df.select("e").first()["e"])
    rows, out = [], None
    for scheme in schemes:
        for depth in depths:
            shapes = [(size if k == 0 else width, width) for k in range(depth)]
            layers = layer_matrices([init_weights(spark, scheme, a, b, seed + k) for k, (a, b) in enumerate(shapes)])
            emb = written(forward_layers(df, layers), "sweep-layers").withColumns({"scheme": F.lit(scheme), "depth": F.lit(depth)})
            by = ["scheme", "depth", "layer"]
            spread = collapse(emb, by)
            collapsed = {r["layer"] for r in spread.where("collapsed").collect()}
            for layer in range(1, depth + 1) if depth == curve_depth else [depth]:
                if layer in collapsed:
                    rows.append((scheme, depth, layer, 1, None, None))
                    continue
                one = emb.where(F.col("layer") == layer)
                mean, components, ratios = pca(one, 50)
                flat = project(one, mean, components)
                rows.append((scheme, depth, layer, effective_rank(ratios), silhouette(flat).first()["silhouette"], linear_probe(flat) if probe else None))
            m = dead_fraction(emb, by).join(mean_norm(emb, by), by).join(spread, by)
            out = m if out is None else out.unionByName(m)
    extra = spark.createDataFrame(rows, "scheme string, depth int, layer int, effective_rank int, silhouette double, probe_accuracy double")
    return out.join(F.broadcast(extra), ["scheme", "depth", "layer"], "left")


def pivot_metric(metrics: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    return metrics.groupBy(row).pivot(column, values).agg(F.round(F.first(value), 4))
