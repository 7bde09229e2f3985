"""Run histories, records, summaries over seeds, and the two gates that a variant must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_running_best(history: DataFrame, initial: Column | None = None) -> DataFrame:
    """Adds best_score: the largest score so far of the run, not below the score before the first epoch if given."""
    best = F.max("score").over(Window.partitionBy("run").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0))
    return history.withColumn("best_score", best if initial is None else F.greatest(initial, best))


def time_to_threshold(history: DataFrame, thresholds: list[float]) -> DataFrame:
    """(run, t_<threshold> ...): least elapsed with best_pct at or above it, null if never."""
    return history.groupBy("run").agg(*[F.min(F.when(F.col("best_pct") >= t, F.col("elapsed"))).alias(f"t_{t:g}".replace(".", "_")) for t in thresholds])


def best_of(results: DataFrame, by: list[str], score: str, *ties: str) -> DataFrame:
    """The best row of each group; of equal ones the first by the tie columns."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summarise_runs(results: DataFrame, by: list[str]) -> DataFrame:
    """Best (and its seed), worst, mean and sample standard deviation of the scores."""
    return results.groupBy(*by).agg(
        F.max("score").alias("best"),
        F.max(F.struct("score", (-F.col("seed")).alias("s")))["s"].alias("_s"),
        F.min("score").alias("worst"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"),
        F.count("*").alias("n_runs"),
    ).withColumn("best_seed", -F.col("_s")).drop("_s")


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation over the runs of each (algo, dataset, config_hash); n_seeds counts runs."""
    commit = F.substring(F.when(F.coalesce("git_commit", F.lit("")) == "", "n/a").otherwise(F.col("git_commit")), 1, 11)
    large = F.max(F.abs("score")) >= 1000
    return runs.groupBy("algo", "dataset", "config_hash").agg(
        F.count("*").alias("n_seeds"),
        F.avg("pct").alias("pct_mean"),
        F.stddev_samp("pct").alias("pct_std"),
        F.avg("score").alias("score_mean"),
        F.stddev_samp("score").alias("score_std"),
        F.when(large, F.format_number(F.avg("score"), 0)).otherwise(F.format_number(F.avg("score"), 4)).alias("score_text"),
        F.avg("wall_clock_s").alias("wall_clock_mean"),
        F.array_join(F.sort_array(F.collect_list("seed")).cast("array<string>"), ", ").alias("seeds"),
        F.array_join(F.sort_array(F.collect_set(commit)), ", ").alias("git_commits"),
    )


def compare(ours: DataFrame, published: DataFrame) -> DataFrame:
    """(algorithm, pct, time) against the same columns of published runs."""
    p = published.select("algorithm", F.col("pct").alias("ref_pct"), F.col("time").alias("ref_time"))
    joined = ours.select("algorithm", "pct", "time").join(p, "algorithm")
    return joined.withColumn("delta_pp", F.col("pct") - F.col("ref_pct")).withColumn("time_ratio", F.try_divide("time", "ref_time"))


def master_results(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def config_json(fields: dict[str, Column]) -> Column:
    """The JSON text of an object with sorted keys, ', ' and ': ', of columns that hold JSON texts of their values."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_string(column: Column) -> Column:
    """A plain string as JSON (quotes and backslashes are escaped)."""
    return F.concat(F.lit('"'), F.regexp_replace(column, r'(["\\])', r"\\$1"), F.lit('"'))


def config_hash(fields: dict[str, Column]) -> Column:
    """First 12 hex digits of the SHA-256 of the settings without seed and device."""
    return F.substring(F.sha2(config_json({k: v for k, v in fields.items() if k not in ("seed", "device")}), 256), 1, 12)


def _against(runs: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    mine = runs.groupBy("algo", "dataset").agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))
    base = baseline.select("dataset", F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    return mine.join(base, "dataset", "right").withColumn("delta", F.col("mean") - F.col("base_mean"))


def screen(runs: DataFrame, baseline: DataFrame, metric: str = "pct") -> DataFrame:
    """(algo, n_datasets, promoted): the mean gain exceeds twice the baseline's deviation on every dataset of the baseline."""
    rows = _against(runs, baseline, metric).where("algo IS NOT NULL")
    n = baseline.agg(F.countDistinct("dataset").alias("_n"))
    out = rows.groupBy("algo").agg(F.count("*").alias("n_datasets"), F.bool_and(F.col("delta") > 2 * F.col("base_std")).alias("_all"))
    return out.crossJoin(F.broadcast(n)).select("algo", "n_datasets", (F.coalesce("_all", F.lit(False)) & (F.col("n_datasets") == F.col("_n"))).alias("promoted"))


def confirm(runs: DataFrame, baseline: DataFrame, metric: str = "pct") -> DataFrame:
    """(algo, least_ci_low, confirmed): the 95 % bound of the gain, delta - 1.96 * std * sqrt(2 / n), is above 0 on every dataset."""
    rows = _against(runs, baseline, metric).where("algo IS NOT NULL")
    rows = rows.withColumn("ci_low", F.col("delta") - 1.96 * F.col("base_std") * F.sqrt(2 / F.col("n")))
    n = baseline.agg(F.countDistinct("dataset").alias("_n"))
    out = rows.groupBy("algo").agg(F.count("*").alias("n_datasets"), F.min("ci_low").alias("least_ci_low"))
    return out.crossJoin(F.broadcast(n)).select("algo", "least_ci_low", (F.coalesce(F.col("least_ci_low") > 0, F.lit(False)) & (F.col("n_datasets") == F.col("_n"))).alias("confirmed"))


def build_records(scores: DataFrame, stamp: Column, env: dict[str, str | None]) -> DataFrame:
    """Run records: exp_id of stamp, algo, dataset, seed and hash; the environment as a struct of strings."""
    exp_id = F.concat_ws("-", F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), "algo", "dataset", F.concat(F.lit("s"), F.col("seed").cast("string")), F.substring("config_hash", 1, 6))
    return scores.select(
        exp_id.alias("exp_id"), "algo", "dataset", "seed", "score", "pct", "wall_clock_s", "git_commit",
        F.struct(*[F.lit(v).cast("string").alias(k) for k, v in env.items()]).alias("env"),
        "config_hash", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        *[c for c in ("total_weight", "n_epochs_done", "best_positions_path", "experiment_id", "role", "hypothesis") if c in scores.columns],
    )


def convergence_series(history: DataFrame, x: str = "iter") -> DataFrame:
    """(run, x, best_pct) for plots on a log axis: epochs count from 1, other columns keep what is above 0."""
    value = F.col(x) + 1 if x == "iter" else F.col(x)
    return history.select("run", value.alias("x"), "best_pct").where("x > 0")
