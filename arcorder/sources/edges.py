"""Readers and writers of edge lists, graphs, run records, positions and result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcorder.operators.graph import nodes_of, remap_node_ids

#: The header of the published edge list (its first name holds two spaces).
CSV_COLUMNS = ("Source Node  ID", "Target Node ID", "Edge Weight")

RUN_SCHEMA = (
    "exp_id string, algo string, dataset string, seed bigint, score double, pct double, wall_clock_s double, git_commit string, "
    "env struct<python: string, jax_or_torch: string, cuda: string, gpu: string>, config_hash string, timestamp string, "
    "total_weight double, n_epochs_done bigint, best_positions_path string, experiment_id string, role string, hypothesis string"
)


@dataclass(frozen=True)
class Dataset:
    """What a named graph should hold; None is not checked."""

    loader: str
    nodes: int | None = None
    edges: int | None = None
    total: float | None = None


#: The two published graphs.
DATASETS = {"connectome": Dataset("csv", 136_648, 5_657_719, 41_912_141), "mouse": Dataset("tsv", 148, 583, None)}


def read_edges_csv(spark: SparkSession, path: str, columns: tuple[str, str, str] = CSV_COLUMNS, weight: str = "bigint") -> DataFrame:
    """A CSV with header, gzip or not; dealt out evenly, as one gzip file is one task and one source may have most edges."""
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, ("bigint", "bigint", weight), strict=True))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).toDF("src", "tgt", "weight")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_edges_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of source, target, weight with any white space between; blank lines are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p")).where("p[0] <> ''")
    return parts.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("tgt"), F.col("p")[2].cast("double").alias("weight"))


def load_graph(spark: SparkSession, name: str, path: str, validate: bool = True, spec: Dataset | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges over dense ids and the node dictionary of a named graph; a mismatch with what it should hold is an error."""
    spec = spec or DATASETS[name]
    raw = read_edges_csv(spark, path) if spec.loader == "csv" else read_edges_tsv(spark, path)
    if validate:
        got = raw.agg(F.count("*").alias("edges"), F.sum("weight").alias("total")).crossJoin(nodes_of(raw).agg(F.count("*").alias("nodes"))).first()
        for key in ("nodes", "edges", "total"):
            want = getattr(spec, key)
            if want is not None and got[key] != want:
                raise ValueError(f"{name} should have {want} {key}, but has {got[key]}")
    return remap_node_ids(raw)


def save_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def load_saved_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def read_runs(spark: SparkSession, glob: str, multi_line: bool = True) -> DataFrame:
    """Run records, one JSON object a file; multi_line=False for the lines that write_runs makes."""
    return spark.read.schema(RUN_SCHEMA).json(glob, multiLine=multi_line)


def write_runs(records: DataFrame, path: str) -> None:
    """One JSON object a line, appended to what the folder holds; nulls are written out."""
    records.write.mode("append").option("ignoreNullFields", False).json(path)


def write_positions(positions: DataFrame, path: str) -> None:
    positions.write.mode("append").partitionBy("run").parquet(path)


def read_positions(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if run is None else found.where(F.col("run") == run)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def read_projections(spark: SparkSession, glob: str, hemisphere: int | None = None, cre: bool | None = None) -> DataFrame:
    """Replicate tables (exp_id, src_region, tgt_region, hemisphere, value, cre) as CSV, of one hemisphere and kind of line."""
    schema = "exp_id bigint, src_region bigint, tgt_region bigint, hemisphere int, value double, cre boolean"
    rows = spark.read.schema(schema).option("header", True).csv(glob)
    if hemisphere is not None:
        rows = rows.where(F.col("hemisphere") == hemisphere)
    return rows if cre is None else rows.where(F.coalesce("cre", F.lit(False)) == cre)
