"""Exact dedup by content sort.

Sampled splitters range-partition the rows by (the first bytes of the normalised text, its hash, id), an external
sort by (first bytes, hash, whole text, id) places equal texts next to each other, and each partition compares
neighbouring texts in full. The splitters hold PREFIX bytes of a text, so the sample that Spark gathers for them
stays small; as the id is part of the key, a text that holds a third of all rows spreads over many partitions. A run of equal texts that touches an end of its partition
may go on in the next one; only those runs (two for each partition at most) are stitched by their SHA-256. Two different
texts of one 64-bit hash and one prefix, on both sides of a border, could leave a run unstitched: by chance, once in about
2^64 pairs of neighbouring texts at borders.

Null texts count as empty. Of each group one row stays: the one with the largest (or smallest) id, and of repeated
rows with that id just one. Null ids sort below all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from arcorder.llm.common import scratch, unused_name, written


#: Bytes of a text in the splitters.
PREFIX = 48


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row for each input row: the id, keep_id, group_size, kept, text_sha256.

    normalise: a function from the text column to the column that is compared (default: the text itself).
    """
    with scratch() as work:
        return work.keep(_exact(df, id_col, text_col, keep, normalise), "dedup")


def _exact(df: DataFrame, id_col: str, text_col: str, keep: str, normalise) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text: Column = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    content = (normalise(text) if normalise else text).cast("binary")
    order = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    # the row that stays comes last in its run
    ordered = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), content.alias("content"))
    keys = [F.substring("content", 1, PREFIX), F.xxhash64("content")]
    ordered = ordered.repartitionByRange(*keys, order).sortWithinPartitions(*keys, "content", order)
    rows = written(ordered.mapInArrow(_runs, "id long, text_sha256 string, part int, edge boolean, last boolean, run_size long, run_id long"), "dedup-runs")

    # runs at an end of a partition: at most two for each partition, whatever the number of rows
    edges = rows.where("edge AND last").groupBy("text_sha256").agg(F.sum("run_size").alias("edge_size"), F.max_by(F.struct("run_id"), "part")["run_id"].alias("edge_id"), F.max("part").alias("edge_part"))
    joined = rows.join(F.broadcast(edges.withColumn("edge", F.lit(True))), ["text_sha256", "edge"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("edge"), F.col("edge_id")).otherwise(F.col("run_id")).alias("keep_id"),
        F.coalesce("edge_size", "run_size").alias("group_size"),
        (F.col("last") & F.coalesce(F.col("part") == F.col("edge_part"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """The rows of df that stay, with all their columns."""
    found = exact_dedup(df, id_col, text_col, keep, normalise)
    text: Column = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sha = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    name = unused_name(df.columns, "sha")
    its_id, its_sha = (unused_name([*df.columns, name], n) for n in ("kept_id", "kept_sha"))
    kept = found.where("kept").select(F.col(id_col).alias(its_id), F.col("text_sha256").alias(its_sha))
    rows = df.withColumn(name, sha)
    rows = rows.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(its_id)) & (F.col(name) == F.col(its_sha)), "left_semi")
    # the same id with the same text: of such rows the join keeps all, so one must be chosen
    if found.where(F.col("keep_id").eqNullSafe(F.col(id_col)) & ~F.col("kept")).limit(1).count():
        rows = rows.dropDuplicates([id_col, name])
    return rows.drop(name)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with its run's size, the id that stays, and whether the run touches an end."""
    part = TaskContext.get().partitionId()
    now: bytes | None = None
    ids: list[int | None] = []
    first = True

    def closed(at_end: bool) -> pa.RecordBatch:
        n = len(ids)
        sha = hashlib.sha256(now).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([sha] * n, pa.string()),
                pa.array([part] * n, pa.int32()),
                pa.array([first or at_end] * n, pa.bool_()),
                pa.array([False] * (n - 1) + [True], pa.bool_()),
                pa.array([n] * n, pa.int64()),
                pa.array([ids[-1]] * n, pa.int64()),
            ],
            names=["id", "text_sha256", "part", "edge", "last", "run_size", "run_id"],
        )

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = text.as_py()
            if content != now:
                if now is not None:
                    ready.append(closed(False))
                    first = False
                now, ids = content, []
            ids.append(i)
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            ready = []
    if now is not None:
        yield closed(True)
