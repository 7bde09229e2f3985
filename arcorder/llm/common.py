"""Shared helpers: table access, written intermediate tables (of the library itself), Arrow text buffers, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcorder.operators.storage import scratch, written

__all__ = ["bounded_rows", "byte_lengths", "hashed_sample", "no_clash", "scratch", "split_batch", "table", "text_bytes", "unused_name", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_batch(batch: pa.RecordBatch, column: int | str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text each (one row at least)."""
    col = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
    if not len(col):
        return
    ends = np.concatenate([[0], np.cumsum(byte_lengths(col))])
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def unused_name(taken: list[str], name: str = "text") -> str:
    """A column name that none of the taken ones clashes with, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def no_clash(keep: list[str], *made: str) -> None:
    """An error if a kept column has the name of one that an operator makes."""
    both = {c.lower() for c in keep} & {c.lower() for c in made}
    if both:
        raise ValueError(f"kept columns have names of the output: {', '.join(sorted(both))}")


def byte_lengths(col: pa.Array) -> np.ndarray:
    off, _ = text_bytes(col)
    return np.diff(off)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column, nulls as empty texts, without a copy where there are none."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return off - off[0], raw


def hashed_sample(df: DataFrame, key: str, rows: int, seed: int = 1) -> DataFrame:
    """About `rows` rows of df with a key (all if it has fewer), chosen by a hash of the key, the same on every run.

    The share follows from the table's count, so the sample stays bounded however large the table is.
    """
    df = df.where(F.col(f"`{key}`").isNotNull())
    share = min(1.0, rows / max(1, df.count()))
    return df if share == 1 else df.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), F.lit(1_000_000_007)) < int(share * 1_000_000_007))


def bounded_rows(df: DataFrame, content: str, rows: int, budget: int) -> pa.Table:
    """Rows of a sample for the driver, bounded in number and in bytes of their content, in the order of a hash of the id.

    df holds `id` and `content`. Rows with one id and content are one, with the smallest other values; a row with more than
    a sixteenth of the budget is left out, and the order is cut where the budget ends. The sample is written, so what is
    counted is what is sent.
    """
    with scratch():
        return _bounded(written(df.where("id IS NOT NULL"), "sample"), content, rows, budget)


def _bounded(some: DataFrame, content: str, rows: int, budget: int) -> pa.Table:
    size = F.coalesce(F.octet_length(F.col(content)), F.lit(0))
    order = F.xxhash64("id", F.lit(3))
    sizes = some.select("id", size.alias("size"), F.xxhash64(content).alias("print")).where(F.col("size") <= budget // 16).distinct().orderBy(order, "id", "print").limit(rows).toArrow()
    kept = sizes.slice(0, int(np.searchsorted(np.cumsum(sizes.column("size").to_numpy()), budget, side="right"))).select(["id", "print"])
    if not kept.num_rows:
        return some.limit(0).toArrow()
    wanted = some.sparkSession.createDataFrame(kept.append_column("place", pa.array(range(kept.num_rows)))).withColumnRenamed("id", "_id")
    rest = F.struct(F.lit(0).alias("_one"), *[c for c in some.columns if c not in ("id", content)])
    got = some.join(F.broadcast(wanted), (F.col("id") == F.col("_id")) & (F.xxhash64(content) == F.col("print"))).groupBy("place", "id", content).agg(F.min(rest).alias("_rest"))
    return got.select("place", "id", content, "_rest.*").drop("_one").toArrow().sort_by("place").select(some.columns)
