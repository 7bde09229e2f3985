"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors become int8 codes of their unit vectors with a scale and an error bound each, and are dealt to hashed blocks of
about BLOCK rows; each pair of blocks is one tile. Only codes travel to all tiles. A tile multiplies them (exact products
of small whole numbers) and compares them with the threshold and the pair's error bound: for u = s q + e,
|u.v - s_u s_v q_u.q_v| <= |e_u| + |e_v| + |e_u| |e_v|. A pair below the threshold by more than that is no link, one above
it by more is a link, and only the pairs in between are recomputed from the full vectors, each for itself and in double
precision; the full vectors follow only to the tiles in which their row has such a pair. A tile returns one row for each vector that has links in it: their number and the vector's root in the
tile, so no pairs leave it, however large a group of copies is, and exact copies need no full vector.

Vectors that are null, empty, zero or hold null or non-finite parts link with nothing; so do vectors of other
dimensions. Rows that share an id are pooled; rows without an id link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import scratch, text_bytes, written
from arcorder.llm.components import components
from arcorder.llm.hashing import Forest, grouped

BLOCK = 4096
TILE = 1024
#: What rounding of scales, bounds and cosines may make of a pair's bound.
CLOSE = 1e-11
CODES = "row long, id long, dim int, code binary, scale double, err double"
FOUND = "id long, n long, root long"
#: Bits of a block's number in the name of its tile.
BITS = 22


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row for each row: id, n_links, component_id (smallest id reachable by links), kept."""
    with scratch() as work:
        return work.keep(_near(df, id_col, vector_col, threshold), "embedding")


def _near(df: DataFrame, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # written, so that each row keeps its number
    good = written(rows.where(F.col("id").isNotNull() & ok).select(F.monotonically_increasing_id().alias("row"), "id", "v"), "embedding-vectors")
    codes = written(good.mapInArrow(_coded, CODES), "embedding-codes")
    blocks = codes.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # as many rows as there are dimensions
    placed = codes.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # 19 bits for the dimension, so names are distinct up to 2^22 blocks of 4,096 rows
    tile = F.shiftleft(F.shiftleft(F.col("dim").cast("long"), BITS) + F.least("block", "other"), BITS) + F.greatest("block", "other")
    side = F.signum(F.col("block") - F.col("other")).cast("int").alias("side")
    tiles = placed.select("row", "id", "code", "scale", "err", "block", "dim", other).select(tile.alias("tile"), "row", "id", "code", "scale", "err", side)
    first = tiles.repartition("tile").sortWithinPartitions("tile", "side", "row").mapInArrow(_products(threshold), f"tile long, row long, code binary, scale double, err double, side int, {FOUND}")
    first = written(first, "embedding-products")
    full = first.where("code IS NOT NULL").drop("n", "root").join(good.select("row", "v"), "row").repartition("tile").sortWithinPartitions("tile", "side", "row")
    found = first.where("n > 0").select("id", "n", "root").unionByName(full.mapInArrow(_recomputed(threshold), FOUND))
    found = written(found, "embedding-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return (
        rows.select("id")
        .join(counts, "id", "left")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, scales, and error bounds of the unit vectors."""
    v = v / np.abs(v).max(1)[:, None]  # cosines don't change, and squares stay finite
    u = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    e = u - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", e, e)) * (1 + 1e-9) + 1e-12


def _vectors(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            for k in range(0, len(rows), max(1, (1 << 20) // int(d))):
                some = rows[k : k + max(1, (1 << 20) // int(d))]
                q, scale, err = quantised(_vectors(batch.column(2), some, int(d)))
                at = pa.array(some)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(some), d, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale), pa.array(err)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "dim", "code", "scale", "err"])


def _pairs(q: np.ndarray, scale: np.ndarray, err: np.ndarray, cut: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, sure) of the pairs of a tile that may reach the threshold, a square at a time; sure where they must.

    Pairs of rows before `cut` with those from it on, or of all rows if it is 0; q as float32 (or 64) for exact fast products.
    """
    for i in range(0, cut or len(q), TILE):
        rows = slice(i, min(i + TILE, cut or len(q)))
        for j in range(cut or i, len(q), TILE):
            cols = slice(j, min(j + TILE, len(q)))
            dots = q[rows] @ q[cols].T
            least = (threshold - err[rows] - (1 + err[rows]) * err[cols].max()) / scale[rows]
            near = dots * scale[cols].astype(dots.dtype) >= (least - 1e-5 * np.abs(least) - 1e-6)[:, None].astype(dots.dtype)
            if not cut and i == j:
                near &= np.arange(near.shape[0])[:, None] < np.arange(near.shape[1])[None, :]
            r, c = np.nonzero(near)
            # the same for a pair whatever square it is in
            about = dots[r, c].astype(np.float64) * (scale[rows][r] * scale[cols][c])
            off = (err[rows][r] + err[cols][c]) + err[rows][r] * err[cols][c] + CLOSE
            r, c, sure, some = r + i, c + j, about - off >= threshold, about + off >= threshold
            if some.any():
                yield r[some], c[some], sure[some]


def _tiles(table: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, rows of the first of two blocks or 0, codes, scales, bounds) of each tile of a table sorted by tile and side."""
    tile, side = table.column("tile").to_numpy(), table.column("side").to_numpy()
    scale, err = table.column("scale").to_numpy(), table.column("err").to_numpy()
    codes = table.column("code").combine_chunks()
    off, raw = text_bytes(codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes)
    ends = np.flatnonzero(np.concatenate([tile[1:] != tile[:-1], [True]])) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        if side[a] == 1:
            continue  # the first block has no row here
        dim = (off[b] - off[a]) // (b - a)
        q = raw[off[a] : off[b]].view(np.int8).reshape(b - a, dim).astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        yield a, b, int(np.searchsorted(side[a:b], 1)) if side[a] else 0, q, scale[a:b], err[a:b]


class _Links:
    """The number of links and the smallest id reachable by them of each row of a tile."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.order = ids, np.argsort(ids, kind="stable")
        self.place = np.empty(len(ids), dtype=np.int64)
        self.place[self.order] = np.arange(len(ids))
        self.n, self.forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        self.n += np.bincount(r, minlength=len(self.n)) + np.bincount(c, minlength=len(self.n))
        self.forest.join(self.place[r], self.place[c])

    def roots(self) -> np.ndarray:
        return self.ids[self.order][self.forest.root[self.place]]


def _products(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tile"):
            ids = table.column("id").to_numpy()
            unsure, n, root = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=np.int64), ids.copy()
            for a, b, cut, q, scale, err in _tiles(table):
                links = _Links(ids[a:b])
                for r, c, sure in _pairs(q, scale, err, cut, threshold):
                    links.add(r[sure], c[sure])
                    unsure[a + r[~sure]] = unsure[a + c[~sure]] = True
                n[a:b], root[a:b] = links.n, links.roots()
            # a row without an unsure pair needs no code any more
            code = pc.if_else(pa.array(unsure), table.column("code").combine_chunks(), pa.scalar(None, table.column("code").type))
            out = pa.table([table.column("tile"), table.column("row"), code, table.column("scale"), table.column("err"), table.column("side"), table.column("id"), pa.array(n), pa.array(root)], names=["tile", "row", "code", "scale", "err", "side", "id", "n", "root"])
            yield from out.filter(pa.array(unsure | (n > 0))).to_batches()

    return run


def _recomputed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tile"):
            ids = table.column("id").to_numpy()
            for a, b, cut, q, scale, err in _tiles(table):
                flat = table.column("v").slice(a, b - a).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                n, root = links_of(flat.reshape(b - a, -1), q, scale, err, cut, threshold, ids[a:b], again=False)
                has = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (ids[a:b], n, root)], names=["id", "n", "root"])

    return run


def links_of(v: np.ndarray, q: np.ndarray, scale: np.ndarray, err: np.ndarray, cut: int, threshold: float, ids: np.ndarray, again: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows before `cut` and those after it (0: among all rows), and each row's smallest id in the tile.

    Pairs that the bounds leave open are computed from the vectors; those that must be links count only with `again`.
    """
    v = v / np.abs(v).max(1)[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    links = _Links(ids)
    for r, c, sure in _pairs(q, scale, err, cut, threshold):
        if again:
            links.add(r[sure], c[sure])
        r, c = r[~sure], c[~sure]
        for k in range(0, len(r), 65536):
            x, y = r[k : k + 65536], c[k : k + 65536]
            linked = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= threshold
            links.add(x[linked], y[linked])
    return links.n, links.roots()
