"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A text's signature is cut into TRIES prefix tries of DEPTH minima each. The tries are sorted and grouped by prefix, and
a class of texts (all with one shingle set) walks up from the full depth: where the candidates that it has met so far
don't show that the target recall is reached, its matched prefix is shortened by one, down to the depth at which even a
pair at the threshold shares a prefix with probability RECALL. A class whose candidates are all so alike that this
depth would have shown a pair of their similarity with probability RECALL stops; it is still met by those that go on.
So a pair at the threshold is missed with probability 5e-6, and with 6e-4 where both classes stopped at the full depth.

A pair is examined once, in the first trie in which it shares its longest prefix: its signatures say where that is. No
pair leaves a task, so large groups of near copies cost no quadratic output:
1. nodes of the tries (split into tiles where large) compare signatures; what leaves a tile is each class that has a
   candidate in it, with the least similarity of its candidates;
2. full shingle sets go to the tiles in which their class has a candidate, only the candidate pairs are compared, and
   what leaves a tile is the number of links of each class and the root of its links there.

Words are runs of letters and digits in lower case. A text of fewer than n words has one shingle of all its words; a
text without words, or null, links with nothing. Each row stands for itself, also where several share an id; rows
without an id form no class. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import scratch, split_batch, text_bytes, unused_name, written
from arcorder.llm.components import components
from arcorder.llm.hashing import Forest, grouped, mixed, shingle_sets

TRIES, DEPTH, RECALL = 40, 8, 0.99999
TILE = 1024
_masks = np.random.default_rng(11).integers(0, 2**32, size=(2, TRIES * DEPTH), dtype=np.uint32)
_masks[1] |= np.uint32(1)


def found_at(similarity: float, depth: int) -> float:
    """Probability that a pair of this similarity shares a prefix of this depth in some trie."""
    return 1 - (1 - similarity**depth) ** TRIES


def least_depth(threshold: float, recall: float = RECALL) -> int:
    """The depth at which a pair at the threshold is found with the target recall."""
    return next((k for k in range(DEPTH, 1, -1) if found_at(threshold, k) >= recall), 1)


def enough(depth: int, recall: float = RECALL) -> float:
    """The least similarity that is found at this depth with the target recall."""
    return (1 - (1 - recall) ** (1 / TRIES)) ** (1 / depth)


def signature(shingles: np.ndarray) -> np.ndarray:
    """A byte of each minimum (tries, depth) of the shingles under bijections of 32-bit words."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.empty(TRIES * DEPTH, dtype=np.uint32)
    step = max(1, (1 << 18) // max(1, len(x)))
    for i in range(0, len(out), step):
        out[i : i + step] = ((x[None, :] ^ _masks[0][i : i + step, None]) * _masks[1][i : i + step, None]).min(1)
    return mixed(out.astype(np.uint64)).astype(np.uint8)


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row: id, class_id (smallest id reachable by links), n_links (rows linked directly), kept."""
    return _joined(df, id_col, text_col, n, threshold).select(F.col("id").alias(id_col), "class_id", "n_links", "kept")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of df that stay: of each class the row with the smallest id (all, if this very row is repeated)."""
    kept = written(_joined(df, id_col, text_col, n, threshold).where("kept").select("id", "print").distinct(), "join-kept")
    key, mark = (unused_name([*df.columns, "id", "print"], name) for name in ("key", "mark"))
    rows = df.withColumns({key: F.col(f"`{id_col}`").cast("long"), mark: _print(text_col)})
    return rows.join(kept, rows[key].eqNullSafe(kept["id"]) & (rows[mark] == kept["print"]), "left_semi").drop(key, mark)


def _print(text_col: str):
    return F.xxhash64(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def _joined(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    with scratch() as work:
        return work.keep(_classes_and_links(df, id_col, text_col, n, threshold), "join")


def _classes_and_links(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), _print(text_col).alias("print"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    docs = written(texts.mapInArrow(_signatures(n), "id long, print long, set binary, sig binary"), "join-signatures")
    # partial aggregation takes a hot set down to a row for each task
    sets = docs.where("id IS NOT NULL AND set IS NOT NULL").groupBy("set").agg(F.min(F.struct("id", "print", "sig")).alias("r"), F.count("*").alias("copies"))
    classes = written(sets.select(F.monotonically_increasing_id().alias("cls"), "set", F.col("r.id").alias("rep"), "r.print", "r.sig", "copies"), "join-classes")

    candidates = _candidates(classes, threshold)
    links = written(_verified(texts, classes, candidates, n, threshold), "join-links")
    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    linked = written(components(links.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls"), "join-groups")
    firsts = linked.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("first"))
    grouped_classes = linked.join(firsts, "component").select("cls", "first")

    per_set = classes.select("cls", "set", "rep", "copies").join(counts, "cls", "left").join(grouped_classes, "cls", "left")
    per_set = per_set.select("set", F.coalesce("first", "rep").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # rows without words or id are in no class and needn't meet the classes
    within = docs.where("id IS NOT NULL AND set IS NOT NULL").select("id", "print", "set").join(per_set, "set", "left").select("id", "print", F.col("class").alias("class_id"), F.col("links").cast("long").alias("n_links"))
    alone = docs.where("id IS NULL OR set IS NULL").select("id", "print", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return within.unionByName(alone).withColumn("kept", F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)))


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, trie, prefix, depth, members): the classes that have a candidate at a node, which is named by its trie and prefix."""
    least = least_depth(threshold)
    # a candidate pair is one whose signatures agree as often as those of a pair at the threshold, less six standard deviations
    agree = threshold + (1 - threshold) / 256
    floor = int(TRIES * DEPTH * agree - 6 * math.sqrt(TRIES * DEPTH * agree * (1 - agree)))
    label = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: F.struct(t.alias("trie"), F.substring("sig", t * DEPTH + 1, F.lit(DEPTH)).alias("path")))
    spread = classes.select("cls", F.explode(label).alias("l")).select("cls", "l.trie", "l.path", F.substring("l.path", 1, least).alias("node"))
    crowded = spread.groupBy("trie", "node").agg(F.count("*").alias("members")).where("members > 1")
    # deeper nodes lie within these, so all that follows is about classes that share a prefix with another one
    paths = written(spread.join(crowded, ["trie", "node"]).select("cls", "trie", "path"), "join-paths")
    seen, found, settled = None, None, None
    for depth in range(DEPTH, least - 1, -1):
        rows = paths.select("cls", "trie", F.substring("path", 1, depth).alias("prefix"))
        active = rows.withColumn("active", F.lit(True)) if settled is None else rows.join(settled.withColumn("stopped", F.lit(True)), "cls", "left").withColumn("active", F.col("stopped").isNull())
        sums = [F.sum(F.xxhash64("cls", F.lit(s)) % (1 << 40)).alias(f"sum{s}") for s in (1, 2)]
        sizes = active.groupBy("trie", "prefix").agg(F.count("*").alias("members"), F.max("active").alias("wanted"), F.min("cls").alias("first"), F.max("cls").alias("last"), *sums).where("members > 1")
        # nodes with the same members share all their pairs, and the first of them owns these
        same = ["members", "first", "last", "sum1", "sum2"]
        nodes = written(sizes.groupBy(*same).agg(F.min(F.struct("trie", "prefix")).alias("node"), F.max("wanted").alias("wanted")), "join-nodes")
        new = nodes.where("wanted") if seen is None else nodes.where("wanted").join(seen, same, "left_anti")
        seen = nodes.select(*same) if seen is None else seen.unionByName(nodes.select(*same))
        here = rows.join(new.select("node.trie", "node.prefix", "members"), ["trie", "prefix"]).join(classes.select("cls", "sig"), "cls")
        compared = _tiled(here, depth).mapInArrow(_compare_signatures(depth, floor), "cls long, trie int, prefix binary, members long, least float")
        met = written(compared.groupBy("cls", "trie", "prefix", "members").agg(F.min("least").alias("least")).withColumn("depth", F.lit(depth)), "join-candidates")
        found = met if found is None else found.unionByName(met)
        if depth > least:
            # two standard deviations below the estimate of the least alike candidate
            settled = found.groupBy("cls").agg(F.min("least").alias("least")).where(F.col("least") >= enough(depth)).select("cls")
    return found.select("cls", "trie", "prefix", "members", "depth")


def _verified(texts: DataFrame, classes: DataFrame, candidates: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cls, n, root): for each class and tile in which it has links, the rows linked directly and a class they reach there."""
    wanted = candidates.select("cls").distinct().join(classes.select("cls", "rep", "print", "set", "sig", "copies"), "cls")
    full = texts.where("id IS NOT NULL").withColumnRenamed("id", "rep").join(wanted, ["rep", "print"]).select("cls", "copies", "set", "sig", "text")
    sets = written(full.mapInArrow(_shingles(n), "cls long, copies long, sig binary, shingles binary"), "join-sets")
    tiles = _tiled(candidates.join(sets, "cls"), None)
    return tiles.mapInArrow(_compare_sets(threshold), "cls long, n long, root long")


def _tiled(df: DataFrame, depth: int | None) -> DataFrame:
    """Rows of a node side by side: one tile for a small node, tiles of two hashed blocks each for a large one.

    side says what a tile compares: 0 all its rows; else those of its first block (-1) with those of its second (1), either
    of which may have no row here.
    """
    df = df if depth is None else df.withColumn("depth", F.lit(depth))
    blocks = F.ceil(F.col("members") / TILE).cast("int")
    placed = df.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("trie", "prefix", "depth", F.least("block", "other"), F.greatest("block", "other"))
    side = F.signum(F.col("block") - F.col("other")).cast("int").alias("side")
    return spread.select(tile.alias("tile"), *df.columns, side).repartition("tile").sortWithinPartitions("tile", "side", "cls")


def _fixed(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return _binary(column)[1].reshape(rows, -1)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return text_bytes(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 2):
                keys, sigs = [], []
                for s in shingle_sets(*text_bytes(part.column(2)), n):
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "print", "set", "sig"])

    return run


def _shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 4):
                sets = [s.tobytes() for s in shingle_sets(*text_bytes(part.column(4)), n)]
                # a hash is no proof that this is the class's own text
                own = pa.array([hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, part.column(2).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), pa.array(sets, pa.binary())], names=["cls", "copies", "sig", "shingles"]).filter(own)

    return run


def owned(sig: np.ndarray, r: np.ndarray, c: np.ndarray, trie: np.ndarray, depth: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (r, c): those that agree in `floor` places or more and belong to their tile's trie and depth; with the places that agree."""
    kept = []
    for i in range(0, len(r), 16384):
        x, y = r[i : i + 16384], c[i : i + 16384]
        same = sig[x] == sig[y]
        many = np.count_nonzero(same, axis=1)
        near = np.flatnonzero(many >= floor)
        paths = same[near].reshape(-1, TRIES, DEPTH)
        longest = np.where(paths.all(2), DEPTH, paths.argmin(2))
        x, y, many = x[near], y[near], many[near]
        mine = (longest.max(1) == depth[x]) & (longest.argmax(1) == trie[x])  # the first trie of the longest prefix
        kept.append((x[mine], y[mine], many[mine]))
    return tuple(np.concatenate([k[j] for k in kept]) if kept else np.zeros(0, np.int64) for j in range(3))


def tile_pairs(sig: np.ndarray, tile: np.ndarray, side: np.ndarray, trie: np.ndarray, depth: np.ndarray, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Owned pairs of every tile: all of a tile of one block, those between the blocks of a tile of two."""
    ends = np.flatnonzero(np.concatenate([tile[1:] != tile[:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    whole = side[starts] == 0
    small = (size <= 32) & whole
    for s in np.unique(size[small]):
        x, y = np.triu_indices(s, 1)
        first = starts[small & (size == s)]
        yield owned(sig, (first[:, None] + x).ravel(), (first[:, None] + y).ravel(), trie, depth, floor)
    for lo, hi, one in zip(starts[~small].tolist(), ends[~small].tolist(), whole[~small].tolist(), strict=True):
        cut = lo + int(np.searchsorted(side[lo:hi], 1))
        for i in range(lo, hi if one else cut, 16):
            rows = np.arange(i, min(i + 16, hi if one else cut))
            cols = np.arange(i if one else cut, hi)
            r, c = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
            ahead = c > r
            yield owned(sig, r[ahead], c[ahead], trie, depth, floor)


def _tile_ends(tile: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.flatnonzero(np.concatenate([tile[1:] != tile[:-1], [True]])) + 1
    return zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)


def _compare_signatures(depth: int, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tile"):
            tile, side, trie = (table.column(c).to_numpy() for c in ("tile", "side", "trie"))
            agree = np.full(len(tile), TRIES * DEPTH + 1)
            for r, c, many in tile_pairs(_fixed(table.column("sig"), len(tile)), tile, side, trie, np.full(len(tile), depth), floor):
                np.minimum.at(agree, r, many)
                np.minimum.at(agree, c, many)
            has = agree <= TRIES * DEPTH
            j = (agree[has] / (TRIES * DEPTH) - 1 / 256) / (1 - 1 / 256)
            least = (j - 2 * np.sqrt(np.maximum(j * (1 - j), 0) / (TRIES * DEPTH))).astype(np.float32)
            kept = table.filter(pa.array(has)).select(["cls", "trie", "prefix", "members"])
            yield from kept.append_column("least", pa.array(least)).to_batches()

    return run


def shared_counts(sets: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How many shingles the sets r[i] and c[i] share, for each i."""
    if len(r) <= 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(r, c, strict=True)], dtype=np.float32)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    use = often[number]
    column, owner = (np.cumsum(often) - 1)[number[use]], owner[use]
    out = np.zeros(len(r), dtype=np.float32)
    dense_pairs = len(r) > 0.05 * len(sets) ** 2
    at = np.searchsorted(column, np.arange(0, int(often.sum()) + 4096, 4096))
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b == a:
            continue
        dense = np.zeros((len(sets), int(column[b - 1]) - 4096 * k + 1), dtype=np.float32)
        dense[owner[a:b], column[a:b] - 4096 * k] = 1
        if dense_pairs:
            out += (dense @ dense.T)[r, c]
        else:
            for i in range(0, len(r), 256):
                out[i : i + 256] += np.einsum("ij,ij->i", dense[r[i : i + 256]], dense[c[i : i + 256]])
    return out


def _compare_sets(threshold: float):
    agree = threshold + (1 - threshold) / 256
    floor = int(TRIES * DEPTH * agree - 6 * math.sqrt(TRIES * DEPTH * agree * (1 - agree)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tile"):
            tile, side, trie, depth = (table.column(c).to_numpy() for c in ("tile", "side", "trie", "depth"))
            classes, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
            all_sig = _fixed(table.column("sig"), len(tile))
            off, raw = _binary(table.column("shingles"))
            for lo, hi in _tile_ends(tile):
                rows = np.arange(lo, hi)
                rows = rows[np.concatenate([[True], classes[lo + 1 : hi] != classes[lo : hi - 1]])]  # a repeated row has its set twice
                pairs = list(tile_pairs(all_sig[rows], tile[rows], side[rows], trie[rows], depth[rows], floor))
                r, c = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                if not len(r):
                    continue
                sets = [np.frombuffer(raw[off[i] : off[i + 1]].tobytes(), dtype=np.uint64) for i in rows]
                size, weight = np.array([len(s) for s in sets]), copies[rows]
                shared = shared_counts(sets, r, c)
                near = shared >= threshold * (size[r] + size[c] - shared) - 1e-9
                r, c = r[near], c[near]
                n = np.bincount(r, weight[c], len(rows)) + np.bincount(c, weight[r], len(rows))
                forest = Forest(len(rows))
                forest.join(r, c)
                has = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (classes[rows], n.astype(np.int64), classes[rows][forest.root])], names=["cls", "n", "root"])

    return run
