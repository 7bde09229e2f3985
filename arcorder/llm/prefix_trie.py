"""A trie of conversation prefixes, with a minimal perfect hash over the nodes of each shard.

A node is a distinct sequence of first turns; its name is a digest of 128 bits, the exclusive or of one hash for each
(depth, turn), so digests along a path of any length are running sums that blocks of BAND turns can take side by side.
Each shard (some blocks of some conversations, CHUNK rows) enumerates its distinct digests, gives each a slot by a minimal
perfect hash, checks the digest, turn and parent that a slot holds against every row that falls on it, scatters counts
into flat arrays, and adds the arrays up through the parents' slots, deepest first. Shards add up to the whole:

- a first pass counts members and ends and finds each node's smallest member, its owner. The nodes that a
  conversation owns are a suffix of its path, so the depth where it begins to own is all that travels to the second pass;
- in the second pass a row counts for a distinct node only in its owner's path. What lies below a block, on the same
  path, comes in as one row for each block, so no path is ever held whole.

A hot node is one row for each shard that meets it, a long conversation is cut into blocks, and nothing of a group is
collected but the numbers of its ending members, which stream through one hash in order, thousands to a row.

Rows without a conversation belong to none. Null roles and texts are empty ones, null turns come first; rows of the same
turn go by role, then by the first TIE characters of the text, then by its hash; repeated rows are turns of their own.
If two different prefixes ever share a digest, the trie is built again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arcorder.llm.common import scratch, written
from arcorder.operators.ranking import global_rank
from arcorder.operators.storage import discard

#: Turns in one block of a path, rows of a shard, and ids in one row of text on the way to their hash.
BAND, CHUNK, IDS = 4096, 1 << 19, 1 << 15
#: Characters of a text that order rows of the same turn.
TIE = 32
#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: n keys have the slots 0 to n - 1.

    Level by level, keys that are alone in their place of a bit array stay there, the rest goes on with another hash; a
    slot is the rank of the bit. Each slot keeps its key, so a foreign key is told from a member.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(hi)), 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            base = int(rank[-1]) + 1
            left = left[~alone[at]]
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        slots = self._find(hi, lo)
        self.hi[slots], self.lo[slots] = hi, lo

    def __len__(self) -> int:
        return len(self.hi)

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (hi.view(np.uint64) + np.uint64(level)) * _ODD[0] ^ (lo.view(np.uint64) + np.uint64(level + 1)) * _ODD[1]
        x ^= x >> np.uint64(29)
        x *= _ODD[1]
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(hi), -1), np.arange(len(hi))
        for k, (alone, rank) in enumerate(self.levels):
            at = self._place(hi[left], lo[left], k, len(alone))
            here = alone[at]
            slots[left[here]] = rank[at[here]]
            left = left[~here]
        return slots

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are none of the table's."""
        found = self._find(hi, lo)
        if not len(self):
            return found
        return np.where((found >= 0) & (self.hi[found] == hi) & (self.lo[found] == lo), found, -1)


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), dtype=bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new]


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that cut no block; rows come sorted by (conv, depth)."""
    held: pa.Table | None = None
    for table in _tables(batches, rows):
        held = table if held is None else pa.concat_tables([held, table])
        conv, band = _numbers(held, "conv", "band")
        cut = len(conv) - int(((conv == conv[-1]) & (band == band[-1])).sum())
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


COUNTED = "hi long, lo long, depth long, phi long, plo long, c1 long, c2 long, words long, owner long, n long, n_ends long, clash boolean"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: members, ends and the smallest member of each node of a shard."""
    for table in _tables(batches, CHUNK):
        conv, depth, hi, lo, phi, plo, c1, c2, words, ends = _numbers(table, "conv", "depth", "hi", "lo", "phi", "plo", "c1", "c2", "words", "ends")
        nodes = SlotTable(*distinct(hi, lo))
        at, n = nodes.slots(hi, lo), len(nodes)
        kept = {}
        clash = np.zeros(n, dtype=bool)
        for name, values in (("depth", depth), ("phi", phi), ("plo", plo), ("c1", c1), ("c2", c2), ("words", words)):
            kept[name] = np.empty(n, dtype=np.int64)
            kept[name][at] = values
            clash[at[kept[name][at] != values]] = True
        owner = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(owner, at, conv)
        count, n_ends = np.bincount(at, minlength=n), np.bincount(at[ends], minlength=n)
        columns = [nodes.hi, nodes.lo, *(kept[k] for k in ("depth", "phi", "plo", "c1", "c2", "words")), owner, count, n_ends, clash]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[c.split()[0] for c in COUNTED.split(", ")])


SUMMED = "hi long, lo long, saved long, leaves long, children long, up long"


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: sums over the part of each subtree that a shard sees, through the parents' slots, deepest first."""
    for table in _blocks(batches, CHUNK):
        conv, depth, band, hi, lo, phi, plo, words, own_from, below_saved, below_leaves = _numbers(table, "conv", "depth", "band", "hi", "lo", "phi", "plo", "words", "own_from", "below_saved", "below_leaves")
        leaf, ends = _numbers(table, "leaf", "ends")
        owned = depth >= own_from
        inner = depth > 0
        nodes = SlotTable(*distinct(np.concatenate([hi, phi[inner]]), np.concatenate([lo, plo[inner]])))
        at, n = nodes.slots(hi, lo), len(nodes)
        up = np.full(len(at), -1)
        up[inner] = nodes.slots(phi[inner], plo[inner])
        saved, leaves, children = (np.zeros(n, dtype=np.int64) for _ in range(3))
        np.add.at(saved, at, np.where(owned, 0, words))
        np.add.at(leaves, at, (ends & owned & leaf).astype(np.int64))
        np.add.at(children, up[owned & inner], 1)
        # what lies below the block comes in at its last row
        last = np.ones(len(conv), dtype=bool)
        last[:-1] = (conv[1:] != conv[:-1]) | (band[1:] != band[:-1])
        np.add.at(saved, at[last], below_saved[last])
        np.add.at(leaves, at[last], below_leaves[last])
        # parents of a block's first turn belong to the block above, which gets its sums by path
        parent, level = np.full(n, -1), np.full(n, -1)
        level[at] = depth
        within = inner & ((depth - 1) // BAND == (depth - 2) // BAND) | (depth == 1)
        parent[at[within]] = up[within]
        order = np.argsort(-level, kind="stable")
        order = order[parent[order] >= 0]
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        for part in np.split(order, cuts):
            np.add.at(saved, parent[part], saved[part])
            np.add.at(leaves, parent[part], leaves[part])
        name = np.full(n, np.iinfo(np.int64).min)
        same = owned & (depth > own_from)
        name[at[same]] = conv[same]
        yield pa.RecordBatch.from_arrays([pa.array(nodes.hi), pa.array(nodes.lo), pa.array(np.where(level >= 0, saved, 0)), pa.array(np.where(level >= 0, leaves, 0)), pa.array(children), pa.array(name, mask=name == np.iinfo(np.int64).min)], names=["hi", "lo", "saved", "leaves", "children", "up"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hi, lo, conv): the ids of each node as text, at most IDS of them a row."""
    for table in _tables(batches, IDS):
        hi, lo, conv = _numbers(table, "hi", "lo", "conv")
        cuts = np.flatnonzero((np.diff(hi) != 0) | (np.diff(lo) != 0)) + 1
        first = np.concatenate([[0], cuts])
        texts = [",".join(map(str, part.tolist())) for part in np.split(conv, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first]), pa.array(conv[first]), pa.array(texts, pa.large_string()).cast(pa.string())], names=["hi", "lo", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hi, lo, first): one SHA-256 a node, fed row by row."""
    now, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = (hi, lo), hashlib.sha256(ids.encode())
        if out:
            yield _sha_batch(out)
    if now is not None:
        yield _sha_batch([(*now, state.hexdigest())])


def _sha_batch(rows: list[tuple]) -> pa.RecordBatch:
    hi, lo, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sha, pa.string())], names=["hi", "lo", "ends_sha256"])


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, rank, content, words) of all turns, and a written table (conv, first, n): a turn's place is rank - first.

    Turns are ranked over the whole table by range, so a conversation of any length is spread over many tasks.
    """

    def col(name: str, kind: str) -> Column:
        return F.col(f"`{name}`").cast(kind)

    role, text = F.coalesce(col(role_col, "string"), F.lit("")), F.coalesce(col(text_col, "string"), F.lit(""))
    rows = df.where(col(conv_col, "long").isNotNull()).select(
        col(conv_col, "long").alias("conv"),
        col(turn_col, "long").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, TIE).alias("head"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("content"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = global_rank(rows, "conv", F.col("turn").asc_nulls_first(), "role", "head", "content", "row").select("conv", "rank", "content", "words")
    return ranked, written(ranked.groupBy("conv").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "trie-conversations")


def trie(rows: DataFrame, lengths: DataFrame, seeds: int = 8) -> DataFrame:
    """One row for each node of the trie of some conversations.

    rows(conv, depth, content, words): turn `depth` (from 1) of each conversation, content 16 bytes that stand for it.
    lengths(conv, length): every conversation once, also those of no turns. Returns conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    with scratch() as work:
        return work.keep(_trie(rows, lengths, seeds), "trie")


def _trie(rows: DataFrame, lengths: DataFrame, seeds: int) -> DataFrame:
    long = bool(lengths.where(f"length > {BAND}").limit(1).count())
    for seed in range(seeds):
        paths, nodes = _nodes(rows, lengths, seed, long)
        if not nodes.where("clash").limit(1).count():
            break
        discard(paths, nodes)
    else:
        raise ValueError("prefixes share digests under every seed")
    owners = written(nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("own_from"), F.max(F.col("n") == F.col("n_ends")).alias("leaf")), "trie-owners")
    never = F.lit(np.iinfo(np.int64).max)
    owned = paths.join(owners, "conv", "left").withColumns({"own_from": F.coalesce("own_from", never), "leaf": F.coalesce("leaf", F.lit(False))})
    shards = owned.withColumns({c: F.lit(0).cast("long") for c in ("below_saved", "below_leaves")}) if not long else _with_below(owned)
    shards = shards.repartition("conv", "band").sortWithinPartitions("conv", "depth")
    sums = shards.select("conv", "depth", "band", "hi", "lo", "phi", "plo", "words", "ends", "own_from", "leaf", "below_saved", "below_leaves").mapInArrow(_accumulate, SUMMED)
    sums = sums.groupBy("hi", "lo").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"), F.max("up").alias("up"))
    ends = paths.where("ends").select("hi", "lo", "conv").repartitionByRange("hi", "lo", "conv").sortWithinPartitions("hi", "lo", "conv").mapInArrow(_listed, "hi long, lo long, first long, ids string")
    ends = ends.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_hashed, "hi long, lo long, ends_sha256 string")
    found = nodes.join(sums, ["hi", "lo"]).join(ends, ["hi", "lo"], "left")
    found = written(found.select("hi", "lo", "phi", "plo", "depth", F.col("owner").alias("conv_id"), F.col("n").alias("n_convs"), "up", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie-nodes")
    # a node whose parent has another owner asks for it; the root, which any number of nodes ask for, is one row
    root = F.broadcast(found.where("depth = 0").select(F.col("conv_id").alias("root")))
    asked = found.where("up IS NULL AND depth > 1").select("phi", "plo", F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    names = found.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("name"))
    answers = asked.join(names, ["phi", "plo"]).select(F.col("_hi").alias("hi"), F.col("_lo").alias("lo"), "name")
    out = found.join(answers, ["hi", "lo"], "left").crossJoin(root)
    parent = F.when(F.col("depth") == 1, F.col("root")).when(F.col("depth") > 1, F.coalesce("up", "name"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _with_below(owned: DataFrame) -> DataFrame:
    """The rows of all paths with the sums of what lies below their block on the same path."""
    blocks = owned.where(f"length > {BAND}").groupBy("conv", "band").agg(
        F.sum(F.when(F.col("depth") < F.col("own_from"), F.col("words")).otherwise(0)).alias("s"), F.count_if(F.col("ends") & F.col("leaf") & (F.col("depth") >= F.col("own_from"))).alias("l")
    )
    deeper = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    below = blocks.select("conv", "band", F.sum("s").over(deeper).alias("below_saved"), F.sum("l").over(deeper).alias("below_leaves"))
    return owned.join(below, ["conv", "band"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("below_saved", "below_leaves")})


def _nodes(rows: DataFrame, lengths: DataFrame, seed: int, long: bool) -> tuple[DataFrame, DataFrame]:
    """The paths, each row with its node's digest and its parent's, and the nodes with what the first pass counts."""
    named = rows.select("conv", F.col("depth").cast("long").alias("depth"), "content", "words")
    named = named.withColumn("band", F.floor((F.col("depth") - 1) / BAND))
    named = named.withColumns({g: F.xxhash64("depth", "content", F.lit(2 * seed + k)) for k, g in enumerate(("g1", "g2"))})
    path = Window.partitionBy("conv", "band").orderBy("depth")
    named = named.withColumns({"hi": F.bit_xor("g1").over(path), "lo": F.bit_xor("g2").over(path)})
    if long:  # what the blocks before come to
        before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.join(lengths.where(f"length > {BAND}").select("conv"), "conv", "left_semi").withColumn("band", F.floor((F.col("depth") - 1) / BAND))
        totals = totals.groupBy("conv", "band").agg(*[F.bit_xor(F.xxhash64(F.col("depth").cast("long"), "content", F.lit(2 * seed + k))).alias(f"t{k}") for k in range(2)])
        totals = totals.select("conv", "band", *[F.bit_xor(f"t{k}").over(before).alias(f"b{k}") for k in range(2)]).where("band > 0")
        named = named.join(totals, ["conv", "band"], "left")
        for k, name in enumerate(("hi", "lo")):
            named = named.withColumn(name, F.col(name).bitwiseXOR(F.coalesce(f"b{k}", F.lit(0).cast("long"))))
    halves = {f"c{k + 1}": F.xxhash64(F.substring("content", 1 + 8 * k, 8), F.lit(k)) for k in range(2)}
    named = named.join(lengths, "conv").withColumns(halves | {"phi": F.col("hi").bitwiseXOR(F.col("g1")), "plo": F.col("lo").bitwiseXOR(F.col("g2")), "ends": F.col("depth") == F.col("length")})
    zero = F.lit(0).cast("long")
    tops = lengths.select("conv", zero.alias("depth"), zero.alias("band"), "length", *[zero.alias(c) for c in ("hi", "lo", "phi", "plo", "c1", "c2", "words")], (F.col("length") == 0).alias("ends"))
    paths = written(tops.unionByName(named.select(tops.columns)), "trie-paths")
    counted = paths.mapInArrow(_count, COUNTED)
    same = [F.min(c).alias(c) for c in ("depth", "phi", "plo", "c1", "c2", "words")]
    differ = F.max("clash")
    for c in ("depth", "phi", "plo", "c1", "c2", "words"):
        differ = differ | (F.min(c) != F.max(c))
    nodes = counted.groupBy("hi", "lo").agg(*same, F.min("owner").alias("owner"), F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), differ.alias("clash"))
    return paths, written(nodes, "trie-counts")
