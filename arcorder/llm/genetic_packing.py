"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents longer than the width are cut into pieces of the width, the first may be shorter; full pieces are sequences of
their own. All other pieces are dealt by hash to blocks of about BLOCK pieces, and each block is packed by ISLANDS
populations that evolve side by side in tasks of their own. An individual is a set of bins, not a list of pieces:
crossover injects whole well-filled bins of one parent into the other, removes the bins that held any of their pieces,
and best-fits the displaced rest, the longest first; mutation dissolves some of the emptiest bins. After each round the
best of an island migrates to the next one. The fitness is the number of bins, then the sum of their squared fills.

The emptiest bins of every block (an eighth of them, none that is full) are opened again and their pieces dealt to new
blocks together with those of other blocks, level by level, until one block is left; so no block pays for its last bins.
Only lengths travel in this, and each level is a written table of an eighth of the one before.

Null texts count as empty; each document ends with the end id, so none is without a piece. Repeated rows are packed like
any others, ties go by place in the block, and all random choices follow from (block, island, round). An empty table gives
no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.bpe import SharedVocabulary
from arcorder.llm.common import scratch, split_batch, written
from arcorder.llm.packing import encoder_of

#: Pieces of a block, populations of each block, rounds between migrations, children of a round, individuals of a population.
BLOCK, ISLANDS, ROUNDS, CHILDREN, POPULATION = 4096, 3, 3, 32, 6

PIECES = "row long, id long, piece int, start long, length long, ids binary, ids_crc32 long"


class Individual:
    """bin_of: the bin of each piece, numbered from 0; fill: the length in each bin."""

    def __init__(self, bin_of: np.ndarray, lengths: np.ndarray) -> None:
        names, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.fill = np.bincount(self.bin_of, weights=lengths, minlength=len(names)).astype(np.int64)
        self.fitness = (len(names), -int((self.fill * self.fill).sum()))


def best_fit(bin_of: np.ndarray, fill: list[int], pieces: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Put pieces, in the order given, into the fullest bin that takes them, or a new one; fill is that of the bins so far."""
    room = sorted((width - f, b) for b, f in enumerate(fill) if 0 < f < width)
    n = len(fill)
    for k, size in zip(pieces.tolist(), lengths[pieces].tolist(), strict=True):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, n = width, n, n + 1
        bin_of[k] = b
        if free > size:
            insort(room, (free - size, b))
    return bin_of


def longest_first(pieces: np.ndarray, lengths: np.ndarray, rng: np.random.Generator | None = None, noise: float = 0.0) -> np.ndarray:
    size = lengths[pieces].astype(float)
    if rng is not None:
        size = size * (1 + noise * rng.standard_normal(len(pieces)))
    return pieces[np.argsort(-size, kind="stable")]


def crossed(a: Individual, b: Individual, lengths: np.ndarray, width: int, rng: np.random.Generator) -> Individual:
    """A child of a with some of the well-filled bins of b, whole."""
    order = np.argsort(-b.fill, kind="stable")
    good = order[: max(1, int(len(order) * rng.uniform(0.2, 0.8)))]
    injected = np.zeros(len(b.fill), dtype=bool)
    injected[good[rng.random(len(good)) < rng.uniform(0.05, 0.4)]] = True
    comes = injected[b.bin_of]
    gone = np.zeros(len(a.fill), dtype=bool)
    gone[a.bin_of[comes]] = True
    # mutation: some of the emptiest bins that stay are opened too
    emptiest = np.argsort(a.fill, kind="stable")
    gone[emptiest[: int(rng.integers(0, 4 + len(emptiest) // 50))]] = True
    displaced = np.flatnonzero(gone[a.bin_of] & ~comes)
    bin_of = a.bin_of.copy()
    bin_of[comes] = len(a.fill) + b.bin_of[comes]
    fill = np.concatenate([np.where(gone, 0, a.fill), np.where(injected, b.fill, 0)]).tolist()
    return Individual(best_fit(bin_of, fill, longest_first(displaced, lengths, rng, 0.02), lengths, width), lengths)


def evolve(lengths: np.ndarray, width: int, population: list[Individual], rng: np.random.Generator, children: int, count: int) -> list[Individual]:
    """`children` steps: two parents by tournament, one child, the worst one goes; the best first."""
    lengths = lengths.astype(np.int64)
    everything = np.arange(len(lengths))
    while len(population) < count:
        order = longest_first(everything, lengths, rng if population else None, 0.1 * len(population) / count)
        population = [*population, Individual(best_fit(np.zeros(len(lengths), np.int64), [], order, lengths, width), lengths)]
    population = sorted(population, key=lambda x: x.fitness)
    least = -(-int(lengths.sum()) // width)
    for _ in range(children):
        if population[0].fitness[0] <= least:
            break
        a, b = (population[int(rng.integers(0, len(population), 2).min())] for _ in range(2))
        child = crossed(a, b, lengths, width, rng)
        if all(child.fitness != x.fitness for x in population):
            population = sorted([*population, child], key=lambda x: x.fitness)[:count]
    return population


STATE = "block long, island int, rows binary, lengths binary, elites array<binary>, bins long, squares long"


def _evolved(width: int, step: int):
    """Rows (block, island, rows, lengths, elites): a round of each island; elites are the bins of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], dtype="<i4")
                population = [Individual(np.frombuffer(x, dtype="<i4"), lengths) for x in row["elites"]]
                rng = np.random.default_rng([row["block"], row["island"], step])
                best = evolve(lengths, width, population, rng, CHILDREN, POPULATION)
                row |= {"elites": [x.bin_of.astype("<i4").tobytes() for x in best], "bins": best[0].fitness[0], "squares": best[0].fitness[1]}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("rows", pa.binary()), ("lengths", pa.binary()), ("elites", pa.list_(pa.binary())), ("bins", pa.int64()), ("squares", pa.int64())]))

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """One block's pieces as two flat arrays, in the order of their rows."""
    table = table.sort_by("row")
    flat = [pa.array([table.column(c).to_numpy().astype(k).tobytes()], pa.binary()) for c, k in (("row", "<i8"), ("length", "<i4"))]
    return pa.table([table.column("block").slice(0, 1), *flat], names=["block", "rows", "lengths"])


def _placed(width: int, level: int, last: bool):
    """Rows (block, rows, lengths, elite): where each piece of a block lies, and whether its bin is opened again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows, lengths, elite in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "lengths", "elite")), strict=True):
                row, n, bins = np.frombuffer(rows, "<i8"), np.frombuffer(lengths, "<i4").astype(np.int64), np.frombuffer(elite, "<i4").astype(np.int64)
                fill = np.bincount(bins, weights=n).astype(np.int64)
                again = np.zeros(len(fill), dtype=bool)
                if not last:
                    again[np.argsort(fill, kind="stable")[: -(-len(fill) // 8)]] = True
                    again &= fill < width
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(n[order]) - n[order]
                offset = np.empty(len(n), dtype=np.int64)
                offset[order] = before - (np.cumsum(fill) - fill)[bins[order]]
                name = (level << 56) + (block << 16) + bins
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(n), pa.array(name), pa.array(offset), pa.array(again[bins])], names=["row", "length", "sequence_id", "offset", "again"])

    return run


def assign(items: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """items(row long, length long), lengths below the width -> (row, sequence_id, offset)."""
    with scratch() as work:
        items, level, done = written(items.select("row", F.col("length").cast("long").alias("length")), "genetic-items"), 0, []
        while True:
            blocks = max(1, -(-items.count() // block))
            # a prime-free deal: the hash of the row and the level, so pieces meet new neighbours at each level
            dealt = items.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
            gathered = dealt.groupBy("block").applyInArrow(_gathered, "block long, rows binary, lengths binary")
            state = gathered.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("elites", F.array().cast("array<binary>"))
            for step in range(ROUNDS):
                if step:
                    # the best of each island goes to the next one
                    guests = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elites")[0].alias("guest"))
                    state = state.join(guests, ["block", "island"]).withColumn("elites", F.array_append(F.slice("elites", 1, POPULATION - 1), F.col("guest")))
                state = state.select("block", "island", "rows", "lengths", "elites").repartition(min(blocks * ISLANDS, 1 << 14), "block", "island")
                state = written(state.mapInArrow(_evolved(width, step), STATE), "genetic-islands")
            fitness = F.struct("bins", "squares", "island")
            best = state.groupBy("block").agg(F.min_by(F.struct("rows", "lengths", F.col("elites")[0].alias("elite")), fitness).alias("b")).select("block", "b.*")
            placed = written(best.mapInArrow(_placed(width, level, blocks == 1), "row long, length long, sequence_id long, offset long, again boolean"), "genetic-places")
            done.append(placed.where("NOT again").select("row", "sequence_id", "offset"))
            if blocks == 1:
                break
            items, level = placed.where("again").select("row", "length"), level + 1
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return work.keep(out, "genetic-assigned")


def pieces(df: DataFrame, vocabulary: SharedVocabulary, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 2) -> DataFrame:
    """A written table of the pieces of all documents, each with a number of its own (row) and its ids."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocabulary)
        number = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            for part in split_batch(batch, "text"):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    total = len(ids) // 4
                    first = total % width or width
                    for k, stop in enumerate(range(first, total + 1, width)):
                        start = max(0, stop - width) if k else 0
                        cut = ids[4 * start : 4 * stop]
                        out.append((number, doc, k, start, stop - start, cut, zlib.crc32(cut)))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return written(source.mapInArrow(run, PIECES), "genetic-pieces")


def pack(df: DataFrame, vocabulary: SharedVocabulary, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 2, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids (binary: unsigned 32 bits, little-endian), ids_crc32, sequence_id, offset."""
    cut = pieces(df, vocabulary, id_col, text_col, width, end_id)
    places = assign(cut.where(f"length < {width}").select("row", "length"), width, block)
    columns = ["id", "piece", "start", "length", "ids", "ids_crc32"]
    full = cut.where(f"length = {width}").select(*columns, (F.col("row") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.where(f"length < {width}").join(places, "row").select(*columns, "sequence_id", "offset").unionByName(full)
