r"""Runs of repeated words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q and a length of at least max(SHORTEST, CUBE * q) that no
neighbouring word extends. When a block of B = 8, 16, 32, ... words is complete, its catcher looks out for the block's
return q words later, for every q from B to below 2 B (the smallest blocks also take the shorter periods): as words are
appended, the suffix of B words is compared with the block by a rolling hash. A long enough run of period q holds a whole
block of that size and its copy, so one catcher at least sees it. What returns is a square in the making: the comparison
goes on word by word to both sides, exactly, and the maximal stretch is a run if it is long enough. Further squares of
a run fall inside it and merge; so do those of multiples of its period, as periods are caught in ascending order.

All catchers of a size advance together in numpy: q words after their blocks, one comparison for all of them, over many
texts at once. That is n comparisons for each of log n sizes, whatever the words are; texts too short for a size drop out.

A word is a run of anything but ASCII white space; words are numbered before they are compared, so equality is exact.
Null, empty and short texts have no runs. Rows are kept as they come, with repeated ids too. An output column named like
one in `keep` is an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import no_clash, split_batch, unused_name

#: Least words of a run, least length over period, and words of the smallest block.
SHORTEST, CUBE, BLOCK = 24, 3, 8
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

Run = tuple[int, int, int]  # start, end, period


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def _joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice the size; the last ones run out of words and mean nothing."""
    out = _mixed(h) * _MIX[1]
    out[:-size] += h[size:]
    return out


class Text:
    """One text's numbered words and the runs caught so far."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.runs: list[Run] = []

    def stretch(self, at: int, q: int) -> tuple[int, int]:
        """The maximal stretch around `at` in which words q apart are identical; (at, at) if the word at `at` has no copy."""
        ids, n = self.ids, len(self.ids)
        i = j = at
        step = 64
        while (m := min(step, n - q - j)) > 0:
            differ = ids[j : j + m] != ids[j + q : j + q + m]
            if differ.any():
                j += int(differ.argmax())
                break
            j, step = j + m, step * 2
        if j == at:
            return at, at
        step = 64
        while (m := min(step, i)) > 0:
            differ = (ids[i - m : i] != ids[i - m + q : i + q])[::-1]
            if differ.any():
                i -= int(differ.argmax())
                break
            i, step = i - m, step * 2
        return i, j + q

    def covered(self, at: np.ndarray, q: np.ndarray, size: int, runs: list[Run]) -> np.ndarray:
        """Which squares (in the order of `at`) lie inside a run whose period divides theirs."""
        out = np.zeros(len(at), dtype=bool)
        for i, j, d in runs:
            a, b = np.searchsorted(at, [i, j])
            out[a:b] |= (at[a:b] + q[a:b] + size <= j) & (q[a:b] % d == 0)
        return out

    def catch(self, at: np.ndarray, q: np.ndarray, size: int) -> None:
        """Blocks that returned: their places, in order, and distances."""
        alive = ~self.covered(at, q, size, self.runs)
        at, q = at[alive], q[alive]
        for period in np.unique(q).tolist():
            end, new = -1, []
            for a in at[q == period].tolist():
                if a + period < end:
                    continue
                i, j = self.stretch(a, period)
                end = j
                if j - i >= max(SHORTEST, CUBE * period):
                    new.append((i, j, period))
            if new:
                self.runs += new
                if size == BLOCK:  # only here a period may divide a later one
                    alive = ~self.covered(at, q, size, new) | (q <= period)
                    at, q = at[alive], q[alive]


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """Of each text (numbers of its words), its runs by start, then period."""
    found = [Text(ids) for ids in texts]
    n = np.array([len(x) for x in texts], dtype=np.int64)
    size, left = BLOCK, np.flatnonzero(n >= SHORTEST)
    h = _mixed(np.concatenate([texts[k] for k in left]).astype(np.uint64) + np.uint64(1)) if len(left) else np.zeros(0, np.uint64)
    for k in (1, 2, 4):
        h = _joined(h, k)
    while len(left):
        first = np.concatenate([[0], np.cumsum(n[left])])
        _advance([found[k] for k in left], h, first, size)
        h, size = _joined(h, size), size * 2
        stay = n[left] >= CUBE * size
        h, left = h[np.repeat(stay, n[left])], left[stay]
    return [sorted(x.runs, key=lambda r: (r[0], r[2])) for x in found]


def _advance(texts: list[Text], h: np.ndarray, first: np.ndarray, size: int) -> None:
    """All catchers of one size over the words of some texts, end to end."""
    low = 1 if size == BLOCK else size
    blocks = len(h) // size
    padded = np.concatenate([h, np.zeros(2 * size, np.uint64)])
    returns = np.lib.stride_tricks.as_strided(padded[low:], shape=(blocks, 2 * size - low), strides=(size * 8, 8)) == h[: blocks * size : size, None]
    row, col = np.nonzero(returns)
    at, q = row * size, col + low
    whose = np.searchsorted(first, at, side="right") - 1
    inside = at + q + size <= first[whose + 1]
    at, q, whose = at[inside], q[inside], whose[inside]
    cuts = np.flatnonzero(np.diff(whose)) + 1
    for part in np.split(np.arange(len(at)), cuts):
        if len(part):
            k = whose[part[0]]
            texts[k].catch(at[part] - first[k], q[part], size)


def best_of(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period, exactly; of equal ones the first, of these the one of the least period."""
    best = None
    for i, j, q in runs:
        if best is None or (j - i) * best[2] > (best[1] - best[0]) * q:
            best = (i, j, q)
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without all but the first period of each run."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for i, j, q in runs:
        kept[i + q : j] = False
    return [words[k] for k in np.flatnonzero(kept)]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all but the text if None), the runs of each whole text by start, then period, the one of the
    greatest exponent, and the text's words joined by one space without those that only repeat a run."""
    made = ("runs", "best", "collapsed")
    keep = [c for c in df.columns if c not in (text_col, *made)] if keep is None else keep
    no_clash(keep, *made)
    last = len(keep)
    kept = [F.col(f"`{c}`") for c in keep]
    source = df.select(*kept, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias(unused_name(keep)))
    schema = df.select(*kept, F.lit(None).cast(f"array<{RUN}>").alias("runs"), F.lit(None).cast(RUN).alias("best"), F.lit("").alias("collapsed")).schema
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, last):
                # bytes.split() cuts at exactly the ASCII white space
                texts = [t.split() for t in part.column(last).to_pylist()]
                number: dict[bytes, int] = defaultdict(count().__next__)
                found = find_runs([np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts])
                rows = [[{"start": i, "length": j - i, "period": q} for i, j, q in runs] for runs in found]
                best = [b and {"start": b[0], "length": b[1] - b[0], "period": b[2]} for b in map(best_of, found)]
                short = [b" ".join(collapsed(words, runs)) for words, runs in zip(texts, found, strict=True)]
                columns = [*part.columns[:last], pa.array(rows, pa.list_(kind)), pa.array(best, kind), pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return source.mapInArrow(run, schema)
