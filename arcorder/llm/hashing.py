"""Hashes of words and word n-grams straight from the bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20240607)
BYTE = _random.integers(1, 2**63, size=256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers are units modulo 2**64
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Letters and digits of ASCII, and every byte of a letter outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: All but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, STEP)]))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= MIX[0]
    h ^= h >> np.uint64(33)
    h *= MIX[1]
    h ^= h >> np.uint64(33)
    return h


def word_spans(off: np.ndarray, raw: np.ndarray, letters: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's first word (texts + 1)."""
    inside = letters[raw]
    before = np.empty(len(raw) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    after = inside.copy()
    edge = off[1:-1][off[1:-1] < len(raw)]
    start = inside & ~before[:-1]
    start[edge] = inside[edge]
    after[:-1] = inside[:-1] & ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    first = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(first, n)
    at = np.repeat(starts, n) + within
    return mixed(np.add.reduceat(BYTE[raw[at]] * powers(int(n.max()))[within], first))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last n - 1 are missing."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * STEP + h[k : k + m]
    return mixed(out)


def shingle_sets(off: np.ndarray, raw: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-word shingles; a text of fewer words has one shingle of them all, an empty one none."""
    starts, ends, first = word_spans(off, raw)
    h = word_hashes(raw, starts, ends)
    grams = ngram_hashes(h, n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(h[a:b], b - a)
        else:
            yield h[:0]


def grouped(batches: Iterator[pa.RecordBatch], key: str, limit: int = 1 << 24) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key (a long), about `limit` bytes each; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < limit:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif len(held) > 1 and held[-2].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held[:-1])
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Local components: parallel hooking of roots on numpy arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
