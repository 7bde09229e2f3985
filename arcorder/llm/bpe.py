"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold ``rank * width + position`` of each adjacent pair, so the root is the leftmost
pair of lowest rank. Each merge rewrites at most three leaves and their paths, until no pair can be merged.
Words of similar length are merged together as one numpy block of trees; long words use one tree each.

Null texts count as empty and give no ids. Texts are encoded whole; special tokens of the vocabulary that stand
in a text become their own ids, as in the tokenizers library's defaults. Rows, ties and repeated texts are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import no_clash, split_batch, unused_name

#: Fixed value: the pre-tokenising pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Pairs in the widest tree of a block; longer words get a tree of their own.
WIDEST = 128
#: Distinct pieces that each of the two generations of a worker's cache holds; a speed parameter only.
CACHE = 400_000

_find = regex.compile(PATTERN).findall
#: White space on both sides of a single space, or two spaces: only there may a run of spaces cross a split at a space.
_crossing = re.compile(r"  |[^\S ] [^\S ]").search


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What tasks need of a tokenizer file, as plain arrays of a fixed size."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    back = {c: b for b, c in enumerate(letters)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    base = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
    keys = np.array([vocab[a] * base + vocab[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    tokens = [b""] * base
    for token, i in vocab.items():
        tokens[i] = bytes(back[c] for c in token)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in special.items():
        tokens[i] = text.encode()
    return {
        "base": base,
        "bytes": np.array([vocab[c] for c in letters], dtype=np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": np.array([vocab[a + b] for a, b in pairs], dtype=np.int64),
        "tokens": tokens,
        "special": special,
    }


class Bpe:
    def __init__(self, vocabulary: dict) -> None:
        self.base, self.of_byte, self.keys = vocabulary["base"], vocabulary["bytes"], vocabulary["keys"]
        self.ranks, self.made = vocabulary["ranks"], vocabulary["made"]
        self.special = vocabulary["special"]
        self.kind = np.int32 if len(self.made) * (WIDEST + 1) < np.iinfo(np.int32).max else np.int64
        self.byte_pairs = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).astype(self.kind)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = np.array([len(t) for t in vocabulary["tokens"]], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(vocabulary["tokens"]), dtype=np.uint8)
        # pieces after a space, and first pieces of a text: a young and an old generation each
        self.young: list[dict[str, bytes]] = [{}, {}]
        self.old: list[dict[str, bytes]] = [{}, {}]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 for those that are never merged."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_block(self, raw: np.ndarray, lens: np.ndarray, w: int) -> list[bytes]:
        """Merge words of 2 to w + 1 bytes, one row each (bytes, then zeros), in step; w is a power of two."""
        n, c = len(raw), w + 1
        none = np.iinfo(self.kind).max
        tree = np.full((n, 2 * w), none, dtype=self.kind)
        ranks = self.byte_pairs[raw[:, :w].astype(np.int32) * 256 + raw[:, 1 : w + 1]]
        pos = np.arange(w, dtype=self.kind)
        np.copyto(tree[:, w:], ranks * self.kind(c) + pos, where=(pos < (lens - 1)[:, None]) & (ranks >= 0))
        ids = self.of_byte[raw]
        for node in range(w - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        nxt = np.tile(np.arange(1, c + 2, dtype=np.int32), (n, 1))
        nxt[np.arange(n), lens - 1] = c
        prv = np.tile(np.concatenate([[c], np.arange(c)]).astype(np.int32), (n, 1))
        alive = np.arange(c) < lens[:, None]
        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            go = root != none
            rows = rows[go]
            if not len(rows):
                break
            rank, p = np.divmod(root[go], c)
            q = nxt[rows, p]
            after, before = nxt[rows, q], prv[rows, p]
            merged = self.made[rank]
            ids[rows, p] = merged
            alive[rows, q] = False
            nxt[rows, p] = after
            prv[rows, after] = p
            has_right, has_left = after < c, before < c
            right = np.where(has_right, self.rank(merged, ids[rows, np.minimum(after, c - 1)]), -1)
            left = np.where(has_left, self.rank(ids[rows, np.minimum(before, c - 1)], merged), -1)
            leaf = q < w
            tree[rows[leaf], w + q[leaf]] = none
            tree[rows, w + np.minimum(p, w - 1)] = np.where(right >= 0, right * c + p, none)
            tree[rows[has_left], w + before[has_left]] = np.where(left >= 0, left * c + before, none)[has_left]
            nodes = [w + p, w + np.minimum(q, w - 1), w + np.where(has_left, before, p)]
            level = w
            while level > 1:
                level >>= 1
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        flat, ends = ids[:, :c][alive].astype("<u4"), np.cumsum(alive.sum(1)) * 4
        out = flat.tobytes()
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_long(self, word: bytes) -> bytes:
        """One word with one tree, in plain Python: logarithmic work for each merge."""
        ids = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        n = len(ids)
        w = 1 << max(0, (n - 2).bit_length())
        ranks = self.rank(ids[:-1], ids[1:]).tolist()
        tree = [NONE] * w + [r * n + i if r >= 0 else NONE for i, r in enumerate(ranks)] + [NONE] * (w - n + 1)
        for x in range(w - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        ids, nxt, prv = ids.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
        known = self.pair_ranks()

        def put(i: int, value: int) -> None:
            x = w + i
            tree[x] = value
            while x > 1:
                x >>= 1
                tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def leaf(i: int) -> int:
            j = nxt[i]
            rank = known.get(ids[i] * self.base + ids[j], -1) if j >= 0 else -1
            return rank * n + i if rank >= 0 else NONE

        while tree[1] != NONE:
            rank, p = divmod(tree[1], n)
            q = nxt[p]
            ids[p], nxt[p] = int(self.made[rank]), nxt[q]
            if nxt[q] >= 0:
                prv[nxt[q]] = p
            ids[q] = -1
            if q < n - 1:
                put(q, NONE)
            put(p, leaf(p))
            if prv[p] >= 0:
                put(prv[p], leaf(prv[p]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def pair_ranks(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._pairs

    def merge_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (unsigned 32 bits, little-endian) of pre-tokenised words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: dict[str, bytes] = {}
        top = 0
        for w in [0, *(1 << k for k in range(WIDEST.bit_length()))]:
            which = np.flatnonzero((lens - 1 > top) & (lens - 1 <= w)) if w else np.flatnonzero(lens <= 1)
            top = w
            for at in range(0, len(which), step := max(64, (1 << 17) // (2 * w + 2))):
                part = which[at : at + step]
                n = lens[part]
                letters = np.zeros((len(part), w + 2), dtype=np.uint8)
                letters[np.arange(w + 2) < n[:, None]] = np.frombuffer(b"".join([raw[i] for i in part]), dtype=np.uint8)
                if w:
                    ids_of = self.merge_block(letters, n, w)
                else:
                    ids_of = [self.of_byte[x[:k]].astype("<u4").tobytes() for x, k in zip(letters, n, strict=True)]
                out.update(zip((words[i] for i in part), ids_of, strict=True))
        for i in np.flatnonzero(lens - 1 > WIDEST):
            out[words[i]] = self.merge_long(raw[i])
        return out

    def look_up(self, kind: int, pieces: list[str], missing: set[str]) -> list[bytes | None]:
        """Ids of known pieces; unknown ones go to `missing`."""
        found = list(map(self.young[kind].get, pieces))
        if None in found:
            unknown = {p for p, x in zip(pieces, found, strict=True) if x is None}
            if again := unknown & self.old[kind].keys():
                old = self.old[kind]
                self.young[kind].update({p: old[p] for p in again})
                unknown -= again
            missing |= unknown
        return found

    def resolve(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces: cut into words, merge the distinct words together, join."""
        cut = [p if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else _find(p) for p in pieces]
        words: set[str] = set()
        for c in cut:
            if type(c) is str:
                words.add(c)
            else:
                words.update(c)
        ids = self.merge_words(list(words))
        return [ids[c] if type(c) is str else b"".join([ids[w] for w in c]) for c in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as unsigned 32 bits, little-endian."""
        jobs: list[list] = []  # of each text: special ids, or first piece and pieces that follow a space
        missing: tuple[set[str], set[str]] = (set(), set())
        for text in texts:
            job: list = []
            text = text or ""
            parts = self.special_split.split(text) if any(s in text for s in self.special) else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    job.append(np.array([self.special[part]], dtype="<u4").tobytes())
                elif part:
                    pieces = part.split(" ") if not _crossing(part) else self.careful(part)
                    for kind, some in ((1, pieces[:1]), (0, pieces[1:])):
                        found = self.look_up(kind, some, missing[kind])
                        job.append((kind, some) if None in found else b"".join(found))
            jobs.append(job)
        for kind, new in enumerate(missing):
            pieces = list(new)
            self.young[kind].update(zip(pieces, self.resolve([" " + p for p in pieces] if kind == 0 else pieces), strict=True))
        get = [x.__getitem__ for x in self.young]
        out = [b"".join([b"".join(map(get[x[0]], x[1])) if type(x) is tuple else x for x in job]) for job in jobs]
        for kind in (0, 1):
            if len(self.young[kind]) > CACHE:
                self.old[kind], self.young[kind] = {p: x for p, x in self.young[kind].items() if len(p) <= 64}, {}
        return out

    @staticmethod
    def careful(part: str) -> list[str]:
        """Pieces split only at single spaces between letters that are not white space."""
        return re.split(r"(?<!\s) (?!\s)", part)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.letters[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + n, n)].tobytes()


_models: dict[int, Bpe] = {}


def model_of(shared) -> Bpe:
    """The worker's own model of a broadcast vocabulary, with its cache of pieces."""
    if shared.id not in _models:
        _models.clear()
        _models[shared.id] = Bpe(shared.value)
    return _models[shared.id]


class SharedVocabulary:
    """A broadcast vocabulary (fixed size, about 50,000 entries); the id names it in the workers."""

    def __init__(self, spark, path: str) -> None:
        import uuid

        self.id, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(read_vocabulary(path))

    @property
    def value(self) -> dict:
        return self.sent.value


def encode(df: DataFrame, vocabulary: SharedVocabulary, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all but the text if None) and the ids of each whole text as array<int>; a kept column named like the ids is an error."""
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else keep
    no_clash(keep, ids)
    last = len(keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused_name(keep)))
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.array(F.lit(0)).alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary)
        for batch in batches:
            for part in split_batch(batch, last):
                out = model.encode(part.column(last).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in out)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(out), dtype="<i4"))
                columns = [*part.columns[:last], pa.ListArray.from_arrays(pa.array(ends), values)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, ids])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: SharedVocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the text of each list of ids; bytes that are not UTF-8 become U+FFFD, null lists give ''."""
    no_clash(df.columns, text)
    schema = df.withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                ends = np.cumsum(n)
                texts = [model.decode_bytes(flat[b - m : b]).decode("utf-8", "replace") for b, m in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)
