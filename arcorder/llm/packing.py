"""Bounded-space online packing of tokenised documents into sequences of a fixed width.

Each partition keeps a fixed number of open windows. Whole widths of a long document become sequences of their own;
the rest goes into the window it fits best. When none fits and all windows are open, the fullest one is topped up
with the document's next ids and emitted. The windows left open at the end (a fixed number for each partition) are
merged in groups of partitions; the last, partly filled window of a group is cut into sequences whose lengths are
powers of two, which need no padding.

Null texts count as empty; each document ends with the end id, so none is without a piece. Repeated rows are packed
like any others. Texts of any length are encoded whole, also runs of a million spaces. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.bpe import PATTERN, Bpe, SharedVocabulary, model_of
from arcorder.llm.common import split_batch, written

PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]
#: Partitions whose open windows are merged in one task.
MERGED = 8
#: Characters above which a text is encoded without tiktoken.
LONG = 100_000


class Windows:
    """A fixed number of open windows; pieces that are done gather in `out`."""

    def __init__(self, width: int, count: int, first_id: int) -> None:
        self.width, self.count, self.next_id = width, count, first_id
        self.used: list[int] = []
        self.held: list[list[tuple]] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple], still_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.next_id, at, still_open))
            at += n
        self.next_id += 1

    def close(self, k: int) -> None:
        self.emit(self.held.pop(k))
        self.used.pop(k)

    def add(self, doc, ids: bytes) -> None:
        """ids: unsigned 32 bits, little-endian."""
        total, at = len(ids) // 4, 0
        while total - at >= self.width:
            self.emit([(doc, at, ids[4 * at : 4 * (at + self.width)], total)])
            at += self.width
        while at < total:
            rest = total - at
            fits = [k for k, used in enumerate(self.used) if self.width - used >= rest]
            if fits:
                k = max(fits, key=self.used.__getitem__)
            elif len(self.used) < self.count:
                k = len(self.used)
                self.used.append(0)
                self.held.append([])
            else:
                k = max(range(len(self.used)), key=self.used.__getitem__)
            n = min(rest, self.width - self.used[k])
            self.held[k].append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.used[k] += n
            at += n
            if self.used[k] == self.width:
                self.close(k)

    def finish(self) -> None:
        for pieces in self.held:
            self.emit(pieces, still_open=True)
        self.held, self.used = [], []

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * 8
        self.out = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def fast_encoder(model: Bpe, tokens: list[bytes]) -> tiktoken.Encoding | None:
    """The same vocabulary in tiktoken, which takes ids for ranks; None where ids don't follow the order of merges."""
    if not hasattr(model, "_tiktoken"):
        special = set(model.special.values())
        ranks = {t: i for i, t in enumerate(tokens) if t and i not in special}
        model._tiktoken = None if (np.diff(model.made) <= 0).any() else tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=model.special)
    return model._tiktoken


def encoder_of(vocabulary: SharedVocabulary) -> Callable[[str], bytes]:
    """The ids of a whole text as unsigned 32 bits, little-endian.

    tiktoken is the faster one, but its pattern engine runs out of stack on very long runs of white space; texts of more
    than LONG characters, and vocabularies that it can't hold, go through the library's own encoder, which takes any.
    """
    model = model_of(vocabulary)
    fast = fast_encoder(model, vocabulary.value["tokens"])

    def encode(text: str) -> bytes:
        if fast is None or len(text) > LONG:
            return model.encode([text])[0]
        ids = fast.encode(text, allowed_special="all") if any(s in text for s in model.special) else fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    return encode


def pack(df: DataFrame, vocabulary: SharedVocabulary, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, windows: int = 32, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: id, start, length, ids (binary: unsigned 32 bits, little-endian), doc_tokens, sequence_id, offset."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocabulary)
        state = Windows(width, windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in split_batch(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    state.add(doc, encode(text or "") + end)
                yield state.taken()
        state.finish()
        yield state.taken()

    pieces = written(source.mapInArrow(run, PIECES + ", open boolean"), "packing-pieces")
    groups = pieces.where("open").withColumn("lot", F.shiftright("sequence_id", 32) / F.lit(MERGED)).withColumn("lot", F.floor("lot").cast("long"))
    merged = groups.groupBy("lot").applyInArrow(_merge(width), PIECES)
    return pieces.where("NOT open").drop("open").unionByName(merged)


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Open windows of some partitions, end to end, cut at the width; the last part is cut into powers of two."""
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        lot = table.column("lot")[0].as_py()
        rows = zip(*(table.column(c).to_pylist() for c in ("id", "start", "ids", "doc_tokens")), strict=True)
        total = sum(table.column("length").to_pylist())
        rest = total % width
        lengths = [width] * (total // width) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        out, number, room, at = [], 0, lengths[0], 0
        for doc, start, ids, doc_tokens in rows:
            while ids:
                cut = ids[: 4 * room]
                n = len(cut) // 4
                out.append((doc, start, n, cut, doc_tokens, (1 << 62) + (lot << 32) + number, at))
                start, ids, room, at = start + n, ids[4 * n :], room - n, at + n
                if not room:
                    number, at = number + 1, 0
                    room = lengths[number] if number < len(lengths) else 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NAMES[:-1])

    return run
