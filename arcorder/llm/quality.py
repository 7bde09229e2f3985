"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Every text becomes the set of its n-grams: words, word endings, and one- to three-grams of word shapes (letter case,
edges, length, line starts, repetition of the words before). An indicator is scaled by its naive Bayes log-count
ratio between the classes and each text by the root of its number of indicators; a linear hinge-loss model is then
fitted by dual coordinate descent, and a logistic link calibrated on a part that the fit did not see gives the score.

The fit uses a bounded, hashed sample of SAMPLE labelled rows and BYTES bytes of text (one text has a sixteenth of them
at most); scoring reads every whole text. Null, empty or wordless texts have no indicators and get the score of the
intercept. Rows are kept as they are; a kept column named like the score is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import bounded_rows, hashed_sample, no_clash, split_batch, text_bytes, unused_name
from arcorder.llm.hashing import SOLID, ngram_hashes, word_hashes, word_spans

#: Labelled rows that the model is fitted on, at most about, and the bytes of their texts.
SAMPLE, BYTES = 8_000, 1 << 25
BITS = 17

_kind = np.zeros(256, dtype=np.uint64)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 end of a sentence, 5 beyond ASCII, 6 up mark or symbol
_kind[97:123], _kind[65:91], _kind[48:58], _kind[128:] = 1, 2, 3, 5
_kind[[ord(c) for c in ".,;:?'\"()-"]] = 4
_kind[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def indicators(off: np.ndarray, raw: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of each text's n-grams."""
    starts, ends, first = word_spans(off, raw, SOLID)
    h = word_hashes(raw, starts, ends)
    mark = np.zeros(1 << BITS, dtype=bool)
    shift = np.uint64(64 - BITS)
    if len(h):
        n = ends - starts
        size = np.minimum(np.frexp(n)[1], 7).astype(np.uint64)
        last, second = _kind[raw[ends - 1]], _kind[raw[np.maximum(ends - 2, starts)]]
        again = np.zeros(len(h), dtype=np.uint64)
        again[1:] += (h[1:] == h[:-1]).astype(np.uint64)
        again[2:] += np.uint64(2) * (h[2:] == h[:-2]).astype(np.uint64)
        # a text's first words repeat nothing, and its first word starts a line, whatever stands before it in the batch
        head = first[:-1][np.diff(first) > 0]
        again[head] = 0
        again[first[:-1][np.diff(first) > 1] + 1] %= 2
        line = (raw[np.maximum(starts - 1, 0)] == 10).astype(np.uint64)
        line[head] = 1
        shape = size
        for value, width in ((_kind[raw[starts]], 8), (_kind[raw[np.minimum(starts + 1, ends - 1)]], 8), (last, 8), (second, 8), (again, 4), (line, 2)):
            shape = shape * np.uint64(width) + value
        ending = raw[ends - 1].astype(np.uint64) + np.uint64(256) * raw[np.maximum(ends - 2, starts)]
        tokens = [h, ngram_hashes(ending + np.uint64(1 << 40), 1), ngram_hashes(shape, 1), ngram_hashes(shape, 2), ngram_hashes(shape, 3)]
        tokens = [(t >> shift).astype(np.int64) for t in tokens]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b == a:
            yield np.zeros(0, dtype=np.int32)
            continue
        for k, t in enumerate(tokens):
            mark[t[a : max(a, b - max(0, k - 2))]] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        yield found.astype(np.int32)


def packed(sets: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end in one, and their lengths: many thousands of small arrays would leave the driver's memory in pieces."""
    held = list(sets)
    return np.concatenate(held) if held else np.zeros(0, np.int32), np.array([len(s) for s in held], dtype=np.int64)


def views(flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(lengths).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found)))) + self.bias

    def probability(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def counted(sets: list[np.ndarray]) -> np.ndarray:
    """How many of the sets hold each bucket; of a lot at a time, as counting takes eight bytes an entry."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    for i in range(0, len(sets), 256):
        out += np.bincount(np.concatenate(sets[i : i + 256]), minlength=1 << BITS)
    return out


def log_count_ratio(sets: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = (smooth + counted([s for s, k in zip(sets, y, strict=True) if k == side]) for side in (1, -1))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """min 1/2 |w|^2 + sum c_i max(0, 1 - y_i (w.x_i + b)): one dual variable at a time, in random order."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            slack = y[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic_link(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps on smoothed targets."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, w = p - target, p * (1 - p) + 1e-9
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_sets(sets: list[np.ndarray], labels: np.ndarray) -> Model:
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 3.0 if len(y) == 0 or y[0] > 0 else -3.0)
    seen = np.arange(len(y)) % 5 != 0 if len(y) >= 50 else np.ones(len(y), dtype=bool)
    if len(set(y[seen].tolist())) < 2:
        seen[:] = True
    train = np.flatnonzero(seen)
    ratio = log_count_ratio([sets[i] for i in train], y[train])
    lengths = np.array([len(sets[i]) for i in train], dtype=np.int64)
    # filled in place, set by set: the driver has room for one array of these values
    values = views(np.empty(lengths.sum()), lengths)
    for i, v in zip(train, values, strict=True):
        np.divide(ratio[sets[i]], np.sqrt(max(1, len(v))), out=v)
    share = (y[train] > 0).mean()
    c = np.where(y[train] > 0, 0.5 / share, 0.5 / (1 - share))
    w, b = dual_coordinate_descent([sets[i] for i in train], values, y[train], c)
    model = Model(w * ratio, b, 1.0, 0.0)
    rest = np.flatnonzero(~seen) if (~seen).any() else train
    model.slope, model.offset = logistic_link(np.array([model.margin(sets[i]) for i in rest]), y[rest])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of a bounded sample of labelled rows; the labels are sampled first, so the broadcast side is bounded."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & allowed(F.col(id_col)))
    some = hashed_sample(rows.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")), "id", sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(F.broadcast(some), "id").select("id", "label", "text")


def training_texts(rows: DataFrame, sample: int, budget: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of the sample, bounded in rows and bytes, in an order that depends on ids and texts only."""
    got = bounded_rows(rows.select("id", "label", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", 2 * sample, budget)
    return pa.concat_arrays(got.column("text").chunks or [pa.array([], pa.string())]), got.column("label").to_numpy()


def fit(rows: DataFrame, budget: int = BYTES) -> Model:
    """rows: (id, label, text), a sample; what comes to the driver is bounded in rows and bytes."""
    texts, labels = training_texts(rows, SAMPLE, budget)
    sets = [s for i in range(0, len(texts), 256) for s in views(*packed(indicators(*text_bytes(texts[i : i + 256]))))]
    del texts
    order = np.random.default_rng(5).permutation(len(sets))
    model = fit_sets([sets[i] for i in order], labels[order] if len(labels) else labels)
    pa.default_memory_pool().release_unused()
    return model


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns in `keep` and the score, the probability of label 1, of each whole text."""
    no_clash(keep, score_col)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(unused_name(keep)))
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(score_col)).schema
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, len(keep)):
                p = [sent.value.probability(s) for s in indicators(*text_bytes(part.column(len(keep))))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(p, pa.float64())], names=[*keep, score_col])

    return source.mapInArrow(run, schema)
