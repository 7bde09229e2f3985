"""Toxicity: a convolutional text classifier in numpy with thresholds calibrated by language.

Words are hashed into embedding tables whose rows are added: two of whole words, so that two words rarely share both,
and one for each of the PREFIXES (first bytes of a word), so that words built on one stem are alike. Filters of
several widths slide over the word vectors, each filter's largest value in the text is kept, and a linear layer gives
the logit. The net is trained by back-propagation (Adagrad) on a bounded, hashed sample of SAMPLE labelled rows and
BYTES bytes of text (one text has a sixteenth of them at most). On a part that training did not see, a threshold is found for each group of languages and mapped to a score of 0.7; a
text's group is the cluster its letters fall in: pairs of neighbouring letters, clustered over the training texts
(scripts and languages part by themselves, whatever they are), so the language column is no input.

Whole texts are scored. Null, empty or wordless texts are read as one blank word. Rows are kept as they are; a kept
column named like the score is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import no_clash, split_batch, text_bytes, unused_name
from arcorder.llm.hashing import mixed, word_hashes, word_spans
from arcorder.llm.quality import training_texts

#: Labelled rows that the net is trained on, at most about, and the bytes of their texts.
SAMPLE, BYTES = 6_000, 1 << 25
BITS, DIM, FILTERS, WIDTHS = 16, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
TABLES = 2 + len(PREFIXES)
PAD = max(WIDTHS)
#: Groups of texts by the letters they use, hashed pairs of bytes that tell them apart, and rounds of the clustering.
GROUPS, PAIRS, ROUNDS = 8, 512, 12


def profiles(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of each text the roots of its shares of hashed pairs of neighbouring letters' bytes, as unit vectors."""
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    at = np.flatnonzero(letter[:-1] & letter[1:]) if len(raw) else np.zeros(0, np.int64)
    text = np.searchsorted(off, at, side="right") - 1
    inside = at + 1 < off[text + 1]
    at, text = at[inside], text[inside]
    pair = (mixed(raw[at].astype(np.uint64) * np.uint64(256) + raw[at + 1]) >> np.uint64(32)).astype(np.int64) % PAIRS
    out = np.sqrt(np.bincount(text * PAIRS + pair, minlength=(len(off) - 1) * PAIRS).reshape(-1, PAIRS))
    return out / np.maximum(np.sqrt((out * out).sum(1)), 1e-12)[:, None]


def clusters(x: np.ndarray, count: int = GROUPS) -> np.ndarray:
    """Centres of spherical k-means: the first text, then always the one least like all so far; fewer if texts are alike."""
    if not len(x):
        return np.zeros((1, PAIRS))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(count, len(x)) and near.min() < 0.9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(ROUNDS):
        group = (x @ centres.T).argmax(1)
        sums = np.stack([x[group == g].sum(0) if (group == g).any() else centres[g] for g in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1)), 1e-12)[:, None]
    return centres


def word_rows(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each table for each word, PAD blanks (row 0) after each text; and each text's number of positions."""
    starts, ends, first = word_spans(off, raw)
    h = word_hashes(raw, starts, ends)
    n = np.maximum(np.diff(first), 1)
    begin = np.cumsum(n + PAD) - n - PAD
    rows = np.zeros((int((n + PAD).sum()), TABLES), dtype=np.int32)
    text = np.repeat(np.arange(len(n)), np.diff(first))
    at = begin[text] + np.arange(len(h)) - first[text]
    mask = np.uint64((1 << BITS) - 1)
    rows[at, 0] = 1 + (h & mask).astype(np.int32)
    rows[at, 1] = 1 + (h >> np.uint64(64 - BITS)).astype(np.int32)
    head = np.zeros(len(h), dtype=np.uint64)
    for k in range(max(PREFIXES)):
        head = head * np.uint64(257) + np.where(starts + k < ends, raw[np.minimum(starts + k, ends - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        if k + 1 in PREFIXES:
            rows[at, 2 + PREFIXES.index(k + 1)] = 1 + (mixed(head) >> np.uint64(64 - BITS)).astype(np.int32)
    return rows, n


class Net:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        f = len(WIDTHS) * FILTERS
        self.p = {
            "e": rng.normal(0, 0.05, (TABLES, (1 << BITS) + 1, DIM)).astype(np.float32),
            "c": rng.normal(0, 0.4, (len(WIDTHS), PAD, DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(f, dtype=np.float32),
            "w": rng.normal(0, 0.3, f).astype(np.float32),
            "o": np.full(1, -1.0, dtype=np.float32),
        }
        self.p["e"][:, 0] = 0
        self.centres = np.zeros((1, PAIRS))
        self.lines: dict[int, tuple[float, float]] = {}

    def forward(self, rows: np.ndarray, n: np.ndarray, where: bool = False):
        """Largest value of each filter in each text, and the positions of those values."""
        x = self.p["e"][0][rows[:, 0]]
        for k in range(1, TABLES):
            x += self.p["e"][k][rows[:, k]]
        begin = np.cumsum(n + PAD) - n - PAD
        cut = np.stack([begin, begin + n], 1).ravel()
        top, at = [], []
        for k, width in enumerate(WIDTHS):
            z = x @ self.p["c"][k, 0]
            for o in range(1, width):
                z[:-o] += x[o:] @ self.p["c"][k, o]
            best = np.maximum.reduceat(z, cut[:-1] if cut[-1] >= len(z) else cut, axis=0)[::2]
            top.append(best)
            if where:
                at.append(np.stack([begin + np.array([z[a : a + m, f].argmax() for a, m in zip(begin, n, strict=True)]) for f in range(FILTERS)], 1))
        return np.concatenate(top, 1) + self.p["b"], x, at

    def logits(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(self.forward(rows, n)[0], 0) @ self.p["w"] + self.p["o"][0]

    def gradients(self, rows: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the weighted log loss and a small penalty on w: by parameter, and for the embeddings the positions and what each adds to its word's vector."""
        top, x, at = self.forward(rows, n, where=True)
        h = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.p["w"] + self.p["o"][0], -30, 30)))
        d = ((p - y) * weight).astype(np.float32)
        dz = d[:, None] * self.p["w"] * (top > 0)
        g = {"w": h.T @ d + 1e-4 * self.p["w"], "o": np.array([d.sum()]), "b": dz.sum(0), "c": np.zeros_like(self.p["c"])}
        touched, change = [], []
        for k, width in enumerate(WIDTHS):
            dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(width):
                pos = at[k] + o
                g["c"][k, o] = np.einsum("tfd,tf->df", x[pos], dk)
                touched.append(pos.ravel())
                change.append((dk[:, :, None] * self.p["c"][k, o].T[None]).reshape(-1, DIM))
        return g, np.concatenate(touched), np.concatenate(change)

    def train(self, texts: list[tuple[np.ndarray, int]], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.08, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        seen = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        share = max(y.mean(), 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                rows, n = np.concatenate([texts[j][0] for j in part]), np.array([texts[j][1] for j in part])
                g, pos, change = self.gradients(rows, n, y[part], weight[part] / len(part))
                for name in ("w", "o", "b", "c"):
                    seen[name] += g[name] ** 2
                    self.p[name] -= rate * g[name] / np.sqrt(seen[name])
                for side in range(TABLES):
                    row, where = np.unique(rows[pos, side], return_inverse=True)
                    total = np.zeros((len(row), DIM), dtype=np.float32)
                    np.add.at(total, where, change)
                    total[row == 0] = 0
                    seen["e"][side, row] += total**2
                    self.p["e"][side, row] -= rate * total / np.sqrt(seen["e"][side, row])

    def groups(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        return (profiles(off, raw) @ self.centres.T).argmax(1)

    def calibrate(self, logits: np.ndarray, y: np.ndarray, group: np.ndarray) -> None:
        """For each group of languages the threshold of best F1 (all groups' where it has too few labels), mapped to 0.7."""
        whole = best_threshold(logits, y)
        scale = 1.0 / max(float(np.std(logits)), 1e-3) if len(logits) else 1.0
        for g in range(len(self.centres)):
            mine = group == g
            enough = min(y[mine].sum(), (1 - y[mine]).sum()) >= 20
            self.lines[g] = (scale, best_threshold(logits[mine], y[mine]) if enough else whole)

    def scores(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        rows, n = word_rows(off, raw)
        slope, middle = (np.array([self.lines[g][k] for g in self.groups(off, raw)]) for k in (0, 1))
        return 1 / (1 + np.exp(-np.clip(4 * slope * (self.logits(rows, n) - middle) + np.log(0.7 / 0.3), -30, 30)))


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    if not len(y) or y.sum() == 0:
        return float(logits.max() + 1) if len(y) else 1e9
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(y) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


def fit(rows: DataFrame, budget: int = BYTES) -> Net:
    """rows: (id, label, text), a sample; what comes to the driver is bounded in rows and bytes."""
    texts, labels = training_texts(rows.withColumn("text", F.lower("text")), SAMPLE, budget)
    net = Net()
    if not len(texts):
        net.calibrate(np.zeros(0), np.zeros(0), np.zeros(0))
        return net
    order = np.random.default_rng(4).permutation(len(texts))
    cut, letters = [], []
    for i in range(0, len(texts), 256):
        off, raw = text_bytes(texts[i : i + 256])
        words, n = word_rows(off, raw)
        cut += [(words[b - m - PAD : b], m) for b, m in zip(np.cumsum(n + PAD), n, strict=True)]
        letters.append(profiles(off, raw))
    letters = np.concatenate(letters)
    net.centres = clusters(letters)
    group = (letters @ net.centres.T).argmax(1)
    texts, y, group = [cut[i] for i in order], (labels[order] > 0).astype(float), group[order]
    held = np.arange(len(y)) % 4 == 0
    train = np.flatnonzero(~held) if len(y) >= 40 else np.arange(len(y))
    net.train([texts[i] for i in train], y[train])
    rest = np.flatnonzero(held) if len(y) >= 40 else train
    net.calibrate(np.concatenate([net.logits(texts[i][0], np.array([texts[i][1]])) for i in rest]), y[rest], group[rest])
    return net


def score(df: DataFrame, net: Net, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns in `keep` and the score (0.7 at the calibrated threshold) of each whole text."""
    no_clash(keep, score_col)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.lower(F.col(f"`{text_col}`").cast("string")).alias(unused_name(keep)))
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(score_col)).schema
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, len(keep), 1 << 20):
                p = sent.value.scores(*text_bytes(part.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(p.astype(np.float64))], names=[*keep, score_col])

    return source.mapInArrow(run, schema)
