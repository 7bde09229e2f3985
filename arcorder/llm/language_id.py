"""Language ID by a linear-chain conditional random field over words.

Each line of a text is a chain. A word's features are hashed affixes (up to four bytes), byte bi- and trigrams, and
its place in a lexicon of words that the training sample holds often; transitions between the languages of
neighbouring words are learned, on lines in which stretches of several languages are spliced so that switches occur.
Forward-backward gives each word's probabilities, for all lines of a batch at once; a text's language is the one with
the largest sum over its words and the score is that sum's share.

Trained by Adagrad on the log-likelihood of CHAINS lines of words, drawn from the whole texts of a bounded, hashed sample:
about SAMPLE documents of each of the LANGUAGES most frequent languages, and BYTES bytes in all (one text has a sixteenth
of them at most). The lexicon holds the sample's LEXICON most frequent words. Whole texts are labelled. Of languages with equal
sums the first by name is chosen. Null texts and texts without a letter give 'und' with score 0. Rows are kept as they
are; a kept column named lang_pred or score is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import bounded_rows, no_clash, split_batch, text_bytes, unused_name
from arcorder.llm.hashing import mixed, word_hashes, word_spans

#: Documents of each language that the model is trained on, at most about; languages; bytes of all texts; chains of words.
SAMPLE, LANGUAGES, BYTES, CHAINS = 400, 256, 1 << 25, 6_000
BITS, LEXICON = 16, 20_000
AFFIX = 4


class Crf:
    def __init__(self, languages: list[str], lexicon: np.ndarray) -> None:
        self.languages, self.lexicon = languages, lexicon
        k = len(languages)
        self.emit = np.zeros(((1 << BITS) + len(lexicon) + 1, k), dtype=np.float32)
        self.move = np.zeros((k, k))
        self.first = np.zeros(k)

    def features(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of each word and the word each belongs to, sorted by word."""
        n = ends - starts
        rows, word = [], []
        every = np.arange(len(n))
        shift = np.uint64(64 - BITS)

        def put(value: np.ndarray, kind: int, who: np.ndarray) -> None:
            rows.append((mixed(value + np.uint64(kind << 40)) >> shift).astype(np.int64))
            word.append(who)

        head, tail = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        for k in range(AFFIX):
            head = head * np.uint64(257) + np.where(k < n, raw[np.minimum(starts + k, ends - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            tail = tail * np.uint64(257) + np.where(k < n, raw[np.maximum(ends - 1 - k, starts)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            put(head, 1 + k, every)
            put(tail, 11 + k, every)
        for size in (2, 3):
            many = np.maximum(n - size + 1, 0)
            who = np.repeat(every, many)
            at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
            gram = np.zeros(len(at), np.uint64)
            for k in range(size):
                gram = gram * np.uint64(257) + raw[at + k].astype(np.uint64)
            put(gram, 20 + size, who)
        place = np.searchsorted(self.lexicon, h)
        place[place == len(self.lexicon)] = 0
        known = self.lexicon[place] == h if len(self.lexicon) else np.zeros(len(h), dtype=bool)
        rows.append((1 << BITS) + np.where(known, place, len(self.lexicon)))
        word.append(every)
        rows, word = np.concatenate(rows), np.concatenate(word)
        order = np.argsort(word, kind="stable")
        return rows[order], word[order]

    def emissions(self, rows: np.ndarray, word: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.add.reduceat(self.emit[rows], first, axis=0).astype(np.float64)

    def marginals(self, s: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over many chains in step: P(label) of each word, and summed P(label, next label) of each pair of labels."""
        k = len(self.languages)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        e = np.exp(s - s.max(1, keepdims=True))
        t = np.exp(self.move - self.move.max())
        ahead, back = np.empty((len(s), k)), np.ones((len(s), k))
        open_at = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for i, m in enumerate(open_at):
            at = begin[:m] + i
            a = e[at] * (ahead[at - 1] @ t if i else np.exp(self.first - self.first.max()))
            ahead[at] = a / a.sum(1, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(len(open_at) - 2, -1, -1):
            at = begin[: open_at[i + 1]] + i
            after = e[at + 1] * back[at + 1]
            b = after @ t.T
            z = (ahead[at] * b).sum(1, keepdims=True)
            pairs += (ahead[at] / z).T @ after * t
            back[at] = b / b.sum(1, keepdims=True)
        p = ahead * back
        return p / p.sum(1, keepdims=True), pairs

    def train(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, label: np.ndarray, chains: np.ndarray, epochs: int = 3, rate: float = 0.3) -> None:
        """chains: (n, length) word numbers; rows of equal length."""
        seen_e, seen_m, seen_f = np.full_like(self.emit, 1e-2), np.full_like(self.move, 1e-2), np.full_like(self.first, 1e-2)
        k, length = len(self.languages), chains.shape[1]
        for epoch in range(epochs):
            for part in np.array_split(np.random.default_rng(epoch).permutation(len(chains)), max(1, len(chains) // 64)):
                w = chains[part].ravel()
                rows, word = self.features(raw, starts[w], ends[w], h[w])
                begin = np.arange(len(part)) * length
                p, pairs = self.marginals(self.emissions(rows, word), begin, np.full(len(part), length))
                y = label[w]
                d = p.copy()
                d[np.arange(len(w)), y] -= 1
                d /= len(part)
                gm = pairs / len(part)
                same = np.arange(len(w)) % length != length - 1
                np.add.at(gm, (y[:-1][same[:-1]], y[1:][same[:-1]]), -1 / len(part))
                gf = d[begin].sum(0)
                row, where = np.unique(rows, return_inverse=True)
                g = np.zeros((len(row), k), dtype=np.float32)
                np.add.at(g, where, d[word].astype(np.float32))
                g += 1e-4 * self.emit[row]
                for value, seen, change, at in ((self.emit, seen_e, g, row), (self.move, seen_m, gm, slice(None)), (self.first, seen_f, gf, slice(None))):
                    seen[at] += change**2
                    value[at] -= rate * change / np.sqrt(seen[at])

    def label(self, off: np.ndarray, raw: np.ndarray) -> tuple[list[str], np.ndarray]:
        starts, ends, first = word_spans(off, raw)
        h = word_hashes(raw, starts, ends)
        total = np.zeros((len(off) - 1, len(self.languages)))
        if len(h):
            _, one, same = np.unique(h, return_index=True, return_inverse=True)
            s = self.emissions(*self.features(raw, starts[one], ends[one], h[one]))[same]
            lines = np.searchsorted(np.flatnonzero(raw == 10), starts)
            text = np.repeat(np.arange(len(off) - 1), np.diff(first))
            begin = np.flatnonzero(np.concatenate([[True], (lines[1:] != lines[:-1]) | (text[1:] != text[:-1])]))
            p, _ = self.marginals(s, begin, np.diff(np.concatenate([begin, [len(h)]])))
            np.add.at(total, text, p)
        best = total.argmax(1)
        return [self.languages[i] for i in best], total[np.arange(len(best)), best] / np.maximum(total.sum(1), 1e-9)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, budget: int = BYTES) -> Crf:
    """docs: the rows that may be learnt from, with null or known languages."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    shares = [x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, sample / r["count"]) * 1_000_000_007)))]
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000_007)) < F.element_at(F.create_map(*shares), F.col("lang"))) if shares else rows.limit(0)
    some = bounded_rows(some, "text", 2 * sample * max(1, len(counts)), budget)
    got = sorted(zip(*(some.column(c).to_pylist() for c in ("id", "text", "lang")), strict=True))
    languages = sorted({r[2] for r in got}) or ["und"]
    data = pa.array([r[1] for r in got], pa.string())
    off, raw = text_bytes(data) if got else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
    starts, ends, first = word_spans(off, raw)
    h = word_hashes(raw, starts, ends)
    label = np.repeat(np.array([languages.index(r[2]) for r in got], dtype=np.int64), np.diff(first))
    value, count = np.unique(h, return_counts=True)
    often = np.argsort(-count, kind="stable")[:LEXICON]
    crf = Crf(languages, np.sort(value[often][count[often] >= 3]))
    if len(languages) < 2:
        return crf
    # chains of 24 words: six stretches of four to twelve words from texts of any languages, half of them from one text
    rng = np.random.default_rng(6)
    chains = []
    starts_of = [np.flatnonzero(label == k) for k in range(len(languages))]
    for _ in range(CHAINS):
        chain: list[int] = []
        own = int(rng.integers(len(languages)))
        mix = rng.random() < 0.5
        while len(chain) < 24:
            k = int(rng.integers(len(languages))) if mix else own
            at = int(rng.choice(starts_of[k]))
            chain += range(at, min(at + int(rng.integers(4, 13)), len(h)))
        chains.append(chain[:24])
    crf.train(raw, starts, ends, h, label, np.array(chains))
    return crf


def identify(df: DataFrame, crf: Crf, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in `keep`, lang_pred and score of each whole text."""
    no_clash(keep, "lang_pred", "score")
    text = F.col(f"`{text_col}`").cast("string")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(unused_name(keep, "letters")), F.lower(text).alias(unused_name(keep)))
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    sent = df.sparkSession.sparkContext.broadcast(crf)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, at + 1, 1 << 20):
                names, p = sent.value.label(*text_bytes(part.column(at + 1)))
                has = part.column(at).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array([x if k else "und" for x, k in zip(names, has, strict=True)], pa.string()), pa.array(np.where(has, p, 0.0))], names=[*keep, "lang_pred", "score"]
                )

    return source.mapInArrow(run, schema)
