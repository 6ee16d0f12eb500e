"""Quality rules: a linear-chain conditional random field labels each line.

Lines are content or boilerplate; Viterbi decoding finds the best labelling of
a document's lines, and the share of its words that lie in content lines
decides whether the document stays.  The field is trained here, by gradient
ascent on the exact log-likelihood, from document-level quality labels: lines
of good documents count as content, lines of poor ones and repeats of an
earlier line as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_each

#: Labelled documents that the field is trained on, at most (those of the smallest hash).
FIT_ROWS = 1_500
#: Lines of a training sequence; longer documents are cut into several, of which at most so many are taken (those of the smallest hash).
FIT_LINES, FIT_SEQUENCES = 64, 12_000
CONTENT_SHARE = 0.5
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
DROP_SPACE, DROP_TAIL = b"".join(SPACES), bytes(range(128, 192))
UPPER, LOWER, DIGIT, MARKS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?#*$%&|<>{}[]=\\^~_"
#: Cuts of a line's measures into steps; a feature for each step of each measure.
CUTS = {"words": (1, 3, 6, 12, 25), "length": (2.5, 4, 6, 8, 12), "marks": (0.005, 0.03, 0.1), "upper": (0.1, 0.3, 0.6), "digits": (0.02, 0.1, 0.3), "repeats": (0.2, 0.4, 0.7), "again": (0.5,), "ends": (0.5,)}
N_FEATURES = sum(len(c) + 1 for c in CUTS.values())


def line_features(line: bytes, words: list[bytes], again: bool) -> list[int]:
    """The indices of the features of a line that has words: one for each measure."""
    n, size = len(words), sum(map(len, words))
    small = len(line.translate(None, UPPER))
    measures = (
        n,
        size / n,
        (len(line) - len(line.translate(None, MARKS))) / size,
        (len(line) - small) / size,
        (len(line) - len(line.translate(None, DIGIT))) / size,
        1 - len(set(words)) / n,
        float(again),
        float(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"')),
    )
    at, out = 0, []
    for value, cuts in zip(measures, CUTS.values(), strict=True):
        step = 0
        for c in cuts:
            step += value > c
        out.append(at + step)
        at += len(cuts) + 1
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * len(known) + ids[2:]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def read(text: bytes | None) -> tuple[tuple[int, int, int, int, int], list[list[int]], list[int], list[bool]]:
    """Counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and of each line with a word its features, words and whether it repeats one."""
    text = text or b""
    words = text.split()
    chars = len(text.translate(None, DROP_SPACE + DROP_TAIL))
    symbols = len(text) - len(text.translate(None, b"".join(SYMBOLS)))
    features, sizes, repeats, seen = [], [], [], set()
    for line in text.split(b"\n"):
        if own := line.split():
            again = line in seen
            seen.add(line)
            features.append(line_features(line, own, again))
            sizes.append(len(own))
            repeats.append(again)
    return (len(words), chars, symbols, sum(repeats), repeated_words(words)), features, sizes, repeats


@dataclass
class Crf:
    """Weights: of features for content against boilerplate, of transitions and of starts."""

    unary: np.ndarray
    pair: np.ndarray
    start: np.ndarray

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """The best labels of a document's lines: 1 content, 0 boilerplate."""
        if not features:
            return []
        own = self.unary[np.array(features)].sum(axis=1).tolist()
        (a00, a01), (a10, a11) = self.pair.tolist()
        s0, s1 = self.start[0], self.start[1] + own[0]
        back = []
        for x in own[1:]:
            from0, from1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
            s0, s1 = (s1 + a10 if from0 else s0 + a00), (s1 + a11 if from1 else s0 + a01) + x
            back.append((from0, from1))
        last = int(s1 > s0)
        out = [last]
        for step in reversed(back):
            last = int(step[last])
            out.append(last)
        return out[::-1]

    def share(self, features: list[list[int]], sizes: list[int]) -> float:
        """Share of words in content lines; 0 without words."""
        total = sum(sizes)
        return sum(n for n, y in zip(sizes, self.viterbi(features), strict=True) if y) / total if total else 0.0


#: Used where no label can be learnt from: many marks, capitals, digits or repeats speak against a line.
PLAIN = {"marks": (1, 0, -1, -3), "upper": (1, -1, -2, -3), "digits": (0, 0, -1, -2), "repeats": (1, 0, -1, -3), "again": (0, -3)}


def plain_field() -> Crf:
    w = [x for name, cuts in CUTS.items() for x in PLAIN.get(name, (0,) * (len(cuts) + 1))]
    return Crf(np.array(w, float), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


def fit(sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam; forward and backward sums run over all sequences at once."""
    s, t = len(sequences), max(len(y) for _, y in sequences)
    k = len(CUTS)
    x, y, on = np.zeros((s, t, k), np.int64), np.zeros((s, t), np.int64), np.zeros((s, t), bool)
    for i, (f, lab) in enumerate(sequences):
        x[i, : len(f)], y[i, : len(lab)], on[i, : len(lab)] = f, lab, True
    n = on.sum()
    w = np.zeros(N_FEATURES + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    both = on[:, 1:] & on[:, :-1]
    seen = np.zeros_like(w)
    np.add.at(seen, x[on & (y == 1)].ravel(), 1)
    np.add.at(seen, N_FEATURES + 2 * y[:, :-1][both] + y[:, 1:][both], 1)
    np.add.at(seen, N_FEATURES + 4 + y[:, 0], 1)
    for step in range(1, rounds + 1):
        own = np.zeros((s, t, 2))
        own[:, :, 1] = w[x].sum(axis=2)
        pair, start = w[N_FEATURES : N_FEATURES + 4].reshape(2, 2), w[N_FEATURES + 4 :]
        a, b = np.zeros((s, t, 2)), np.zeros((s, t, 2))
        a[:, 0] = start + own[:, 0]
        for i in range(1, t):
            z = a[:, i - 1, :, None] + pair
            a[:, i] = np.where(on[:, i, None], np.logaddexp(z[:, 0], z[:, 1]) + own[:, i], a[:, i - 1])
        for i in range(t - 2, -1, -1):
            z = pair + (own[:, i + 1] + b[:, i + 1])[:, None, :]
            b[:, i] = np.where(on[:, i + 1, None], np.logaddexp(z[:, :, 0], z[:, :, 1]), 0)
        total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - total[:, None, None]) * on[:, :, None]
        expected = np.zeros_like(w)
        np.add.at(expected, x.reshape(-1, k), np.repeat(p[:, :, 1].reshape(-1, 1), k, axis=1))
        e = np.exp(a[:, :-1, :, None] + pair + (own[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None])
        expected[N_FEATURES : N_FEATURES + 4] = e[both].sum(axis=0).ravel()
        expected[N_FEATURES + 4 :] = p[:, 0].sum(axis=0)
        g = (seen - expected) / n - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(w[:N_FEATURES], w[N_FEATURES : N_FEATURES + 4].reshape(2, 2), w[N_FEATURES + 4 :])


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Crf:
    """Fit the field on at most ``rows`` labelled documents of either quality whose doc_id occurs once; without both kinds, a plain field."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("_id"), "_id"]
    picked = marked.where("quality = 1").orderBy(*order).limit(rows // 2).unionByName(marked.where("quality = 0").orderBy(*order).limit(rows // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for doc, t, q in zip(batch.column("_id").to_pylist(), batch.column("t"), batch.column("quality"), strict=True):
                _, features, _, repeats = read(t.as_py())
                good = q.as_py() == 1
                for i in range(0, len(features), FIT_LINES):
                    out[0].append(features[i : i + FIT_LINES])
                    out[1].append([int(good and not r) for r in repeats[i : i + FIT_LINES]])
                    out[2].append((doc << 20) + i)
            yield pa.RecordBatch.from_arrays([pa.array([((k + (1 << 63)) % (1 << 64)) - (1 << 63) for k in out[2]], pa.int64()), pa.array(out[0], pa.list_(pa.list_(pa.int32()))), pa.array(out[1], pa.list_(pa.int32()))], ["place", "x", "y"])

    docs = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("t"))
    found = once_each(docs, picked).select("_id", "t", "quality").mapInArrow(run, "place long, x array<array<int>>, y array<int>")
    found = found.orderBy(F.xxhash64("place"), "place").limit(FIT_SEQUENCES).select("x", "y").toArrow()
    sequences = sorted(zip(found.column("x").to_pylist(), found.column("y").to_pylist(), strict=True))
    if not any(1 in y for _, y in sequences) or not any(0 in y for _, y in sequences):
        return plain_field()
    return fit(sequences)


def quality(documents: DataFrame, field: Crf, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row for each document: counts, base_failed, content_share and kept.

    Texts are read whole; words are runs without ASCII white space.  Null and
    empty texts have no words, so they fail the base rules and go.  Repeated
    rows get equal rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares = [], []
            for t in batch.column("t"):
                c, features, sizes, _ = read(t.as_py())
                counts.append(c)
                shares.append(field.share(features, sizes))
            c = np.array(counts, np.int64).reshape(-1, 5)
            failed = (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])
            share = np.array(shares, float)
            columns = [batch.column("doc_id"), *(pa.array(x) for x in c.T.copy()), pa.array(failed), pa.array(share), pa.array(~failed & (share >= content_share))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, schema)
