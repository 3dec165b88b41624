"""Quality of documents from their lines: a linear-chain conditional random field labels every line good or bad.

A line is described by its own features and those of the lines before and after it. Forward-backward gives the chance
that each line is good; a document's score is their mean, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, whole

OWN = ("symbols", "capitals", "digits", "blanks", "repeats", "same_again", "word_length", "length", "sentence_end")
N_FEATURES = 1 + 3 * len(OWN)
#: Training chains are cut to so many lines, so that one long document doesn't set the pace.
CHAIN = 48

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[list(b".,;:'\"?-()")] = 0
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_ENDS = np.zeros(256, bool)
_ENDS[list(b".?!:;")] = True


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of their neighbours, where each text's lines start, and the lines' lengths."""
    parts = pc.split_pattern(texts, "\n")
    at = parts.offsets.to_numpy().astype(np.int64)
    at, lines = at - at[0], parts.flatten()
    n = len(lines)
    sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer("".join(lines.to_pylist()).encode(), np.uint8)
    kinds = _CLASS[raw]
    counts = []
    for kind in (1, 2, 3, 4):
        total = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int32)])
        counts.append(total[ends] - total[starts])
    # Words of a line that the line had before, and words equal to the one just before.
    cut = pc.split_pattern(lines, " ")
    word_at = cut.offsets.to_numpy().astype(np.int64)
    word_at = word_at - word_at[0]
    codes = pc.dictionary_encode(cut.flatten()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.diff(word_at)
    key = np.repeat(np.arange(n), words) << 32 | codes
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], key[1:] == key[:-1]])[: len(key)])])
    key.sort()
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], key[1:] == key[:-1]])[: len(key)])])
    size, held = np.maximum(sizes, 1), np.maximum(words, 1)
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(n, np.uint8)
    own = np.stack(
        [
            counts[0] / size, counts[1] / size, counts[2] / size, counts[3] / size, (again[word_at[1:]] - again[word_at[:-1]]) / held,
            (same[word_at[1:]] - same[word_at[:-1]]) / held, np.minimum(size / held, 20) / 10, np.log1p(sizes) / 5,
            _ENDS[last] & (sizes > 0),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[at[:-1][at[:-1] < n]] = 0
    after[at[1:] - 1] = 0
    return np.concatenate([np.ones((n, 1)), own, before, after], axis=1), at, size


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class LineCrf:
    """weights: features x 2; moves: from label x to label; label 1 is good."""

    weights: np.ndarray
    moves: np.ndarray
    #: slope and shift that make a chance of a document's label out of the log-odds of its mean
    scale: tuple[float, float] = (1.0, 0.0)

    def messages(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward messages of all chains, and each line's own factor. Chains advance side by side."""
        own = x @ self.weights
        own = np.exp(own - own.max(axis=1, keepdims=True)) if len(own) else own
        step, n = np.exp(self.moves - self.moves.max()), np.diff(at)
        order = np.argsort(-n, kind="stable")
        start, n = at[:-1][order], n[order]
        ahead, back = np.full_like(own, 0.5), np.full_like(own, 0.5)
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), "left")  # chains with more than t lines
        for t in range(longest):
            rows = start[: live[t]] + t
            m = own[rows] if t == 0 else own[rows] * (ahead[rows - 1] @ step)
            ahead[rows] = m / m.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            rows = start[: live[t + 1]] + t
            m = (own[rows + 1] * back[rows + 1]) @ step.T
            back[rows] = m / m.sum(axis=1, keepdims=True)
        return ahead, back, own

    def marginals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        ahead, back, _ = self.messages(x, at)
        both = ahead * back
        return both / both.sum(axis=1, keepdims=True)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The chance, for each text, that it is good: its lines' chances, weighted by length, on the documents' scale."""
        return self.of_lines(*line_features(texts)) if len(texts) else np.zeros(0)

    def of_lines(self, x: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        good = self.marginals(x, at)[:, 1]
        odds = _log_odds(np.add.reduceat(good * size, at[:-1]) / np.add.reduceat(size, at[:-1]))
        return 1 / (1 + np.exp(-(self.scale[0] * odds + self.scale[1])))


def fit(x: np.ndarray, at: np.ndarray, labels: np.ndarray, rounds: int = 2, steps: int = 250, ridge: float = 1e-3) -> LineCrf:
    """Fit to lines that carry their document's label, by gradient steps (Adam) on the chains' likelihood.

    After each round, lines of bad documents that look good beyond doubt are taken as good: junk often has a clean line
    or two around it.
    """
    weights, moves = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    y = labels.copy()
    if not len(x) or y.min() == y.max():
        return LineCrf(weights, moves)
    inner = np.ones(len(x), bool)
    inner[at[:-1]] = False  # lines with a line before them in their chain
    later = np.flatnonzero(inner)
    for _ in range(rounds):
        means = [np.zeros_like(weights), np.zeros_like(moves)]
        squares = [np.zeros_like(weights), np.zeros_like(moves)]
        seen = np.eye(2)[y]
        pairs_seen = np.zeros((2, 2))
        np.add.at(pairs_seen, (y[later - 1], y[later]), 1)
        for t in range(1, steps + 1):
            crf = LineCrf(weights, moves)
            ahead, back, own = crf.messages(x, at)
            both = ahead * back
            both /= both.sum(axis=1, keepdims=True)
            joint = ahead[later - 1][:, :, None] * np.exp(moves - moves.max())[None] * (own[later] * back[later])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            slopes = [x.T @ (seen - both) / len(x) - ridge * weights, (pairs_seen - joint.sum(axis=0)) / len(x) - ridge * moves]
            for k, (value, slope) in enumerate(zip((weights, moves), slopes)):
                means[k] = 0.9 * means[k] + 0.1 * slope
                squares[k] = 0.999 * squares[k] + 0.001 * slope**2
                value += 0.1 * (means[k] / (1 - 0.9**t)) / (np.sqrt(squares[k] / (1 - 0.999**t)) + 1e-9)
        # Lines by themselves, without their chain, decide what is beyond doubt.
        alone = 1 / (1 + np.exp(-(x @ (weights[:, 1] - weights[:, 0]))))
        y = np.where((labels == 0) & (alone > 0.9), 1, labels)
        if y.min() == y.max():
            break
    return LineCrf(weights, moves)


def calibrated(crf: LineCrf, raw: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> LineCrf:
    """Fit the scale to documents' labels by Newton's method; raw are the log-odds of their means."""
    if not len(labels) or labels.min() == labels.max():
        return crf
    x, w = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (labels - p) - ridge * (w - [1.0, 0.0])
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), slope)
    return LineCrf(crf.weights, crf.moves, (float(max(w[0], 0.1)), float(w[1])))


def train_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = 3000
) -> LineCrf:
    """Fit on at most `max_docs` labelled documents, those with the smallest hash of their identifier.

    Rows with a null identifier or label are left out; a document without a label too. Without both labels the field says
    0.5 of everything. The lines' features, not the texts, come to the driver.
    """
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    some = some.orderBy(F.xxhash64("id"), "id", "label").limit(max_docs)

    @F.arrow_udf("struct<features:binary,lines:bigint,sizes:binary>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                x, _, size = line_features(pa.array([t], pa.string()))
                rows.append({"features": x.astype("<f4").tobytes(), "lines": len(x), "sizes": size.astype("<i8").tobytes()})
            yield pa.array(rows, pa.struct([("features", pa.binary()), ("lines", pa.int64()), ("sizes", pa.binary())]))

    held = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(some), "id")  # max_docs rows
    rows = held.select("label", describe("text").alias("d")).select("label", "d.features", "d.lines", "d.sizes").collect()
    rows = sorted(rows, key=lambda r: (r["label"], r["lines"], bytes(r["features"])))  # the same fit in whatever order rows come
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
    size = np.frombuffer(b"".join(bytes(r["sizes"]) for r in rows), "<i8")
    lines, labels_of = [r["lines"] for r in rows], np.array([r["label"] for r in rows], np.int64)
    chains = [n for total in lines for n in [CHAIN] * (total // CHAIN) + [total % CHAIN] * (total % CHAIN > 0)]
    places = lambda sizes: np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    crf = fit(x, places(chains), np.repeat(labels_of, lines))
    return calibrated(crf, _log_odds(crf.of_lines(x, places(lines), size)), labels_of) if rows else crf


def quality_score(model: LineCrf, text: str | Column = "text") -> Column:
    """The score, 0 to 1, of each whole text; null counts as empty, and an empty text is one empty line."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array(model.scores(texts))

    return score(whole(text))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: one in five, by a checksum of its identifier."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
