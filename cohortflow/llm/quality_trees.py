"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are sums over its bytes, words and lines, computed for many texts at once in numpy. The
trees are grown on the driver from a bounded sample of labelled rows: every statistic is cut into bins at quantiles
of the sample, and each split is the best over the histograms of gradients. A fitted forest is a few flat arrays
(statistic, threshold, children, value), and scoring walks all texts of a batch down all trees level by level.

Defined results: a null text counts as empty, and an empty text has a score too; labels other than 0 and 1 are not
learned from; a document with both labels is left out; without rows of both classes the score is the share of class 1
(0.5 without any row); equal texts get equal scores; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import Groups, Words, running_hash, span_hash, text_buffer, text_steps, with_text

#: Bound of the labelled sample, and the shape of the forest.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, LEAST_ROWS, SHRINK = 80, 4, 64, 0.15, 10, 1.0

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_WIDE = _BYTE >= 128
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_STOP = np.isin(_BYTE, list(b".?!"))
_COMMA = np.isin(_BYTE, list(b",;:"))
_MARK = np.isin(_BYTE, list(b"#$%&*|<>{}[]\\^~_=+@/"))
_CONTROL = (_BYTE < 32) & ~_SPACE
#: What is counted per text, as a share of its bytes.
_CLASSES = (_DIGIT, _UPPER, _LOWER, _WIDE, _STOP, _COMMA, _MARK, _CONTROL, _BYTE == ord("!"), _BYTE == ord("|"))
STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "word_bytes_spread", "long_words", "words_per_line",
    "digits", "upper", "lower", "wide", "stops", "commas", "marks", "controls", "bangs", "bars",
    "distinct_words", "distinct_lines", "repeated_words", "marked_words", "upper_words", "digit_words", "one_byte_words",
    "lines_ended", "line_spread", "top_word", "letter_entropy",
)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    raw, offsets = text_buffer(column)
    words = Words(column)
    n = words.texts
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    per = np.maximum(size, 1)
    count = lambda where: np.bincount(owner[where], minlength=n)
    out = {"bytes": np.log1p(size), "words": np.log1p(words.counts)}
    for name, chosen in zip(STATISTICS[7:17], _CLASSES):
        out[name] = count(chosen[raw]) / per

    per_word = np.maximum(words.counts, 1)
    length = words.stops - words.starts
    by_word = lambda values: np.bincount(words.owner, weights=values, minlength=n) / per_word
    out["word_bytes"] = by_word(length)
    out["word_bytes_spread"] = np.sqrt(np.maximum(by_word(length.astype(float) ** 2) - out["word_bytes"] ** 2, 0))
    out["long_words"] = by_word(length > 15)
    out["one_byte_words"] = by_word(length == 1)

    def inside(chosen: np.ndarray) -> np.ndarray:
        """Per word, its bytes of a class."""
        sums = np.concatenate([[0], np.cumsum(chosen[raw], dtype=np.int64)])
        return sums[words.stops] - sums[words.starts]

    out["marked_words"] = by_word(inside(_MARK) > 0)
    out["digit_words"] = by_word(inside(_DIGIT) > 0)
    out["upper_words"] = by_word((inside(_UPPER) > 1) & (inside(_LOWER) == 0))

    hashes = words.hashes()
    same = Groups(words.owner, hashes)
    who, times = same.owner, same.sizes
    out["distinct_words"] = np.bincount(who, minlength=n) / per_word
    out["repeated_words"] = np.bincount(who, weights=(times > 2) * times, minlength=n) / per_word
    most = np.zeros(n)
    np.maximum.at(most, who, times)
    out["top_word"] = most / per_word

    # Lines: stretches without a line feed inside one text; empty ones do not exist.
    inside_line = raw != 10
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside_line[:-1], inside_line[1:]
    bounds = offsets[1:-1]
    before[bounds[bounds < len(raw)]] = False
    after[bounds[bounds > 0] - 1] = False
    starts = np.flatnonzero(inside_line & ~before)
    stops = np.flatnonzero(inside_line & ~after) + 1
    line_owner = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    per_line = np.maximum(lines, 1)
    out["lines"] = np.log1p(lines)
    out["words_per_line"] = words.counts / per_line
    width = (stops - starts).astype(float)
    mean = np.bincount(line_owner, weights=width, minlength=n) / per_line
    square = np.bincount(line_owner, weights=width**2, minlength=n) / per_line
    out["line_spread"] = np.sqrt(np.maximum(square - mean**2, 0)) / np.maximum(mean, 1)
    out["lines_ended"] = np.bincount(line_owner, weights=_STOP[raw[stops - 1]] if len(stops) else None, minlength=n) / per_line
    marks = span_hash(running_hash(words.data), starts, stops)
    out["distinct_lines"] = np.bincount(Groups(line_owner, marks).owner, minlength=n) / per_line

    letters = words.data & 31
    letters = np.where(_LOWER[words.data], letters, 0)
    table = np.bincount(owner * 32 + letters, minlength=n * 32).reshape(n, 32)[:, 1:27].astype(float)
    share = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
    out["letter_entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    return np.column_stack([out[name] for name in STATISTICS])


class Forest:
    """All trees as flat arrays: node i of tree t is at t * nodes + i, its children at 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        root = np.arange(trees)[None, :] * nodes
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(nodes + 1)) - 1):
            place = at + root
            at = 2 * at + 1 + (x[rows, feature[place]] > threshold[place])
        return 1 / (1 + np.exp(-(total + self.value.ravel()[at + root].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosted trees for the log-loss; every level is split from one histogram over (node, statistic, bin)."""
    nodes = 2 ** (depth + 1) - 1
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    empty = lambda t: (np.zeros((t, nodes), np.int64), np.full((t, nodes), np.inf), np.zeros((t, nodes)))
    if len(np.unique(y)) < 2:
        return Forest(base if len(y) else 0.0, *empty(1))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    features = x.shape[1]
    slots = np.arange(features) * bins
    feature, threshold, value = empty(rounds)
    margin = np.full(len(y), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * features * bins + slots + binned).ravel()
            hist = [
                np.bincount(cell, weights=np.repeat(w, features), minlength=width * features * bins).reshape(width, features, bins).cumsum(axis=2)
                for w in (slope, bend, np.ones(len(y)))
            ]
            g, h, c = hist
            gain = g**2 / (h + SHRINK) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + SHRINK) - g[..., -1:] ** 2 / (h[..., -1:] + SHRINK)
            gain[(c < LEAST_ROWS) | (c[..., -1:] - c < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for node in range(width):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + node], threshold[t, first + node] = f, edges[f][b]
            go = x[np.arange(len(y)), feature[t, at]] > threshold[t, at]
            at = 2 * at + 1 + go
        sums = np.bincount(at, weights=slope, minlength=nodes) / (np.bincount(at, weights=bend, minlength=nodes) + SHRINK)
        value[t] = RATE * sums
        margin += value[t, at]
    return Forest(base, feature, threshold, value)


def learn(docs: DataFrame, labels: DataFrame, learned: Column, text: str = "text", rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from at most ``rows`` labelled documents where ``learned`` holds, those lowest in hash order of the id.

    ``labels`` has doc_id and quality. Only the statistics of the sample reach the driver.
    """
    clean = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learned)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``rows`` rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            stats = statistics(batch.column("text"))
            packed = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), packed, batch.column("quality").cast(pa.int32())], ["id", "x", "y"])

    # Copies of a row beyond the first per id would go past the bound.
    measured = sample.mapInArrow(measure, "id string, x array<double>, y int").groupBy("id").agg(F.min(F.struct("x", "y")).alias("s"))
    table = measured.select("id", "s.x", "s.y").toArrow().sort_by("id")
    if not table.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, len(STATISTICS))
    return grow(x, table["y"].to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) as struct ``row`` with ``score``, the probability of class 1."""
    packed, row = with_text(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "_text"):
            result = shared.value.score(statistics(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(result)], ["row", "score"])

    return packed.mapInArrow(predict, f"row {row}, score double")
