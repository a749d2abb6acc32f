"""Language identification by cross-parsing entropy.

For each language, labelled text is joined to one reference string and its suffix automaton is built. A text is cut
into phrases, each the longest stretch that occurs somewhere in the reference. The fewer phrases a text needs, the
closer it is to the language; phrases count by the logarithm of the reference's length, the price of naming a place
in it, so references of different lengths compare.

The automata are flattened to a table from (state, byte) to the next state. Where the automaton has no such step, the
table holds the step from the start and a mark, so one look-up per byte follows a phrase or begins the next. numpy
takes that step for many stretches of text at once; a long text is cut into stretches of ``STRETCH`` bytes whose
phrases add up.

Defined results: a null text, or one without a letter, gives ``und`` with score 0; a tie goes to the language first
in code point order; without any labelled row all texts give ``und``; equal texts get equal results; other columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import text_steps, with_text
from cohortflow.session import materialize

UNKNOWN = "und"
#: Bound of the labelled sample: rows per language, characters that one row gives. All that is drawn is used.
SAMPLE_ROWS = 48
ROW_CHARACTERS = 512
#: Bytes of the step tables that travel at once; more languages are compared in several passes.
TABLE_BYTES = 1 << 28
STRETCH = 512
LANES = 4096
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with every stretch of other ASCII as one space, and each text's length."""
    encoded = [text.lower().encode() for text in texts]
    sizes = np.array([len(e) for e in encoded], np.int64)
    data = _PLAIN[np.frombuffer(b"".join(encoded), np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    ends = np.cumsum(sizes)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], np.diff(kept[np.concatenate([[0], ends])])


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that reads exactly the substrings of ``text``; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    longest, link = [0], [-1]
    last = 0
    for byte in text:
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in steps[at]:
            steps[at][byte] = new
            at = link[at]
        if at >= 0:
            target = steps[at][byte]
            if longest[target] == longest[at] + 1:
                link[new] = target
            else:
                # The target also ends longer strings: a copy takes over the short ones.
                copy = len(steps)
                steps.append(dict(steps[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while at >= 0 and steps[at].get(byte) == target:
                    steps[at][byte] = copy
                    at = link[at]
        last = new
    return steps


class Languages:
    """Step tables of all languages over one alphabet of byte classes; plain arrays, so it travels as a broadcast."""

    def __init__(self, references: dict[str, bytes]):
        self.names = sorted(references)
        seen = np.unique(np.frombuffer(b"".join(references.values()), np.uint8))
        self.width = len(seen) + 1  # class 0: bytes in no reference
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.price = np.array([np.log2(len(references[name]) + 2) for name in self.names])
        self.tables = [self._flat(suffix_automaton(references[name])) for name in self.names]

    def _flat(self, steps: list[dict[int, int]]) -> np.ndarray:
        """Twice the offset of the next state's row, plus 1 where a phrase ends before the byte."""
        rows = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
        bytes_ = np.fromiter((b for s in steps for b in s), np.int64, len(rows))
        target = np.fromiter((t for s in steps for t in s.values()), np.int64, len(rows))
        # A byte that the reference lacks is a phrase of its own: it leads to a last row, where every byte begins one.
        start = np.full(self.width, len(steps), np.int32)
        start[self.classes[bytes_[rows == 0]]] = target[rows == 0]
        flat = np.repeat((start * self.width * 2 + 1)[None, :], len(steps) + 1, axis=0)
        flat[rows, self.classes[bytes_]] = target * self.width * 2
        return flat.ravel()

    def phrases(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases that each text needs in each language: an array of texts by languages."""
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[owner] + place * STRETCH
        length = np.minimum(sizes[owner] - place * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        codes = np.concatenate([self.classes[data], np.zeros(STRETCH, np.int32)])
        result = np.zeros((len(sizes), len(self.names)))
        for low in range(0, len(order), LANES):
            lanes = order[low : low + LANES]
            spans = length[lanes]
            grid = codes[begin[lanes][None, :] + np.arange(spans[0])[:, None]]
            alive = np.searchsorted(-spans, -np.arange(spans[0]), side="left")  # lanes longer than each step
            for k, flat in enumerate(self.tables):
                state = np.full(len(lanes), len(flat) - self.width, np.int32)  # the last row: a phrase begins
                count = np.zeros(len(lanes), np.int32)
                for step in range(spans[0]):
                    n = alive[step]
                    found = flat[state[:n] + grid[step, :n]]
                    count[:n] += found & 1
                    state[:n] = found >> 1
                result[:, k] += np.bincount(owner[lanes], weights=count, minlength=len(sizes))
        return result


def passes_of(references: dict[str, bytes]) -> list[Languages]:
    """Languages in name order, as many together as keep their tables within ``TABLE_BYTES``."""
    groups: list[dict[str, bytes]] = []
    size = 0
    for name in sorted(references):
        # At most two states a byte, each with a step of four bytes for every byte that occurs.
        table = 8 * len(references[name]) * (len(set(references[name])) + 1)
        if not groups or size + table > TABLE_BYTES:
            groups.append({})
            size = 0
        groups[-1][name] = references[name]
        size += table
    return [Languages(group) for group in groups]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[Languages]:
    """Languages from a bounded sample of rows with a text and a language, in groups that are compared one after the other.

    Per language the ``SAMPLE_ROWS`` texts lowest in hash order are read, and each gives up to ``ROW_CHARACTERS`` from a
    place that its hash names. Copies of a text count once.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    mark = F.xxhash64(text)
    place = (F.pmod(mark, F.greatest(F.length(text) - ROW_CHARACTERS, F.lit(1))) + 1).cast("int")
    pieces = known.select(F.col(lang).alias("lang"), mark.alias("mark"), F.substring(F.col(text), place, F.lit(ROW_CHARACTERS)).alias("piece"))
    # Smallest marks per task first, then of all: no language's rows ever meet in one place.
    spread = pieces.groupBy("lang", "mark").agg(F.first("piece").alias("piece"))
    for keys in (["lang", F.pmod("mark", F.lit(64))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("mark"))
        spread = spread.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS)
    sample: dict[str, list[tuple[int, str]]] = {}
    for row in spread.select("lang", "mark", "piece").toLocalIterator():
        sample.setdefault(row["lang"], []).append((row["mark"], row["piece"]))
    references = {}
    for name, rows in sample.items():
        data, _ = _letters([piece + " " for _, piece in sorted(rows)])
        if len(data):
            references[name] = data.tobytes()
    return passes_of(references)


def identify(docs: DataFrame, languages: list[Languages], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) as struct ``row`` with lang_pred and score, the share by which the winner beats the runner-up.

    With several groups of languages, each is a pass over the written texts that carries the best two so far on.
    """
    packed, row = with_text(docs, text, keep)
    rows = packed.select("row", "_text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("inf")).alias("best"), F.lit(float("inf")).alias("second"))
    for place, group in enumerate(languages):
        rows = _compared(materialize(rows, "language-pass") if place else rows, group, row, place + 1 < len(languages))
    share = F.col("second") / (F.col("best") + F.col("second"))
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).when(F.col("second") == float("inf"), 1.0).otherwise(share)
    return rows.select("row", "lang_pred", score.alias("score"))


def _compared(rows: DataFrame, languages: Languages, row: str, again: bool) -> DataFrame:
    """``rows`` (row, _text, lang_pred, best, second) after a comparison with some languages; texts go on if needed ``again``."""
    shared = rows.sparkSession.sparkContext.broadcast(languages)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_steps(batches, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            known = np.array([any(map(str.isalpha, t)) for t in texts])
            names = np.array(batch.column("lang_pred").to_pylist(), object)
            best, second = (batch.column(c).to_numpy().copy() for c in ("best", "second"))
            if model.names and known.any():
                data, sizes = _letters([t for t, k in zip(texts, known) if k])
                cost = model.phrases(data, sizes) * model.price
                # The best before goes first, so that a tie stays with the earlier name.
                every = np.concatenate([best[known, None], second[known, None], cost], axis=1)
                winner = np.argmin(every, axis=1)
                names[known] = np.where(winner < 2, names[known], np.array(model.names, object)[np.maximum(winner - 2, 0)])
                best[known], second[known] = np.sort(every, axis=1)[:, :2].T
            left = batch.column("_text") if again else pa.nulls(batch.num_rows, pa.string())
            columns = [batch.column("row"), left, pa.array(names, pa.string()), pa.array(best), pa.array(second)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "_text", "lang_pred", "best", "second"])

    return rows.mapInArrow(predict, f"row {row}, _text string, lang_pred string, best double, second double")
