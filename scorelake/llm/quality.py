"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics (shares of character classes, word and line lengths, repetition) are
computed in numpy over whole Arrow columns.  Trees are grown on a sample of at
most ``MAX_TRAINING_ROWS`` labelled documents, those of the smallest hashes of
their ids: values are put into quantile bins once, a split is found from
gradient and hessian histograms per bin.  The trees are complete and flattened
into arrays, so scoring walks all rows of a batch down a tree with a few numpy
steps.

Defined cases: a null or empty text has all statistics zero and gets a score
like any other; labels that are null, or of ids that no document has, teach
nothing; repeated rows or labels count each time; without a single label, or
with one class only, every score is that class's share (0.5 without labels);
input columns pass through, ``held_out``, ``score`` and ``predicted`` replace
input columns of those names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import col, packed, text_of, unpacked
from scorelake.llm.words import Hasher, chunks, mix

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TRAINING_ROWS = 40_000
SYMBOLS = b"!#$%&*|<>{}[]_=+~^\\/@"
CLASSES = ["lower", "upper", "digit", "space", "line_end", "stop", "comma", "other", "high"] + [f"symbol_{c}" for c in range(len(SYMBOLS))]
STATISTICS = [f"share_{c}" for c in CLASSES] + [
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "distinct_words", "top_word",
    "distinct_pairs", "line_length", "distinct_lines", "short_lines", "upper_starts", "longest_word",
]


def _class_of_byte() -> np.ndarray:
    code = np.arange(256)
    kind = np.full(256, CLASSES.index("other"))
    kind[(code >= ord("a")) & (code <= ord("z"))] = CLASSES.index("lower")
    kind[(code >= ord("A")) & (code <= ord("Z"))] = CLASSES.index("upper")
    kind[(code >= ord("0")) & (code <= ord("9"))] = CLASSES.index("digit")
    kind[[32, 9]], kind[[10, 13]] = CLASSES.index("space"), CLASSES.index("line_end")
    kind[[ord("."), ord("?")]], kind[ord(",")] = CLASSES.index("stop"), CLASSES.index("comma")
    kind[code >= 128] = CLASSES.index("high")
    for i, c in enumerate(SYMBOLS):
        kind[c] = CLASSES.index(f"symbol_{i}")
    return kind


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the number of distinct hashes and how often the most frequent occurs."""
    _, first, times = np.unique(mix(hashes + mix(row.astype(np.uint64))), return_index=True, return_counts=True)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[first], times)
    return np.bincount(row[first], minlength=rows), most


class Statistics:
    def __init__(self):
        self.kind = _class_of_byte()
        self.words, self.lines = Hasher(), Hasher(apart=b"\n")

    def of(self, texts: pa.Array) -> np.ndarray:
        """The statistics of every text of a column without nulls, one row each."""
        n = len(texts)
        data, ends, start, stop = self.words.spans(texts)
        size = np.diff(ends)
        safe = np.maximum(size, 1)
        owner = np.repeat(np.arange(n), size)
        shares = np.bincount(owner * len(CLASSES) + self.kind[data], minlength=n * len(CLASSES)).reshape(n, -1) / safe[:, None]

        counts = np.diff(np.searchsorted(start, ends))
        words = np.maximum(counts, 1)
        row = np.repeat(np.arange(n), counts)
        length = (stop - start + 1).astype(np.float64)
        mean = np.bincount(row, length, n) / words
        spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / words - mean**2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        hashes = self.words.hashes(data, start, stop)
        distinct, most = _distinct(hashes, row, n)
        inner = row[1:] == row[:-1]
        pairs = (hashes[1:] + hashes[:-1] * np.uint64(0x9E3779B97F4A7C15))[inner]
        distinct_pairs, _ = _distinct(pairs, row[1:][inner], n)
        upper = self.kind[data[start]] == CLASSES.index("upper")

        _, _, line_start, line_stop = self.lines.spans(texts)
        line_counts = np.diff(np.searchsorted(line_start, ends))
        lines = np.maximum(line_counts, 1)
        line_row = np.repeat(np.arange(n), line_counts)
        line_length = (line_stop - line_start + 1).astype(np.float64)
        distinct_lines, _ = _distinct(self.lines.hashes(data, line_start, line_stop), line_row, n)
        more = [
            np.log1p(size), np.log1p(counts), mean, spread, np.bincount(row, length > 14, n) / words, distinct / words, most / words,
            distinct_pairs / np.maximum(counts - 1, 1), np.bincount(line_row, line_length, n) / lines, distinct_lines / lines,
            np.bincount(line_row, line_length < 20, n) / lines, np.bincount(row, upper, n) / words, longest,
        ]
        return np.column_stack([shares, *more])


@dataclass
class Trees:
    """Complete trees as arrays: per tree, the splits of the inner nodes in heap order and the leaves' values."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are at the same depth
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 2.0, least: float = 5.0
) -> Trees:
    """Boosted trees for labels 0 and 1 by the logistic loss."""
    share = float(np.mean(y)) if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    start = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
    if not len(y) or not 0 < share < 1:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    total = np.full(len(y), start)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                place = (node - low) * bins + binned[:, j]
                gs = np.bincount(place, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(place, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gl, hl = gs[:, : len(edges[j])], hs[:, : len(edges[j])]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain[(hl < least / 4) | (hr < least / 4)] = 0
                cut = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(width), cut] > best)
                best[better] = gain[better, cut[better]]
                feature[low + better], limit[low + better] = j, edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        total += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), start)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(label, statistics)`` of labelled texts."""
    made = Statistics()
    for batch in batches:
        texts = batch.column(1)
        for start, stop in chunks(texts):
            x = made.of(texts.slice(start, stop - start))
            ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), listed], names=["label", "statistics"])


def _scorer(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Statistics()
        for batch in batches:
            texts = batch.column(1)
            for start, stop in chunks(texts):
                score = trees.score(made.of(texts.slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(score)], names=["row", "score"])

    return run


def held_out(id_column: Column) -> Column:
    """Whether a document's label is kept from training: one id in five, by crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
) -> Trees:
    """Trees grown on at most ``max_rows`` labelled documents that are not held out."""
    taught = (
        labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    texts = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    # The labels number max_rows at most, so they can go to every task.
    rows = texts.join(F.broadcast(taught), "id").select("label", "text")
    found = rows.mapInArrow(_statistics_rows, "label int, statistics array<double>").toArrow()
    x = found.column("statistics").combine_chunks()
    flat = x.flatten().to_numpy() if len(x) else np.zeros(0)
    return grow(flat.reshape(-1, len(STATISTICS)), found.column("label").to_numpy().astype(np.float64))


def score_quality(
    docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.3
) -> DataFrame:
    """The documents with ``held_out``, ``score`` and ``predicted`` (1 from a score of ``keep_from`` up)."""
    rows = docs.select(packed(docs).alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_scorer(trees), schema)
    return unpacked(
        scored, "row", docs.columns, held_out=held_out(F.col("row")[id_col]), score=F.col("score"),
        predicted=(F.col("score") >= keep_from).cast("int"),
    )
