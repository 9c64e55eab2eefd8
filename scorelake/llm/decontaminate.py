"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words at the kept positions of a fixed mask, so words at the
other positions may differ.  The masks were chosen by covering all placements of
changed words: of any 10 words or more of which at least 0.8 agree in place, one
mask has all its words among those that agree.  (All placements in 10 to 19
words are enumerated in the tests; a longer stretch parts into such, and one of
the parts agrees as well as the whole.)  So no stretch is missed for want of a
seed while ``min_match`` is 0.8 or more.  Seeds of the benchmark and of the
documents are joined by hash; a bitmap of the benchmark's hashes, of a fixed size
whatever the benchmark's, keeps nearly all other seeds of a document from leaving
its task.
Around its hits a document sends the words of the neighbourhood along, and each
hit's alignment is verified there: the longest stretch in which at least
``min_match`` of the words agree in place.

Defined cases: null or empty texts have no words and leak nothing; benchmark
items of fewer than ``SHORTEST`` words are left out, as single words prove
nothing, and items shorter than the masks must occur whole and unchanged; items
that repeat are each reported; repeated rows are reported once; rows without an
id are told apart by their text and reported with a null id; empty tables leak
nothing; ``decontaminate`` keeps the input's columns as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import LAST_ID, col, ordered_id, packed, stage, text_of, unpacked
from scorelake.llm.words import Hasher, chunks, mix

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASKS = ["1111011", "110010111", "1110100011", "1011111", "1110111", "111100101"]  # 1: the word at this position counts
SPAN = max(len(mask) for mask in MASKS)
SHORTEST = 5
NEAR = 32  # words of the neighbourhood on either side of a hit
SLOTS = 1 << 24  # bits of the filter
PROBES = (0, 24, 40)  # a seed passes where the bits at its numbers from these places on are all set


def _seeds(words: np.ndarray, counts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of all places where the mask fits into a text."""
    kept = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = np.random.default_rng(int("1" + mask, 2)).integers(1, 2**63, len(kept), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    found = np.zeros(n, np.uint64)
    for i, factor in zip(kept, factors, strict=True):
        found += words[i : i + n] * factor
    valid = np.ones(len(words), bool)
    stop = np.cumsum(counts)
    for j in range(1, len(mask)):
        valid[stop[stop >= j] - j] = False
    place = np.flatnonzero(valid[:n])
    return mix(found[place]), place


def _bench_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(item, words, size, seeds, places)`` of benchmark items."""
    hasher = Hasher()
    for batch in batches:
        texts = batch.column(1)
        for start, stop in chunks(texts):
            words, counts = hasher.words(texts.slice(start, stop - start))
            ends = np.cumsum(counts)
            rows = []
            for i, (end, count) in enumerate(zip(ends, counts, strict=True)):
                own = words[end - count : end]
                for mask in MASKS if count >= SPAN else ["1" * count] if count >= SHORTEST else []:
                    seeds, places = _seeds(own, np.array([count]), mask)
                    rows.append((batch.column(0)[start + i].as_py(), own.tobytes(), int(count), seeds.view(np.int64), places))
            if rows:
                types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["item", "words", "size", "seeds", "places"])


_NEAR = "did long, th long, start long, words binary, seeds array<long>, places array<long>"


def _near_hits(masks: list[str], packed_slots: np.ndarray):
    """Neighbourhoods of a document's seeds that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed_slots, bitorder="little").view(bool)
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(2)
            for start, stop in chunks(texts):
                words, counts = hasher.words(texts.slice(start, stop - start))
                seeds, places = [], []
                for mask in masks:
                    own, place = _seeds(words, counts, mask)
                    hit = np.flatnonzero(known[own & np.uint64(SLOTS - 1)])
                    for probe in PROBES[1:]:
                        hit = hit[known[(own[hit] >> np.uint64(probe)) & np.uint64(SLOTS - 1)]]
                    seeds.append(own[hit])
                    places.append(place[hit])
                seeds, places = np.concatenate(seeds), np.concatenate(places)
                if not len(seeds):
                    continue
                order = np.argsort(places, kind="stable")
                seeds, places = seeds[order], places[order]
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, places, side="right")
                apart = np.ones(len(places), bool)
                apart[1:] = (doc[1:] != doc[:-1]) | (places[1:] - places[:-1] > SPAN + 2 * NEAR)
                edges = np.append(np.flatnonzero(apart), len(places))
                rows = []
                for a, b in zip(edges, edges[1:], strict=False):
                    d = int(doc[a])
                    first = int(ends[d] - counts[d])
                    low = max(first, int(places[a]) - NEAR)
                    high = min(int(ends[d]), int(places[b - 1]) + SPAN + NEAR)
                    own = words[low:high].tobytes()
                    rows.append((batch.column(0)[start + d].as_py(), batch.column(1)[start + d].as_py(), low - first, own,
                                 seeds[a:b].view(np.int64), places[a:b] - first))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["did", "th", "start", "words", "seeds", "places"])

    return run


def longest_agreement(agree: np.ndarray, min_match: float) -> tuple[int, int]:
    """Bounds of the longest stretch of which ``min_match`` agrees."""
    total = np.concatenate([[0.0], np.cumsum(agree - min_match)])
    least = np.minimum.accumulate(total)
    # The first place whose running minimum is not above the sum at the end of the stretch.
    first = len(least) - np.searchsorted(least[::-1], total + 1e-9, side="right")
    first = np.minimum(first, np.arange(len(total)))
    size = np.arange(len(total)) - first
    best = int(np.argmax(size))
    return int(first[best]), best


def _verifier(min_words: int, min_match: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, th, start, near, item, own, shift in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, passage = np.frombuffer(near, np.uint64), np.frombuffer(own, np.uint64)
                low, high = max(start, shift), min(start + len(text), shift + len(passage))
                agree = text[low - start : high - start] == passage[low - shift : high - shift]
                a, b = longest_agreement(agree, min_match)
                if b - a >= min(min_words, len(passage)):
                    rows.append((did, th, item, b - a, int(agree[a:b].sum()), low + a, low + a - shift))
            if rows:
                names = ["did", "th", "item_id", "words", "matches", "doc_word", "item_word"]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=names)

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 13,
    min_match: float = 0.8,
) -> DataFrame:
    """``(doc_id, item_id, words, matches, doc_word, item_word)``: the longest overlap of each pair; ``th`` hashes the text."""
    items = benchmark.select(col(item_col).cast("long").alias("item"), F.lower(text_of(item_text_col)).alias("text"))
    seeded = stage(
        items.mapInArrow(_bench_seeds, "item long, words binary, size long, seeds array<long>, places array<long>")
    )
    seeds = seeded.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_place")
    )
    # At most SLOTS small numbers, however large the benchmark; a full filter only lets more seeds through to the join.
    probes = F.array(*[F.shiftrightunsigned("seed", probe).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for probe in PROBES])
    slots = seeds.select(F.explode(probes).alias("slot")).distinct().toArrow()
    known = np.zeros(SLOTS, bool)
    known[slots.column("slot").to_numpy()] = True
    short = [r.size for r in seeded.select("size").filter(F.col("size") < SPAN).distinct().collect()]  # at most SPAN of them
    masks = MASKS + ["1" * n for n in sorted(short)]

    rows = docs.select(ordered_id(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), F.lower(text_of(text_col)).alias("text"))
    near = stage(rows.mapInArrow(_near_hits(masks, np.packbits(known, bitorder="little")), _NEAR).dropDuplicates(["did", "th", "start"]))
    key = ["did", "th", "start"]
    hits = near.select(*key, F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        *key, F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")
    )
    aligned = hits.join(seeds, "seed").select(*key, "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    passages = seeded.select("item", F.col("words").alias("passage")).distinct()
    found = (
        near.select(*key, "words")
        .join(aligned, key)
        .join(passages, "item")
        .select(*key, "words", "item", "passage", "shift")
        .mapInArrow(
            _verifier(min_words, min_match),
            "did long, th long, item_id long, words long, matches long, doc_word long, item_word long",
        )
    )
    measures = ["words", "matches", "doc_word", "item_word"]
    best = found.groupBy("did", "th", "item_id").agg(F.max(F.struct(*measures)).alias("best"))
    return best.select(
        F.when(F.col("did") != LAST_ID, F.col("did")).alias("doc_id"), "th", "item_id", *[F.col(f"best.{m}").alias(m) for m in measures]
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that leak no benchmark item."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **params)
    leaky = leaks.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("did"), "th").distinct()
    rows = docs.select(ordered_id(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), packed(docs).alias("row"))
    return unpacked(rows.join(leaky, ["did", "th"], "left_anti"), "row", docs.columns)
