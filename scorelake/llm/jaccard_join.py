"""Near-duplicate join by word-shingle Jaccard with Bayesian candidate pruning.

1. Every text becomes a MinHash signature of its shingles; equal texts are
   collapsed to the smallest id and counted.
2. Texts that agree on a whole band of hashes are candidates.  Buckets are cut
   into hashed blocks of a bounded size and compared block by block, so a bucket
   of any size is spread over tasks.
3. A pair's hashes are compared a few at a time.  After n hashes with m equal and
   a uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m); a pair below
   ``tolerance`` is dropped.  Of the rest only a spanning forest leaves the task:
   its components hold every surviving pair.
4. Shingle sets of such components are compared exactly, again block by block;
   per text the number of links and a spanning forest of the links leave the task.

A pair of similarity t misses all bands with probability (1 - t^4)^28 = 4e-7 at
t = 0.8 and is pruned wrongly with about the tolerance; nothing else is lost.

Defined cases: equal texts always link, and so do null and empty ones with each
other; a text of one to four words has one shingle of all its words; texts
without any word link only with equal texts; repeated rows are copies of each
other; a row without an id counts as the largest id; an empty table gives an
empty table; input columns pass through, ``class_id``, ``n_links`` and ``kept``
replace input columns of those names.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.blocks import block_pairs, classes_of, exact_links, forest, groups, link_rows, named_texts
from scorelake.llm.common import ordered_id, packed, stage, text_of, unpacked
from scorelake.llm.components import components
from scorelake.llm.words import Hasher, chunks, shingles

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
STEP = 16  # hashes compared before each look at the posterior
BUCKET_BLOCK = 1024  # signatures in a block of a bucket: larger blocks meet less often and send fewer links
PAIRS_AT_ONCE = 50_000
COLUMNS_AT_ONCE = 4096


def fewest_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After each step of hashes, the fewest matches that keep the posterior at the tolerance."""
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
        found.append((n, m))
    return found


def _signer(k: int):
    """``(row columns..., n_shingles, signature, bands)`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        rng = np.random.default_rng(7)
        factors = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        weights = rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in chunks(texts):
                hashes, counts = shingles(*hasher.words(texts.slice(start, stop - start)), k)
                full = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[full]
                sign = np.zeros((stop - start, HASHES), np.uint32)
                if len(full):
                    for i, factor in enumerate(factors):
                        sign[full, i] = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), first)
                bands = (sign.reshape(-1, BANDS, ROWS).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
                bands = (bands * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                ends = np.arange(stop - start + 1, dtype=np.int32)
                blob = pa.Array.from_buffers(
                    pa.binary(), stop - start, [None, pa.py_buffer(ends * np.int32(4 * HASHES)), pa.py_buffer(sign.tobytes())]
                )
                listed = pa.ListArray.from_arrays(pa.array(ends * np.int32(BANDS)), pa.array(bands.ravel()))
                own = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                names = [*batch.schema.names[:-1], "n_shingles", "signature", "bands"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts.astype(np.int64)), blob, listed], names=names)

    return run


def _compare_buckets(limits: list[tuple[int, int]]):
    """Candidate links of bucket blocks sorted by ``(bucket, pa, pb)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["bucket", "pa", "pb"], whole=False):
            n = rows.num_rows
            bucket, pa_, pb_, block, node = (rows.column(c).to_numpy() for c in ("bucket", "pa", "pb", "block", "node"))
            blob = rows.column("signature")
            ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + n + 1]
            sign = np.frombuffer(blob.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32).reshape(n, HASHES)
            left, right = [], []
            for lag in range(1, n):
                i = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & (pa_[lag:] == pa_[:-lag]) & (pb_[lag:] == pb_[:-lag]))
                if not len(i):
                    break  # sorted: no group is longer
                # Two blocks meet across only; each is compared within itself as a pair of its own.
                i = i[(pa_[i] == pb_[i]) | (block[i] != block[i + lag])]
                for part in np.split(i, range(PAIRS_AT_ONCE, len(i), PAIRS_AT_ONCE)):
                    equal = np.zeros(len(part), np.int64)
                    done = 0
                    for upto, fewest in limits:
                        equal += (sign[part, done:upto] == sign[part + lag, done:upto]).sum(axis=1)
                        keep = equal >= fewest
                        part, equal, done = part[keep], equal[keep], upto
                        if not len(part):
                            break
                    left.append(part)
                    right.append(part + lag)
            if left and sum(map(len, left)):
                ids, place = np.unique(node, return_inverse=True)
                a, b = forest(len(ids), place[np.concatenate(left)], place[np.concatenate(right)])
                yield link_rows(ids[a], ids[b])

    return run


def _set_maker(k: int):
    """``(row columns..., shingles)``: each text's sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in chunks(texts):
                hashes, counts = shingles(*hasher.words(texts.slice(start, stop - start)), k)
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends, counts, strict=True)]
                own = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each two sets share; shingles of one set only are left out beforehand."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    row, column = row[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((n, n), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + COLUMNS_AT_ONCE])
        has = np.zeros((n, COLUMNS_AT_ONCE), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        found += has @ has.T
    return found


def _similar(threshold: float):
    def matrix(rows: pa.RecordBatch) -> np.ndarray:
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in rows.column("shingles")]
        size = np.array([len(s) for s in sets], np.float64)
        both = _shared(sets)
        return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9

    return matrix


def jaccard_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
) -> DataFrame:
    """The documents with ``class_id`` (smallest linked id), ``n_links`` (directly linked rows) and ``kept``.

    ``kept`` is true for one row of each class: the smallest id, and of rows alike in
    id and text none more than another, so callers with repeated ids drop duplicates.
    """
    text = text_of(text_col)
    rows = docs.select(
        ordered_id(id_col).alias("did"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), F.lower(text).alias("text")
    )
    signed = stage(
        rows.mapInArrow(
            _signer(words), "did long, t1 long, t2 long, n_shingles long, signature binary, bands array<long>"
        )
    )
    same = ["t1", "t2"]
    texts = signed.groupBy(*same).agg(F.min("did").alias("rep"), F.count(F.lit(1)).alias("copies"))
    texts = stage(named_texts(texts, same))
    # One row a text: of rows alike in id and text any will do, their signatures are equal.
    reps = stage(
        signed.filter("n_shingles > 0")
        .join(texts.withColumnRenamed("rep", "did"), ["did", *same])
        .dropDuplicates(["did", *same])
        .select("did", *same, "node", "copies", "signature", "bands")
    )

    banded = reps.select("node", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    paired = block_pairs(banded.join(crowded, "bucket"), F.col("members"), BUCKET_BLOCK)
    blocks = paired.join(reps.select("node", "signature"), "node").select("bucket", "pa", "pb", "block", "node", "signature")
    keys = ["bucket", "pa", "pb"]
    candidates = (
        blocks.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_compare_buckets(fewest_matches(threshold, tolerance)), "a long, b long")
    )
    grouped = components(candidates)

    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    asked = reps.select("did", *same, "node", "copies").join(grouped.join(sizes, "component"), "node")
    wanted = rows.join(asked, ["did", *same]).dropDuplicates(["did", *same])
    sets = wanted.select("node", "component", "members", "copies", "text").mapInArrow(
        _set_maker(words), "node long, component long, members long, copies long, shingles binary"
    )
    known = classes_of(texts, same, *exact_links(sets, "shingles", _similar(threshold)))
    out = docs.select(
        ordered_id(id_col).alias("did"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), packed(docs).alias("row")
    ).join(known, same, "left")
    class_id = F.coalesce("class_id", "did")
    return unpacked(
        out, "row", docs.columns, class_id=class_id, n_links=F.coalesce("n_links", F.lit(0)).cast("long"), kept=class_id == F.col("did")
    )
