"""Isotonic steps of many rows: pool adjacent violators as a mergeable summary.

Counts of distinct values are range-partitioned; every slice pools its own
violators into blocks and cuts them into pieces of ``PIECE`` blocks.  Only where a piece's
last block lies above the next piece's first can more pooling be needed, so a round joins such
neighbours, two at a time, pools them and cuts the result again.  Pooling never depends on the order of merges, and rounds end
when no edge is violated; a chain of violated edges halves with each round.  A
task holds two pieces; the driver sees one row per piece.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import constants
from scorelake.functions.state import stage

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 16
BLOCKS = "part int, piece double, low double, high double, n long, bad long"
Block = list  # low, high, n, bad


def pool(blocks: list[Block], more: Iterator[Block]) -> list[Block]:
    """Append blocks in order, pooling as long as a mean falls; whole numbers decide."""
    for block in more:
        while blocks and blocks[-1][3] * block[2] > block[3] * blocks[-1][2]:
            low, _, n, bad = blocks.pop()
            block = [low, block[1], n + block[2], bad + block[3]]
        blocks.append(block)
    return blocks


def _cut(part: int, blocks: list[Block]) -> list[tuple]:
    return [(part, blocks[i - i % PIECE][0], *b) for i, b in enumerate(blocks)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def row(part: int, blocks: list[Block]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_cut(part, blocks)), kinds)], names=names)

    now, blocks = None, []
    for batch in batches:
        for part, p, n, bad in zip(*[batch[c].to_pylist() for c in ("part", "p", "n", "bad")]):
            if part != now:
                if blocks:
                    yield row(now, blocks)
                now, blocks = part, []
            pool(blocks, iter([[p, p, n, bad]]))
    if blocks:
        yield row(now, blocks)


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    ordered = pieces.sort_values("low")
    rows = zip(*[ordered[c].tolist() for c in ("low", "high", "n", "bad")])
    return pd.DataFrame(_cut(int(pieces["part"].iloc[0]), pool([], map(list, rows))), columns=[c.split()[0] for c in BLOCKS.split(", ")])


def isotonic_blocks(weights: DataFrame) -> DataFrame:
    """``(part, low, high, n, bad)`` of rising means per part, from ``weights (part, p, n, bad)`` with distinct (part, p)."""
    chosen = weights.select(F.col("part").cast("int").alias("part"), F.col("p").cast("double").alias("p"), F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    blocks = stage(chosen.filter("n > 0").repartitionByRange("part", "p").sortWithinPartitions("part", "p").mapInArrow(_slices, BLOCKS))
    while True:
        sides = [F.min_by(F.struct("n", "bad"), "low").alias("first"), F.max_by(F.struct("n", "bad"), "low").alias("last")]
        edges = sorted(blocks.groupBy("part", "piece").agg(*sides).collect(), key=lambda r: (r.part, r.piece))
        pairs, at = [], 0
        while at < len(edges) - 1:
            a, b = edges[at], edges[at + 1]
            violated = a.part == b.part and a.last.bad * b.first.n > b.first.bad * a.last.n
            if violated:
                pairs += [(a.part, a.piece, a.piece), (b.part, b.piece, a.piece)]
            at += 2 if violated else 1
        if not pairs:
            return blocks.select("part", "low", "high", "n", "bad")
        met = F.broadcast(constants(blocks, pairs, "part int, piece double, with double"))  # pieces, not blocks
        merged = blocks.join(met, ["part", "piece"]).groupBy("part", "with").applyInPandas(_joined, BLOCKS)
        blocks = stage(blocks.join(met, ["part", "piece"], "left_anti").select("part", "piece", "low", "high", "n", "bad").union(merged))
