"""Comparing groups of any size block by block.

A group's rows are dealt to hashed blocks of a bounded size and each row is sent
once to every pair of blocks its own takes part in, so no task ever holds more
than two blocks of a group.  From a block pair only counts and a spanning forest
leave the task, never the pairs themselves.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stage
from scorelake.llm.components import components

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256  # rows in a block, on average


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys``, never parting a group: several groups at a time, or one (``whole``)."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = joined()
        at = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(rows.num_rows, bool)
        for values in at:
            change[1:] |= values[1:] != values[:-1]
        edges = np.flatnonzero(change)
        if not len(edges):
            held = [rows]
            continue
        bounds = [0, *edges.tolist()] if whole else [0, int(edges[-1])]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield rows.slice(a, b - a)
        held = [rows.slice(bounds[-1])]
    if held:
        yield joined()


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node of a component to its smallest node, for nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            child = np.flatnonzero(label != np.arange(n))
            return label[child], child
        label = new


def link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def block_pairs(df: DataFrame, count: Column, size: int = BLOCK) -> DataFrame:
    """Each row once for every pair of blocks (of about ``size`` rows) that its own block takes part in."""
    blocks = F.ceil(count / size).cast("int")
    df = df.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    df = df.select("*", other)
    return df.withColumn("pa", F.least("block", "other")).withColumn("pb", F.greatest("block", "other")).drop("other", "blocks")


def link_counter(matrix: Callable[[pa.RecordBatch], np.ndarray]):
    """Links of component blocks sorted by ``(component, pa, pb)``: weighted counts per node and a spanning forest.

    ``matrix`` says of a block pair's rows which are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["component", "pa", "pb"], whole=True):
            node, block, copies = (rows.column(c).to_numpy() for c in ("node", "block", "copies"))
            linked = matrix(rows)
            np.fill_diagonal(linked, False)
            if rows.column("pa")[0].as_py() != rows.column("pb")[0].as_py():
                linked &= block[:, None] != block[None, :]
            links = linked @ copies
            some = np.flatnonzero(links)
            if not len(some):
                continue
            a, b = forest(len(node), *np.nonzero(linked))
            counted = pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(links[some]), pa.nulls(len(some), pa.int64())], names=["a", "links", "b"]
            )
            tied = pa.RecordBatch.from_arrays(
                [pa.array(node[a]), pa.nulls(len(a), pa.int64()), pa.array(node[b])], names=["a", "links", "b"]
            )
            yield from (counted, tied)

    return run


def exact_links(members: DataFrame, payload: str, matrix: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Compare ``(node, component, members, copies, payload)`` within components.

    Returns ``(node, links)``, the linked rows of other nodes, and ``(node, component)`` of the links.
    """
    keys = ["component", "pa", "pb"]
    exact = stage(
        block_pairs(members, F.col("members"))
        .select(*keys, "block", "node", "copies", payload)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(link_counter(matrix), "a long, links long, b long")
    )
    counts = exact.filter("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return counts, components(exact.filter("b IS NOT NULL").select("a", "b"))


def named_texts(counted: DataFrame, same: list[str]) -> DataFrame:
    """``(same..., rep, copies)`` with ``node``: the smallest id, or a hash where different rows share that id."""
    users = counted.groupBy("rep").agg(F.count(F.lit(1)).alias("users")).filter("users > 1")
    node = F.when(F.col("users").isNull(), F.col("rep")).otherwise(-1 - F.abs(F.col(same[0])))
    return counted.join(users, "rep", "left").select(*same, "rep", "copies", node.alias("node"))


def classes_of(named: DataFrame, same: list[str], counts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(same..., class_id, n_links)``: the smallest id linked, and linked rows counting equal ones."""
    smallest = named.join(classes, "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    found = named.join(counts, "node", "left").join(classes, "node", "left").join(smallest, "component", "left")
    return found.select(
        *same, F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
