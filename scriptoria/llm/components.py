"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import Scratch

#: Edges that one call of the local contraction holds.
HELD_EDGES = 500_000
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the given edges: each node that is not the least of its component, and the least."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at.ravel()[: len(u)], at.ravel()[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    leaf = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[leaf], nodes[parent[leaf]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_u, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held_u, held_v = np.concatenate((held_u, u[u != v])), np.concatenate((held_v, v[u != v]))
        if len(held_u) > HELD_EDGES:
            held_u, held_v = contracted(held_u, held_v)
            if len(held_u) > HELD_EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held_u), pa.array(held_v)], schema=_EDGES)
                held_u, held_v = held_u[:0], held_v[:0]
    if len(held_u):
        held_u, held_v = contracted(held_u, held_v)
        yield pa.RecordBatch.from_arrays([pa.array(held_u), pa.array(held_v)], schema=_EDGES)


def _are_stars(e: DataFrame) -> bool:
    """Whether every node that is not a centre has one edge, to a centre."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leaf")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("leaf")))
    nodes = ends.groupBy("x").agg(F.sum("leaf").alias("up"), F.min("leaf").alias("least"))
    return nodes.where("up > 1 or (up = 1 and least = 0)").isEmpty()


def _round(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Edges are first contracted within each partition, a bounded number at a time; then each round is an
    aggregate and a join on slim rows, contracted again, until all components are stars. A node with
    very many links is spread by the join's skew handling and never gathered. The number of rounds
    grows with the logarithm of the longest path; lineage is cut in every round. Loops, repeated edges and
    edges with a null end are harmless: a null names no node.
    """
    scratch = Scratch(edges.sparkSession, "components")
    slim = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    contract = lambda d: d.mapInArrow(_contract, "u long,v long")
    e = scratch.keep(contract(slim))
    for _ in range(rounds):
        if _are_stars(e):
            break
        last, e = e, scratch.keep(contract(_round(e)))
        scratch.drop(last)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
