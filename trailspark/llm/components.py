"""Connected components of an edge table by alternating stars.

Large-star links every larger neighbour of a node to the node's smallest
neighbour; small-star links a node and its smaller neighbours to the smallest of
them. Both are an aggregation and a ``lookup`` of the node, which keeps nodes of
very many edges out of the shuffle, so a hub's neighbours are never gathered in
one place. The rounds end when the edges no longer change; then every node is
linked to its component's smallest node. Each star is written to shared storage,
which cuts its lineage, and what it was made from is deleted: planned as one query,
a round reads its edges a hundred times over in the plan, and the driver holds that.

Before the first round and after each, every task replaces the edges it holds, a
bounded number at a time, by a tree of two levels for each component among them.
That ties the same nodes, never raises a node's smallest neighbour and leaves
finished stars alone, so the rounds end as without it but sooner.

Defined results: edges from a node to itself and edges with a null end count for
nothing; repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, lookup, settle

#: A task ties so many edges at a time.
EDGES = 1 << 20


def tie(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): each node of these edges but the smallest of its component among them, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(left):
        # roots point at the smallest root that an edge leads to, then nodes at the ends of their paths
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(further := root[root], root):
            root = further
        left, right = root[left], root[right]
        open_ = left != right
        left, right = left[open_], right[open_]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _tied(batches):
    """Edges as trees of two levels, of at most EDGES and a batch at a time."""

    def out():
        node, root = tie(*(np.concatenate([x[c] for x in held]) for c in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    held, n = [], 0
    for x in batches:
        held.append([x.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        n += x.num_rows
        if n >= EDGES:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _state(edges: DataFrame) -> tuple[int, int]:
    # xor does not overflow, and only a round that is not the last can hold an edge twice
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def _rows(*pairs: tuple[str, str]) -> Column:
    """Rows (a, b) of these columns, from one reading of what they stand in."""
    return F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """Edges with the smallest b of their a."""
    least = edges.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    return lookup(edges, least, {"a": "m_a"}, "degree", most, "inner").select("a", "b", "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(_rows(("a", "b"), ("b", "a")))
    return _with_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tied = _with_least(down, n)
    return tied.select(_rows(("a", "m"), ("b", "m"))).where("a <> b").distinct()


def _in_tasks(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_tied, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge, but the roots themselves; edges: columns a, b of long."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.table(_in_tasks(_in_tasks(edges.where("a <> b").select("a", "b")).distinct()), "round0")
    before = _state(now)
    for i in range(1, rounds + 1):
        if not before[0]:
            break
        # a star has no more edges than what it is made from
        large = scratch.table(_large_star(now, before[0]), f"large{i}")
        now = scratch.table(_in_tasks(_small_star(large, 2 * before[0])), f"round{i}")
        scratch.drop(f"round{i - 1}", f"large{i}")
        settle(edges.sparkSession)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
