"""Connected components of an edge table: parts of bounded size are contracted each in a task, and alternating large and
small stars join what the parts have in common. Nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


#: Nodes with more neighbours than this, and than a share of all edges, are joined by broadcast: there are at most 2 * SHARE of them.
HUB, SHARE = 1_000, 100_000
#: Edges that one task contracts, of 16 bytes.
CONTRACT = 1_000_000


def _stars(pairs: DataFrame, size: int) -> DataFrame:
    """pairs (u, v), at most `size`: links u's neighbours v to the smallest of u and its neighbours.

    The neighbours of a hub are never brought into one task: hubs are few by their degree, so they travel to the pairs.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    hub = F.col("degree") > max(HUB, size // SHARE)
    hubs = least.where(hub).select(F.col("u").alias("h"), F.col("m").alias("hm"))
    marked = pairs.join(F.broadcast(hubs), pairs["u"] == hubs["h"], "left")
    near = marked.where("h is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u").select("u", "v", "m")
    return near.unionAll(marked.where("h is not null").select("u", "v", F.col("hm").alias("m")))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and, for each, the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]


def _contracted(e: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) with the same components: in each of `parts` parts, every node is linked to the smallest that it reaches there."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, roots = _roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            on = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(roots[on])], names=["u", "v"])

    dealt = e.repartition(parts) if parts == 1 else e.repartition(parts, F.xxhash64("v"))
    return dealt.mapInArrow(contract, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, label) for every node that has an edge to another; label is the smallest node of its component. Nodes are longs.

    Every round contracts parts of at most CONTRACT edges or so, then either shortens the paths to the smallest node or
    leaves the edges as they are, which ends the work; the number of rounds grows with the logarithm of the longest path.
    Rounds are kept in the shared folder. Null ends and loops are no edges. No edges give no rows. Running out of rounds is
    an error, never a partial answer.
    """
    e = kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        count = e.count()
        parts = -(-count // CONTRACT)
        if parts > 1:
            size = 2 * count  # no step of the round has more pairs
            e = _contracted(e, parts).distinct()
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _stars(both, size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small = _stars(large, size)  # its v are all smaller than u
            e = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        elif parts == 1:
            e = kept(_contracted(e, 1))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or parts < 2:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(e.select(F.col("v"), F.col("v")).distinct())
        seen = now
    raise RuntimeError(f"components not found in {rounds} rounds")
