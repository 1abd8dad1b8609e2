"""Connected components: distributed union-find, local forests merged level by level.

Every task joins the edges of its partition into a local forest and passes on only (node, root). A node that
several forests know links their roots; these links, far fewer, are the edges of the next level, in fewer
partitions. Only when the links are few does one task take them all. Node ids must be hash values: in random
order every level removes a constant share of the nodes of any graph, so the number of levels is logarithmic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

FOREST_EDGES = 1_000_000  #: edges held by a task before it passes on a forest (about 100 MB)
LAST_EDGES = 400_000  #: so many links at most go to one task


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of the edges u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def forests(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Forests of bounded parts of a partition, as rows (node, root); roots have a row too."""
    held, n = [], 0
    for u, v in batches:
        held.append((u, v))
        n += len(u)
        if n >= FOREST_EDGES:
            # the forest so far stays as edges, so one partition mostly gives one forest
            nodes, roots = forest(*(np.concatenate(x) for x in zip(*held)))
            held, n = [(nodes, roots)], len(nodes)
            if n >= FOREST_EDGES // 2:
                yield _rows(nodes, roots)
                held, n = [], 0
    if held:
        yield _rows(*forest(*(np.concatenate(x) for x in zip(*held))))


def _rows(nodes: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def edge_forests(edges: DataFrame) -> DataFrame:
    """(node, root) of the local forests of a table of edges (its first two columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from forests((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)

    return edges.mapInArrow(run, "node bigint, root bigint")


def merge_forests(local: DataFrame, partitions: int, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, root): one row a node, equal roots within a component, from local forests (node, root).

    A node may be in any number of forests (as many as there are tasks), each with one row for it. The result
    of an empty table is empty.
    """
    maps: list[DataFrame] = []
    level = local
    while True:  # every level leaves a node fewer at least, on hash values a share of them
        by_node = Window.partitionBy("node")
        seen = cut(level.withColumn("up", F.min("root").over(by_node)), "forest")
        maps.append(seen.select("node", F.col("up").alias("root")).distinct())
        links = seen.where(F.col("root") != F.col("up")).select("root", "up").distinct()
        links = cut(links, "links")
        n = links.count()
        if n == 0:
            break
        partitions = 1 if n <= last_edges else max(2, partitions // 4, n // FOREST_EDGES)
        spread = links.coalesce(1) if partitions == 1 else links.repartition(partitions, "root", "up")
        level = edge_forests(spread)
    out = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        out = out.join(up, out["root"] == up["__n"], "left").select("node", F.coalesce("__r", "root").alias("root"))
    return out


def connected_components(edges: DataFrame, partitions: int = 64, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, root) for all nodes of the edges (first two columns, bigint hash values)."""
    return merge_forests(edge_forests(edges), partitions, last_edges)
