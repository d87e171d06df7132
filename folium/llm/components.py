"""Connected components of a graph in DataFrames: tasks contract the edges they read to stars; what is left of a small graph is labelled
by one task, of a large one by smallest labels that spread along edges, with pointer jumping.

Defined results: repeated edges count once, loops (a = b) give no node, an empty graph gives no rows; edges with a null end are
left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, prepare, written

#: Edges that a task contracts at once (16 MB); a graph of more contracted edges is labelled in rounds.
EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := up[up], up):
            up = above
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def contracted(edges: DataFrame, most: int, whole: bool = False) -> DataFrame:
    """(a, b): edges that connect the same nodes as edges (a, b) do, a star for each component of what a task holds: at most twice
    ``most`` edges at once.  whole: a task holds all it reads, and each star has its smallest node with itself too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def closed() -> tuple[np.ndarray, np.ndarray]:
            a, b = stars(*(np.concatenate(c) for c in zip(*held)))
            return (a, b) if whole else (a[a != b], b[a != b])

        def rows(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size >= 2 * most and not whole:
                held = [closed()]
                size = len(held[0][0])
                if size >= most:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*closed())

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, scratch: Scratch | None = None, most: int | None = None) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node it is connected to.  The result is a table of scratch, if given.

    The edges are read once and contracted where they are.  Where at most ``most`` edges are left, one task has the labels.  A larger
    graph takes rounds.  A round takes the smallest label next to each node; from the third round on labels jump to the labels of
    their labels as well, so that rounds are about the logarithm of the longest shortest path, while near stars, which end sooner, take
    cheaper rounds.  Each round is written to the shared folder and the one before deleted.  Minima are taken before rows are dealt,
    and joins on labels and nodes read written tables, so a node with very many edges is split."""
    prepare(edges.sparkSession)
    most = EDGES if most is None else most
    keep = scratch.written if scratch else written
    with Scratch(edges.sparkSession) as own:
        edges, left = own.counted(contracted(edges.where("a <> b"), max(most, 1)), "stars", F.lit(True))
        if left <= most:
            return keep(contracted(edges.coalesce(1), most, whole=True).toDF("node", "label"), "components")
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both = own.written(both, "edges")
        labels = own.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
        rounds = 0
        while True:
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
            step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            step, changed = own.counted(step, "labels", F.col("label") != F.col("old"))
            own.done(labels)
            labels, rounds = step, rounds + 1
            if not changed:
                return keep(labels.select("node", "label"), "components")
            if rounds >= 3:
                up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
                labels = own.written(labels.join(up, F.col("label") == F.col("up"), "left").select("node", F.least("label", "above").alias("label")), "labels")
                own.done(step)
