"""Pairs of like strings by pigeonhole segments, and connected components, both without a driver's help."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from .edits import typos


def within_one_edit(words: DataFrame, block: list[str], word: str) -> DataFrame:
    """(``block``..., ``a``, ``b``), a < b: different words of the same block within one edit, a swap of neighbours counting as one.

    Method: pigeonhole segment join for k = 1.  Each word is cut into k+1 = 2 segments that
    go into an inverted index under the word's length.  One edit leaves one segment
    whole, so a word looks up, for its own length and the one below, its beginning and
    its end, where a whole segment would be found at its shifted position; a swap across
    the border of the segments is looked up with the two characters put back.  What
    comes together is verified with a banded edit distance.
    """
    base = words.select(*block, F.col(word).alias("w")).filter(F.length("w") >= 2).distinct()
    n, half = F.length("w"), F.floor(F.length("w") / 2).cast("int")

    def entry(length, part, segment):
        return F.struct(length.cast("int").alias("len"), F.lit(part).alias("part"), segment.alias("segment"))

    index = base.select(*block, F.col("w").alias("a"), F.explode(F.array(entry(n, 0, F.substring("w", F.lit(1), half)), entry(n, 1, F.substring("w", half + 1, n)))).alias("e"))
    less, low = n - 1, F.floor((n - 1) / 2).cast("int")
    swapped = F.concat(F.substring("w", F.lit(1), half - 1), F.substring("w", half + 1, F.lit(1)), F.substring("w", half, F.lit(1)), F.substring("w", half + 2, n))
    probes = F.array(
        entry(n, 0, F.substring("w", F.lit(1), half)), entry(n, 1, F.substring("w", half + 1, n)), entry(n, 0, F.substring(swapped, F.lit(1), half)),
        entry(less, 0, F.substring("w", F.lit(1), low)), entry(less, 1, F.substring("w", n - less + low + 1, n)),
    )
    asked = base.select(*block, F.col("w").alias("b"), F.explode(probes).alias("e"))
    pairs = index.join(asked, [*block, "e"]).filter("a <> b").select(*block, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[[typos(a, b, 1) <= 1 for a, b in zip(p["a"], p["b"])]]

    return pairs.mapInPandas(verify, pairs.schema)


def star(rows: DataFrame, *keys: str) -> DataFrame:
    """Edges (a, b) from the least id of equal keys to the others; null keys link nothing."""
    some = rows.dropna(subset=list(keys)).select(*keys, "id")
    least = some.groupBy(*keys).agg(F.min("id").alias("a"), F.max("id").alias("_last")).filter("a < _last").drop("_last")
    return some.join(least, list(keys)).filter("id <> a").select("a", F.col("id").alias("b")).distinct()


#: Edges up to which components are found in one task; of more in rounds.
ONE_TASK_EDGES = 500_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(n, root) of a bounded number of edges (a, b) by union-find."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]  # paths are halved
                x = up
            return x

        for part in parts:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, edge_type), pa.array([root(n) for n in nodes], edge_type)], names=["n", "root"])

    edge_type = pa.string() if kind == "string" else pa.int64()
    return edges.select("a", "b").repartition(1).mapInArrow(run, f"n {kind}, root {kind}")


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(``node``, ``root``): the least node that each node is connected with; ``edges`` has columns a and b (longs or strings).

    Up to ONE_TASK_EDGES edges are joined in one task.  Of more, least labels spread over
    the edges and over their own labels (so paths shrink by half a round), each round
    written to a table and the one before it dropped; only whether a round changed
    something goes to the driver, and rounds go on until none does.  Nodes without edges
    are their own root.
    """
    given = cut(edges.select("a", "b").filter("a <> b"), "edges")
    if given.count() <= ONE_TASK_EDGES:
        labels = cut(_in_one_task(given), "labels")
        return nodes.join(labels.select(F.col("n").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))
    both = cut(given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    changed = True
    while changed:
        near = both.join(labels.select(F.col("n").alias("b"), F.col("root").alias("_r")), "b").groupBy(F.col("a").alias("n")).agg(F.min("_r").alias("_near"))
        step = labels.join(near, "n").select("n", F.col("root").alias("_old"), F.least("root", "_near").alias("_new"))
        jump = labels.select(F.col("n").alias("_new"), F.col("root").alias("_far"))
        step = step.join(jump, "_new", "left").select("n", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("root"))
        step = cut(step, "labels")
        changed = step.filter("_old <> root").limit(1).count()
        labels, before = step.select("n", "root"), labels
        drop(before)
    drop(both)
    return nodes.join(labels.select(F.col("n").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))
