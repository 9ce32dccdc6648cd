"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinweave.workspace import Workspace

#: Up to so many edges, two ids each, are settled in one task.
ONE_TASK = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least.hint("merge"), "u").where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def _labelled(parts: list[pa.Table]) -> tuple[pa.Array, np.ndarray]:
    """The nodes of some edges in their order, and the place of the least one that each reaches."""
    whole = pa.concat_tables(parts)
    kind, n = whole["u"].type, whole.num_rows
    wide = pa.large_string() if kind == pa.string() else kind  # offsets of many texts may need more than 32 bits
    ends = pa.concat_arrays([chunk.cast(wide) for c in whole.columns for chunk in c.chunks]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[ends.indices.to_numpy()]
    return ends.dictionary.take(pa.array(order)).cast(kind), _labels(code[:n], code[n:], len(order))


def _settled(batches):
    parts = [pa.table({"u": b.column(0), "v": b.column(1)}) for b in batches if b.num_rows]
    if parts:
        nodes, label = _labelled(parts)
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])


def _forest(batches):
    """Edges that connect what each ONE_TASK edges of a task connect: fewer than these have nodes."""
    def stars(parts):
        nodes, label = _labelled(parts)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], ["u", "v"])

    parts, n = [], 0
    for b in batches:
        if b.num_rows:
            parts.append(pa.table({"u": b.column(0), "v": b.column(1)}))
            n += b.num_rows
        if n >= ONE_TASK:
            yield stars(parts)
            parts, n = [], 0
    if parts:
        yield stars(parts)


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the least node it can reach.

    Returns ``(node, component)`` for nodes that have an edge; loops are ignored. At most
    ONE_TASK edges of whole numbers or texts are settled in a single task. Of more, each task
    first leaves a forest of its own, so very many edges among few nodes become few. What is
    still more goes through rounds of contraction: minima are aggregated before they are joined back, so a node with
    very many neighbours is no single group; nor are they broadcast. Each round is written to the shared folder, and
    rounds grow with the logarithm of the component size.
    """
    current = work.table(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges-0",
    )
    kind = current.schema["u"].dataType.simpleString()
    if kind in ("bigint", "string"):
        if (n := current.count()) > ONE_TASK:
            trees = current.hint("rebalance", "v").mapInArrow(_forest, f"u {kind}, v {kind}")
            current = work.table(trees, "forest")
            n = current.count()
        if n <= ONE_TASK:
            return work.table(current.coalesce(1).mapInArrow(_settled, f"node {kind}, component {kind}"), "settled")
    mark = None
    for k in range(1, max_rounds + 1):
        nxt = work.table(_small_star(work.table(_large_star(current), "large")), f"edges-{k}")
        new_mark = tuple(
            nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        work.remove(f"edges-{k - 1}")
        current = nxt
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(current.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
