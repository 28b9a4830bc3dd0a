"""Connected components of a large undirected graph given as an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.runtime import forget, saved

LOCAL_EDGES = 1_000_000  # below this many edges one task finishes the job; its memory is bounded by it


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for edges between nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def _finish(batches):
    """One task over all remaining edges; it streams out (id, root)."""
    a, b, kind = [], [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        a.append(batch.column(0))
        b.append(batch.column(1))
    if not a:
        return
    ends = pa.chunked_array([*a, *b])
    n_edges = sum(map(len, a))
    codes = ends.combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    import pyarrow.compute as pc

    order = pc.sort_indices(codes.dictionary).to_numpy()  # so that code order is id order
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    code = rank[codes.indices.to_numpy()]
    names = codes.dictionary.take(pa.array(order))
    root = roots(code[:n_edges], code[n_edges:], len(order))
    for at in range(0, len(order), 50_000):
        yield pa.record_batch([names.slice(at, 50_000).cast(kind), names.take(pa.array(root[at : at + 50_000])).cast(kind)], names=["id", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, root) of every node in ``edges``; root is the smallest id of its component.

    While there are more than ``local_edges`` edges, the graph is contracted: each node points to its
    smallest neighbour if that is smaller, pointers are followed to their ends by repeated self-joins,
    and the edges are rewritten between those ends. Contraction at least halves the nodes that still
    have an edge. The rest, bounded by ``local_edges``, is finished by union-find in one task.
    Nulls and self-loops: a null end drops the edge; a self-loop makes a component of one.
    No edges give no rows.
    """
    kind = edges.schema[a].dataType.simpleString()
    e = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    pointers: list[DataFrame] = []
    while e.limit(local_edges + 1).count() > local_edges:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "up")
        while True:
            q = p.alias("x").join(p.select(F.col("id").alias("up"), F.col("up").alias("top")).alias("y"), "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            q = saved(q, "up")
            done = q.where("moved").isEmpty()
            forget(p)
            p = q.drop("moved")
            p._stratum_path = q._stratum_path  # type: ignore[attr-defined]
            if done:
                break
        up = p.select("id", "up")
        new = e.join(up.withColumnRenamed("id", "a"), "a").select(F.col("up").alias("u"), "b").join(up.withColumnRenamed("id", "b"), "b").select(F.least("u", "up").alias("a"), F.greatest("u", "up").alias("b")).where("a <> b").distinct()
        new = saved(new, "edges")
        forget(e)
        e = new
        pointers.append(up)
    rest = e.coalesce(1).mapInArrow(_finish, f"id {kind}, root {kind}")
    if not pointers:
        return rest
    rest = saved(rest, "rest")
    for up in reversed(pointers):
        rest = up.join(rest.select(F.col("id").alias("up"), "root"), "up", "left").select("id", F.coalesce("root", "up").alias("root"))
    return rest
