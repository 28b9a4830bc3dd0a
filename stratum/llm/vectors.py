"""Vectors as compact blobs: validation, scaling to unit length and collapsing of equal directions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 120


def usable(df: DataFrame, enc: str = "enc", dim: int = DIM) -> DataFrame:
    """Rows whose vector has ``dim`` components, all finite, not all zero."""
    ok = f"{enc} is not null and size({enc}) = {dim} and forall({enc}, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists({enc}, x -> x <> 0)"
    return df.where(ok)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that the squares of huge components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fixed_point(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as integers of ``bits`` bits and the size of one step per vector."""
    top = float(2 ** (bits - 1) - 1)
    step = np.abs(u).max(1) / top
    return np.rint(u / step[:, None]).astype(np.int8 if bits == 8 else np.int16), step.astype(np.float32)


def blobs(q: np.ndarray) -> pa.Array:
    width = q.shape[1] * q.itemsize
    data = np.ascontiguousarray(q).tobytes()
    offsets = np.arange(len(q) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def floats(column: pa.Array, bits: int, dim: int) -> np.ndarray:
    """Blobs back to float32 vectors of unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8 if bits == 8 else np.int16).reshape(-1, dim).astype(np.float32)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Exact cosine of two array columns, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def encoded(df: DataFrame, bits: int, keep: list[str], dim: int = DIM) -> DataFrame:
    """(keep..., q binary): usable vectors at ``bits`` bits a component; equal directions have equal q."""
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for b in batches:
            q, _ = fixed_point(units(matrix(b.column(len(keep)), dim)), bits) if b.num_rows else (np.zeros((0, dim), np.int16), None)
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), blobs(q)], names=[*keep, "q"])

    return usable(df).select(*keep, F.col("enc").cast("array<double>").alias("enc")).mapInArrow(run, ", ".join(f"{k} {schema[k]}" for k in keep) + ", q binary")


def whole_partition(batches) -> pa.Table | None:
    """All batches of a partition; its size is set by an explicit number of partitions."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None
