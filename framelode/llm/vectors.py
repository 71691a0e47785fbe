"""Vectors as bytes, for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, dim, vec, *more): rows with an id and a vector without null or non-finite components that isn't zero.

    ``vec`` has the components as little-endian doubles, which hold floats exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            size = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()])
            end = np.cumsum(size)
            fine, vecs = [], []
            for k, (a, b) in enumerate(zip(end - size, end, strict=True)):
                v = flat[a:b]
                if len(v) and np.isfinite(v).all() and v.any():
                    fine.append(k)
                    vecs.append(v.astype("<f8").tobytes())
            kept = batch.take(pa.array(fine, pa.int64()))
            dims = pa.array([len(v) // 8 for v in vecs], pa.int32())
            yield pa.RecordBatch.from_arrays([kept.column(0), dims, pa.array(vecs, pa.binary()), *kept.columns[2:]], names=["id", "dim", "vec", *more])

    kinds = dict(df.dtypes)
    chosen = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)
    return chosen.mapInArrow(run, ", ".join(["id long, dim int, vec binary", *(f"`{m}` {kinds[m]}" for m in more)]))


def matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype="<f8").reshape(len(vecs), -1)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows, none of them zero, times powers of two that bring their largest components near 1, so that no square overflows or vanishes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
