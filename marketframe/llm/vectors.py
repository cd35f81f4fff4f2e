"""Vectors as whole numbers: what may take part, and its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(column: pa.ListArray, scale: int, limit: float) -> list[np.ndarray | None]:
    """floor(scale * x) of every component, as long; None for a null vector, and for one with a null, a non-finite component, or one whose
    scaled magnitude reaches ``limit`` (beyond which whole numbers could not be kept exact)."""
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values * scale)
        bad = ~(np.abs(whole) < limit)
    before = np.concatenate([[0], np.cumsum(bad)])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    ints = np.where(bad, 0, whole).astype(np.int64)
    return [ints[a:b] if ok and before[b] == before[a] else None for a, b, ok in zip(off[:-1], off[1:], there, strict=True)]


def int_vectors(df: DataFrame, others: dict[str, Column], vector: Column, *, scale: int, limit: float, kind: str, offset: int = 0, norm: float = np.inf) -> DataFrame:
    """The columns ``others``, size and vec (the scaled components plus ``offset`` as little-endian numbers of the numpy type ``kind``)
    of each row whose vector can take part (see ``scaled``) and has a squared norm below ``norm``; the other rows are left out."""
    shaped = df.select(*(c.alias(n) for n, c in others.items()), vector.cast("array<double>").alias("vector"))
    names, schema = list(others), shaped.select(*others, F.lit(0).cast("int").alias("size"), F.lit(b"").alias("vec")).schema

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [v if v is not None and (v.astype(np.float64) ** 2).sum() < norm else None for v in scaled(b.column("vector"), scale, limit)]
            keep = b.filter(pa.array([v is not None for v in found], pa.bool_()))
            good = [v + offset for v in found if v is not None]
            arrays = [keep.column(n) for n in names] + [pa.array([len(v) for v in good], pa.int32()), pa.array([v.astype(kind).tobytes() for v in good], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "size", "vec"])

    return shaped.where("vector is not null").mapInArrow(convert, schema)
