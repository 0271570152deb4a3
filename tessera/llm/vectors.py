"""Vectors as whole numbers: what operators on embeddings have in common."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def narrow(d: int) -> int:
    """The largest size at which d numbers, each four times that size, can be squared and summed as 64-bit numbers."""
    return math.isqrt((1 << 62) // (16 * d))


def whole(rows: DataFrame, scale: int, *keep: str) -> tuple[DataFrame, int, bool]:
    """(columns ``keep`` and x: the floors of scale * entry; length of x; whether some |x| passes ``narrow``).

    A row goes if its vector is null, or holds a null, NaN or infinite entry. A
    vector shorter than the longest of these lacks entries, and goes too. A floor
    beyond the range of a long is the end of that range.
    """
    c = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    x = F.transform(c, lambda v: F.floor(v * scale))
    kept = rows.where(sound).select(*keep, x.alias("x"))
    far = kept.agg(F.max(F.size("x")).alias("d"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    d = far["d"] or 0
    wide = d > 0 and max(-far["low"], far["high"]) > narrow(d)
    return kept.where(F.size("x") == d), d, wide


def matrix(column: pa.Array, d: int, wide: bool) -> np.ndarray:
    """An Arrow column of equally long lists of longs as rows of a matrix; of Python's numbers if wide."""
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return m.astype(object) if wide else m
