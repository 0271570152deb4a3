"""Interval joins by bins of the intervals' own size.

An interval of length n lies in at most two bins of a power of two that is not
under n. Of two that overlap, both lie in at most two bins of the larger one's
size, and share one of these: so the larger keeps to its own size and the smaller
one goes to each size that occurs. Sizes are powers of 64, so that few occur and
rows are moved about once; where bins of that size hold so many rows that most of
what meets is no pair, they are powers of two. Work follows the intervals and the
pairs there are, not their product, however many lie in one group or however long
some are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position(line: Column, col: Column) -> Column:
    """A point of a text as one long, in the order of points."""
    return F.shiftleft(line.cast("long"), 32) + col.cast("long")


def ends(span: Column) -> tuple[Column, Column]:
    return position(span["start_line"], span["start_col"]), position(span["end_line"], span["end_col"])


#: Steps between the sizes of bins, coarse and fine, and how many rows may meet in coarse bins, for each row that is moved.
COARSE, FINE, MEETINGS = 6, 1, 64


def _size(start: Column, end: Column, step: int) -> Column:
    """The power of two of an interval's bins, a multiple of the step."""
    n = end - start
    bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.least(F.greatest(F.ceil(bits / step), F.lit(1)) * step, F.lit(63)).cast("int")


def _bins(rows: DataFrame, start: str, end: str, size: str) -> DataFrame:
    last = f"shiftright(greatest({end} - 1, {start}), {size})"
    return rows.withColumn("_bin", F.explode(F.expr(f"sequence(shiftright({start}, {size}), {last})")))


def _sizes(rows: DataFrame, size: str) -> list[int]:
    return sorted(r[0] for r in rows.select(size).distinct().collect())  # powers of two of a long: 64 at most


def _ways(left: DataFrame, right: DataFrame, step: int) -> list[tuple[DataFrame, DataFrame, Column]]:
    """Which rows meet on ``_size`` and ``_bin``: those of the larger intervals, of the smaller ones, and the one bin of a pair."""
    left, right = left.withColumn("_s", _size(F.col("_a"), F.col("_b"), step)), right.withColumn("_t", _size(F.col("_c"), F.col("_d"), step))
    of_left, of_right = _sizes(left, "_s"), _sizes(right, "_t")
    out = []
    for large, small, at_large, at_small, sizes, others, equal in (
        (right, left, ("_c", "_d", "_t"), ("_a", "_b", "_s"), of_right, of_left, True),
        (left, right, ("_a", "_b", "_s"), ("_c", "_d", "_t"), of_left, of_right, False),
    ):
        sizes = [s for s in sizes if others and (s > others[0] or equal and s == others[0])]  # nothing is smaller than the others
        if not sizes:
            continue
        every, least = F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), F.col(at_small[2])
        own = _bins(large.where(F.col(at_large[2]).isin(sizes)).withColumn("_size", F.col(at_large[2])), *at_large[:2], "_size")
        met = _bins(small.withColumn("_size", F.explode(F.filter(every, lambda s: s >= least if equal else s > least))), *at_small[:2], "_size")
        out.append((own.drop(at_large[2]), met.drop(at_small[2]), F.expr(f"shiftright(greatest({at_large[0]}, {at_small[0]}), _size)")))
    return out


def _crowded(ways: list, by: list[str]) -> bool:
    """Whether more rows meet in bins than MEETINGS for each row; bins are counted by a hash, in each task first."""
    sides = [rows.select(F.xxhash64(*by, "_size", "_bin", F.lit(i)).alias("k"), F.lit(1 - k).alias("x"), F.lit(k).alias("y")) for i, (own, met, _) in enumerate(ways) for k, rows in enumerate((own, met))]
    each = reduce(DataFrame.unionAll, sides).groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    met, moved = each.agg(F.sum(F.col("x").cast("double") * F.col("y")), F.sum(F.col("x") + F.col("y"))).first()
    return (met or 0) > MEETINGS * (moved or 0)


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], a_ends: tuple[Column, Column], b_ends: tuple[Column, Column]) -> DataFrame:
    """The pairs of rows of a and b, equal on ``by``, whose half-open intervals share a place; each pair once.

    The two have no other column in common. An empty interval shares its place
    with those that hold it strictly inside. Rows without an end have no pairs.
    """
    left = a.withColumns({"_a": a_ends[0].cast("long"), "_b": a_ends[1].cast("long")}).where("_a <= _b")
    right = b.withColumns({"_c": b_ends[0].cast("long"), "_d": b_ends[1].cast("long")}).where("_c <= _d")
    columns = [*by, *[c for c in a.columns if c not in by], *[c for c in b.columns if c not in by]]
    ways = _ways(left, right, COARSE)
    if not ways:
        return left.join(right.where("false"), by).select(*columns)
    if _crowded(ways, by):
        ways = _ways(left, right, FINE)
    pairs = [own.join(met, [*by, "_size", "_bin"]).where((F.col("_bin") == first) & (F.col("_a") < F.col("_d")) & (F.col("_b") > F.col("_c"))).select(*columns) for own, met, first in ways]
    return reduce(DataFrame.unionByName, pairs)
