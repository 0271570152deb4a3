"""Source spans: lines from 1, columns in UTF-8 bytes from 0, end exclusive; only LF ends a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


TYPE = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"


def span(start_line, start_col, end_line, end_col) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(start_line).cast("int").alias("start_line"), lit(start_col).cast("int").alias("start_col"), lit(end_line).cast("int").alias("end_line"), lit(end_col).cast("int").alias("end_col"))


def start(s: Column) -> Column:
    return F.struct(s["start_line"].alias("l"), s["start_col"].alias("c"))


def end(s: Column) -> Column:
    return F.struct(s["end_line"].alias("l"), s["end_col"].alias("c"))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intervals that share a byte."""
    return (start(a) < end(b)) & (end(a) > start(b))


def contains_start(outer: Column, inner: Column) -> Column:
    return (start(outer) <= start(inner)) & (start(inner) < end(outer))


def valid(s: Column) -> Column:
    return F.coalesce((s["start_line"] >= 1) & (s["start_col"] >= 0) & (s["end_col"] >= 0) & (start(s) <= end(s)), F.lit(False))


def whole(text: Column) -> Column:
    """The span of a text that begins a file."""
    return of(text, F.lit(1), F.lit(0))


def of(text: Column, line: Column, col: Column) -> Column:
    """The span of literal text that begins at (line, col)."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    tail = F.octet_length(F.substring_index(text, "\n", -1))
    return span(line, col, line + breaks, F.when(breaks == 0, col + tail).otherwise(tail))
