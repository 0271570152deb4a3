"""Reciprocal-rank fusion of retrieval signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import intervals

RANK_OFFSET = 60


def ranked_signal(top: DataFrame, order: list, signal: str, weight: float, base: float = 0.0) -> DataFrame:
    """chunk_id, signal, part of a bounded ranking: base + weight / (60 + rank)."""
    rank = F.row_number().over(Window.orderBy(*order))  # ``top`` is a limited list
    return top.select("chunk_id", F.lit(signal).alias("signal"), (F.lit(base) + F.lit(weight) / (RANK_OFFSET + rank)).alias("part"))


def symbol_signal(found: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """chunk_id, signal, part of the first ``limit`` chunks that each found definition overlaps: 1 + 1 / (60 + its rank).

    found (a bounded list): entity_id, file_id, own (its span), reason, rank. A
    definition that overlaps no chunk gives nothing.
    """
    both = intervals.overlap_join(found, chunks.select("chunk_id", "file_id", "span"), ["file_id"], intervals.ends(F.col("own")), intervals.ends(F.col("span")))
    turn = F.row_number().over(Window.partitionBy("entity_id").orderBy("span", "chunk_id"))
    part = F.lit(1.0) + F.lit(1.0) / (RANK_OFFSET + F.col("rank"))
    return both.withColumn("turn", turn).where(F.col("turn") <= limit).select("chunk_id", F.col("reason").alias("signal"), part.alias("part"))


def fuse(signals: DataFrame) -> DataFrame:
    """chunk_id, score (parts summed in a fixed order), reason (signal names)."""
    parts = F.array_sort(F.collect_list(F.struct("signal", "part")))
    got = signals.groupBy("chunk_id").agg(parts.alias("p"))
    return got.select("chunk_id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("score"), F.array_join(F.array_distinct("p.signal"), "+").alias("reason"))


def first_details(signals: DataFrame, most: int = 4) -> DataFrame:
    """chunk_id, details: of rows (chunk_id, seq, detail) the first details in the order in which they were found.

    Only the first ``most`` rows of a chunk are gathered.
    """
    turn = F.row_number().over(Window.partitionBy("chunk_id").orderBy("seq", "detail"))
    few = signals.select("chunk_id", "seq", "detail", turn.alias("turn")).where(F.col("turn") <= most)
    rows = F.array_sort(F.collect_list(F.struct("turn", "detail")))
    return few.groupBy("chunk_id").agg(F.transform(rows, lambda x: x["detail"]).alias("details"))


def expression(terms: Column) -> Column:
    """A match expression: one quoted term, or the quoted phrase OR any of its terms."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    phrase = F.concat(F.lit('"'), F.array_join(terms, " "), F.lit('"'))
    return F.when(F.size(terms) < 2, F.array_join(quoted, "")).otherwise(F.concat(phrase, F.lit(" OR ("), F.array_join(quoted, " OR "), F.lit(")")))
