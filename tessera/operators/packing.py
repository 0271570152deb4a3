"""Packing winners into a byte budget: exact-text aliases, greedy choice with skipping, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_aliases(rows: DataFrame, by: list[str], order: list[str], text: str = "content", name: str = "rel_path") -> DataFrame:
    """The first row of each text in each group, with the sorted names of the others."""
    key = F.sha2(F.col(text).cast("binary"), 256)
    first = F.min(F.struct(*order, F.col(name).alias("_name")))
    got = rows.groupBy(*by, key.alias("source_sha256")).agg(first.alias("first"), F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("_name")))).alias("every"))
    return got.select(*by, "source_sha256", F.col("first._name").alias(name), F.transform(F.slice("every", 2, F.greatest(F.size("every") - 1, F.lit(1))), lambda x: x["_name"]).alias("aliases"))


def greedy(items: Column, budget: int, limit: int) -> Column:
    """Ids taken from an ordered array of (id, size): each that still fits, up to ``limit``; later smaller ones may."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))
    step = lambda acc, x: F.when((acc["used"] + x["size"] <= budget) & (F.size(acc["taken"]) < limit), F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["taken"], F.array(x["id"])).alias("taken"))).otherwise(acc)
    return F.aggregate(items, state, step)


def pack(rows: DataFrame, by: list[str], order: list[str], id_col: str, size: Column, budget: int, limit: int, candidates: int = 32) -> DataFrame:
    """Of each group: used bytes, taken ids in order, counts left out by budget and by limit, status.

    At most ``candidates`` rows a group are gathered, by rank.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= candidates)
    item = F.struct(F.col("_rank").alias("rank"), F.col(id_col).cast("string").alias("id"), size.cast("long").alias("size"))
    lists = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    done = lists.withColumn("p", greedy(F.col("items"), budget, limit))
    taken, n = F.col("p.taken"), F.size("items")
    left = n - F.size(taken)
    full = F.size(taken) >= limit
    return done.select(*by, F.col("p.used").alias("used"), taken.alias("taken"), F.when(full, 0).otherwise(left).alias("omitted_budget"), F.when(full, left).otherwise(0).alias("omitted_limit"), F.when(n == 0, "EMPTY").when(F.size(taken) == 0, "BUDGET_EXHAUSTED").otherwise("OK").alias("status"))


def coverage(pieces: DataFrame, by: list[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Whether the pieces [start, end) cover [low, high) of their group without a gap."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = pieces.withColumn("_gap", F.col(start) > F.coalesce(before, low))
    return gap.groupBy(*by).agg((~F.bool_or("_gap") & (F.max(end) >= F.max(high))).alias("complete"))
