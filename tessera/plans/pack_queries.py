"""Packing, deduplication, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.operators import packing
from tessera.plans import model
from tessera.plans.registry import query

_GREEDY = """, items AS (SELECT generation_id, rel_path, size_bytes, row_number() OVER (PARTITION BY generation_id ORDER BY rel_path) AS rank FROM files QUALIFY rank <= 32),
fold AS (
  SELECT generation_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS taken FROM (SELECT DISTINCT generation_id FROM files)
  UNION ALL
  SELECT f.generation_id, i.rank, CASE WHEN f.used + i.size_bytes <= 8192 AND len(f.taken) < 5 THEN f.used + i.size_bytes ELSE f.used END,
         CASE WHEN f.used + i.size_bytes <= 8192 AND len(f.taken) < 5 THEN list_append(f.taken, i.rel_path) ELSE f.taken END
  FROM fold f JOIN items i ON i.generation_id = f.generation_id AND i.rank = f.rank + 1
), done AS (SELECT *, (SELECT count(*) FROM items i WHERE i.generation_id = fold.generation_id) AS n FROM fold QUALIFY row_number() OVER (PARTITION BY generation_id ORDER BY rank DESC) = 1)"""


def _packed(spark, d):
    return packing.pack(model.files(spark, d), ["generation_id"], ["rel_path"], "rel_path", F.col("size_bytes"), 8192, 5)


@query("greedy_pack", _GREEDY + " SELECT generation_id, used, array_to_string(taken, '|') AS taken FROM done")
def greedy_pack(spark, d):
    return _packed(spark, d).select("generation_id", "used", F.array_join("taken", "|").alias("taken"))


@query("pack_status", _GREEDY + " SELECT generation_id, CAST(CASE WHEN len(taken) >= 5 THEN 0 ELSE n - len(taken) END AS INTEGER) AS omitted_budget, CAST(CASE WHEN len(taken) >= 5 THEN n - len(taken) ELSE 0 END AS INTEGER) AS omitted_limit, CASE WHEN n = 0 THEN 'EMPTY' WHEN len(taken) = 0 THEN 'BUDGET_EXHAUSTED' ELSE 'OK' END AS status FROM done")
def pack_status(spark, d):
    return _packed(spark, d).select("generation_id", "omitted_budget", "omitted_limit", "status")


@query("literal_file_pack", _GREEDY.replace("FROM files QUALIFY", "FROM files WHERE contains(lower(content), 'the') QUALIFY") + " SELECT generation_id, used, array_to_string(taken, '|') AS taken FROM done WHERE n > 0")
def literal_file_pack(spark, d):
    hits = model.files(spark, d).where(F.contains(F.lower("content"), F.lit("the")))
    return packing.pack(hits, ["generation_id"], ["rel_path"], "rel_path", F.col("size_bytes"), 8192, 5).select("generation_id", "used", F.array_join("taken", "|").alias("taken"))


@query("dedup_aliases", "SELECT content_hash AS source_sha256, min(rel_path) AS rel_path, coalesce(array_to_string(list_sort(list(rel_path))[2:], '|'), '') AS aliases FROM files GROUP BY content_hash")
def dedup_aliases(spark, d):
    got = packing.dedup_aliases(model.files(spark, d), [], ["rel_path"])
    return got.select("source_sha256", "rel_path", F.array_join("aliases", "|").alias("aliases"))


@query("symbol_coverage", "SELECT l_orderkey, NOT bool_or(gap) AND max(e) >= max(high) AS complete FROM (SELECT l_orderkey, e, max(e) OVER (PARTITION BY l_orderkey) - 5 AS high, s > coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10) AS gap FROM (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + 10 AS e FROM lineitem)) GROUP BY l_orderkey", False)
def symbol_coverage(spark, d):
    from pyspark.sql.window import Window

    p = model.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + 10).alias("e")).distinct()
    p = p.withColumn("high", F.max("e").over(Window.partitionBy("l_orderkey")) - 5)
    return packing.coverage(p, ["l_orderkey"], "s", "e", F.lit(10), F.col("high"))


@query("verify_literals", "SELECT rel_path, CASE WHEN doc_id % 43 = 0 THEN 'SOURCE_UNAVAILABLE' WHEN doc_id % 7 = 0 THEN 'STALE_SOURCE' WHEN doc_id % 5 = 0 THEN 'PROVENANCE_MISMATCH' ELSE 'OK' END AS verdict FROM files")
def verify_literals(spark, d):
    f = model.files(spark, d)
    packet = f.select("rel_path", F.col("content_hash").alias("file_sha256"), "content", F.when(F.col("doc_id") % 5 == 0, F.lit("0")).otherwise(F.col("content_hash")).alias("source_sha256"))
    now = f.where("doc_id % 43 <> 0").select("rel_path", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("now"))
    return packing_verify(packet, now)


def packing_verify(packet, now):
    """rel_path, verdict of packet rows (file_sha256, content, source_sha256) against the files' present text."""
    fresh = identity.sha256(F.col("now"))
    verdict = F.when(F.col("now").isNull(), "SOURCE_UNAVAILABLE").when(fresh != F.col("file_sha256"), "STALE_SOURCE").when(identity.sha256(F.col("content")) != F.col("source_sha256"), "PROVENANCE_MISMATCH").otherwise("OK")
    return packet.join(now, "rel_path", "left").select("rel_path", verdict.alias("verdict"))
