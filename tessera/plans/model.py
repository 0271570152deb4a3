"""The engine's tables, mapped from a table of texts and a star schema.

Repositories are the sources of ``documents``, files and chunks its texts, the
symbol graph is customers (classes) that define orders (methods) that call parts
(functions), and events are the history of generations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity, spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    repo = identity.repo_id(F.coalesce("source", F.lit("")))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        "doc_id",
        repo.alias("repo_id"),
        F.concat(F.lit("gen_"), repo).alias("generation_id"),
        path.alias("rel_path"),
        identity.short_id("file_", repo, path).alias("file_id"),
        text.alias("content"),
        identity.sha256(text).alias("content_hash"),
        F.octet_length(text).cast("long").alias("size_bytes"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a file: its whole text."""
    f = files(spark, sf_dir).withColumn("span", spans.whole(F.col("content")))
    return f.withColumn("chunk_id", identity.chunk_id(F.col("file_id"), F.col("generation_id"), F.col("span"), F.col("content_hash")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, qualified_name, kind, parent_id, repo."""
    customer, orders, part = (table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    text = lambda c: F.col(c).cast("string")
    classes = customer.select(F.concat(F.lit("c"), text("c_custkey")).alias("entity_id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), text("c_nationkey"), F.lit("."), F.col("c_name")).alias("qualified_name"), F.lit("CLASS").alias("kind"), F.lit(None).cast("string").alias("parent_id"))
    methods = orders.select(F.concat(F.lit("o"), text("o_orderkey")).alias("entity_id"), F.concat(F.lit("order_"), text("o_orderkey")).alias("name"), F.concat(F.lit("c"), text("o_custkey"), F.lit(".order_"), text("o_orderkey")).alias("qualified_name"), F.lit("METHOD").alias("kind"), F.concat(F.lit("c"), text("o_custkey")).alias("parent_id"))
    functions = part.select(F.concat(F.lit("p"), text("p_partkey")).alias("entity_id"), F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.lit("."), F.col("p_name")).alias("qualified_name"), F.lit("FUNCTION").alias("kind"), F.lit(None).cast("string").alias("parent_id"))
    return classes.unionByName(methods).unionByName(functions)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, rel_type, trust_class, site."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    defines = orders.select(F.concat(F.lit("c"), text("o_custkey")).alias("source_id"), F.concat(F.lit("o"), text("o_orderkey")).alias("target_id"), F.lit("DEFINES").alias("rel_type"), F.lit("EXACT").alias("trust_class"), F.lit(0).alias("site"))
    trust = F.when(F.col("l_returnflag") == "A", "EXACT").when(F.col("l_returnflag") == "R", "RESOLVED").otherwise("HEURISTIC")
    calls = line.select(F.concat(F.lit("o"), text("l_orderkey")).alias("source_id"), F.concat(F.lit("p"), text("l_partkey")).alias("target_id"), F.lit("CALLS").alias("rel_type"), trust.alias("trust_class"), F.col("l_linenumber").cast("int").alias("site"))
    return defines.unionByName(calls)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, generation_id, sequence, lifecycle, is_active (newest committed), from events."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    g = e.select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("generation_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"), F.when(F.col("event_type") == "error", "STAGING").otherwise("COMMITTED").alias("lifecycle"))
    newest = F.max(F.when(F.col("lifecycle") == "COMMITTED", F.col("sequence"))).over(Window.partitionBy("repo_id"))
    return g.withColumn("is_active", F.coalesce(F.col("sequence") == newest, F.lit(False)))


#: The same tables for the oracle.
SQL = r"""
files AS (
  SELECT doc_id, repo_id, 'gen_' || repo_id AS generation_id, rel_path,
         'file_' || substr(sha256(repo_id || ':' || rel_path), 1, 16) AS file_id,
         content, sha256(content) AS content_hash, CAST(strlen(content) AS BIGINT) AS size_bytes
  FROM (SELECT doc_id, 'repo_' || substr(sha256(coalesce(source, '')), 1, 16) AS repo_id,
               coalesce(source, '') || '/' || coalesce(lang, '') || '/doc_' || doc_id || '.txt' AS rel_path,
               coalesce(text, '') AS content FROM documents)
), spanned AS (
  SELECT *, 1 + length(content) - length(replace(content, chr(10), '')) AS end_line,
         strlen(string_split(content, chr(10))[-1]) AS end_col FROM files
), chunks AS (
  SELECT *, 'chk_' || substr(sha256(file_id || ':' || generation_id || ':1:0-' || end_line || ':' || end_col || ':' || content_hash), 1, 16) AS chunk_id
  FROM spanned
), entities AS (
  SELECT 'c' || c_custkey AS entity_id, c_name AS name, 'n' || c_nationkey || '.' || c_name AS qualified_name, 'CLASS' AS kind, CAST(NULL AS VARCHAR) AS parent_id FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'order_' || o_orderkey, 'c' || o_custkey || '.order_' || o_orderkey, 'METHOD', 'c' || o_custkey FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_name, p_brand || '.' || p_name, 'FUNCTION', NULL FROM part
), relations AS (
  SELECT 'c' || o_custkey AS source_id, 'o' || o_orderkey AS target_id, 'DEFINES' AS rel_type, 'EXACT' AS trust_class, 0 AS site FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'CALLS', CASE l_returnflag WHEN 'A' THEN 'EXACT' WHEN 'R' THEN 'RESOLVED' ELSE 'HEURISTIC' END, l_linenumber FROM lineitem
), generations0 AS (
  SELECT user_id AS repo_id, event_id AS generation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
         CASE event_type WHEN 'error' THEN 'STAGING' ELSE 'COMMITTED' END AS lifecycle FROM events
), generations AS (
  SELECT *, coalesce(sequence = max(CASE WHEN lifecycle = 'COMMITTED' THEN sequence END) OVER (PARTITION BY repo_id), false) AS is_active FROM generations0
)
"""
