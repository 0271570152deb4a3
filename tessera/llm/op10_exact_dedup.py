"""Exact deduplication by stateful streaming (native: DataFrame functions only).

Each row becomes a fixed-size fingerprint: SHA-256 of the normalised text, its
length, the row's id and a locator (the file and the row's place in it). The fingerprints are streamed through a
keyed aggregation whose state lies in RocksDB on disk, has no watermark and so
never expires; a digest's state holds its count and the retained row (id,
length, locator); each micro-batch writes what it changed. A digest seen more than once is a *hit*: the full normalised
bytes of its rows are grouped as they are, and where one digest turns out to
hold different bytes, those rows are grouped by bytes instead.

Defined results: a null text counts as empty; empty texts are equal to each
other; of equal texts the one with most code points stays, then the smallest
id (a null id comes first); of repeated rows (same id, same text) exactly one
locator stays, though ``kept`` is told by id; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # without preallocated logs: with many state partitions these fill the disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(col: str = "text") -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]."""
    return F.regexp_replace(common.text_or_empty(col), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprints(docs: DataFrame, digest=sha256) -> DataFrame:
    """_row (locator), doc_id, n, digest of each row, written to the shared folder."""
    text = docs.select("_row", "doc_id", "text")
    # the text is normalised once: a shared subexpression of both digests
    text = text.select("_row", "doc_id", F.length(common.text_or_empty()).alias("n"), normalised().alias("norm"))
    return common.written(text.select("_row", "doc_id", "n", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256")))


def retained() -> Column:
    """Of a group, the longest original text, then the smallest id, then the first locator."""
    return F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id"), F.col("_row")))


#: Micro-batches that a stored table is streamed in: later ones look their digests up in the state of earlier ones.
BATCHES = 3


def stream_state(prints: DataFrame, max_files: int | None = None) -> DataFrame:
    """The final state: digest, keep (less, doc_id, _row), group_size.

    ``prints`` must be stored (as ``fingerprints`` leaves it); its files are the
    stream, ``max_files`` of them a micro-batch (None: in BATCHES equal ones).
    """
    spark = prints.sparkSession
    root = common.shared_dir(spark)
    files = prints.inputFiles()
    empty = prints.limit(0).groupBy("digest").agg(retained().alias("keep"), F.count("*").alias("group_size"))
    if not files:
        return empty
    source = files[0].rpartition("/")[0]
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    made: dict[int, str] = {}

    def put(batch: DataFrame, number: int) -> None:  # what the batch changed; a batch that is tried again replaces its own
        made[number] = f"{root}/state-{number}"
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(made[number])

    try:
        reader = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", max_files or -(-len(files) // BATCHES))
        state = reader.parquet(source).groupBy("digest").agg(retained().alias("keep"), F.count("*").alias("group_size"))
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if len(made) < 2:
        return spark.read.schema(empty.schema).parquet(*made.values()) if made else empty
    every = spark.read.parquet(*made.values())
    return every.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.keep", "s.group_size")


def groups(docs: DataFrame, digest=sha256, max_files: int | None = None) -> DataFrame:
    """One row for each of the numbered rows docs (_row, doc_id, text): _row, doc_id, keep_row, keep_id, group_size, text_sha256."""
    prints = fingerprints(docs, digest)
    state = stream_state(prints, max_files)
    hits = common.written(state.where("group_size > 1").select("digest", "keep", "group_size"))

    # Full bytes of the hits: copies fall together within a task, before anything is shuffled.
    text = docs.select("_row", "doc_id", F.length(common.text_or_empty()).alias("n"), normalised().alias("norm"))
    text = common.keep_ids(text.withColumn("digest", digest(F.col("norm"))), hits, "digest")
    differ = common.written(text.select("digest", "norm").distinct().groupBy("digest").count().where("count > 1").select("digest"))

    few = hits.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    sure = hits if differ.isEmpty() else common.drop_ids(hits, differ, "digest")
    sure = sure.select("digest", F.col("keep._row").alias("keep_row"), F.col("keep.doc_id").alias("keep_id"), "group_size")
    alone = F.col("group_size").isNull()
    plain = prints if differ.isEmpty() else prints.join(differ, "digest", "left_anti")
    out = plain.join(F.broadcast(sure) if few else sure, "digest", "left").select(
        "_row",
        "doc_id",
        F.when(alone, F.col("_row")).otherwise(F.col("keep_row")).alias("keep_row"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
    )
    if not differ.isEmpty():  # two texts, one digest: go by the bytes
        rows = text.join(differ, "digest", "left_semi")
        exact = rows.groupBy("norm").agg(retained().alias("keep"), F.count("*").alias("group_size"))
        out = out.unionByName(rows.join(exact, "norm").select("_row", "doc_id", F.col("keep._row").alias("keep_row"), F.col("keep.doc_id").alias("keep_id"), "group_size", sha256(F.col("norm")).alias("text_sha256")))
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text)."""
    return groups(common.numbered(docs.select("doc_id", "text"))).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all their columns as they are."""
    rows, own, number = common.numbered_apart(docs)
    dropped = common.written(groups(rows).where("_row <> keep_row").select(F.col("_row").alias(number)))
    return common.drop_ids(own, dropped, number).drop(number)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": ORACLE}
