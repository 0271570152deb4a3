"""A stored trigram index: postings that are read by trigram, texts that are read by candidate.

Postings lie sorted by trigram in small row groups, with the number of chunks of
each trigram beside them; texts lie in folders by bucket of their id, numbered in
each. A trigram is the number that its three characters make, a posting names a
chunk by bucket and number: both are moved and sorted as numbers. A phrase reads
the counts of its trigrams, the postings of the rarest ones by a pushed-down filter,
and the texts of the buckets that candidates are in (dynamic partition pruning).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import runtime

#: Trigrams of a phrase whose postings are read, chunks of a bucket, most candidates that are broadcast.
RAREST, BUCKET_CHUNKS, MAX_BROADCAST = 3, 2_000, 500_000
_SMALL = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 16)}
#: Postings that a task makes at a time, about.
_BATCH = 1 << 20


def numbers(text: str) -> np.ndarray:
    """The distinct trigrams of a text, ascending: 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return c[:0]
    v = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    v.sort()
    return v[np.concatenate(([True], v[1:] != v[:-1]))]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, bucket, n from bucket, n, low."""
    for batch in batches:
        ids, made, size = [batch.column(i).to_numpy() for i in (0, 1)], [], 0
        for i, low in enumerate(batch.column(2)):
            made.append(numbers(low.as_py()))
            size += len(made[-1])
            if size >= _BATCH or i + 1 == batch.num_rows:
                times, at = [len(x) for x in made], slice(i + 1 - len(made), i + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), *[pa.array(np.repeat(x[at], times)) for x in ids]], names=["trigram", "bucket", "n"])
                made, size = [], 0


def store(chunks: DataFrame, path: str) -> None:
    """Write texts, postings and frequencies of chunks (generation_id, chunk_id, content, ...) below a new path."""
    spark = chunks.sparkSession
    n = max(1, -(-chunks.count() // BUCKET_CHUNKS))
    bucket = F.pmod(F.xxhash64("generation_id", "chunk_id"), F.lit(n)).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("generation_id", "chunk_id"))
    chunks.withColumn("bucket", bucket).withColumn("n", place).write.partitionBy("bucket").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    held = texts.where("content IS NOT NULL").select("bucket", "n", F.lower("content").alias("low")).mapInArrow(_postings, "trigram long, bucket int, n int")
    held = runtime.settled(held)  # ranges are told by a pass of its own
    # by range of all columns: a trigram that most texts hold is spread over files
    held.repartitionByRange("trigram", "bucket", "n").sortWithinPartitions("trigram").write.options(**_SMALL).parquet(f"{path}/postings")
    df = spark.read.parquet(f"{path}/postings").groupBy("trigram").agg(F.count("*").alias("df"))
    df.repartitionByRange("trigram").sortWithinPartitions("trigram").write.options(**_SMALL).parquet(f"{path}/frequencies")


def _one_of(column: str, values: list[int]) -> Column:
    """Equalities, each of which is pushed down to row groups; a long IN would become a range."""
    return reduce(lambda x, y: x | y, [F.col(column) == v for v in values])


def rarest(spark: SparkSession, path: str, phrase: str) -> list[int] | None:
    """The rarest trigrams of a phrase in lower case; None if one of its trigrams is nowhere."""
    grams = numbers(phrase).tolist()
    told = {r["trigram"]: r["df"] for r in spark.read.parquet(f"{path}/frequencies").where(_one_of("trigram", grams)).collect()}  # a phrase's trigrams
    return sorted(grams, key=lambda g: (told[g], g))[:RAREST] if len(told) == len(grams) else None


def candidates(spark: SparkSession, path: str, phrase: str) -> DataFrame | None:
    """bucket, n of the chunks that hold a phrase's rarest trigrams; None if there are none."""
    grams = rarest(spark, path, phrase.lower())
    if not grams:
        return None
    met = spark.read.parquet(f"{path}/postings").where(_one_of("trigram", grams))
    return met.groupBy("bucket", "n").agg(F.count("*").alias("held")).where(F.col("held") == len(grams)).drop("held")


def matches(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """The stored chunks whose text holds the phrase, letter case aside; phrases of under three characters read all texts."""
    stored = spark.read.parquet(f"{path}/texts")
    texts = stored.drop("n")
    holds = F.contains(F.lower("content"), F.lit(phrase.lower()))
    if len(phrase.lower()) < 3:
        return texts.where(holds)
    found = candidates(spark, path, phrase)
    if found is None:
        return texts.limit(0)
    few = found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return stored.join(F.broadcast(found) if few else found, ["bucket", "n"], "left_semi").where(holds).drop("n")
