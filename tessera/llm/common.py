"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that may be broadcast to drop rows; beyond it the join is shuffled.
MAX_BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach.

    Only where that setting is absent (tests on one machine) a local folder is
    chosen, and the setting is made, so that later calls use the same one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = "file://" + local
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read of files, not a recomputation, and
    values such as generated row keys are fixed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no bucket (null)."""
    return F.crc32(F.col(col).cast("string")) % n


def in_bucket(col: str, n: int, k: int) -> Column:
    return F.coalesce(bucket_of(col, n) == k, F.lit(False))


def drop_ids(docs: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``drop`` (materialised).

    The ids are counted first: up to MAX_BROADCAST_IDS they are broadcast, more
    are met by a shuffled anti join. Rows with a null key stay.
    """
    few = drop.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    side = drop.select(key)
    return docs.join(F.broadcast(side) if few else side.hint("shuffle_hash"), key, "left_anti")


def keep_ids(docs: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``keep`` (materialised)."""
    few = keep.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    side = keep.select(key)
    return docs.join(F.broadcast(side) if few else side.hint("shuffle_hash"), key, "left_semi")


def with_row_id(docs: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row, for one scan only.

    Another scan of the same files may be split elsewhere, as by the cores there
    are when it is planned; what is read again needs ``numbered``.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number for each row that each later scan finds again, however files are split.

    For rows read from files, it is the file's number and the row's place in the
    file; other rows are stored with their number.
    """
    if not _plain_scan(docs):
        return written(with_row_id(docs, name))
    paths = [p.replace(":///", ":/", 1) for p in docs.inputFiles()]  # as _metadata has them
    path, file, place = (f"_{k} of {name}" for k in ("path", "file", "place"))
    files = docs.sparkSession.createDataFrame(list(zip(sorted(paths), range(len(paths)))), f"`{path}` string, `{file}` long")
    at = docs.select("*", F.replace("_metadata.file_path", F.lit(":///"), F.lit(":/")).alias(path), F.col("_metadata.row_index").alias(place))
    known = F.coalesce(F.col(f"`{file}`"), F.raise_error(F.concat(F.lit("not among the input files: "), F.col(f"`{path}`"))).cast("long"))
    return at.join(F.broadcast(files), path, "left").select(*(F.col(f"`{c}`") for c in docs.columns), (F.shiftleft(known, 40) + F.col(f"`{place}`")).alias(name))


def numbered_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(_row, doc_id, text of each numbered row; the rows as they are, with their number; the name it has there).

    The name is none of the table's own, so that no column of it is lost.
    """
    number = "_row"
    while number.lower() in [c.lower() for c in docs.columns]:
        number = "_" + number
    own = numbered(docs, number)
    return own.select(F.col(number).alias("_row"), "doc_id", "text"), own, number


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is a row of a Parquet file, and none is there twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.children().nonEmpty() or not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True
