"""Chunks that follow definitions: each byte of a file belongs to the innermost one that holds it.

A sweep over each definition's children in order gives what lies before, between
and after them to itself. Texts are joined once, with the pieces of their file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What is wrong with a file's definitions, in the order it is looked for.
FAULTS = ("no single module", "unknown parent", "outside its parent", "siblings cross")
_BLANK = r"^[\x09-\x0D\x1C-\x20\x85\p{Z}]*$"


def _families(definitions: DataFrame) -> DataFrame:
    """Each definition with its parent's range and where its earlier siblings end."""
    d = definitions.select("file_id", "entity_id", "kind", "parent_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    parent = d.select("file_id", F.col("entity_id").alias("parent_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    siblings = Window.partitionBy("file_id", "parent_id").orderBy("start", "end", "entity_id")
    before = F.max("end").over(siblings.rowsBetween(Window.unboundedPreceding, -1))
    return d.join(parent, ["file_id", "parent_id"], "left").withColumns({"before": before, "last": F.lead("entity_id").over(siblings).isNull()})


def faults(definitions: DataFrame) -> DataFrame:
    """file_id, entity_id, fault: what keeps a file from being dealt out; entity_id is null where it is the file's.

    definitions: file_id, entity_id, kind, parent_id (null at the top), start, end
    (bytes). A file has one module; the others stand inside their parent, which is
    known, and don't cross the siblings before them.
    """
    modules = definitions.groupBy("file_id").agg(F.count_if(F.col("kind") == "MODULE").alias("n")).where("n <> 1")
    f = _families(definitions).where("parent_id IS NOT NULL")
    wrong = F.when(F.col("p_start").isNull(), FAULTS[1]).when((F.col("start") < F.col("p_start")) | (F.col("end") > F.col("p_end")), FAULTS[2]).when(F.col("start") < F.col("before"), FAULTS[3])
    of_file = modules.select("file_id", F.lit(None).cast(definitions.schema["entity_id"].dataType).alias("entity_id"), F.lit(FAULTS[0]).alias("fault"))
    return of_file.unionByName(f.select("file_id", "entity_id", wrong.alias("fault")).where("fault IS NOT NULL"))


def ranges(definitions: DataFrame) -> DataFrame:
    """file_id, owner_id, start, end of what each definition has besides its children; together they tile the module."""
    f = _families(definitions)
    children = f.where("parent_id IS NOT NULL")
    ahead = children.select("file_id", F.col("parent_id").alias("owner_id"), F.coalesce("before", "p_start").alias("from"), F.col("start").alias("to"))
    after = children.where("last").select("file_id", F.col("parent_id").alias("owner_id"), F.greatest("before", "end").alias("from"), F.col("p_end").alias("to"))
    parents = children.select("file_id", F.col("parent_id").alias("entity_id")).distinct()
    leaves = f.join(parents, ["file_id", "entity_id"], "left_anti").select("file_id", F.col("entity_id").alias("owner_id"), F.col("start").alias("from"), F.col("end").alias("to"))
    return ahead.unionByName(after).unionByName(leaves).where("from < to").select("file_id", "owner_id", F.col("from").alias("start"), F.col("to").alias("end"))


def owned(files: DataFrame, definitions: DataFrame, text: str = "content") -> DataFrame:
    """file_id, owner_id, start, end, content of the pieces of each file (file_id, text); pieces of white space are none.

    The pieces are checked to follow each other and to leave nothing but white
    space out; a file where they don't fails the query. Faults are found by ``faults``.
    """
    held = ranges(definitions).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "owner_id"))).alias("pieces"))  # a file's own
    raw = files.select("file_id", F.col(text).cast("binary").alias("raw")).join(held, "file_id")
    n = F.octet_length("raw").cast("long")
    tiles = F.aggregate("pieces", F.lit(0).cast("long"), lambda at, p: F.when(p["start"] == at, p["end"])) == n  # null where one doesn't begin at the last one's end
    cut = F.transform("pieces", lambda p: F.struct(p["owner_id"].alias("owner_id"), p["start"].alias("start"), p["end"].alias("end"), F.substring("raw", (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")).cast("string").alias("content")))
    sound = F.when(F.coalesce(tiles, F.lit(False)), cut).otherwise(F.raise_error(F.concat(F.lit("pieces don't tile the file "), F.col("file_id").cast("string"))).cast(raw.select(cut.alias("c")).schema["c"].dataType))
    return raw.select("file_id", F.inline(sound)).where(~F.col("content").rlike(_BLANK)).select("file_id", "owner_id", "start", "end", "content")
