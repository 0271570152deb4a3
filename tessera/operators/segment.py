"""Segmentation: lines, bounded chunks, literal slices, ranges that children leave."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity, spans

#: Most UTF-8 bytes of a chunk.
MAX_BYTES = 1800


def lines(text: Column) -> Column:
    """LF-ended lines of a text, the LF with its line; their concatenation is the text."""
    parts = F.split(text, "\n", -1)
    whole = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(x, F.lit("\n")))
    last = F.element_at(parts, -1)
    return F.when(last == "", whole).otherwise(F.concat(whole, F.array(last)))


def prefix_sums(sizes: Column, run: int = 256) -> Column:
    """What comes before each element of an array of longs.

    Sums go over runs and then over the runs: appending to one array would copy
    it for each element.
    """
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    runs = F.transform(F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(run))).otherwise(F.array().cast("array<int>")), lambda i: F.aggregate(F.slice(sizes, i, run), none, step))

    def whole(r: Column) -> Column:
        before = F.aggregate(F.transform(r, lambda x: x["at"]), none, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(r, before, lambda x, at: F.transform(x["out"], lambda y: y + at)))

    return F.get(F.transform(F.array(runs), whole), 0)


def line_offsets(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), start (byte offset): running sums within each row, no shuffle."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)
    return files.select(key, F.posexplode(prefix_sums(sizes)).alias("i", "start")).select(key, (F.col("i") + 1).cast("long").alias("line"), "start")


def offset_of(starts: Column, line: Column, col: Column) -> Column:
    """The byte offset of a point, from the lines' starts; null outside."""
    return F.get(starts, line - 1) + col


def point_of(starts: Column, offset: Column) -> Column:
    """The point (line, col) of a byte offset, from the lines' starts."""
    line = F.size(F.filter(starts, lambda x: x <= offset))
    return F.struct(line.alias("line"), (offset - F.get(starts, line - 1)).alias("col"))


def pieces_of(line: str, most: int = MAX_BYTES) -> list[str]:
    """A line in pieces of at most ``most`` bytes, as long as they can be, cut between characters."""
    raw = line.encode("utf-8")
    out, at = [], 0
    while len(raw) - at > most:
        end = at + most
        while end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        end = end if end > at else at + most
        out.append(raw[at:end].decode("utf-8"))
        at = end
    return [*out, raw[at:].decode("utf-8")] if at < len(raw) or not out else out


def segments_of(text: str, most: int = MAX_BYTES) -> list[str]:
    """Greedy next-fit of LF-ended lines into segments of at most ``most`` bytes; joined, they are the text."""
    out: list[str] = []
    now: list[str] = []
    used = 0
    for line in text.split("\n"):
        for piece in pieces_of(line + "\n", most):
            size = len(piece.encode("utf-8"))
            if used + size > most and now:
                out.append("".join(now))
                now, used = [], 0
            now.append(piece)
            used += size
    if now:  # the last line has no LF of its own
        now[-1] = now[-1][:-1]
        out.append("".join(now))
    return [x for x in out if x]


def segments(files: DataFrame, key: str, text: str, most: int = MAX_BYTES) -> DataFrame:
    """key, ordinal, content of each segment; a fold over a text's lines, in Python since it is sequential."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                got = segments_of(t.as_py() or "", most)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(got), batch.schema.field(0).type), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], names=[key, "ordinal", "content"])

    kind = files.select(key).schema[0].dataType.simpleString()
    return files.select(key, text).mapInArrow(run, f"{key} {kind}, ordinal int, content string")


def bound(chunks: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Chunks cut to at most ``most`` bytes, each with its own span, hash and id, and its ordinal in the chunk."""
    keep = [c for c in chunks.columns if c not in ("content", "span", "content_hash", "chunk_id")]
    rows = chunks.select(*keep, "content", F.col("span.start_line").alias("_line"), F.col("span.start_col").alias("_col"))
    out = rows.select(*keep).schema.add("ordinal", "integer").add("content", "string").add("_l0", "integer").add("_c0", "integer").add("_l1", "integer").add("_c1", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, ordinal, content, points = [], [], [], []
            for i, (t, line, col) in enumerate(zip(batch.column("content"), batch.column("_line").to_pylist(), batch.column("_col").to_pylist())):
                for k, piece in enumerate(segments_of(t.as_py() or "", most)):
                    breaks = piece.count("\n")
                    tail = len(piece.rpartition("\n")[2].encode("utf-8"))
                    end = (line + breaks, tail if breaks else col + tail)
                    index.append(i)
                    ordinal.append(k)
                    content.append(piece)
                    points.append((line, col, *end))
                    line, col = end
            cols = [batch.column(c).take(pa.array(index, pa.int64())) for c in keep] + [pa.array(ordinal, pa.int32()), pa.array(content, pa.string())]
            cols += [pa.array([p[k] for p in points], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ordinal", "content", "_l0", "_c0", "_l1", "_c1"])

    cut = rows.mapInArrow(run, out).withColumn("span", spans.span(F.col("_l0"), F.col("_c0"), F.col("_l1"), F.col("_c1")))
    cut = cut.select(*keep, "ordinal", "content", "span").withColumn("content_hash", identity.sha256(F.col("content")))
    return cut.withColumn("chunk_id", identity.chunk_id(F.col("file_id"), F.col("generation_id"), F.col("span"), F.col("content_hash")))


def literal(text: Column, s: Column) -> Column:
    """The bytes of a span."""
    rows = F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x) + 1)
    offset = lambda line, col: F.aggregate(F.slice(rows, 1, line - 1), F.lit(0), lambda a, n: a + n) + col
    a, b = offset(s["start_line"], s["start_col"]), offset(s["end_line"], s["end_col"])
    return F.substring(text.cast("binary"), a + 1, b - a)


def own_pieces(parents: DataFrame, children: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, end, content of what each parent's bytes leave of its children (key, start, end); white space alone is nothing."""
    ends = parents.select(key, F.octet_length(text).cast("long").alias("start"), F.octet_length(text).cast("long").alias("end"))
    gaps = own_ranges(children.select(key, F.col("start").cast("long"), F.col("end").cast("long")).unionByName(ends), key, "start", "end").where("own_start < own_end")
    cut = gaps.join(parents.select(key, F.col(text).cast("binary").alias("_raw")), key)
    piece = F.substring(F.col("_raw"), (F.col("own_start") + 1).cast("int"), (F.col("own_end") - F.col("own_start")).cast("int")).cast("string")
    return cut.select(key, F.col("own_start").alias("start"), F.col("own_end").alias("end"), piece.alias("content")).where(F.trim(F.translate("content", "\n\r\t", "   ")) != "")


def own_ranges(children: DataFrame, parent: str, start: str, end: str) -> DataFrame:
    """parent, own_start, own_end: what a parent (from 0) has before and between its children."""
    w = Window.partitionBy(parent).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    return children.select(parent, before.alias("own_start"), F.greatest(F.col(start), before).alias("own_end"))
