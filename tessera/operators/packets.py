"""Packets: candidates to whole texts within a byte budget, and many packets checked against sources at once.

A candidate gives its definition whole where that has room, else its own text;
equal texts become places of the first one; what is taken is the fold of
``packing.greedy`` over the sizes. Packets are checked as tables: their shape by a
schema and rules, their places by one join with the files they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import runtime
from tessera.functions import identity, spans
from tessera.operators import admission, intervals, packing, segment

# Fixed values of packets: bounds of what may be asked, candidates, bytes kept for the frame.
CANDIDATES, FRAME = 32, 512
LEAST_BYTES, MOST_BYTES, MOST_FRAGMENTS = 1024, 8192, 20
STATUSES = ("OK", "EMPTY", "BUDGET_EXHAUSTED")
#: What a packet may be told, worst first.
VERDICTS = ("INVALID_PACKET", "SOURCE_UNAVAILABLE", "STALE_SOURCE", "INVALID_SPAN", "PROVENANCE_MISMATCH", "OK")

_COVERAGE = "struct<symbol_span: array<int>, complete: boolean>"
_PLACE = f"path: string, span: array<int>, file_sha256: string, coverage: {_COVERAGE}"
#: The shape of a packet.
SCHEMA = (
    "schema string, version int, status string, snapshot_sha256 string, refreshed boolean, "
    "limits struct<packet_bytes: int, fragments: int, candidates: int, unit: string>, "
    f"selected array<struct<{_PLACE}, source: string, source_sha256: string, reason: string, score: double, aliases: array<struct<{_PLACE}>>>>, "
    "omitted struct<duplicate: int, budget: int, limit: int>"
)


def points(s: Column) -> Column:
    """A span as the four numbers that packets hold."""
    return F.when(s.isNotNull(), F.array(s["start_line"], s["start_col"], s["end_line"], s["end_col"]))


def span_of(four: Column) -> Column:
    return spans.span(F.get(four, 0), F.get(four, 1), F.get(four, 2), F.get(four, 3))


def inside(raw: Column, s: Column) -> Column:
    """Whether a span's ends are points of a text."""
    rows = F.split(raw, "\n", -1)
    return _within(lambda line: F.octet_length(F.get(rows, line - 1)), s)


def _within(width, s: Column) -> Column:
    """Whether a span's ends are points of lines of these widths (null: no such line)."""
    return F.coalesce(spans.valid(s) & (s["start_col"] <= width(s["start_line"])) & (s["end_col"] <= width(s["end_line"])), F.lit(False))


def rows_of(candidates: DataFrame, now: DataFrame, budget: int, limit: int) -> DataFrame:
    """What a packet takes of ranked candidates, and what it leaves out: rank, path, span, source, ..., places, taken.

    candidates (a bounded list): rank, rel_path, span, content, file_sha256,
    reason, score, symbol_span (null if none). now: rel_path, now (its text); a
    candidate that is not what stands there now fails the query.
    """
    c = candidates.join(now, "rel_path", "left")
    same = F.coalesce((identity.sha256(F.col("now")) == F.col("file_sha256")) & (segment.literal(F.col("now"), F.col("span")).cast("string") == F.col("content")), F.lit(False))
    c = c.withColumn("content", F.when(same, F.col("content")).otherwise(F.raise_error(F.lit("PROVENANCE_MISMATCH")).cast("string")))
    whole = F.when(inside(F.col("now"), F.col("symbol_span")), segment.literal(F.col("now"), F.col("symbol_span")).cast("string"))
    room = F.octet_length(F.to_json(F.struct(whole.alias("source")))) <= budget - FRAME - 256  # beside its place and hashes
    c = c.withColumn("whole", F.when(room, whole))
    c = c.withColumns({"source": F.coalesce("whole", "content"), "span": F.when(F.col("whole").isNull(), F.col("span")).otherwise(F.col("symbol_span"))})
    place = F.struct(F.col("rank"), F.col("rel_path").alias("path"), points(F.col("span")).alias("span"), "file_sha256", points(F.col("symbol_span")).alias("symbol_span"))
    each = c.groupBy("source", "rel_path", "span").agg(F.min("rank").alias("rank"), *[F.min_by(k, "rank").alias(k) for k in ("reason", "score", "file_sha256", "symbol_span")])
    texts = each.groupBy("source").agg(F.min("rank").alias("rank"), F.min_by("reason", "rank").alias("reason"), F.round(F.min_by("score", "rank"), 9).alias("score"), F.array_sort(F.collect_list(place)).alias("places"))
    texts = texts.withColumn("source_sha256", identity.sha256(F.col("source")))
    size = F.octet_length(F.to_json(F.struct("source", "reason", "score", "places", "source_sha256"))).cast("long") + 32 * F.size("places") + 96
    listed = texts.select(F.array_sort(F.collect_list(F.struct("rank", F.col("source_sha256").alias("id"), size.alias("size"))).over(_all())).alias("items"), "rank", "source", "reason", "score", "places", "source_sha256")
    taken = packing.greedy(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))), budget - FRAME, limit)["taken"]
    return listed.withColumn("all", taken).select("rank", "source", "source_sha256", "reason", "score", "places", F.array_contains("all", F.col("source_sha256")).alias("taken"), (F.size("all") >= limit).alias("full")).orderBy("rank")


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy()  # of at most CANDIDATES rows


def covered(places: DataFrame, by: list[str]) -> DataFrame:
    """by, path, symbol_span, whole: whether a packet's pieces of a file leave no gap in a definition (places: by, path, span, symbol_span)."""
    at = lambda four, i: intervals.position(F.get(four, i), F.get(four, i + 1))
    asked = places.where("symbol_span IS NOT NULL").select(*by, "path", "symbol_span").distinct()
    pieces = asked.join(places.select(*by, "path", "span"), [*by, "path"]).select(*by, "path", "symbol_span", at(F.col("span"), 0).alias("s"), at(F.col("span"), 2).alias("e"))
    low, high = at(F.col("symbol_span"), 0), at(F.col("symbol_span"), 2)
    # pieces that end before it begins, or begin after it ends, tell nothing
    met = pieces.where((F.col("e") > low) & (F.col("s") < high)).withColumns({"_low": low, "_high": high})
    whole = packing.coverage(met, [*by, "path", "symbol_span"], "s", "e", F.col("_low"), F.col("_high"))
    return asked.join(whole, [*by, "path", "symbol_span"], "left").select(*by, "path", "symbol_span", F.coalesce("complete", F.lit(False)).alias("whole"))


def _rules(p: Column) -> dict[str, Column]:
    left, n, limits = p["omitted"], F.size(p["selected"]), p["limits"]
    counts = [left["duplicate"], left["budget"], left["limit"]]
    some = counts[0] + counts[1] + counts[2]
    return {
        "read": p.isNotNull(),
        "kind": (p["schema"] == "tessera-packet") & (p["version"] == 2) & p["status"].isin(*STATUSES),
        "digest": p["snapshot_sha256"].rlike("^[0-9a-f]{64}$") & p["refreshed"].isNotNull(),
        "limits": limits["packet_bytes"].between(LEAST_BYTES, MOST_BYTES) & limits["fragments"].between(1, MOST_FRAGMENTS) & (limits["candidates"] == CANDIDATES),
        "counts": (F.least(*counts) >= 0) & (n <= limits["fragments"]) & (n + some <= CANDIDATES),
        "status": F.when(p["status"] == "OK", n > 0).when(p["status"] == "EMPTY", (n == 0) & (some == 0)).otherwise((n == 0) & (some > 0)),
        "aliases": F.aggregate(p["selected"], F.lit(0), lambda a, r: a + F.size(r["aliases"])) == left["duplicate"],
        "texts": F.size(F.array_distinct(F.transform(p["selected"], lambda r: r["source_sha256"]))) == n,
    }


def verdicts(packets: DataFrame, files_of) -> DataFrame:
    """packet_id, verdict of each of packets (packet_id, packet: JSON text).

    files_of: a function of the table of paths that packets name (path, each once)
    that gives rel_path and now, the present text of those that are there.
    """
    # read once and stored: rules and places ask for many parts of a packet
    p = runtime.settled(packets.select("packet_id", F.octet_length("packet").alias("bytes"), F.from_json("packet", SCHEMA).alias("p")))
    p = p.withColumn("broken", admission.first_broken(_rules(F.col("p")) | {"size": F.col("bytes") <= F.col("p.limits.packet_bytes")}))
    row = p.where("broken IS NULL").select("packet_id", F.explode("p.selected").alias("r"))
    one = F.struct(*[F.col(f"r.{k}") for k in ("path", "span", "file_sha256", "coverage")])
    place = row.select("packet_id", "r.source", "r.source_sha256", F.explode(F.concat(F.array(one), F.col("r.aliases"))).alias("q")).select("packet_id", "source", "source_sha256", "q.*").withColumn("symbol_span", F.col("coverage.symbol_span"))
    told = covered(place, ["packet_id"])
    sizes = F.transform(F.split("now", "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)
    starts = F.concat(segment.prefix_sums(sizes), F.array(F.octet_length("now").cast("long") + 1))
    # a file is hashed and cut to lines once, however many places name it
    now = files_of(place.select("path").distinct()).select(F.col("rel_path").alias("path"), "now", identity.sha256(F.col("now")).alias("now_sha256"), starts.alias("starts"))
    span, symbol, raw, at = span_of(F.col("span")), span_of(F.col("symbol_span")), F.col("now"), F.col("starts")
    width = lambda line: F.get(at, line) - F.get(at, line - 1) - 1
    low, high = (segment.offset_of(at, span[f"{k}_line"], span[f"{k}_col"]) for k in ("start", "end"))
    body = F.substring(raw.cast("binary"), (low + 1).cast("int"), (high - low).cast("int"))
    formed = (F.size("span") == 4) & spans.valid(span) & F.when(F.col("symbol_span").isNull(), ~F.col("coverage.complete")).otherwise(F.col("coverage.complete") == F.col("whole"))
    verdict = (
        F.when(~F.coalesce(formed, F.lit(False)), 0)
        .when(raw.isNull(), 1)
        .when(F.col("now_sha256") != F.col("file_sha256"), 2)
        .when(~_within(width, span) | ~F.when(F.col("symbol_span").isNull(), F.lit(True)).otherwise(_within(width, symbol)), 3)
        .when((body != F.col("source").cast("binary")) | (F.sha2(body, 256) != F.col("source_sha256")), 4)
        .otherwise(5)
    )
    # files meet their places once; a file that is named by many is read once
    each = place.join(told, ["packet_id", "path", "symbol_span"], "left").join(now, "path", "left").select("packet_id", verdict.alias("v"))
    worst = p.select("packet_id", F.when(F.col("broken").isNull(), 5).otherwise(0).alias("v")).unionByName(each).groupBy("packet_id").agg(F.min("v").alias("v"))
    return worst.select("packet_id", F.get(F.array(*[F.lit(v) for v in VERDICTS]), F.col("v")).alias("verdict"))


def rollup(packets: DataFrame, by: list[str]) -> DataFrame:
    """by, and over the packets (by, packet: JSON text): how many, of which status, with how much taken and left out.

    A packet that isn't one counts as unreadable and in nothing else; sums are made in each task before the shuffle.
    """
    p = F.col("p")
    read = (p["schema"] == "tessera-packet") & p["status"].isin(*STATUSES)
    parsed = packets.select(*by, F.from_json("packet", SCHEMA).alias("p")).withColumn("read", F.coalesce(read, F.lit(False)))
    total = lambda x: F.coalesce(F.sum(F.when(F.col("read"), x)), F.lit(0)).cast("long")
    taken = F.aggregate(p["selected"], F.lit(0).cast("long"), lambda a, r: a + F.octet_length(r["source"]))
    return parsed.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.count_if(~F.col("read")).alias("unreadable"),
        *[F.count_if(F.col("read") & (p["status"] == s)).alias(s.lower()) for s in STATUSES],
        total(F.size(p["selected"])).alias("fragments"),
        total(taken).alias("source_bytes"),
        *[total(p["omitted"][k]).alias(f"omitted_{k}") for k in ("duplicate", "budget", "limit")],
    )
