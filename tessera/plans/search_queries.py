"""Lexical search, fusion and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity, spans
from tessera.operators import ranking, search, segment
from tessera.plans import model
from tessera.plans.registry import query

PHRASES = ["the", "eau", "and the"]


def _bm25_sql(by: str = "") -> str:
    """BM25 of the three phrases, none of which overlaps itself."""
    part = f"PARTITION BY {by}" if by else ""
    f = [f"(length(low) - length(replace(low, '{p}', ''))) / {len(p)}" for p in PHRASES]
    counts = ", ".join(f"CAST({x} AS DOUBLE) AS f{i}" for i, x in enumerate(f))
    dfs = ", ".join(f"count(*) FILTER (contains(low, '{p}')) OVER ({part}) AS n{i}" for i, p in enumerate(PHRASES))
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / avg_len)) ELSE 0 END" for i in range(3))
    return f""", folded AS (SELECT *, lower(content) AS low, greatest(length(content) - 2, 0) AS size FROM chunks),
counted AS (SELECT *, {counts}, {dfs}, count(*) OVER ({part}) AS n_docs, avg(size) OVER ({part}) AS avg_len FROM folded),
scored AS (SELECT *, round({score}, 6) AS score FROM counted WHERE f0 > 0 OR f1 > 0 OR f2 > 0)"""


def _scored(spark, d, by=()):
    hits = search.bm25(model.chunks(spark, d), PHRASES, list(by))
    return hits.withColumn("score", F.round("score", 6))


@query("bm25_scores", _bm25_sql() + " SELECT doc_id, score FROM scored")
def bm25_scores(spark, d):
    return _scored(spark, d).select("doc_id", "score")


@query("bm25_topk", _bm25_sql() + " SELECT doc_id, rel_path, score FROM scored ORDER BY score DESC, rel_path, chunk_id LIMIT 10")
def bm25_topk(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), "rel_path", "chunk_id").limit(10).select("doc_id", "rel_path", "score")


@query("bm25_stats", "SELECT generation_id, count(*) AS n_docs, round(avg(greatest(length(content) - 2, 0)), 6) AS avg_len, count(*) FILTER (contains(lower(content), 'the')) AS n0, count(*) FILTER (contains(lower(content), 'eau')) AS n1, count(*) FILTER (contains(lower(content), 'and the')) AS n2 FROM chunks GROUP BY generation_id")
def bm25_stats(spark, d):
    return search.corpus_stats(model.chunks(spark, d), PHRASES, ["generation_id"]).withColumn("avg_len", F.round("avg_len", 6))


_RANKED = _bm25_sql("generation_id") + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, generation_id ORDER BY score DESC, rel_path, chunk_id) AS turn FROM scored)"


@query("lexical_search", _RANKED + " SELECT doc_id, generation_id, score FROM ranked WHERE turn <= 5")
def lexical_search(spark, d):
    w = Window.partitionBy("repo_id", "generation_id").orderBy(F.desc("score"), "rel_path", "chunk_id")
    return _scored(spark, d, ["generation_id"]).withColumn("turn", F.row_number().over(w)).where("turn <= 5").select("doc_id", "generation_id", "score")


@query("round_robin_merge", _RANKED + " SELECT doc_id, turn FROM ranked WHERE turn <= 32 ORDER BY turn, repo_id, generation_id LIMIT 32")
def round_robin_merge(spark, d):
    hits = _scored(spark, d, ["generation_id"])
    return search.round_robin(hits, ["repo_id", "generation_id"], [F.desc("score"), "rel_path", "chunk_id"], 32).select("doc_id", F.col("turn").cast("long").alias("turn"))


@query("fts_join_chunks", "SELECT c.chunk_id, c.rel_path, length(i.content) AS n FROM chunks c JOIN chunks i ON i.chunk_id = c.chunk_id AND i.generation_id = c.generation_id WHERE contains(lower(i.content), 'eau')")
def fts_join_chunks(spark, d):
    c = model.chunks(spark, d)
    hit = c.where(F.contains(F.lower("content"), F.lit("eau"))).select("chunk_id", "generation_id", F.length("content").cast("long").alias("n"))
    return c.select("chunk_id", "generation_id", "rel_path").join(hit, ["chunk_id", "generation_id"]).select("chunk_id", "rel_path", "n")


@query("trigram_match", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'thntbl')", False)
def trigram_match(spark, d):
    """Chunks that the postings of all the phrase's trigrams have in common are read and matched."""
    c = model.chunks(spark, d)
    some = search.candidates(search.postings(c), ["ThNtBl"])
    return search.matching(c.join(some, ["generation_id", "chunk_id"], "left_semi"), ["ThNtBl"]).select("doc_id")


@query("trigram_postings", "SELECT generation_id, chunk_id, CAST(len(list_distinct(list_transform(range(1, length(content) - 1), lambda i: substr(lower(content), i, 3)))) AS BIGINT) AS n FROM chunks WHERE length(content) > 2")
def trigram_postings(spark, d):
    return search.postings(model.chunks(spark, d)).groupBy("generation_id", "chunk_id").agg(F.count("*").alias("n"))


@query("query_terms", r"SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(list_transform(t, lambda x: lower(x)), lower(t[i])) = i)[1:64], lambda i: t[i]), ' ') AS terms FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[\pL\pN_/.\-]+'), lambda t: length(t) >= 3) AS t FROM benchmark)", False)
def query_terms(spark, d):
    return model.table(spark, d, "benchmark").select("item_id", F.array_join(search.terms_column(F.col("text")), " ").alias("terms"))


@query("fts_expression", "SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN '\"' || p_name || '\" OR (\"' || replace(p_name, ' ', '\" OR \"') || '\")' ELSE '\"' || p_name || '\"' END AS expression FROM part", False)
def fts_expression(spark, d):
    return model.table(spark, d, "part").select("p_partkey", ranking.expression(F.split("p_name", " ")).alias("expression"))


_SHORT = """, prefix AS (SELECT *, sum(size_bytes) OVER (ORDER BY chunk_id) AS used, row_number() OVER (ORDER BY chunk_id) AS n FROM chunks)"""


@query("byte_prefix", _SHORT + " SELECT chunk_id FROM prefix WHERE used <= 100000 AND n <= 64")
def byte_prefix(spark, d):
    return search.byte_prefix(model.chunks(spark, d), ["chunk_id"], F.col("size_bytes"), 64, 100_000).select("chunk_id")


@query("short_literal", _SHORT + " SELECT doc_id, 1.0::DOUBLE AS score FROM prefix WHERE used <= 4194304 AND n <= 4096 AND (contains(lower(content), 'ñ') OR contains(lower(content), 'ö'))")
def short_literal(spark, d):
    return search.short_literal(model.chunks(spark, d), search.short_terms("Ñ ö"), ["rel_path"]).select("doc_id", "score")


_SIGNALS = """, lexical AS (SELECT chunk_id, 'lexical' AS signal, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, rel_path, chunk_id)) AS part FROM scored),
exact AS (SELECT chunk_id, 'exact' AS signal, 1 + 1.0 / (60 + row_number() OVER (ORDER BY rel_path, chunk_id)) AS part FROM chunks WHERE contains(content, 'Eauouon')),
signals AS (SELECT * FROM (SELECT * FROM lexical ORDER BY part DESC LIMIT 64) UNION ALL SELECT * FROM (SELECT * FROM exact ORDER BY part DESC LIMIT 32))"""


def _lexical(spark, d):
    top = _scored(spark, d).orderBy(F.desc("score"), "rel_path", "chunk_id").limit(64)
    return ranking.ranked_signal(top, [F.desc("score"), "rel_path", "chunk_id"], "lexical", 1.0)


def _exact(spark, d):
    top = model.chunks(spark, d).where(F.contains("content", F.lit("Eauouon"))).orderBy("rel_path", "chunk_id").limit(32)
    return ranking.ranked_signal(top, ["rel_path", "chunk_id"], "exact", 1.0, base=1.0)


@query("hybrid_lexical", _bm25_sql() + _SIGNALS + " SELECT chunk_id, round(part, 9) AS part FROM signals WHERE signal = 'lexical'")
def hybrid_lexical(spark, d):
    return _lexical(spark, d).select("chunk_id", F.round("part", 9).alias("part"))


@query("hybrid_exact", _bm25_sql() + _SIGNALS + " SELECT chunk_id, round(part, 9) AS part FROM signals WHERE signal = 'exact'")
def hybrid_exact(spark, d):
    return _exact(spark, d).select("chunk_id", F.round("part", 9).alias("part"))


@query("rrf_fuse", _bm25_sql() + _SIGNALS + " SELECT chunk_id, round(sum(part), 9) AS score FROM signals GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 32")
def rrf_fuse(spark, d):
    return ranking.fuse(_lexical(spark, d).unionByName(_exact(spark, d))).select("chunk_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(32)


@query("signal_reason", _bm25_sql() + _SIGNALS + " SELECT chunk_id, string_agg(DISTINCT signal, '+' ORDER BY signal) AS reason FROM signals GROUP BY chunk_id")
def signal_reason(spark, d):
    return ranking.fuse(_lexical(spark, d).unionByName(_exact(spark, d))).select("chunk_id", "reason")


@query("signal_details", "SELECT l_orderkey AS chunk_id, array_to_string(list(l_linenumber || ':' || l_returnflag ORDER BY l_linenumber, l_linenumber || ':' || l_returnflag)[1:4], '+') AS details FROM lineitem GROUP BY l_orderkey", False)
def signal_details(spark, d):
    line = model.table(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("seq"), F.concat_ws(":", F.col("l_linenumber").cast("string"), "l_returnflag").alias("detail"))
    return ranking.first_details(rows).select("chunk_id", F.array_join("details", "+").alias("details"))


@query("fallback_chunk", "SELECT doc_id, chunk_id, CAST(end_line AS INTEGER) AS end_line, CAST(end_col AS INTEGER) AS end_col, content_hash FROM chunks")
def fallback_chunk(spark, d):
    return model.chunks(spark, d).select("doc_id", "chunk_id", "span.end_line", "span.end_col", "content_hash")


@query("canonical_span", "SELECT item_id, CAST(5 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS end_line, CAST(CASE WHEN contains(text, chr(10)) THEN 0 ELSE 7 END + strlen(string_split(text, chr(10))[-1]) AS INTEGER) AS end_col FROM benchmark", False)
def canonical_span(spark, d):
    return model.table(spark, d, "benchmark").select("item_id", spans.of(F.col("text"), F.lit(5), F.lit(7)).alias("s")).select("item_id", "s.end_line", "s.end_col")


_LINES = """, parts AS (SELECT doc_id, string_split(content, chr(10)) AS ls FROM files),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM parts)"""


@query("line_offsets", _LINES + " SELECT doc_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines")
def line_offsets(spark, d):
    return segment.line_offsets(model.files(spark, d), "doc_id", "content")


@query("line_pieces", _LINES + ", cut AS (SELECT doc_id, line, t, (SELECT max(line) FROM lines m WHERE m.doc_id = lines.doc_id) AS last FROM lines) SELECT doc_id, line, sha256(CASE WHEN line < last THEN t || chr(10) ELSE t END) AS piece FROM cut WHERE NOT (line = last AND t = '')")
def line_pieces(spark, d):
    got = model.files(spark, d).select("doc_id", F.posexplode(segment.lines(F.col("content"))).alias("i", "piece"))
    return got.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), identity.sha256(F.col("piece")).alias("piece"))


_GREEDY = """, parts AS (SELECT doc_id, content, string_split(content, chr(10)) AS ls FROM files WHERE content <> ''),
line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS t, len(ls) AS n FROM parts),
size AS (SELECT doc_id, i, n, strlen(t) + CASE WHEN i < n THEN 1 ELSE 0 END AS bytes, strlen(t) + 1 AS whole FROM line),
plain AS (SELECT doc_id, max(whole) <= 1800 AS ok FROM size GROUP BY doc_id),
fold AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS i, whole AS used, CAST(1 AS BIGINT) AS seg, bytes FROM size WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN f.used + s.whole > 1800 THEN s.whole ELSE f.used + s.whole END, CASE WHEN f.used + s.whole > 1800 THEN f.seg + 1 ELSE f.seg END, s.bytes
  FROM fold f JOIN size s ON s.doc_id = f.doc_id AND s.i = f.i + 1
), segs AS (SELECT doc_id, seg, sum(bytes) AS bytes FROM fold GROUP BY doc_id, seg HAVING sum(bytes) > 0),
cuts AS (SELECT doc_id, string_agg(CAST(CAST(bytes AS BIGINT) AS VARCHAR), ',' ORDER BY seg) AS sizes FROM segs GROUP BY doc_id)"""


@query("segment_lines", _GREEDY + " SELECT p.doc_id, sha256(p.content) AS joined, true AS within, CASE WHEN ok THEN sizes END AS sizes FROM parts p JOIN plain USING (doc_id) LEFT JOIN cuts USING (doc_id)")
def segment_lines(spark, d):
    """Segments joined again are the text; none exceeds the limit; their sizes, where no line is longer than it."""
    files = model.files(spark, d)
    got = segment.segments(files, "doc_id", "content")
    by = got.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("s"))
    size = F.transform("s", lambda x: F.octet_length(x["content"]))
    plain = files.select("doc_id", F.forall(F.split("content", "\n", -1), lambda x: F.octet_length(x) < segment.MAX_BYTES).alias("ok"))
    return by.join(plain, "doc_id").select("doc_id", identity.sha256(F.array_join(F.transform("s", lambda x: x["content"]), "")).alias("joined"), F.forall(size, lambda n: n <= segment.MAX_BYTES).alias("within"), F.when(F.col("ok"), F.array_join(F.transform(size, lambda n: n.cast("string")), ",")).alias("sizes"))


@query("bound_chunks", "SELECT doc_id, content_hash AS joined, CAST(size_bytes AS BIGINT) AS n_bytes, CAST(end_line AS INTEGER) AS end_line, CAST(end_col AS INTEGER) AS end_col, true AS adjoin FROM chunks WHERE size_bytes > 0")
def bound_chunks(spark, d):
    """Bounded chunks of a file, put together: their bytes and the last one's end point are the file's; each begins where the one before ends."""
    pieces = segment.bound(model.chunks(spark, d))
    last = F.max_by(F.col("span"), F.col("ordinal"))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "content", "span")))
    by = pieces.groupBy("doc_id").agg(rows.alias("p"), F.sum(F.octet_length("content")).alias("n_bytes"), last.alias("s"))
    begins = F.transform(F.slice("p", 2, F.size("p")), lambda x: spans.start(x["span"]))
    ends = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: F.struct(x["span"]["end_line"].alias("l"), x["span"]["end_col"].alias("c")))
    return by.select("doc_id", identity.sha256(F.array_join(F.transform("p", lambda x: x["content"]), "")).alias("joined"), "n_bytes", "s.end_line", "s.end_col", (begins == ends).alias("adjoin"))


@query("point_offset", _LINES + ", begun AS (SELECT doc_id, line, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, strlen(t) AS n FROM lines) SELECT f.doc_id, CAST(max_by(line, line) FILTER (start <= f.size_bytes // 2) AS INTEGER) AS line, CAST(f.size_bytes // 2 - max(start) FILTER (start <= f.size_bytes // 2) AS BIGINT) AS col, f.size_bytes // 2 AS back FROM files f JOIN begun USING (doc_id) GROUP BY f.doc_id, f.size_bytes")
def point_offset(spark, d):
    """The point of each text's middle byte, and the byte of that point."""
    sizes = F.transform(F.split("content", "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)
    f = model.files(spark, d).withColumn("starts", segment.prefix_sums(sizes)).withColumn("mid", F.floor(F.col("size_bytes") / 2))
    f = f.withColumn("p", segment.point_of(F.col("starts"), F.col("mid")))
    return f.select("doc_id", "p.line", "p.col", segment.offset_of(F.col("starts"), F.col("p.line"), F.col("p.col")).alias("back"))


@query("literal_slice", "SELECT doc_id, sha256(string_split(content, chr(10))[2]) AS second_line FROM files WHERE contains(content, chr(10))")
def literal_slice(spark, d):
    files = model.files(spark, d).where(F.contains("content", F.lit("\n")))
    second = F.get(F.split("content", "\n", -1), F.lit(1))
    piece = segment.literal(F.col("content"), spans.span(2, 0, F.lit(2), F.octet_length(second)))
    return files.select("doc_id", F.sha2(piece, 256).alias("second_line"))


@query("own_minus_children", "SELECT o_orderkey AS parent, sum(gap) AS own FROM (SELECT o_orderkey, greatest(l_linenumber * 10 - coalesce(max(l_linenumber * 10 + 5) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber FROM lineitem)) GROUP BY o_orderkey", False)
def own_minus_children(spark, d):
    child = model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 5).alias("end")).distinct()
    return segment.own_ranges(child, "parent", "start", "end").groupBy("parent").agg(F.sum(F.col("own_end") - F.col("own_start")).alias("own"))


@query("evidence_hash_check", "SELECT chunk_id, doc_id % 41 <> 0 AS intact FROM chunks")
def evidence_hash_check(spark, d):
    c = model.chunks(spark, d).withColumn("content", F.when(F.col("doc_id") % 41 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    return c.select("chunk_id", (identity.sha256(F.col("content")) == F.col("content_hash")).alias("intact"))
