"""Stored tables and what is found in them: index, sinks, intervals, owned chunks, admission, packets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import runtime
from tessera.functions import identity, spans
from tessera.functions.fold import fold
from tessera.operators import admission, intervals, ownership, packets, ranking, resolve, segment, sinks, snapshots, storage, trigrams
from tessera.plans import model
from tessera.plans.registry import query

_SOUGHT = ["eau", "tion the", "THAT", "of. the", "zzzz"]


@query("trigram_stored", f" SELECT phrase, doc_id FROM chunks, (VALUES {', '.join(f"('{p}')" for p in _SOUGHT)}) v(phrase) WHERE contains(lower(content), lower(phrase))")
def trigram_stored(spark, d):
    """An index is stored, then asked for five phrases, one of which stands nowhere."""
    path = runtime.shared_path(spark)
    trigrams.store(model.chunks(spark, d).select("doc_id", "generation_id", "chunk_id", "content"), path)
    found = [trigrams.matches(spark, path, p).select(F.lit(p).alias("phrase"), "doc_id") for p in _SOUGHT]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_PLANTED = ["Straße", "STRASSE", "ΟΔΟΣ", "οδός", "ﬁn", "Kelvin K"]


@query("folded_match", " SELECT doc_id, contains(f, 'strasse') AS street, contains(f, 'οδοσ') AS way, contains(f, 'fin') AS fin, contains(f, 'kelvin k') AS kelvin FROM (SELECT doc_id, replace(replace(replace(replace(lower(content || ' ' || [" + ", ".join(f"'{p}'" for p in _PLANTED) + "][1 + doc_id % 6]), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), chr(8490), 'k') AS f FROM files)")
def folded_match(spark, d):
    """Folded texts, with letters that lower case alone leaves apart planted in each."""
    word = F.get(F.array(*[F.lit(p) for p in _PLANTED]), (F.col("doc_id") % 6).cast("int"))
    f = model.files(spark, d).select("doc_id", fold(F.concat("content", F.lit(" "), word)).alias("f"))
    has = lambda p, name: F.contains("f", F.lit(p.casefold())).alias(name)
    return f.select("doc_id", has("Strasse", "street"), has("οδοΣ", "way"), has("FIN", "fin"), has("KELVIN K", "kelvin"))


@query("interval_join", """SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT o_orderkey, o_orderkey * 8 + 2 AS s, o_orderkey * 8 + 2 + CASE WHEN o_orderkey % 500 = 7 THEN 2000 ELSE o_custkey % 12 END AS e FROM orders) o
JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey * 8 + l_linenumber AS s2, l_orderkey * 8 + l_linenumber + l_partkey % 7 AS e2 FROM lineitem) l ON s < e2 AND e > s2""", False)
def interval_join(spark, d):
    """All spans of one file: empty, short and long ones."""
    k, line = F.col("o_orderkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    o = model.table(spark, d, "orders").select(F.lit(1).alias("file"), k, (k * 8 + 2).alias("s"), (k * 8 + 2 + F.when(k % 500 == 7, 2000).otherwise(F.col("o_custkey") % 12)).alias("e"))
    li = model.table(spark, d, "lineitem").select(F.lit(1).alias("file"), "l_orderkey", "l_linenumber", "l_partkey", line.alias("s2"), (line + F.col("l_partkey") % 7).alias("e2"))
    met = intervals.overlap_join(o, li, ["file"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")))
    return met.select("o_orderkey", "l_orderkey", "l_linenumber", "l_partkey")


_OWNED = r""", cut AS (SELECT doc_id, string_split(content, chr(10)) AS parts FROM files WHERE content <> ''),
line AS (SELECT doc_id, i - 1 AS i, parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS t FROM cut, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
held AS (SELECT doc_id, i, t, i // 8 AS g, CASE i % 8 WHEN 0 THEN 'm' WHEN 1 THEN 'm' WHEN 3 THEN 'b' || i // 8 WHEN 5 THEN 'b' || i // 8 WHEN 4 THEN 'c' || i // 8 ELSE 'a' || i // 8 END AS owner_id, sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM line WHERE t <> ''),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, owner_id ORDER BY i) AS r FROM held)"""


@query("owned_chunks", _OWNED + r""" SELECT doc_id, owner_id, CAST(min(e - strlen(t)) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end", sha256(string_agg(t, '' ORDER BY i)) AS content_sha256 FROM run GROUP BY doc_id, owner_id, r HAVING NOT regexp_full_match(string_agg(t, '' ORDER BY i), '\s*')""")
def owned_chunks(spark, d):
    """Definitions within definitions, by lines of each text: a (lines 2-7 of each 8), in it b (3-5), in it c (4)."""
    files = model.files(spark, d).where("content <> ''").select(F.col("doc_id").alias("file_id"), "content")
    line = files.select("file_id", F.posexplode(segment.lines(F.col("content"))).alias("i", "t")).select("file_id", "i", F.octet_length("t").cast("long").alias("n"))
    end = F.sum("n").over(Window.partitionBy("file_id").orderBy("i"))
    line = line.withColumn("end", end).withColumns({"start": F.col("end") - F.col("n"), "g": F.floor(F.col("i") / 8).cast("string"), "k": F.col("i") % 8})
    whole = files.select("file_id", F.lit("m").alias("entity_id"), F.lit("MODULE").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("start"), F.octet_length("content").cast("long").alias("end"))
    out = whole
    for name, parent, low, high in (("a", "m", 2, 7), ("b", "a", 3, 5), ("c", "b", 4, 4)):
        up = F.lit("m") if parent == "m" else F.concat(F.lit(parent), "g")
        own = line.where(F.col("k").between(low, high)).groupBy("file_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        out = out.unionByName(own.select("file_id", F.concat(F.lit(name), "g").alias("entity_id"), F.lit("FUNCTION").alias("kind"), up.alias("parent_id"), "start", "end"))
    got = ownership.owned(files, runtime.settled(out))
    return got.select(F.col("file_id").alias("doc_id"), "owner_id", "start", "end", identity.sha256(F.col("content")).alias("content_sha256"))


@query("ownership_faults", """, d AS (SELECT o_custkey AS file_id, o_orderkey, o_orderkey % 40 AS s, o_orderkey % 40 + 1 + o_orderkey % 7 AS e FROM orders),
f AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e, 'o' || o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT file_id, 'o' || o_orderkey AS entity_id, CASE WHEN e > 42 THEN 'outside its parent' ELSE 'siblings cross' END AS fault FROM f WHERE e > 42 OR s < before
UNION ALL SELECT DISTINCT o_custkey, NULL, 'no single module' FROM orders WHERE o_custkey % 10 = 0""")
def ownership_faults(spark, d):
    """Orders as definitions of their customer's file, which holds 42 bytes."""
    o, key = model.table(spark, d, "orders"), F.col("o_orderkey")
    own = o.select(F.col("o_custkey").alias("file_id"), F.concat(F.lit("o"), key.cast("string")).alias("entity_id"), F.lit("FUNCTION").alias("kind"), F.lit("m").alias("parent_id"), (key % 40).alias("start"), (key % 40 + 1 + key % 7).alias("end"))
    file = o.select(F.col("o_custkey").alias("file_id")).distinct()
    module = file.select("file_id", F.lit("m").alias("entity_id"), F.when(F.col("file_id") % 10 == 0, "CLASS").otherwise("MODULE").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("start"), F.lit(42).alias("end"))
    return ownership.faults(module.unionByName(own))


@query("sink_partitions", """ SELECT doc_id, generation_id, size_bytes FROM (SELECT doc_id, 'g' || doc_id % 5 AS generation_id, CASE WHEN doc_id % 5 = 1 THEN size_bytes + 1 WHEN doc_id % 5 = 2 AND doc_id % 3 = 0 THEN -1 ELSE size_bytes END AS size_bytes FROM files)
WHERE NOT (generation_id = 'g1' AND doc_id % 2 = 1) AND NOT (generation_id = 'g2' AND doc_id % 7 = 0)""")
def sink_partitions(spark, d):
    """All generations written; one replaced as a whole, in one listed rows dropped and some brought anew; read back."""
    f = model.files(spark, d).select("doc_id", F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string")).alias("generation_id"), "size_bytes")
    path = runtime.shared_path(spark)
    sinks.put(f, path)
    sinks.put(f.where("generation_id = 'g1' AND doc_id % 2 = 0").withColumn("size_bytes", F.col("size_bytes") + 1), path)
    listed = f.where("generation_id = 'g2' AND (doc_id % 7 = 0 OR doc_id % 3 = 0)")
    sinks.replace_rows(spark, path, listed, listed.where("doc_id % 7 <> 0").withColumn("size_bytes", F.lit(-1).cast("long")), "doc_id")
    return spark.read.parquet(path).select("doc_id", F.col("generation_id").cast("string").alias("generation_id"), "size_bytes")


_SHAPES = """CASE event_id % 8 WHEN 1 THEN replace(props, '}', '') WHEN 2 THEN '[' || props || ']' WHEN 3 THEN '{"k": "x"}' WHEN 4 THEN '{"k": ' || event_id || '.5}' WHEN 5 THEN '{"k": ' || event_id % 200 || ', "tags": {}}' WHEN 6 THEN '{"k": 5, "tags": ["a", "b"]}' ELSE props END"""


@query("json_admission", f"""SELECT event_id, CASE WHEN user_id < 0 OR event_type IS NULL THEN 'columns' WHEN NOT json_valid(p) THEN 'json' WHEN json_type(p) <> 'OBJECT' THEN 'object' WHEN coalesce(json_type(p, '$.k'), '') NOT IN ('UBIGINT', 'BIGINT') THEN 'k is an integer' WHEN CAST(json_extract(p, '$.k') AS BIGINT) NOT BETWEEN 0 AND 99 THEN 'k in range' WHEN json_type(p, '$.tags') IS NOT NULL AND json_type(p, '$.tags') <> 'ARRAY' THEN 'tags are a list' END AS broken
FROM (SELECT *, {_SHAPES} AS p FROM events)""", False)
def json_admission(spark, d):
    """The first rule each event breaks, with malformed and mistyped properties planted."""
    e, k, p = model.table(spark, d, "events"), F.col("event_id"), F.col("props")
    text = F.get(F.array(p, F.replace(p, F.lit("}"), F.lit("")), F.concat(F.lit("["), p, F.lit("]")), F.lit('{"k": "x"}'), F.concat(F.lit('{"k": '), k.cast("string"), F.lit(".5}")), F.concat(F.lit('{"k": '), (k % 200).cast("string"), F.lit(', "tags": {}}')), F.lit('{"k": 5, "tags": ["a", "b"]}'), p), (k % 8).cast("int"))
    e = e.withColumn("v", admission.parsed(text))
    v = F.col("v")
    rules = {
        "columns": (F.col("user_id") >= 0) & F.col("event_type").isNotNull(),
        "json": v.isNotNull(),
        "object": admission.is_json(v, "$", "object"),
        "k is an integer": admission.is_json(v, "$.k", "integer"),
        "k in range": F.try_variant_get(v, "$.k", "long").between(0, 99),
        "tags are a list": F.coalesce(admission.is_json(v, "$.tags", "array"), F.lit(True)),
    }
    return e.select("event_id", admission.first_broken(rules).alias("broken"))


@query("constraint_report", """SELECT * FROM (
  SELECT 'customer(c_custkey) unique' AS "constraint", count(*) AS broken, min(CAST(c_custkey AS VARCHAR)) AS example FROM customer WHERE c_custkey % 100 = 3
  UNION ALL SELECT 'orders(o_custkey) -> customer(c_custkey)', count(*), min(CAST(o_custkey AS VARCHAR)) FROM orders WHERE o_custkey % 100 = 5 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'nation.n_name present', count(*), '' FROM nation WHERE n_nationkey % 7 = 0
  UNION ALL SELECT 'customer(c_nationkey) -> nation(n_nationkey)', count(*), min(CAST(c_nationkey AS VARCHAR)) FROM (FROM customer WHERE c_custkey % 100 <> 5 UNION ALL FROM customer WHERE c_custkey % 100 = 3) c WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'lineitem(l_orderkey) -> orders(o_orderkey)', count(*), min(CAST(l_orderkey AS VARCHAR)) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'lineitem(l_partkey) -> part(p_partkey)', count(*), min(CAST(l_partkey AS VARCHAR)) FROM lineitem WHERE l_partkey % 500 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'lineitem(l_suppkey) -> supplier(s_suppkey)', count(*), min(CAST(l_suppkey AS VARCHAR)) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
) WHERE broken > 0""", False)
def constraint_report(spark, d):
    """Keys and references of seven tables; customers repeated and missing, names and parts missing."""
    t = {n: model.table(spark, d, n) for n in ("customer", "orders", "nation", "lineitem", "part", "supplier")}
    c = t["customer"]
    t["customer"] = c.where("c_custkey % 100 <> 5").unionByName(c.where("c_custkey % 100 = 3"))
    t["nation"] = t["nation"].withColumn("n_name", F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")))
    t["part"] = t["part"].where("p_partkey % 500 <> 0")
    declared = [admission.Unique("customer", ("c_custkey",)), admission.Unique("nation", ("n_nationkey",)), admission.Present("nation", "n_name")]
    declared += [admission.Reference(a, (x,), b, (y,)) for a, x, b, y in (("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))]
    return admission.violations(t, declared)


@query("snapshot_streamed", " SELECT repo_id, sha256('{\"files\":[' || string_agg('[\"' || rel_path || '\",\"' || content_hash || '\"]', ',' ORDER BY rel_path, content_hash) || '],\"schema\":\"tessera-snapshot-v1\"}') AS snapshot FROM files GROUP BY repo_id")
def snapshot_streamed(spark, d):
    return snapshots.hashes(model.files(spark, d), "repo_id")


@query("verify_packets", " SELECT doc_id AS packet_id, CASE WHEN doc_id % 11 = 0 THEN 'INVALID_PACKET' WHEN doc_id % 43 = 0 THEN 'SOURCE_UNAVAILABLE' WHEN doc_id % 7 = 0 THEN 'STALE_SOURCE' WHEN doc_id % 5 = 0 THEN 'INVALID_SPAN' WHEN doc_id % 3 = 0 THEN 'PROVENANCE_MISMATCH' ELSE 'OK' END AS verdict FROM files WHERE content <> ''")
def verify_packets(spark, d):
    """A packet of each piece of each text; shapes, files, spans and sources of some texts' packets are damaged, all alike."""
    k, span = F.col("doc_id"), F.col("span")
    whole = model.chunks(spark, d).where("content <> ''").withColumn("file_sha256", F.col("content_hash"))
    c = runtime.settled(segment.bound(whole))
    four = packets.points(span)
    place = {"path": F.col("rel_path"), "span": F.when(k % 5 == 0, F.transform(four, lambda x, i: F.when(i == 2, x + 1000000).otherwise(x))).otherwise(four), "file_sha256": F.col("file_sha256"), "coverage": F.struct(F.lit(None).cast("array<int>").alias("symbol_span"), F.lit(False).alias("complete"))}
    said = F.when(k % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    row = F.struct(*[v.alias(n) for n, v in place.items()], said.alias("source"), identity.sha256(said).alias("source_sha256"), F.lit("x").alias("reason"), F.lit(1.0).alias("score"), F.array().cast("array<struct<path:string,span:array<int>,file_sha256:string,coverage:struct<symbol_span:array<int>,complete:boolean>>>").alias("aliases"))
    limits = F.struct(F.lit(8192).alias("packet_bytes"), F.when(k % 11 == 0, 21).otherwise(5).alias("fragments"), F.lit(packets.CANDIDATES).alias("candidates"), F.lit("UTF-8 bytes").alias("unit"))
    left = F.struct(*[F.lit(0).alias(n) for n in ("duplicate", "budget", "limit")])
    packet = F.to_json(F.struct(F.lit("tessera-packet").alias("schema"), F.lit(2).alias("version"), F.lit("OK").alias("status"), F.col("file_sha256").alias("snapshot_sha256"), F.lit(False).alias("refreshed"), limits.alias("limits"), F.array(row).alias("selected"), left.alias("omitted")))
    now = model.files(spark, d).where("doc_id % 43 <> 0").select("rel_path", F.when(k % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("now"))
    asked = c.select(F.concat_ws(":", k.cast("string"), F.col("ordinal").cast("string")).alias("packet_id"), packet.alias("packet"))
    told = packets.verdicts(asked, lambda paths: now.join(paths.withColumnRenamed("path", "rel_path"), "rel_path", "left_semi"))
    return told.select(F.substring_index("packet_id", ":", 1).cast("long").alias("packet_id"), "verdict").distinct()


_SYMBOL = """SELECT chunk_id, reason AS signal, round(1 + 1.0 / (60 + rank), 9) AS part FROM (
  SELECT e.*, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY c.s, c.e, chunk_id) AS turn FROM
    (SELECT *, row_number() OVER (ORDER BY file, s, entity_id) AS rank FROM (SELECT 'p' || p_partkey AS entity_id, 'exact_short_name' AS reason, p_size AS file, p_partkey AS s, p_partkey + 3 + p_partkey % 40 AS e FROM part WHERE p_name = 'hot bolt' ORDER BY file, s, entity_id LIMIT 128)) e
    JOIN (SELECT 'k' || p_partkey AS chunk_id, p_size AS file, p_partkey - 9 AS s, p_partkey + 11 + p_partkey % 30 AS e FROM part) c ON e.file = c.file AND e.s < c.e AND e.e > c.s) WHERE turn <= 4"""


@query("symbol_signal", _SYMBOL, False)
def symbol_signal(spark, d):
    """Definitions of one short name, ranked by place, to the chunks they overlap."""
    p, key = model.table(spark, d, "part"), F.col("p_partkey")
    name = lambda kind: F.concat(F.lit(kind), key.cast("string"))
    e = p.select(name("p").alias("entity_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.col("p_size").alias("file_id"), spans.span(key, 0, key + 3 + key % 40, 0).alias("own"))
    c = p.select(name("k").alias("chunk_id"), F.col("p_size").alias("file_id"), spans.span(key - 9, 0, key + 11 + key % 30, 0).alias("span"))
    found = resolve.exact_candidates(e, "hot bolt", ["file_id", "own"]).join(e, "entity_id")
    rank = F.row_number().over(Window.orderBy("file_id", "own", "entity_id"))  # of at most MAX_EXACT rows
    got = ranking.symbol_signal(found.select("entity_id", "file_id", "own", "reason", rank.alias("rank")), c, 4)
    return got.withColumn("part", F.round("part", 9))


@query("packet_rollup", """ SELECT coalesce(source, '') AS arm, count(*) AS runs, count(*) FILTER (doc_id % 11 = 0) AS unreadable, count(*) FILTER (doc_id % 11 <> 0 AND n BETWEEN 1 AND 1000) AS ok, count(*) FILTER (doc_id % 11 <> 0 AND n = 0) AS empty, count(*) FILTER (doc_id % 11 <> 0 AND n > 1000) AS budget_exhausted,
  count(*) FILTER (doc_id % 11 <> 0 AND n BETWEEN 1 AND 1000) AS fragments, CAST(coalesce(sum(n) FILTER (doc_id % 11 <> 0 AND n <= 1000), 0) AS BIGINT) AS source_bytes, CAST(coalesce(sum(doc_id % 3) FILTER (doc_id % 11 <> 0 AND n BETWEEN 1 AND 1000), 0) AS BIGINT) AS omitted_duplicate, count(*) FILTER (doc_id % 11 <> 0 AND n > 1000) AS omitted_budget, CAST(0 AS BIGINT) AS omitted_limit
  FROM (SELECT doc_id, source, strlen(coalesce(text, '')) AS n FROM documents) GROUP BY coalesce(source, '')""")
def packet_rollup(spark, d):
    """A packet of each text, of 1,000 bytes of source at most, rolled up by the text's source; some are cut off."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n = F.octet_length(text)
    fits, over = n.between(1, 1000), n > 1000
    row = F.struct(F.lit("a").alias("path"), text.alias("source"))
    left = F.struct(F.when(fits, k % 3).otherwise(0).alias("duplicate"), F.when(over, 1).otherwise(0).alias("budget"), F.lit(0).alias("limit"))
    status = F.when(fits, "OK").when(over, "BUDGET_EXHAUSTED").otherwise("EMPTY")
    packet = F.to_json(F.struct(F.lit("tessera-packet").alias("schema"), F.lit(2).alias("version"), status.alias("status"), F.when(fits, F.array(row)).otherwise(F.array().cast("array<struct<path:string,source:string>>")).alias("selected"), left.alias("omitted")))
    packet = F.when(k % 11 == 0, F.substring(packet, 1, 20)).otherwise(packet)
    arms = model.table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("arm"), packet.alias("packet"))
    return packets.rollup(arms, ["arm"])


_PATHS = """, e AS (SELECT event_id AS entity_id, event_id AS generation_id, CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS repo_id, event_id % 5 AS file_id, CASE WHEN event_id % 3 = 0 THEN 'hint/' || event_id WHEN event_id % 3 = 1 THEN '' END AS hint FROM events),
f AS (SELECT event_id AS generation_id, event_id % 5 AS file_id, event_type || '/' || event_id AS rel_path FROM events WHERE event_id % 2 = 0)"""


def _history(spark, d):
    """(entities, files) of each event's generation; every seventh entity names another repository."""
    e, k = model.table(spark, d, "events"), F.col("event_id")
    repo = F.when(k % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    hint = F.when(k % 3 == 0, F.concat(F.lit("hint/"), k.cast("string"))).when(k % 3 == 1, "")
    entities = e.select(k.alias("entity_id"), k.alias("generation_id"), repo.alias("repo_id"), (k % 5).alias("file_id"), hint.alias("rel_path"))
    return entities, e.where(k % 2 == 0).select(k.alias("generation_id"), (k % 5).alias("file_id"), F.concat_ws("/", "event_type", k.cast("string")).alias("rel_path"))


@query("entity_paths", _PATHS + " SELECT entity_id, coalesce(nullif(hint, ''), f.rel_path, '~') AS rel_path FROM e JOIN generations g ON g.generation_id = e.generation_id AND g.repo_id = e.repo_id LEFT JOIN f ON f.generation_id = e.generation_id AND f.file_id = e.file_id")
def entity_paths(spark, d):
    entities, files = _history(spark, d)
    return storage.with_paths(entities, model.generations(spark, d), files).select("entity_id", "rel_path")


@query("lookup_active", _PATHS + " SELECT generation_id, file_id, rel_path FROM f WHERE file_id IN (SELECT n_regionkey + 1 FROM nation) AND generation_id IN (SELECT generation_id FROM generations WHERE is_active)")
def lookup_active(spark, d):
    """Files by id in whatever generation is active."""
    keys = model.table(spark, d, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("file_id"))
    return storage.lookup(_history(spark, d)[1], keys, model.generations(spark, d)).select("generation_id", "file_id", "rel_path")


@query("lookup_generation", _PATHS + " SELECT generation_id, file_id, rel_path FROM f WHERE (file_id, generation_id) IN (SELECT p_size % 5, p_partkey FROM part)")
def lookup_generation(spark, d):
    """Files by id in the generation that the key names."""
    keys = model.table(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("file_id"), F.col("p_partkey").cast("long").alias("generation_id"))
    return storage.lookup(_history(spark, d)[1], keys, model.generations(spark, d)).select("generation_id", "file_id", "rel_path")
