"""Scans, lookups, predicates, sinks, set operations and validations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity, spans
from tessera.operators import graph, search, storage
from tessera.plans import model
from tessera.plans.registry import query



@query("scan_hash", "SELECT rel_path, content_hash, size_bytes FROM files WHERE size_bytes <= 16777216")
def scan_hash(spark, d):
    return model.files(spark, d).where(F.col("size_bytes") <= storage.MAX_FILE_BYTES).select("rel_path", "content_hash", "size_bytes")


@query("path_policy", "SELECT doc_id, doc_id % 9 IN (0, 6, 8) AS allowed FROM files")
def path_policy(spark, d):
    k, path = F.col("doc_id") % 9, F.col("rel_path")
    odd = [path, F.concat(F.lit("node_modules/"), path), F.concat(path, F.lit(".PNG")), F.concat(F.lit("a/.idea/"), path), F.concat(F.lit("../"), path), F.concat(F.lit("cache.db/"), path), F.concat(path, F.lit(".jsonl.py")), F.concat(path, F.lit(".jsonl")), F.replace(path, F.lit("/"), F.lit("\\"))]
    return model.files(spark, d).select("doc_id", storage.path_allowed(F.get(F.array(*odd), k.cast("int"))).alias("allowed"))


@query("binary_filter", "SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN true ELSE (doc_id % 1000) * 10 > least(8192, doc_id % 1000 + size_bytes) END AS is_binary FROM files")
def binary_filter(spark, d):
    """Texts after so many control characters as their id tells, some with an end that is no UTF-8."""
    k = (F.col("doc_id") % 1000).cast("int")
    raw = F.concat(F.repeat(F.lit("\x01"), k).cast("binary"), F.col("content").cast("binary"), F.when(F.col("doc_id") % 8 == 7, F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit(""))))
    return model.files(spark, d).select("doc_id", storage.is_binary(raw).alias("is_binary"))


@query("snapshot_bound_read", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'MISMATCH' ELSE 'OK' END AS state FROM files")
def snapshot_bound_read(spark, d):
    files = model.files(spark, d)
    now = files.select("rel_path", "doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return storage.bound_read(files.select("rel_path", "content_hash"), now).select("doc_id", "state")


@query("generation_scan", "SELECT file_id, rel_path, content_hash FROM files WHERE generation_id = 'gen_repo_' || substr(sha256('src3'), 1, 16)")
def generation_scan(spark, d):
    wanted = F.concat(F.lit("gen_"), identity.repo_id(F.lit("src3")))
    return model.files(spark, d).where(F.col("generation_id") == wanted).select("file_id", "rel_path", "content_hash")


@query("point_lookup", "SELECT repo_id, generation_id, sequence FROM generations WHERE is_active AND repo_id IN (1, 2, 3, 5, 8)")
def point_lookup(spark, d):
    g = model.generations(spark, d)
    active = g.where("is_active").select("generation_id")
    return g.where(F.col("repo_id").isin(1, 2, 3, 5, 8)).join(active, "generation_id", "left_semi").select("repo_id", "generation_id", "sequence")


@query("active_semi", "SELECT g.repo_id, count(*) AS n FROM generations g WHERE g.repo_id IN (SELECT repo_id FROM generations WHERE is_active AND sequence > 5) GROUP BY g.repo_id")
def active_semi(spark, d):
    g = model.generations(spark, d)
    return g.join(g.where("is_active AND sequence > 5").select("repo_id"), "repo_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("n"))


@query("upsert_last_wins", "SELECT user_id AS k, max_by(event_id, (ts, event_id)) AS v FROM events GROUP BY user_id", False)
def upsert_last_wins(spark, d):
    return storage.last_wins(model.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"v": "event_id"}).select(F.col("user_id").alias("k"), "v")


@query("replace_by_key", "SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars + 1 ELSE n_chars END AS n FROM documents", False)
def replace_by_key(spark, d):
    t = model.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    new = t.where("lang = 'en'").withColumn("n", F.col("n") + 1)
    return storage.replace(t, new, ["doc_id"]).drop("lang")


@query("file_chunks", "SELECT file_id, chunk_id FROM chunks WHERE rel_path LIKE 'src1/en/%'")
def file_chunks(spark, d):
    return model.chunks(spark, d).where(F.col("rel_path").startswith("src1/en/")).select("file_id", "chunk_id")


@query("activate_flip", "SELECT repo_id, generation_id, coalesce(sequence = max(CASE WHEN lifecycle = 'COMMITTED' AND sequence <= 3 THEN sequence END) OVER (PARTITION BY repo_id), false) AS is_active FROM generations")
def activate_flip(spark, d):
    g = model.generations(spark, d)
    target = g.where("lifecycle = 'COMMITTED' AND sequence <= 3").groupBy("repo_id").agg(F.max("sequence").alias("target"))
    return storage.activate(g, target).select("repo_id", "generation_id", "is_active")


@query("metadata_merge", "SELECT user_id, coalesce(max_by(event_type, (ts, event_id)), '') AS last_type, count(DISTINCT event_type) AS n_keys FROM events GROUP BY user_id", False)
def metadata_merge(spark, d):
    e = model.table(spark, d, "events")
    merged = storage.merge_metadata(e.select("user_id", "ts", "event_id", F.create_map(F.lit("last"), F.col("event_type"), F.concat(F.lit("k_"), "event_type"), F.lit("1")).alias("metadata")), "user_id", ["ts", "event_id"], "metadata")
    return merged.select("user_id", F.col("metadata")["last"].alias("last_type"), (F.size("metadata") - 1).cast("long").alias("n_keys"))


@query("project_struct", "SELECT chunk_id, 1 AS start_line, 0 AS start_col, CAST(end_line AS INTEGER) AS end_line, CAST(end_col AS INTEGER) AS end_col FROM chunks")
def project_struct(spark, d):
    return model.chunks(spark, d).select("chunk_id", "span.*")


@query("name_scope_lookup", "SELECT entity_id, kind FROM entities WHERE (name = 'order_7' OR qualified_name = 'n3.' || name) AND kind <> ''")
def name_scope_lookup(spark, d):
    e = model.entities(spark, d)
    return e.where((F.col("name") == "order_7") | (F.col("qualified_name") == F.concat(F.lit("n3."), "name"))).select("entity_id", "kind")


@query("suffix_before_limit", "SELECT entity_id, qualified_name FROM entities WHERE substr(qualified_name, -3) = '.order_9' OR suffix(qualified_name, '_19') ORDER BY qualified_name, entity_id LIMIT 5")
def suffix_before_limit(spark, d):
    return model.entities(spark, d).where(F.col("qualified_name").endswith("_19")).select("entity_id", "qualified_name").orderBy("qualified_name", "entity_id").limit(5)


@query("span_overlap", "SELECT chunk_id FROM chunks WHERE (1, 0) < (3, 5) AND (end_line, end_col) > (2, 10)")
def span_overlap(spark, d):
    return model.chunks(spark, d).where(spans.overlaps(F.col("span"), spans.span(2, 10, 3, 5))).select("chunk_id")


@query("array_member", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_contains(list('o' || o_orderkey), 'o7') OR list_contains(list('o' || o_orderkey), 'o11')", False)
def array_member(spark, d):
    o = model.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("ids"))
    return o.where(F.array_contains("ids", "o7") | F.array_contains("ids", "o11")).select("o_custkey")


@query("literal_scan", "SELECT rel_path, content_hash FROM files WHERE contains(lower(content), 'the and') ORDER BY rel_path, content_hash LIMIT 32")
def literal_scan(spark, d):
    return search.literal_hits(model.files(spark, d), "The AND").select("rel_path", "content_hash").orderBy("rel_path", "content_hash").limit(32)


@query("test_path_flag", "SELECT rel_path, contains(p, '/test') OR contains(p, 'test_') OR contains(p, '_test') OR contains(p, 'tests/') AS is_test FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'src/Test_' || rel_path ELSE rel_path END AS rel_path, lower(CASE WHEN doc_id % 4 = 0 THEN 'src/Test_' || rel_path ELSE rel_path END) AS p FROM files)")
def test_path_flag(spark, d):
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("src/Test_"), "rel_path")).otherwise(F.col("rel_path"))
    return model.files(spark, d).select(path.alias("rel_path")).select("rel_path", storage.is_test_path(F.col("rel_path")).alias("is_test"))


@query("ident_gate", "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9_.:]+') AS is_identifier FROM part", False)
def ident_gate(spark, d):
    return model.table(spark, d, "part").select("p_partkey", storage.is_identifier(F.col("p_name")).alias("is_identifier"))


@query("generation_counts", "SELECT generation_id, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM files GROUP BY generation_id")
def generation_counts(spark, d):
    return model.files(spark, d).groupBy("generation_id").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


@query("one_active_per_repo", "SELECT repo_id, count(*) AS n FROM generations WHERE is_active OR generation_id % 97 = 0 GROUP BY repo_id HAVING count(*) > 1")
def one_active_per_repo(spark, d):
    return model.generations(spark, d).where("is_active OR generation_id % 97 = 0").groupBy("repo_id").agg(F.count("*").alias("n")).where("n > 1")


@query("next_sequence", "SELECT repo_id, max(sequence) + 1 AS next FROM generations GROUP BY repo_id")
def next_sequence(spark, d):
    return model.generations(spark, d).groupBy("repo_id").agg((F.max("sequence") + 1).cast("long").alias("next"))


@query("snapshot_hash", """SELECT generation_id, sha256('{"files":[' || string_agg('["' || rel_path || '","' || content_hash || '"]', ',' ORDER BY rel_path) || '],"schema":"tessera-snapshot-v1"}') AS snapshot_hash FROM files GROUP BY generation_id""")
def snapshot_hash(spark, d):
    pairs = F.collect_list(F.array("rel_path", "content_hash"))
    return model.files(spark, d).groupBy("generation_id").agg(identity.snapshot_hash(pairs).alias("snapshot_hash"))


@query("generation_retention", "SELECT repo_id, generation_id, CASE WHEN is_active OR (lifecycle = 'COMMITTED' AND r <= 3) THEN 'KEEP' ELSE 'DROP' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, lifecycle ORDER BY sequence DESC) AS r FROM generations)")
def generation_retention(spark, d):
    return storage.retention(model.generations(spark, d), 3).select("repo_id", "generation_id", "action")


@query("conflict_dedupe", "SELECT p_name AS id, count(DISTINCT p_brand || ':' || p_size) AS versions, count(DISTINCT p_brand || ':' || p_size) > 1 AS conflict FROM part GROUP BY p_name", False)
def conflict_dedupe(spark, d):
    p = model.table(spark, d, "part").select(F.col("p_name").alias("id"), F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("value"))
    return storage.conflicts(p, "id", "value")


@query("terms_dedupe", "SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(list_transform(t, lambda x: lower(x)), lower(t[i])) = i), lambda i: t[i]), ' ') AS terms FROM (SELECT p_partkey, list_filter(string_split(upper(p_name) || ' ' || p_name || ' ' || p_type, ' '), lambda x: length(x) >= 3) AS t FROM part)", False)
def terms_dedupe(spark, d):
    from tessera.operators import search

    return model.table(spark, d, "part").select("p_partkey", F.array_join(search.terms_column(F.concat_ws(" ", F.upper("p_name"), "p_name", "p_type")), " ").alias("terms"))


@query("eval_rollup", "SELECT event_type AS arm, count(*) AS runs, count(*) FILTER (value >= 50) AS correct FROM events GROUP BY event_type", False)
def eval_rollup(spark, d):
    return model.table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("runs"), F.count_if(F.col("value") >= 50).alias("correct"))


_PREVIOUS = """previous AS (
  SELECT rel_path, CASE WHEN doc_id % 7 = 0 THEN sha256(content || 'x') ELSE content_hash END AS content_hash FROM files WHERE doc_id % 11 <> 0
  UNION ALL SELECT rel_path || '.old', content_hash FROM files WHERE doc_id % 13 = 0)"""


def _previous(files):
    old = files.where("doc_id % 11 <> 0").select("rel_path", F.when(F.col("doc_id") % 7 == 0, identity.sha256(F.concat("content", F.lit("x")))).otherwise(F.col("content_hash")).alias("content_hash"))
    return old.unionByName(files.where("doc_id % 13 = 0").select(F.concat("rel_path", F.lit(".old")).alias("rel_path"), "content_hash"))


@query("snapshot_diff", f", {_PREVIOUS} SELECT coalesce(f.rel_path, p.rel_path) AS rel_path, CASE WHEN p.rel_path IS NULL THEN 'ADDED' WHEN f.rel_path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM files f FULL JOIN previous p ON f.rel_path = p.rel_path WHERE p.content_hash IS DISTINCT FROM f.content_hash")
def snapshot_diff(spark, d):
    files = model.files(spark, d)
    return storage.diff(files.select("rel_path", "content_hash"), _previous(files))


@query("path_except", f", {_PREVIOUS} SELECT rel_path FROM files EXCEPT SELECT rel_path FROM previous")
def path_except(spark, d):
    files = model.files(spark, d)
    return files.select("rel_path").subtract(_previous(files).select("rel_path"))


@query("path_intersect", f", {_PREVIOUS} SELECT rel_path FROM files INTERSECT SELECT rel_path FROM previous")
def path_intersect(spark, d):
    files = model.files(spark, d)
    return files.select("rel_path").intersect(_previous(files).select("rel_path"))


@query("id_symdiff", "SELECT doc_id, 'only_files' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only_labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", False)
def id_symdiff(spark, d):
    a, b = (model.table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    return storage.symmetric_difference(a, b, "only_files", "only_labels")


@query("row_admission", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey IS NOT NULL AND o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F'))", False)
def row_admission(spark, d):
    rules = [F.col("o_orderkey").isNotNull(), F.col("o_totalprice") >= 1000, F.col("o_orderstatus").isin("O", "F")]
    return storage.inadmissible(model.table(spark, d, "orders"), rules).select("o_orderkey")


@query("span_valid", "SELECT l_orderkey, l_linenumber, (l_linenumber > 2 OR (l_linenumber = 2 AND CAST(l_quantity AS INTEGER) >= 30)) AS valid FROM lineitem", False)
def span_valid(spark, d):
    s = spans.span(F.lit(2), F.lit(30), F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    return model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", spans.valid(s).alias("valid"))


@query("chunk_identity", "SELECT chunk_id, doc_id % 17 <> 0 AS ok FROM chunks")
def chunk_identity(spark, d):
    c = model.chunks(spark, d).withColumn("content", F.when(F.col("doc_id") % 17 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return c.select("chunk_id", storage.chunk_is_literal().alias("ok"))


@query("pk_unique", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1", False)
def pk_unique(spark, d):
    return storage.repeated_keys(model.table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("batch_scope", "SELECT c_nationkey, count(DISTINCT c_mktsegment) = 1 AS one_segment, count(DISTINCT c_nationkey) = 1 AS one_nation FROM customer GROUP BY c_nationkey", False)
def batch_scope(spark, d):
    return storage.batch_scope(model.table(spark, d, "customer"), ["c_nationkey"], {"one_segment": "c_mktsegment", "one_nation": "c_nationkey"})


@query("chunk_entity_refs", ", named AS (SELECT o_orderkey AS chunk_id, o_custkey % 7 AS file, unnest(CASE WHEN o_orderkey % 13 = 0 THEN ['x'] WHEN o_orderkey % 11 = 0 THEN ['c' || o_custkey, 'c' || o_custkey] WHEN o_orderkey % 5 = 0 THEN ['c' || (o_custkey + 1)] ELSE ['c' || o_custkey] END) AS id FROM orders), each AS (SELECT chunk_id, id, count(*) AS n, max(CASE WHEN c_custkey IS NULL THEN 3 WHEN c_custkey % 7 <> file THEN 2 ELSE 0 END) AS fault FROM named LEFT JOIN customer ON 'c' || c_custkey = id GROUP BY ALL) SELECT chunk_id, CASE max(greatest(fault, CASE WHEN n > 1 THEN 1 ELSE 0 END)) WHEN 0 THEN 'OK' WHEN 1 THEN 'REPEATED' WHEN 2 THEN 'OTHER_FILE' ELSE 'NO_ENTITY' END AS state FROM each GROUP BY chunk_id")
def chunk_entity_refs(spark, d):
    o, c = model.table(spark, d, "orders"), model.table(spark, d, "customer")
    k, name = F.col("o_orderkey"), lambda x: F.concat(F.lit("c"), x.cast("string"))
    own = name(F.col("o_custkey"))
    ids = F.when(k % 13 == 0, F.array(F.lit("x"))).when(k % 11 == 0, F.array(own, own)).when(k % 5 == 0, F.array(name(F.col("o_custkey") + 1))).otherwise(F.array(own))
    chunks = o.select(k.alias("chunk_id"), (F.col("o_custkey") % 7).alias("file_id"), ids.alias("entity_ids"))
    return storage.chunk_entity_references(chunks, c.select(name(F.col("c_custkey")).alias("entity_id"), (F.col("c_custkey") % 7).alias("file_id")))


@query("generation_times", "SELECT user_id AS repo_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS newest, CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS days FROM events GROUP BY user_id", False)
def generation_times(spark, d):
    e = model.table(spark, d, "events").groupBy(F.col("user_id").alias("repo_id")).agg(F.max("ts").alias("new"), F.min("ts").alias("old"))
    return e.select("repo_id", F.date_format("new", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("newest"), F.date_diff(F.to_date("new"), F.to_date("old")).alias("days"))


@query("delete_generation", "SELECT doc_id, generation_id FROM chunks WHERE generation_id NOT IN (SELECT DISTINCT generation_id FROM files WHERE rel_path LIKE 'src1%')")
def delete_generation(spark, d):
    retired = model.files(spark, d).where(F.col("rel_path").startswith("src1"))
    return storage.delete_generations(model.chunks(spark, d), retired).select("doc_id", "generation_id")


@query("orphan_collections", "SELECT DISTINCT 'gen_' || user_id AS name FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)", False)
def orphan_collections(spark, d):
    text = lambda c: F.concat(F.lit("gen_"), F.col(c).cast("string"))
    names = model.table(spark, d, "events").select(text("user_id").alias("name")).distinct()
    return storage.orphans(names, model.table(spark, d, "customer").select(text("c_custkey").alias("generation_id")))


@query("ignore_fingerprint", "SELECT repo_id, sha256(string_agg(rel_path || '/.gitignore:' || content_hash, chr(10) ORDER BY rel_path)) AS fingerprint FROM files WHERE doc_id % 4 = 0 GROUP BY repo_id")
def ignore_fingerprint(spark, d):
    f = model.files(spark, d).withColumn("rel_path", F.when(F.col("doc_id") % 4 == 0, F.concat("rel_path", F.lit("/.gitignore"))).otherwise(F.col("rel_path")))
    return storage.ignore_fingerprint(f)


@query("conflict_free", "SELECT c_custkey AS id, min(c_name) AS value FROM customer GROUP BY c_custkey", False)
def conflict_free(spark, d):
    c = model.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    return storage.without_conflicts(c.unionByName(c), "id", "value")


@query("chunk_refs", "SELECT c.chunk_id, CASE WHEN f.rel_path IS NULL THEN 'NO_FILE' WHEN f.rel_path <> c.rel_path THEN 'WRONG_PATH' ELSE 'OK' END AS state FROM (SELECT chunk_id, CASE WHEN doc_id % 19 = 0 THEN 'file_none' ELSE file_id END AS file_id, CASE WHEN doc_id % 23 = 0 THEN rel_path || '~' ELSE rel_path END AS rel_path FROM chunks) c LEFT JOIN files f USING (file_id)")
def chunk_refs(spark, d):
    c = model.chunks(spark, d).select("chunk_id", F.when(F.col("doc_id") % 19 == 0, "file_none").otherwise(F.col("file_id")).alias("file_id"), F.when(F.col("doc_id") % 23 == 0, F.concat("rel_path", F.lit("~"))).otherwise(F.col("rel_path")).alias("rel_path"))
    return storage.chunk_references(c, model.files(spark, d).select("file_id", F.col("rel_path").alias("file_path")))


@query("dangling_refs", "SELECT source_id, target_id FROM relations r WHERE rel_type = 'CALLS' AND NOT EXISTS (SELECT 1 FROM part WHERE 'p' || p_partkey = r.target_id AND p_size > 10)")
def dangling_refs(spark, d):
    r = model.relations(spark, d).where("rel_type = 'CALLS'")
    known = model.table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("target_id"))
    return r.join(known, "target_id", "left_anti").select("source_id", "target_id")


@query("index_coherence", "SELECT coalesce(c.chunk_id, x.chunk_id) AS chunk_id, CASE WHEN x.chunk_id IS NULL THEN 'MISSING' WHEN c.chunk_id IS NULL THEN 'ORPHAN' WHEN x.n > 1 THEN 'DUPLICATE' ELSE 'STALE' END AS damage FROM chunks c FULL JOIN (SELECT chunk_id, min(h) AS h, count(*) AS n FROM (SELECT CASE WHEN doc_id % 29 = 0 THEN chunk_id || '?' ELSE chunk_id END AS chunk_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE content_hash END AS h FROM chunks UNION ALL SELECT chunk_id, content_hash FROM chunks WHERE doc_id % 37 = 0) GROUP BY chunk_id) x ON x.chunk_id = c.chunk_id WHERE c.chunk_id IS NULL OR x.chunk_id IS NULL OR x.n > 1 OR x.h IS DISTINCT FROM c.content_hash")
def index_coherence(spark, d):
    c = model.chunks(spark, d)
    index = c.select(F.when(F.col("doc_id") % 29 == 0, F.concat("chunk_id", F.lit("?"))).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("doc_id") % 31 == 0, "").otherwise(F.col("content_hash")).alias("indexed"))
    index = index.unionByName(c.where("doc_id % 37 = 0").select("chunk_id", F.col("content_hash").alias("indexed")))
    return storage.coherence(c.select("chunk_id", "content_hash"), index)


@query("partition_gaps", "SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous, l_linenumber - coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) > 1 AS gap FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", False)
def partition_gaps(spark, d):
    rows = model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", before.alias("previous"), (F.col("l_linenumber") - F.coalesce(before, F.lit(0)) > 1).alias("gap"))


@query("definition_ordinal", "SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS ordinal FROM part", False)
def definition_ordinal(spark, d):
    return model.table(spark, d, "part").select("p_partkey", "p_name", F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")).cast("long").alias("ordinal"))


@query("seed_union", "SELECT 'c5' AS entity_id UNION SELECT target_id FROM relations WHERE source_id = 'c5' AND rel_type = 'DEFINES'")
def seed_union(spark, d):
    return graph.seeds(model.relations(spark, d), spark.createDataFrame([("c5",)], "entity_id string"))


@query("module_name", "SELECT rel_path, regexp_replace(substr(rel_path, 1, length(rel_path) - 4), '/', '.', 'g') AS module FROM files")
def module_name(spark, d):
    return model.files(spark, d).select("rel_path", storage.module_name(F.col("rel_path"), [".txt"]).alias("module"))


@query("parse_dispatch", "SELECT rel_path, CASE WHEN doc_id % 3 = 0 THEN 'python' WHEN doc_id % 3 = 1 THEN 'typescript' ELSE 'text' END AS language FROM files")
def parse_dispatch(spark, d):
    path = F.concat("rel_path", F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".ts").otherwise(".md"))
    return model.files(spark, d).select("rel_path", storage.language_of(path).alias("language"))
