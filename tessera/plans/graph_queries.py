"""Symbol graph: neighbours, ownership, call resolution, syntax."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import runtime
from tessera.functions import spans
from tessera.operators import graph, intervals, resolve
from tessera.plans import model
from tessera.plans.registry import query
from tessera.sources import syntax

_SEEDS = ", seeds AS (SELECT 'c5' AS id UNION SELECT target_id FROM relations WHERE source_id = 'c5' AND rel_type = 'DEFINES')"
_RANK = "CASE trust_class WHEN 'EXACT' THEN 0 WHEN 'RESOLVED' THEN 1 WHEN 'HEURISTIC' THEN 2 ELSE 3 END"
_NAME = "CASE min(r) WHEN 0 THEN 'EXACT' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'HEURISTIC' ELSE 'INFERRED' END"


@query("graph_callees", _SEEDS + f" SELECT target_id AS entity_id, {_NAME} AS trust FROM (SELECT *, {_RANK} AS r FROM relations) WHERE rel_type = 'CALLS' AND trust_class IN ('EXACT', 'RESOLVED') AND source_id IN (FROM seeds) AND target_id NOT IN (FROM seeds) GROUP BY target_id ORDER BY min(r), target_id LIMIT 50")
def graph_callees(spark, d):
    return graph.neighbours(model.relations(spark, d), spark.createDataFrame([("c5",)], "entity_id string"), "target_id")


@query("graph_callers", f" SELECT source_id AS entity_id, {_NAME} AS trust FROM (SELECT *, {_RANK} AS r FROM relations) WHERE rel_type = 'CALLS' AND trust_class IN ('EXACT', 'RESOLVED') AND target_id = 'p7' GROUP BY source_id ORDER BY min(r), source_id LIMIT 50")
def graph_callers(spark, d):
    return graph.neighbours(model.relations(spark, d), spark.createDataFrame([("p7",)], "entity_id string"), "source_id")


@query("graph_expand", _SEEDS + f", hop AS (SELECT target_id AS entity_id, 'callee' AS role, min({_RANK}) AS r FROM relations WHERE rel_type = 'CALLS' AND source_id IN (FROM seeds) GROUP BY target_id UNION ALL SELECT source_id, 'caller', min({_RANK}) FROM relations WHERE rel_type = 'CALLS' AND target_id = 'p7' GROUP BY source_id), turns AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY r, entity_id) AS idx FROM hop) SELECT entity_id, role, row_number() OVER (ORDER BY idx, role DESC) AS k FROM turns ORDER BY idx, role DESC LIMIT 24")
def graph_expand(spark, d):
    r = model.relations(spark, d)
    one = lambda x: spark.createDataFrame([(x,)], "entity_id string")
    up = graph.neighbours(r, one("p7"), "source_id", 24, heuristic=True)
    down = graph.neighbours(r, one("c5"), "target_id", 24, heuristic=True)
    return graph.interleave(up, down, 24)


@query("strongest_trust", f"SELECT target_id, {_NAME} AS trust FROM (SELECT *, {_RANK} AS r FROM relations WHERE rel_type = 'CALLS') GROUP BY target_id")
def strongest_trust(spark, d):
    r = model.relations(spark, d).where("rel_type = 'CALLS'")
    return r.groupBy("target_id").agg(graph.trust_name(F.min(graph.trust_rank(F.col("trust_class")))).alias("trust"))


@query("edge_endpoint_semi", "SELECT source_id, target_id, site FROM relations WHERE source_id IN (SELECT entity_id FROM entities WHERE kind = 'METHOD') AND target_id IN (SELECT entity_id FROM entities WHERE kind = 'FUNCTION')")
def edge_endpoint_semi(spark, d):
    e = model.entities(spark, d)
    r = model.relations(spark, d)
    r = r.join(e.where("kind = 'METHOD'").select(F.col("entity_id").alias("source_id")), "source_id", "left_semi")
    return r.join(e.where("kind = 'FUNCTION'").select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "site")


@query("entity_path_coalesce", "SELECT c_custkey, coalesce(n_name, '') AS path FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = c_nationkey", False)
def entity_path_coalesce(spark, d):
    n = model.table(spark, d, "nation").where("n_nationkey % 2 = 0")
    c = model.table(spark, d, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("path"))


@query("exact_entity_order", "SELECT entity_id, qualified_name FROM entities WHERE name LIKE 'order_1%' ORDER BY contains(lower(qualified_name), 'test_'), qualified_name, entity_id LIMIT 128")
def exact_entity_order(spark, d):
    e = model.entities(spark, d).where(F.col("name").startswith("order_1"))
    return e.orderBy(F.contains(F.lower("qualified_name"), F.lit("test_")), "qualified_name", "entity_id").limit(128).select("entity_id", "qualified_name")


_STAGED = ", staged AS (SELECT entity_id, 0 AS stage FROM entities WHERE qualified_name = '{0}' UNION ALL SELECT entity_id, 1 FROM entities WHERE name = '{1}' AND suffix(qualified_name, '.{0}') UNION ALL SELECT entity_id, 2 FROM entities WHERE qualified_name IN ({2}) UNION ALL SELECT entity_id, 3 FROM entities WHERE name = '{0}')"
_BEST = " SELECT entity_id, min(stage) AS stage, CASE min(stage) WHEN 1 THEN 'exact_qualified_suffix' WHEN 3 THEN 'exact_short_name' ELSE 'exact_qualified_name' END AS reason FROM staged GROUP BY entity_id ORDER BY stage, entity_id LIMIT 128"


@query("exact_candidates", _STAGED.format("c7.order_7", "order_7", "'c7.__init__.order_7'") + _BEST)
def exact_candidates(spark, d):
    return resolve.exact_candidates(model.entities(spark, d), "c7.order_7")


@query("exact_short_name", " SELECT entity_id, 3 AS stage, 'exact_short_name' AS reason FROM entities WHERE name = 'order_12' ORDER BY entity_id LIMIT 128")
def exact_short_name(spark, d):
    return resolve.exact_candidates(model.entities(spark, d), "order_12")


@query("preferred_chunk", ", own AS (SELECT o_orderkey, 1 + o_orderkey % 3 AS a, 3 + o_orderkey % 5 AS b FROM orders), piece AS (SELECT DISTINCT l_orderkey, l_linenumber AS c, l_linenumber + 1 + l_partkey % 3 AS d FROM lineitem) SELECT o_orderkey, arg_min(c || '-' || d, (CASE WHEN a = c AND b = d THEN 0 ELSE 1 END, d - c, c, c || '-' || d)) AS preferred FROM own JOIN piece ON l_orderkey = o_orderkey WHERE (a = c AND b = d) OR (c <= a AND a < d) GROUP BY o_orderkey")
def preferred_chunk(spark, d):
    """Of an entity's chunks the one of exactly its span, else the shortest that holds its start."""
    k = F.col("o_orderkey")
    own = model.table(spark, d, "orders").select(k.alias("entity_id"), k.alias("file_id"), spans.span((1 + k % 3), 0, (3 + k % 5), 0).alias("span"))
    line, size = F.col("l_linenumber"), 1 + F.col("l_partkey") % 3
    piece = model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat_ws("-", line.cast("string"), (line + size).cast("string")).alias("chunk_id"), spans.span(line, 0, line + size, 0).alias("span")).distinct()
    return graph.preferred(own, piece).select(F.col("entity_id").alias("o_orderkey"), F.col("chunk_id").alias("preferred"))


@query("span_overlap_join", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND (a.l_linenumber, 0) < (b.l_linenumber + 1, 0) AND (a.l_linenumber + 2, 0) > (b.l_linenumber, 0)", False)
def span_overlap_join(spark, d):
    line = model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    a = line.select("l_orderkey", F.col("l_linenumber").alias("a"), spans.span(F.col("l_linenumber"), 0, F.col("l_linenumber") + 2, 0).alias("s"))
    b = line.select("l_orderkey", F.col("l_linenumber").alias("b"), spans.span(F.col("l_linenumber"), 0, F.col("l_linenumber") + 1, 0).alias("t"))
    met = intervals.overlap_join(a, b, ["l_orderkey"], intervals.ends(F.col("s")), intervals.ends(F.col("t")))
    return met.where("a < b").select("l_orderkey", "a", "b")


@query("call_candidates", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey", False)
def call_candidates(spark, d):
    p, s = model.table(spark, d, "part"), model.table(spark, d, "supplier")
    return resolve.many_to_many(p.select("p_partkey", "p_size"), s.select("s_suppkey", "s_nationkey"), "p_size", "s_nationkey").select("p_partkey", "s_suppkey")


_CLASS = "(CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Http' ELSE 'My' END) || n_name || (CASE c_custkey % 7 WHEN 0 THEN 'Service' WHEN 1 THEN 'LIMITER' WHEN 2 THEN 'Impl' ELSE '' END)"


@query("naming_theta_join", f"SELECT DISTINCT leaf, class_name FROM (SELECT lower(n_name) AS leaf FROM nation UNION SELECT substr(lower(n_name), 2) FROM nation) r JOIN (SELECT {_CLASS} AS class_name FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON lower(class_name) IN (leaf, leaf || 'service', leaf || 'controller', leaf || 'manager', leaf || 'client', leaf || 'limiter', leaf || 'middleware', leaf || 'provider') OR suffix(lower(class_name), leaf) OR (length(leaf) >= 6 AND contains(lower(class_name), leaf))", False)
def naming_theta_join(spark, d):
    n, c = model.table(spark, d, "nation"), model.table(spark, d, "customer")
    leaf = n.select(F.explode(F.array(F.lower("n_name"), F.substring(F.lower("n_name"), 2, 100))).alias("leaf")).distinct()
    before = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 == 1, "Http").otherwise("My")
    after = F.when(F.col("c_custkey") % 7 == 0, "Service").when(F.col("c_custkey") % 7 == 1, "LIMITER").when(F.col("c_custkey") % 7 == 2, "Impl").otherwise("")
    named = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(before, "n_name", after).alias("class_name")).distinct()
    return resolve.naming_join(leaf, named, "leaf", "class_name").select("leaf", "class_name")


@query("lexical_ancestors", ", tree AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS up FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), closure AS (SELECT id, up, 1 AS depth FROM tree UNION SELECT c.id, t.up, c.depth + 1 FROM closure c JOIN tree t ON t.id = c.up) SELECT id AS entity_id, up AS ancestor_id, depth FROM closure")
def lexical_ancestors(spark, d):
    s = lambda c: F.col(c).cast("string")
    o = model.table(spark, d, "orders").select(F.concat(F.lit("o"), s("o_orderkey")).alias("entity_id"), F.concat(F.lit("c"), s("o_custkey")).alias("parent_id"))
    c = model.table(spark, d, "customer").select(F.concat(F.lit("c"), s("c_custkey")).alias("entity_id"), F.concat(F.lit("n"), s("c_nationkey")).alias("parent_id"))
    n = model.table(spark, d, "nation").select(F.concat(F.lit("n"), s("n_nationkey")).alias("entity_id"), F.concat(F.lit("r"), s("n_regionkey")).alias("parent_id"))
    return graph.ancestors(o.unionByName(c).unionByName(n))


_DEEP = """WITH RECURSIVE tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 1000 > 0 THEN p_partkey - 1 WHEN p_partkey % 2000 = 1000 THEN least(p_partkey + 999, (SELECT max(p_partkey) FROM part)) END AS up FROM part),
closure AS (SELECT id, up, 1 AS depth FROM tree WHERE up IS NOT NULL AND up <> id UNION ALL SELECT c.id, t.up, c.depth + 1 FROM closure c JOIN tree t ON t.id = c.up WHERE t.up IS NOT NULL AND t.up <> c.id)"""


@query("deep_ancestors", _DEEP + " SELECT id AS p_partkey, count(*) AS ancestors, max(depth) AS deepest, CAST(sum(depth * up) AS BIGINT) AS weight FROM closure GROUP BY id", False)
def deep_ancestors(spark, d):
    """Chains of 1,000 parts; every second one is closed to a cycle."""
    part, key = model.table(spark, d, "part"), F.col("p_partkey")
    last = part.agg(F.max("p_partkey").alias("last"))
    up = F.when(key % 1000 > 0, key - 1).when(key % 2000 == 1000, F.least(key + 999, F.col("last")))
    found = graph.ancestors(part.select("p_partkey").join(F.broadcast(last)).select(key.alias("entity_id"), up.alias("parent_id")))
    return found.groupBy(F.col("entity_id").alias("p_partkey")).agg(F.count("*").alias("ancestors"), F.max("depth").alias("deepest"), F.sum(F.col("depth") * F.col("ancestor_id")).alias("weight"))


#: Classes (suppliers) of repeating names, methods and functions (parts), and calls (line items) for each rule.
_CALLS = """, cls AS (SELECT 'k' || s_suppkey AS id, 'Cls' || s_suppkey % 7 || CASE WHEN s_suppkey % 2 = 0 THEN 'Service' ELSE '' END AS name, 'm' || s_nationkey || '.K' || s_suppkey AS path FROM supplier),
tgt AS (SELECT 'p' || p_partkey AS id, 'f' || p_partkey % 97 || CASE WHEN p_partkey % 11 = 0 THEN '_' || p_partkey ELSE '' END AS name, CASE WHEN p_size < 25 THEN 'METHOD' ELSE 'FUNCTION' END AS kind, CASE WHEN p_size < 25 THEN 'k' || (1 + p_partkey % (SELECT count(*) FROM supplier)) WHEN p_partkey % 2 = 0 THEN 'mod' || p_size % 10 END AS parent, 'file' || p_size % 10 AS file FROM part),
obs AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
call AS (SELECT l_orderkey AS call_id, l_linenumber AS site, l_partkey, t.name AS callee, 'src' || l_orderkey AS source_id, 'file' || l_orderkey % 10 AS file, CASE WHEN l_orderkey % 5 = 0 THEN 'FUNCTION' ELSE 'METHOD' END AS source_kind, 'k' || l_suppkey AS source_parent, 'mod' || l_orderkey % 10 AS scope,
  CASE l_linenumber WHEN 1 THEN 'self' WHEN 2 THEN 'x' WHEN 3 THEN 'a. ' || c.name WHEN 4 THEN 'Cls' || l_suppkey % 7 || '.prototype' WHEN 5 THEN 'my.cls' || l_suppkey % 7 ELSE '' END AS receiver,
  CASE WHEN l_linenumber = 2 AND l_orderkey % 2 = 0 THEN c.name WHEN l_linenumber = 2 THEN c.path END AS receiver_type
  FROM obs JOIN tgt t ON t.id = 'p' || l_partkey JOIN cls c ON c.id = 'k' || l_suppkey),
leafed AS (SELECT *, CASE WHEN receiver LIKE '%.prototype' THEN replace(receiver, '.prototype', '') ELSE trim(string_split(receiver, '.')[-1]) END AS leaf FROM call),
meth AS (SELECT * FROM tgt WHERE kind = 'METHOD'),
r2 AS (SELECT call_id, site, m.id AS target, 2 AS p, 1 AS classes FROM leafed l JOIN cls ON cls.id = source_parent JOIN meth m ON m.name = callee AND m.parent = source_parent WHERE receiver = 'self' AND source_kind = 'METHOD'),
m3 AS (SELECT DISTINCT call_id, site, callee, cls.id AS class FROM leafed JOIN cls ON receiver_type = cls.path OR string_split(receiver_type, '.')[-1] = cls.name WHERE receiver <> 'self'),
r3 AS (SELECT call_id, site, m.id AS target, 3 AS p, (SELECT count(*) FROM m3 z WHERE z.call_id = m3.call_id AND z.site = m3.site) AS classes FROM m3 JOIN meth m ON m.name = callee AND m.parent = class),
m4 AS (SELECT DISTINCT call_id, site, callee, cls.id AS class FROM leafed JOIN cls ON leaf = cls.name WHERE receiver NOT IN ('', 'self')),
n4 AS (SELECT call_id, site, count(*) AS n FROM m4 GROUP BY ALL),
r4 AS (SELECT call_id, site, m.id AS target, 4 AS p, n AS classes FROM m4 JOIN n4 USING (call_id, site) JOIN meth m ON m.name = callee AND m.parent = class),
r5 AS (SELECT call_id, site, t.id AS target, 5 AS p, 1 AS classes FROM leafed l JOIN tgt t ON t.name = callee AND t.kind <> 'METHOD' AND t.file = l.file AND t.parent IN (scope, source_id) WHERE receiver = ''),
lone AS (SELECT name, min(id) AS id, min(file) AS file, min(kind) AS kind FROM tgt GROUP BY name HAVING count(*) = 1),
r6 AS (SELECT call_id, site, lone.id AS target, 6 AS p, 1 AS classes FROM leafed l JOIN lone ON lone.name = callee AND lone.file <> l.file AND lone.kind <> 'METHOD' WHERE receiver = ''),
pair AS (SELECT DISTINCT leaf, cls.id AS class FROM (SELECT DISTINCT leaf FROM leafed WHERE receiver NOT IN ('', 'self') AND leaf <> '') JOIN cls ON lower(name) IN (lower(leaf), lower(leaf) || 'service', lower(leaf) || 'controller', lower(leaf) || 'manager', lower(leaf) || 'client', lower(leaf) || 'limiter', lower(leaf) || 'middleware', lower(leaf) || 'provider') OR suffix(lower(name), lower(leaf)) OR (length(leaf) >= 6 AND contains(lower(name), lower(leaf)))),
r7 AS (SELECT DISTINCT call_id, site, m.id AS target, 7 AS p, 1 AS classes FROM leafed l JOIN pair ON pair.leaf = l.leaf JOIN meth m ON m.name = callee AND m.parent = class WHERE receiver NOT IN ('', 'self')),
hit AS (SELECT DISTINCT * FROM (FROM r2 UNION ALL FROM r3 UNION ALL FROM r4 UNION ALL FROM r5 UNION ALL FROM r6 UNION ALL FROM r7)),
best AS (SELECT *, min(p) OVER (PARTITION BY call_id, site) AS least, count(*) OVER (PARTITION BY call_id, site, p) AS n FROM hit)"""


@query("resolve_calls", _CALLS + """ SELECT call_id, site, target AS target_id, CASE WHEN p = 3 AND n = 1 AND classes = 1 THEN 'RESOLVED' ELSE 'HEURISTIC' END AS trust_class,
  CASE p WHEN 2 THEN CASE WHEN n = 1 THEN 'same_class_receiver_without_binding' ELSE 'ambiguous_same_class_overload' END
         WHEN 3 THEN CASE WHEN n = 1 AND classes = 1 THEN 'explicit_receiver_type' ELSE 'ambiguous_explicit_receiver_type' END
         WHEN 4 THEN CASE WHEN n = 1 AND classes = 1 THEN 'class_name_receiver_without_binding' ELSE 'ambiguous_exact_receiver_class' END
         WHEN 5 THEN CASE WHEN n = 1 THEN 'same_file_name_without_binding' ELSE 'ambiguous_same_file_callable' END
         WHEN 6 THEN 'unique_global_name_without_import_binding' ELSE 'receiver_naming_convention' END AS reason
  FROM best WHERE p = least""")
def resolve_calls(spark, d):
    line, part, supplier = (model.table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    text, key = lambda c: F.col(c).cast("string"), F.col("p_partkey")
    n = supplier.count()
    cls_name = lambda k: F.concat(F.lit("Cls"), (k % 7).cast("string"), F.when(k % 2 == 0, "Service").otherwise(""))
    classes = supplier.select(F.concat(F.lit("k"), text("s_suppkey")).alias("entity_id"), cls_name(F.col("s_suppkey")).alias("name"), F.concat(F.lit("m"), text("s_nationkey"), F.lit(".K"), text("s_suppkey")).alias("qualified_name"), F.lit("CLASS").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit("classes").alias("file_id"))
    name = F.concat(F.lit("f"), (key % 97).cast("string"), F.when(key % 11 == 0, F.concat(F.lit("_"), text("p_partkey"))).otherwise(""))
    method = F.col("p_size") < 25
    parent = F.when(method, F.concat(F.lit("k"), (1 + key % n).cast("string"))).when(key % 2 == 0, F.concat(F.lit("mod"), (F.col("p_size") % 10).cast("string")))
    targets = part.select(F.concat(F.lit("p"), text("p_partkey")).alias("entity_id"), name.alias("name"), name.alias("qualified_name"), F.when(method, "METHOD").otherwise("FUNCTION").alias("kind"), parent.alias("parent_id"), F.concat(F.lit("file"), (F.col("p_size") % 10).cast("string")).alias("file_id"))
    obs = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().join(part.select("p_partkey", name.alias("callee")), F.col("l_partkey") == key).join(classes.select(F.col("entity_id").alias("c_id"), F.col("name").alias("c_name"), "qualified_name"), F.concat(F.lit("k"), text("l_suppkey")) == F.col("c_id"))
    at, seven, order = F.col("l_linenumber"), (F.col("l_suppkey") % 7).cast("string"), F.col("l_orderkey")
    receiver = F.when(at == 1, "self").when(at == 2, "x").when(at == 3, F.concat(F.lit("a. "), "c_name")).when(at == 4, F.concat(F.lit("Cls"), seven, F.lit(".prototype"))).when(at == 5, F.concat(F.lit("my.cls"), seven)).otherwise("")
    source = F.concat(F.lit("src"), text("l_orderkey"))
    calls = obs.select(order.alias("call_id"), at.alias("site"), source.alias("source_id"), F.concat(F.lit("file"), (order % 10).cast("string")).alias("file_id"), F.when(order % 5 == 0, "FUNCTION").otherwise("METHOD").alias("source_kind"), F.col("c_id").alias("source_parent"), "callee", receiver.alias("receiver"), F.when((at == 2) & (order % 2 == 0), F.col("c_name")).when(at == 2, F.col("qualified_name")).alias("receiver_type"))
    scopes = line.select(source.alias("entity_id"), F.concat(F.lit("mod"), (order % 10).cast("string")).alias("parent_id")).distinct()
    return resolve.resolve(calls, classes.unionByName(targets), scopes, ["call_id", "site"])


_EXPAND = """, top AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, 'c' || c_custkey AS seed, c_custkey % 2 = 0 AS explicit FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5),
member AS (SELECT place, seed, explicit, seed AS id FROM top UNION SELECT place, seed, explicit, target_id FROM top JOIN relations ON source_id = seed AND rel_type = 'DEFINES'),
met AS (SELECT place, explicit, 'callee' AS role, target_id AS entity_id, min(""" + _RANK + """) AS r FROM member JOIN relations ON source_id = id AND rel_type = 'CALLS' GROUP BY ALL
  UNION ALL SELECT place, explicit, 'caller', source_id, min(""" + _RANK + """) FROM member JOIN relations ON target_id = id AND rel_type = 'CALLS' GROUP BY ALL),
named AS (SELECT met.*, p_name IN ('""" + "{0}" + """') AND role = 'callee' AS said, row_number() OVER (PARTITION BY place, role ORDER BY r, (p_name IN ('""" + "{0}" + """') AND role = 'callee') DESC, coalesce(p_brand, ''), coalesce(p_size, 0), entity_id) AS idx
  FROM met LEFT JOIN part ON entity_id = 'p' || p_partkey WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.place = met.place AND m.id = met.entity_id)),
taken AS (SELECT *, row_number() OVER (ORDER BY place, idx, role DESC) AS k FROM named QUALIFY k <= 24)"""


@query("hybrid_graph", _EXPAND.replace("{0}", "hot rod") + f" SELECT CAST(place AS INTEGER) AS place, entity_id, role, CASE r WHEN 0 THEN 'EXACT' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'HEURISTIC' ELSE 'INFERRED' END AS trust, k, round((CASE WHEN explicit AND role = 'callee' AND r <= 1 THEN 2.5 ELSE 0.9 END) / (60 + k), 9) AS part FROM taken")
def hybrid_graph(spark, d):
    """The five richest customers' classes with what calls their methods and is called by them."""
    c, p = model.table(spark, d, "customer"), model.table(spark, d, "part")
    best = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(graph.TOP_CHUNKS)
    top = best.select(F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"), F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("entity_ids"), F.lit("x = hot rod (1)").alias("text"), (F.col("c_custkey") % 2 == 0).alias("explicit"))
    place = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_brand").alias("rel_path"), F.col("p_size").alias("start_line"))
    e = model.entities(spark, d).join(place, "entity_id", "left").withColumns({"rel_path": F.coalesce("rel_path", F.lit("")), "start_line": F.coalesce("start_line", F.lit(0))})
    return graph.expand(top, model.relations(spark, d), e, 12).withColumn("part", F.round("part", 9))


_PY = 'class Box{k}:\n    """Holds {k}."""\n\n    def get(self):\n        return load{k}(self)\n\n\ndef load{k}(box):\n    return box\n'
_TS = "export class Box{k} {{\n  get(): number {{ return load{k}(this); }}\n}}\nfunction load{k}(box) {{ return box; }}\nconst add{k} = (a, b) => a + b;\n"


def _sources(spark, d, template, ending):
    text = F.lit(template.replace("{{", "{").replace("}}", "}"))
    return model.files(spark, d).select(F.concat("rel_path", F.lit(ending)).alias("rel_path"), F.replace(text, F.lit("{k}"), F.col("doc_id").cast("string")).alias("content"))


@query("py_entities", "SELECT rel_path || '.py' AS rel_path, name, kind, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM files, (VALUES ('doc', 'MODULE', 1, 10), ('Box', 'CLASS', 1, 5), ('get', 'METHOD', 4, 5), ('load', 'FUNCTION', 8, 9)) v(stem, kind, start_line, end_line), LATERAL (SELECT CASE stem WHEN 'doc' THEN 'doc_' || doc_id || '.txt' WHEN 'get' THEN 'get' ELSE stem || doc_id END AS name)")
def py_entities(spark, d):
    return syntax.entities(_sources(spark, d, _PY, ".py")).select("rel_path", "name", "kind", "start_line", "end_line")


@query("ts_entities", "SELECT rel_path || '.ts' AS rel_path, name, kind, CAST(start_line AS INTEGER) AS start_line FROM files, (VALUES ('doc', 'MODULE', 1), ('Box', 'CLASS', 1), ('get', 'METHOD', 2), ('load', 'FUNCTION', 4), ('add', 'FUNCTION', 5)) v(stem, kind, start_line), LATERAL (SELECT CASE stem WHEN 'doc' THEN 'doc_' || doc_id || '.txt' WHEN 'get' THEN 'get' ELSE stem || doc_id END AS name)")
def ts_entities(spark, d):
    return syntax.entities(_sources(spark, d, _TS, ".ts")).select("rel_path", "name", "kind", "start_line")


#: A class for each distinct word of a document, whose method calls that of the next word's class on a typed
#: parameter; in every third class the parameter is assigned first, so that its type says nothing.
_WORDS = """, words AS (SELECT doc_id, rel_path, word, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, rel_path, unnest(regexp_extract_all(content, '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(content, '[a-z]+'), 1) AS pos FROM files) GROUP BY doc_id, rel_path, word)"""


def _words(spark, d):
    # parsing costs more than moving the words: files of few splits are dealt out
    return syntax.dealt(model.files(spark, d).select("doc_id", "rel_path", "content")).select("doc_id", "rel_path", F.array_distinct(F.regexp_extract_all("content", F.lit("[a-z]+"), F.lit(0))).alias("words"))


def _typed_sources(spark, d):
    word = _words(spark, d)
    cls = lambda w: F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("_"), w)
    after = lambda i: F.get("words", (i + 1) % F.size("words"))
    one = lambda w, i: F.concat(F.lit("class "), cls(w), F.lit(" {\n  go(p9: "), cls(after(i)), F.lit(") { "), F.when(i % 3 == 2, "p9 = null; ").otherwise(""), F.lit("p9.go(); }\n}\n"))
    return word.select(F.concat("rel_path", F.lit(".ts")).alias("rel_path"), F.array_join(F.transform("words", one), "").alias("content"))


@query("typed_calls", _WORDS + " SELECT 'D' || a.doc_id || '_' || a.word || '.go' AS source_id, 'D' || b.doc_id || '_' || b.word || '.go' AS target_id, 'RESOLVED' AS trust_class, 'explicit_receiver_type' AS reason FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.rel_path = b.rel_path AND b.i = (a.i + 1) % a.n WHERE a.i % 3 <> 2")
def typed_calls(spark, d):
    """Calls of sources made of each text's words, resolved by the written types of parameters."""
    sources = _typed_sources(spark, d)
    # parsed once, then read by every rule
    found = runtime.settled(syntax.both(sources).where("name IS NULL OR kind <> 'MODULE'"))
    targets = found.where("name IS NOT NULL").select(F.col("identity").alias("entity_id"), "name", "qualified_name", "kind", F.col("parent").alias("parent_id"), F.col("rel_path").alias("file_id"))
    calls = found.where("name IS NULL").select(F.col("identity").alias("source_id"), F.col("rel_path").alias("file_id"), F.col("kind").alias("source_kind"), F.col("parent").alias("source_parent"), "callee", "receiver", "receiver_type")
    none = targets.select("entity_id", "parent_id").where("parent_id IS NOT NULL")
    return resolve.resolve(calls, targets, none, ["source_id"])


@query("py_symbols", _WORDS + " SELECT rel_path || '.py' AS rel_path, 'f_' || word AS name, CAST(1 + 3 * i AS INTEGER) AS start_line, CAST(2 + 3 * i AS INTEGER) AS end_line, 12 AS end_col FROM words")
def py_symbols(spark, d):
    """Functions of Python sources made of each text's words."""
    one = lambda w: F.concat(F.lit("def f_"), w, F.lit("():\n    return 1\n\n"))
    sources = _words(spark, d).select(F.concat("rel_path", F.lit(".py")).alias("rel_path"), F.array_join(F.transform("words", one), "").alias("content"))
    columns = ["rel_path", "name", "start_line", "end_line", "end_col"]
    return syntax.entities(sources, "kind", *columns).where("kind = 'FUNCTION'").select(*columns)
