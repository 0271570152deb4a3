"""What is moved between tasks follows the input, where the result is larger."""

import ast
import hashlib
import json
import time

from pyspark.sql import functions as F

from tessera import runtime
from tessera.functions import spans
from tessera.functions.fold import fold
from tessera.operators import admission, graph, intervals, packets, resolve, trigrams
from tessera.sources import syntax


def moved(spark, run):
    """run()'s result, and the rows that it shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def rows():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    out = run()
    return out, rows() - before


def test_targets_of_calls_are_not_shuffled(spark):
    """300 calls on a name that 100 classes have: 30,000 rows come out, some hundreds are moved."""
    calls = spark.createDataFrame([(i, "s", "f", "METHOD", "k0", "go", "Box", None) for i in range(300)], "id int, source_id string, file_id string, source_kind string, source_parent string, callee string, receiver string, receiver_type string")
    rows = [(f"k{i}", "Box", "CLASS", None, "f") for i in range(100)] + [(f"m{i}", "go", "METHOD", f"k{i}", "f") for i in range(100)]
    targets = spark.createDataFrame(rows, "entity_id string, name string, kind string, parent_id string, file_id string")
    none = spark.createDataFrame([], "entity_id string, parent_id string")
    got, n = moved(spark, lambda: resolve.resolve(calls, targets, none, ["id"]).collect())
    assert len(got) == 30_000 and {r["reason"] for r in got} == {"ambiguous_exact_receiver_class"}
    assert n < 10_000


def test_small_files_are_parsed_by_many_tasks(spark):
    """2,000 files of some bytes: work goes by their number, not by their bytes."""
    files = spark.range(2000).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("rel_path"), F.lit("def f():\n    return 1\n").alias("content"))
    parsed = syntax.entities(syntax.dealt(files))
    assert parsed.select(F.spark_partition_id()).distinct().count() == 10


def test_parts_of_class_names_stay_where_they_are(spark):
    """2,000 long names have some 80,000 parts, of which two receivers seek a few."""
    receivers = spark.createDataFrame([("limiter",), ("x9",)], "leaf string")
    classes = spark.range(2000).select(F.concat(F.lit("RequestQueueLimiter"), F.col("id").cast("string")).alias("class_name"))
    got, n = moved(spark, lambda: resolve.naming_join(receivers, classes, "leaf", "class_name").collect())
    assert len(got) == 2000 and {r["leaf"] for r in got} == {"limiter"}
    assert n < 10_000


def test_calls_of_one_key_that_share_targets_do_not_shuffle_them(spark):
    """300 keys with three calls, of two names; two calls meet the same 100 targets: each pair comes out once, few rows are moved."""
    schema = "id int, source_id string, file_id string, source_kind string, source_parent string, callee string, receiver string, receiver_type string"
    types = [("go", "Box"), ("go", "m.Box"), ("run", "Box")]
    calls = spark.createDataFrame([(i, "s", "f", "METHOD", "k0", callee, "x", kind) for i in range(300) for callee, kind in types], schema)
    rows = [(f"k{i}", "Box", "m.Box", "CLASS", None, "f") for i in range(100)] + [(f"{x}{i}", x, x, "METHOD", f"k{i}", "f") for i in range(100) for x in ("go", "run")]
    none = spark.createDataFrame([], "entity_id string, parent_id string")
    entity = "entity_id string, name string, qualified_name string, kind string, parent_id string, file_id string"
    got, n = moved(spark, lambda: resolve.resolve(calls, spark.createDataFrame(rows, entity), none, ["id"]).collect())
    want = {(i, f"{x}{j}", "HEURISTIC", "ambiguous_explicit_receiver_type") for i in range(300) for j in range(100) for x in ("go", "run")}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert n < 20_000
    # a target of two names is met by calls of both, once
    rows += [("both", x, x, "METHOD", "k0", "f") for x in ("go", "run")]
    got = resolve.resolve(calls, spark.createDataFrame(rows, entity), none, ["id"]).collect()
    assert len(got) == len(want) + 300 == len(set(map(tuple, got)))


def test_targets_that_no_call_asks_for_stay_where_they_are(spark):
    """One call, 3,000 classes with a method each: only what the call names is listed."""
    calls = spark.createDataFrame([(1, "s", "f", "METHOD", "k0", "go", "p", "Box7")], "id int, source_id string, file_id string, source_kind string, source_parent string, callee string, receiver string, receiver_type string")
    rows = [(f"k{i}", f"Box{i}", "CLASS", None, "f") for i in range(3000)] + [(f"m{i}", "go", "METHOD", f"k{i}", "f") for i in range(3000)]
    targets = spark.createDataFrame(rows, "entity_id string, name string, kind string, parent_id string, file_id string")
    none = spark.createDataFrame([], "entity_id string, parent_id string")
    got, n = moved(spark, lambda: resolve.resolve(calls, targets, none, ["id"]).collect())
    assert [tuple(r) for r in got] == [(1, "m7", "RESOLVED", "explicit_receiver_type")]
    assert n < 10_000


def test_definitions_and_calls_come_from_one_parse(spark):
    text = "class A {\n go(p: B) { p.go(); q(); }\n}\nclass B { go() { this.x(); } }\nfunction f(a: A) { a.go(); }\n"
    files = spark.createDataFrame([("a.ts", text), ("b.py", "def f():\n    g(1)\n"), ("c.txt", "x")], "rel_path string, content string")
    both = syntax.both(files)
    names = syntax.entities(files).columns
    assert sorted(map(tuple, both.where("name IS NOT NULL").select(names).collect()), key=repr) == sorted(map(tuple, syntax.entities(files).collect()), key=repr)
    calls = both.where("name IS NULL").select("rel_path", F.col("identity").alias("caller"), "callee", "receiver", "receiver_type", "line")
    assert sorted(map(tuple, calls.collect()), key=repr) == sorted(map(tuple, syntax.calls(files).collect()), key=repr)
    assert {(r.identity, r.kind, r.parent) for r in both.where("name IS NULL").collect()} == {("A.go", "METHOD", "A"), ("B.go", "METHOD", "B"), ("f", "FUNCTION", None)}


def test_code_that_files_share_is_parsed_once(monkeypatch):
    """200 files of 20 of 30 functions in some order: the same results, and a parse for each function, not for each file's."""
    one = lambda k: f"@d\ndef f{k}(a):\n    return g{k}(a)\n\n\nclass C{k}:\n    def m(self):\n        'x'\n        return f{k}(1)\n\n"
    texts = ['"doc"\nimport x\n' + "".join(one((7 * i + 11 * j) % 30) for j in range(20)) for i in range(200)]
    odd = ["x = \"\"\"\ndef f(): pass\n\"\"\"\ndef g(): pass\n", "@a(\n1)\ndef f(): pass\n", "def f(): pass\nelse:\n", "if a:\n    b\ndef f(): pass\n", "def f(): pass\ndef f(): pass\n", "", "\n\ndef f(): pass"]
    odd += ["class Ab:\n    def g(self):\n        def Ab(): return Ab()\n    class Ab: pass\nif x:\n    def Ab(): pass\n", "def if(): pass\n", "def é(): pass\n", "def aé(): pass\n", "def ab(): pass\ndef xx(): return ab()\n", "async def ab(x): await x.ab()\n"]
    odd += ["".join(f"def f_{w}():\n    return 1\n\n" for w in ("a", "bc", "de", "fgh", "a"))]
    parsed, parse = [], ast.parse
    with monkeypatch.context() as m:
        m.setattr(ast, "parse", lambda *a: parsed.append(a) or parse(*a))
        got = [syntax.python_file("a.py", t) for t in texts]
    assert len(parsed) <= 100
    got += [syntax.python_file("a.py", t) for t in odd]
    monkeypatch.setattr(syntax, "_blocks", lambda text: None)  # each file as a whole
    assert got == [syntax.python_file("a.py", t) for t in texts + odd]


def test_pairs_along_one_parent_are_not_shuffled(spark):
    """A chain of 400, a cycle of 60 and a tail into it: some 90,000 pairs come out, far fewer are moved."""
    edges = [(i, i + 1) for i in range(400)] + [(1000 + i, 1000 + (i + 1) % 60) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(99)] + [(2099, 1007)]
    rows = spark.createDataFrame(edges, "entity_id long, parent_id long")
    got, n = moved(spark, lambda: graph.ancestors(rows).collect())
    up, want = dict(edges), set()
    for first in up:
        seen, at = [first], first
        while (at := up.get(at)) is not None and at not in seen:
            seen.append(at)
        want |= {(first, x, d) for d, x in enumerate(seen) if d}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert n < 90_000


def test_pairs_of_few_keys_are_spread(spark, monkeypatch):
    """3 keys, 400 pairs each at most 50 a task: no task makes most of them, with either way of meeting."""
    a = spark.range(60).select(F.col("id").alias("a"), (F.col("id") % 3).alias("x"))
    b = spark.range(60).select(F.col("id").alias("b"), (F.col("id") % 3).alias("y"))
    monkeypatch.setattr(resolve, "PAIRS_A_TASK", 50)
    for most in (100, 10):
        monkeypatch.setattr(resolve, "MAX_BROADCAST", most)
        met = resolve.many_to_many(a, b, "x", "y").select("a", "b", F.spark_partition_id().alias("task")).collect()
        assert sorted((r["a"], r["b"]) for r in met) == [(i, j) for i in range(60) for j in range(60) if i % 3 == j % 3]
        tasks = [r["task"] for r in met]
        assert max(map(tasks.count, set(tasks))) < 400


def test_rows_without_a_partner_are_not_dealt_out(spark, monkeypatch):
    """30,000 rows of a of which 100 have partners, with either way of meeting."""
    a = spark.range(30_000).select(F.col("id").alias("a"), (F.col("id") % 300).alias("x"))
    b = spark.range(60).select(F.col("id").alias("b"), (F.col("id") % 3 + 299).alias("y"))
    monkeypatch.setattr(resolve, "PAIRS_A_TASK", 50)
    for most in (100, 10):
        monkeypatch.setattr(resolve, "MAX_PAIRED", most, raising=False)
        got, n = moved(spark, lambda: resolve.many_to_many(a, b, "x", "y").select("a", "b").collect())
        assert sorted(map(tuple, got)) == [(i, j) for i in range(299, 30_000, 300) for j in range(0, 60, 3)]
        assert n < 15_000


def test_intervals_are_moved_about_once(spark):
    """Spans of nine sizes: rows don't go to each size that occurs; crowded bins are made smaller, with the same pairs."""
    n = 20_000
    a = spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("i"), (F.col("id") * 8).alias("s"), (F.col("id") * 8 + F.expr("shiftleft(1, cast(id % 6 as int))")).alias("e"))
    b = spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("j"), (F.col("id") * 8 + 1).alias("s2"), (F.col("id") * 8 + 1 + F.when(F.col("id") % 500 == 7, 2000).otherwise(F.col("id") % 9)).alias("e2"))
    join = lambda x, y: intervals.overlap_join(x, y, ["f"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = moved(spark, lambda: join(a, b).count())
        assert rows < 6 * n and got == a.join(b, (F.col("s") < F.col("e2")) & (F.col("e") > F.col("s2"))).count()
        full = [x.select("f", c, *[(F.col(e) % 64).alias(e) for e in ends]) for x, c, ends in ((a.limit(3000), "i", "se"), (b.limit(3000), "j", ("s2", "e2")))]
        got = join(*full).count()
        assert got == full[0].join(full[1], (F.col("s") < F.col("e2")) & (F.col("e") > F.col("s2")) & (F.col("s") <= F.col("e")) & (F.col("s2") <= F.col("e2"))).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_are_numbers(spark):
    """Each text's distinct trigrams, as numbers of 21 bits a character, by the place that the texts are stored with."""
    texts = ["aXbaxb", "ab", "", "😀é\u0000z", "x" * 50]
    c = spark.createDataFrame([(f"c{i}", "g", t) for i, t in enumerate([*texts, None])], "chunk_id string, generation_id string, content string")
    path = runtime.shared_path(spark)
    trigrams.store(c, path)
    posted = spark.read.parquet(f"{path}/postings")
    assert dict(posted.dtypes) == {"trigram": "bigint", "bucket": "int", "n": "int"}
    three = lambda v: "".join(chr(v >> s & 0x1FFFFF) for s in (42, 21, 0))
    got = sorted((r.chunk_id, three(r.trigram)) for r in posted.join(spark.read.parquet(f"{path}/texts"), ["bucket", "n"]).collect())
    assert got == sorted((f"c{i}", t) for i, x in enumerate(texts) for t in {x.lower()[k : k + 3] for k in range(len(x) - 2)})


def test_long_texts_are_folded_in_batches(spark):
    """400 texts of 20,000 characters, with some that fold to several: seconds, not minutes."""
    texts = spark.range(400).select(F.repeat(F.lit("Straße ΟΔΟΣ ﬁn é "), 1200).alias("t"))
    began = time.time()
    got = texts.select(fold("t").alias("f")).groupBy("f").count().collect()
    assert [tuple(r) for r in got] == [(("Straße ΟΔΟΣ ﬁn é " * 1200).casefold(), 400)] and time.time() - began < 15


def test_chunks_are_made_once_for_the_preferred_ones(spark):
    """5,000 chunks that take a shuffle to make, asked for 10 entities: they are not made again for each join."""
    span = lambda a, b: spans.span(F.col("id") + a, 0, F.col("id") + b, 0).alias("span")
    chunks = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("chunk_id"), F.lit("f").alias("file_id"), span(1, 3)).distinct()
    entities = spark.range(10).select(F.col("id").alias("entity_id"), F.lit("f").alias("file_id"), span(1, 3))
    got, n = moved(spark, lambda: graph.preferred(entities, chunks).collect())
    assert {(r.entity_id, r.chunk_id) for r in got} == {(i, f"k{i}") for i in range(10)}
    assert n < 15_000


def test_packets_are_read_once_and_files_cut_once(spark):
    """300 packets of one file of 3,000 lines, two of them damaged: rules and places don't read the JSON again."""
    lines = [f"line é {i}" for i in range(3000)]
    text = "\n".join(lines)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def packet(i, col):
        row = {"path": "f", "span": [i + 1, 0, i + 1, col], "file_sha256": sha(text), "coverage": {"symbol_span": None, "complete": False}, "source": lines[i], "source_sha256": sha(lines[i]), "reason": "x", "score": 1.0, "aliases": []}
        limits = {"packet_bytes": 8192, "fragments": 5, "candidates": packets.CANDIDATES, "unit": "UTF-8 bytes"}
        return json.dumps({"schema": "tessera-packet", "version": 2, "status": "OK", "snapshot_sha256": "0" * 64, "refreshed": False, "limits": limits, "selected": [row], "omitted": {"duplicate": 0, "budget": 0, "limit": 0}})

    width = [len(x.encode()) for x in lines]
    asked = [(i, packet(i, width[i] + {1510: 1, 2990: -1}.get(i, 0))) for i in range(0, 3000, 10)]
    now = spark.createDataFrame([("f", text)], "rel_path string, now string")
    told = packets.verdicts(spark.createDataFrame(asked, "packet_id int, packet string"), lambda paths: now)
    assert "from_json" not in told._jdf.queryExecution().toString()
    want = {1510: "INVALID_SPAN", 2990: "PROVENANCE_MISMATCH"}
    assert {r.packet_id: r.verdict for r in told.collect()} == {i: want.get(i, "OK") for i, _ in asked}


def test_keys_of_one_column_are_compared_as_they_are(spark):
    """Whole numbers of any width and texts are no arrays of texts; keys of several columns or kinds are."""
    t = {
        "a": spark.createDataFrame([(1, "x", 7), (2, "y", 8), (None, None, None), (10, "x", 8)], "k int, v string, w short"),
        "b": spark.createDataFrame([(1, "x"), (1, "x"), (8, "z")], "k long, v string"),
    }
    single = [admission.Unique("b", ("k",)), admission.Reference("a", ("k",), "b", ("k",)), admission.Reference("a", ("w",), "b", ("k",)), admission.Reference("a", ("v",), "b", ("v",))]
    got = admission.violations(t, single)
    assert "array(cast" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {("b(k) unique", 1, "1"), ("a(k) -> b(k)", 2, "10"), ("a(w) -> b(k)", 1, "7"), ("a(v) -> b(v)", 1, "y")}
    assert {tuple(r) for r in got.collect()} == want
    other = [admission.Reference("a", ("k", "v"), "b", ("k", "v")), admission.Reference("a", ("k",), "b", ("v",)), admission.Unique("b", ("k", "v"))]
    assert {tuple(r) for r in admission.violations(t, other).collect()} == {("a(k,v) -> b(k,v)", 2, "10,x"), ("a(k) -> b(v)", 3, "1"), ("b(k,v) unique", 1, "1,x")}
