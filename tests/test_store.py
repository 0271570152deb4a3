"""Stored tables and joins of intervals, against brute force and against what may be read."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera import engine, runtime
from tessera.functions import identity
from tessera.functions.fold import fold
from tessera.operators import admission, graph, intervals, ownership, search, sinks, snapshots, trigrams
from tessera.sources import tree


def test_folding_equals_casefold(spark):
    letters = [chr(c) for c in range(1, 0x2400)] + [chr(c) for c in range(0xFB00, 0xFB20)] + ["𐐀", "Ꭰ", "ꭰ", "ß", "İ"]
    texts = letters + ["ΟΔΟΣ ΣΑΣ", "STRASSE Straße", "İstanbul ŉ", "plain ASCII", "", "ﬃx" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold("t").alias("f")).collect()
    assert [r.f for r in got] == [r.t.casefold() for r in got]


def test_short_literals_and_terms_are_folded(spark):
    c = spark.createDataFrame([("a", "ẞ"), ("b", "ss"), ("c", "x")], "chunk_id string, content string")
    assert {r.chunk_id for r in search.short_literal(c, ["ß"], ["chunk_id"]).collect()} == {"a", "b"}
    words = spark.createDataFrame([("STRASSE Straße abc",)], "t string").select(search.terms_column(F.col("t")).alias("w")).first().w
    assert words == search.query_terms("STRASSE Straße abc") == ["STRASSE", "abc"]


@pytest.mark.parametrize("seed", range(4))
def test_intervals_meet_as_all_pairs_do(spark, seed):
    rng = random.Random(seed)
    draw = lambda n, k: [(k + i, rng.choice("xy"), a, a + rng.choice([0, 0, 1, 2, 3, 17, 300])) for i, a in enumerate(rng.randint(0, 400) for _ in range(n))]
    a, b = draw(80, 0), draw(80, 1000)
    da = spark.createDataFrame(a + [(-1, "x", None, 3), (-2, "x", 9, 3)], "i long, f string, s long, e long")
    db = spark.createDataFrame(b, "j long, f string, s2 long, e2 long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(da, db, ["f"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2"))).collect())
    assert got == sorted((i, j) for i, f, s, e in a for j, g, s2, e2 in b if f == g and s < e2 and e > s2)


def test_a_million_spans_of_one_file_take_no_more_than_their_pairs(spark):
    n = 500_000
    a = spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("i"), (F.col("id") * 3).alias("s"), F.when(F.col("id") % 100_000 == 0, 300_000 + F.col("id") * 3).otherwise(F.col("id") * 3 + 2).alias("e"))
    b = spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("j"), (F.col("id") * 3).alias("s2"), (F.col("id") * 3 + 3).alias("e2"))
    assert intervals.overlap_join(a, b, ["f"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2"))).count() == n + 5 * (100_000 - 1)


def closure(parents):
    out = set()
    for x in {c for c, _ in parents}:
        depth, front = 1, {p for c, p in parents if c == x}
        seen = set()
        while front:
            out |= {(x, a, depth) for a in front if a != x and a not in seen}
            seen |= front
            front = {p for c, p in parents if c in front} - seen
            depth += 1
    return out


def test_ancestors_of_any_depth(spark):
    chain = spark.range(1000).select(F.col("id").alias("entity_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    deepest = graph.ancestors(chain).agg(F.count("*"), F.max("depth")).first()
    assert tuple(deepest) == (999 * 1000 // 2, 999)


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_with_tails_cycles_and_several_parents(spark, seed):
    rng = random.Random(seed)
    parents = {(i, (i + 1) % 7) for i in range(7)} | {(i, rng.randrange(max(1, i - 3), i)) for i in range(8, 30)} | {(rng.randrange(30), rng.randrange(30)) for _ in range(6)} | {(40, 40)}
    got = graph.ancestors(spark.createDataFrame([*parents, (50, None)], "entity_id long, parent_id long")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {x for x in closure({p for p in parents if p[0] != p[1]})}


def test_stored_index_reads_what_it_needs(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "Straße", "delta"]) + str(rng.randrange(50)) for _ in range(30)) for _ in range(3000)] + ["the only needle here", "", None, "ab"]
    c = spark.createDataFrame([(f"c{i}", "g", t) for i, t in enumerate(texts)], "chunk_id string, generation_id string, content string")
    path = runtime.shared_path(spark)
    trigrams.store(c, path)
    assert len(trigrams.rarest(spark, path, "needle")) == trigrams.RAREST and trigrams.rarest(spark, path, "needles") is None
    for phrase in ("Needle", "STRAßE1", "gamma7 ", "zzz", "a", "lpha"):
        got = {r.chunk_id for r in trigrams.matches(spark, path, phrase).collect()}
        assert got == {f"c{i}" for i, t in enumerate(texts) if t is not None and phrase.lower() in t.lower()}, phrase
    found = trigrams.matches(spark, path, "needle")
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    index = trigrams.candidates(spark, path, "needle")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in index.replace("\n", " ") and "EqualTo(trigram" in index


def test_sinks_leave_other_generations_alone(spark):
    path = runtime.shared_path(spark)
    rows = spark.range(30).select("id", F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("generation_id"), F.lit(0).alias("v"))
    sinks.put(rows, path)
    files = lambda g: set(spark.read.parquet(path).where(F.col("generation_id") == g).select("_metadata.file_path").distinct().toPandas().file_path)
    before = {g: files(g) for g in ("g0", "g1", "g2")}
    sinks.put(rows.where("generation_id = 'g1' AND id < 10").withColumn("v", F.lit(1)), path)
    gone = spark.createDataFrame([("g2", 2), ("g2", 5), ("g2", 999)], "generation_id string, id long")
    sinks.replace_rows(spark, path, gone, spark.createDataFrame([(5, "g2", 7), (1000, "g2", 7)], "id long, generation_id string, v int"), "id")
    got = {(r.id, r.generation_id, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {(i, "g0", 0) for i in range(0, 30, 3)} | {(i, "g1", 1) for i in (1, 4, 7)} | {(i, "g2", 0) for i in range(8, 30, 3)} | {(5, "g2", 7), (1000, "g2", 7)}
    assert files("g0") == before["g0"] and not files("g1") & before["g1"] and not files("g2") & before["g2"]


def test_of_two_writers_one_wins(spark):
    uri = runtime.shared_path(spark)
    one, two = sinks.Log(spark, uri), sinks.Log(spark, uri)
    assert one.state() == two.state() == (0, None)
    assert one.commit(0, {"by": "one"}) and not two.commit(0, {"by": "two"})
    assert two.state() == (1, {"by": "one"}) and two.commit(1, {"by": "é"}) and not one.commit(1, {})
    assert one.state() == (2, {"by": "é"})
    one.forget(1)
    assert one.sequences() == [2] and one.commit(2, {}) and one.children(uri) == sorted(f"{s:020d}.json" for s in (2, 3))


def test_engine_on_a_uri_and_files_that_are_named(spark, tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    repo.mkdir()
    for k in range(5):
        (repo / f"m{k}.py").write_text(f"X{k} = 1\n\n\nclass Box{k}:\n    N = 2\n\n    def get(self):\n        return X{k}\n\n    END = 3\n\n\nprint(X{k})\n")
    e = engine.Engine(spark, str(repo), "file:" + str(tmp_path / "store"))
    assert e.index()["files"] == 5
    pieces = [r.content for r in e.table("chunks").where("rel_path = 'm1.py'").orderBy("span").collect()]
    assert "".join(pieces).replace("\n", "").replace(" ", "") == (repo / "m1.py").read_text().replace("\n", "").replace(" ", "")
    assert any(p.strip() == "def get(self):\n        return X1" for p in pieces) and len(pieces) == 5
    packet = e.query("Box3")
    text = engine.canonical(packet).decode()
    stale = text.replace("m3.py", "m4.py")
    (repo / "m0.py").write_bytes(b"\x00\x01")  # not named, so not opened: it would fail the scan
    table = spark.createDataFrame([(1, text), (2, stale), (3, "{}"), (4, text.replace("m3.py", "gone.py")), (5, text.replace("m3.py", "../m3.py"))], "packet_id int, packet string")
    assert {r.packet_id: r.verdict for r in e.verify_all(table).collect()} == {1: "OK", 2: "STALE_SOURCE", 3: "INVALID_PACKET", 4: "SOURCE_UNAVAILABLE", 5: "SOURCE_UNAVAILABLE"}
    with pytest.raises(Exception, match="is binary"):
        tree.read(spark, str(repo)).collect()


def owner_brute(n, d):
    """Each byte's innermost definition."""
    out = [None] * n
    for key, _, _, s, e in sorted(d, key=lambda x: (x[3], -x[4])):
        for i in range(s, e):
            out[i] = key
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bytes_belong_to_the_innermost_definition(spark, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab \n") for _ in range(200))
    d = [("m", "MODULE", None, 0, len(text))]

    def grow(parent, s, e, depth):
        at = s
        while depth and at < e - 4:
            a = rng.randint(at, e - 3)
            b = rng.randint(a + 1, e)
            key = f"d{len(d)}"
            d.append((key, "FUNCTION", parent, a, b))
            grow(key, a, b, depth - 1)
            at = b

    grow("m", 0, len(text), 3)
    defs = spark.createDataFrame([(1, *x) for x in d], "file_id int, entity_id string, kind string, parent_id string, start long, end long")
    assert ownership.faults(defs).count() == 0
    got = ownership.owned(spark.createDataFrame([(1, text)], "file_id int, content string"), defs).collect()
    want = owner_brute(len(text), d)
    held = {i: r.owner_id for r in got for i in range(r.start, r.end)}
    assert all(text[r.start : r.end] == r.content and r.content.strip() for r in got)
    assert all(held.get(i, want[i]) == want[i] for i in range(len(text))) and all(i in held for i in range(len(text)) if text[i] in "ab")


def test_crossing_and_strange_definitions_are_told(spark):
    rows = [(1, "m", "MODULE", None, 0, 9), (1, "a", "CLASS", "m", 1, 5), (1, "b", "CLASS", "m", 4, 8), (1, "c", "CLASS", "a", 2, 6), (1, "d", "CLASS", "x", 2, 3), (2, "n", "CLASS", None, 0, 9)]
    defs = spark.createDataFrame(rows, "file_id int, entity_id string, kind string, parent_id string, start long, end long")
    assert {tuple(r) for r in ownership.faults(defs).collect()} == {(1, "b", "siblings cross"), (1, "c", "outside its parent"), (1, "d", "unknown parent"), (2, None, "no single module")}
    with pytest.raises(Exception, match="don't tile"):
        ownership.owned(spark.createDataFrame([(1, "123456789")], "file_id int, content string"), defs).collect()


def test_admission_and_constraints(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":[1]}}'), (2, "{"), (3, None), (4, '{"a":1.5}'), (5, '{"a":null}')], "id int, t string")
    v = admission.parsed(F.col("t"))
    assert [r.k for r in rows.orderBy("id").select(admission.json_type(v, "$.a").alias("k")).collect()] == ["object", None, None, "number", "null"]
    t = {"a": spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, None)], "k int, v string"), "b": spark.createDataFrame([("x",), ("x",)], "v string")}
    got = admission.violations(t, [admission.Unique("a", ("k",)), admission.Present("a", "k"), admission.Reference("a", ("v",), "b", ("v",)), admission.Unique("a", ("k", "v"))]).collect()
    assert {tuple(r) for r in got} == {("a(k) unique", 1, "1"), ("a.k present", 2, ""), ("a(v) -> b(v)", 2, "y")}


def test_streamed_digests_equal_the_whole_ones(spark):
    rows = [(g, f"p{i}/é\"{i}\\", hashlib.sha256(str(i).encode()).hexdigest()) for g in ("a", "b", None) for i in range(120)]
    files = spark.createDataFrame(rows, "g string, rel_path string, content_hash string")
    want = {r.g: r.s for r in files.groupBy("g").agg(identity.snapshot_hash(F.collect_list(F.array("rel_path", "content_hash"))).alias("s")).collect()}
    assert {r.g: r.snapshot for r in snapshots.hashes(files, "g").collect()} == want
