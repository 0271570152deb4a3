"""Unit expectations of single operators."""

import hashlib
import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import identity, spans
from tessera.operators import graph, packing, resolve, search, segment, storage
from tessera.sources import syntax, tree


def test_ids_are_hashes_of_their_preimages(spark):
    row = spark.range(1).select(identity.repo_id(F.lit("/x")).alias("r"), identity.file_id(F.lit("repo_1"), F.lit("a\\b/./c.py")).alias("f"), identity.normal_path(F.lit("a/../b")).alias("bad"), identity.generation_id(F.lit("r"), F.lit(7), F.lit("s")).alias("g")).first()
    short = lambda p, t: p + hashlib.sha256(t.encode()).hexdigest()[:16]
    assert row.r == short("repo_", "/x")
    assert row.f == short("file_", "repo_1:a/b/c.py")
    assert row.bad is None
    assert row.g == "gen_000007_" + hashlib.sha256(b'["tessera-generation-v1","r",7,"s"]').hexdigest()


def test_bm25_of_a_known_corpus(spark):
    texts = ["def reserve_seats(n): pass", "x" * 40, "reserve_seats(3); reserve_seats(4)", "y" * 80]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    got = {r.id: r.score for r in search.bm25(df, ["Reserve_Seats"]).collect()}
    import math

    avg = sum(max(0, len(t) - 2) for t in texts) / 4
    idf = max(math.log((4 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    for i, f in ((0, 1), (2, 2)):
        want = idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(texts[i]) - 2) / avg))
        assert abs(got[i] - want) < 1e-12
    assert set(got) == {0, 2}


def test_overlapping_occurrences_count(spark):
    assert spark.range(1).select(search.occurrences(F.lit("aaaaa"), "aaa").alias("n")).first().n == 3


def test_query_terms_and_short_terms():
    assert search.query_terms("Foo foo ba src/x.py FOO") == ["Foo", "src/x.py"]
    assert search.phrases(["a1b", "c2d"]) == ["a1b c2d", "a1b", "c2d"]
    assert search.short_terms("id é") == ["id", "é"]
    assert search.short_terms("id name") == []


def test_trust_is_the_strongest_in_any_order(spark):
    for order in itertools.permutations(graph.TRUST):
        rel = spark.createDataFrame([("a", "b", "CALLS", t, i) for i, t in enumerate(order)], "source_id string, target_id string, rel_type string, trust_class string, site int")
        one = spark.createDataFrame([("a",)], "entity_id string")
        assert graph.neighbours(rel, one, "target_id", heuristic=True).collect()[0].trust == "EXACT"
        break  # the rank itself is order-free; one plan is enough


def test_one_hop_stops(spark):
    rel = spark.createDataFrame([("s", "m", "CALLS", "EXACT", 0), ("m", "t", "CALLS", "EXACT", 0)], "source_id string, target_id string, rel_type string, trust_class string, site int")
    one = spark.createDataFrame([("s",)], "entity_id string")
    assert [r.entity_id for r in graph.neighbours(rel, one, "target_id").collect()] == ["m"]


def test_ancestors_survive_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "entity_id string, parent_id string")
    got = {(r.entity_id, r.ancestor_id) for r in graph.ancestors(p).collect()}
    assert ("a", "c") in got and ("a", "b") in got and len(got) <= 9


def test_greedy_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 9, 3, 2])], "g string, i int, s int")
    r = packing.pack(rows, ["g"], ["i"], "i", F.col("s"), 10, 5).first()
    assert r.taken == ["0", "2", "3"] and r.used == 10 and r.omitted_budget == 1 and r.status == "OK"


def test_aliases(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "rel_path string, content string")
    got = {r.rel_path: r.aliases for r in packing.dedup_aliases(rows, [], ["rel_path"]).collect()}
    assert got == {"a": ["b"], "c": []}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aé🙂\n \r"), max_size=60), st.integers(4, 24))
def test_segments_join_to_the_text(text, most):
    got = segment.segments_of(text, most)
    assert "".join(got) == text
    assert all(0 < len(x.encode()) <= most for x in got)


def test_segments_are_greedy():
    assert segment.segments_of("aa\nbb\ncc", 6) == ["aa\nbb\n", "cc"]
    assert segment.segments_of("aaaaaaa\nb", 3) == ["aaa", "aaa", "a\n", "b"]
    assert segment.pieces_of("éé🙂", 4) == ["éé", "🙂"]
    assert segment.segments_of("", 8) == []


def test_segments_of_very_many_lines(spark):
    """The time is in proportion to the lines."""
    n = 200_000
    files = spark.range(1).select(F.col("id"), F.repeat(F.lit("é\n"), n).alias("t"))
    assert segment.line_offsets(files, "id", "t").agg(F.count("*").alias("n"), F.max("start").alias("m")).first()[:] == (n + 1, 3 * n)
    got = segment.segments(files, "id", "t").agg(F.sum(F.octet_length("content")).alias("n"), F.count("*").alias("k")).first()
    assert got.n == 3 * n and got.k == n // 600 + (n % 600 > 0)


def test_points_and_offsets(spark):
    starts = F.array(*[F.lit(x).cast("long") for x in (0, 3, 3, 9)])
    r = spark.range(1).select(segment.point_of(starts, F.lit(5)).alias("p"), segment.offset_of(starts, F.lit(4), F.lit(2)).alias("o"), segment.prefix_sums(F.array(F.lit(3).cast("long"), F.lit(0).cast("long"), F.lit(6).cast("long")), 2).alias("s")).first()
    assert tuple(r.p) == (3, 2) and r.o == 11 and r.s == [0, 3, 3]


def test_own_pieces(spark):
    parents = spark.createDataFrame([("p", "head é\nchild\n  \nkid tail")], "k string, t string")
    children = spark.createDataFrame([("p", 8, 14), ("p", 17, 20)], "k string, start int, end int")
    got = segment.own_pieces(parents, children, "k", "t").orderBy("start").collect()
    assert [(r.start, r.end, r.content) for r in got] == [(0, 8, "head é\n"), (20, 25, " tail")]


def test_spans_are_in_bytes(spark):
    r = spark.range(1).select(spans.whole(F.lit("é\nλx")).alias("s"), segment.literal(F.lit("é\nλx"), spans.span(2, 0, 2, 2)).alias("b")).first()
    assert tuple(r.s) == (1, 0, 2, 3) and bytes(r.b) == "λ".encode()


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "rel_path string, content_hash string")
    b = spark.createDataFrame([("y", "3"), ("z", "4")], "rel_path string, content_hash string")
    assert {(r.rel_path, r.change) for r in storage.diff(a, b).collect()} == {("x", "ADDED"), ("y", "MODIFIED"), ("z", "DELETED")}


def test_binary_and_paths(spark):
    cases = [(b"abc\x00", True), (b"plain", False), (b"\xff\xfe", True), (b"", False), (b"a" * 90 + b"\x01" * 10, False), (b"a" * 89 + b"\x01" * 11, True), (b"a" * 8192 + b"\x00", False), ("é".encode() * 45 + b"\x01" * 10, False)]
    r = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw binary").select("i", storage.is_binary(F.col("raw")).alias("b")).collect()
    assert {x.i: x.b for x in r} == {i: want for i, (_, want) in enumerate(cases)}
    assert [tree.looks_binary(raw) for raw, _ in cases] == [want for _, want in cases]
    paths = {"a/node_modules/x.js": False, "a/x.PNG": False, "a/x.py": True, "x.py": True, "vendor": False, "my.db/x.py": False, "../x.py": False, "a/.idea/x.py": False, "a.jsonl": False}
    p = spark.createDataFrame([(k,) for k in paths], "p string").select("p", storage.path_allowed(F.col("p")).alias("ok")).collect()
    assert {x.p: x.ok for x in p} == paths


def test_ids_of_null_parts_are_refused(spark):
    import pytest

    with pytest.raises(Exception, match="null part"):
        spark.range(1).select(identity.entity_id(F.lit("f"), F.lit(None).cast("string"), F.lit("x"))).collect()


def test_activation_needs_a_committed_target(spark):
    g = spark.createDataFrame([("r", 1, "COMMITTED", True), ("r", 2, "STAGING", False), ("s", 1, "COMMITTED", True), ("s", 2, "COMMITTED", False), ("t", 1, "COMMITTED", True)], "repo_id string, sequence int, lifecycle string, is_active boolean")
    aim = spark.createDataFrame([("r", 2), ("s", 2)], "repo_id string, target int")
    assert {(r.repo_id, r.sequence) for r in storage.activate(g, aim).where("is_active").collect()} == {("r", 1), ("s", 2)}


def test_conflicts_fail(spark):
    import pytest

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    assert storage.without_conflicts(rows, "id", "v").count() == 2
    with pytest.raises(Exception, match="CONFLICT"):
        storage.without_conflicts(rows.unionByName(spark.createDataFrame([(2, "c")], rows.schema)), "id", "v").collect()
    assert storage.unequal_names(["a", "b"], ["b", "c"]) == ["-c", "+a"]


CALL = "k int, source_id string, file_id string, source_kind string, source_parent string, callee string, receiver string, receiver_type string"


def test_call_rules(spark):
    rows = [
        (1, "m1", "f", "METHOD", "C", "get", "self", None),
        (2, "g", "f", "FUNCTION", None, "get", "x", "pkg.C"),
        (3, "g", "f", "FUNCTION", None, "get", "C", None),
        (4, "g", "f", "FUNCTION", None, "away", None, None),
        (5, "m9", "f", "FUNCTION", None, "get", "self", None),
        (6, "g", "f", "FUNCTION", None, "login", "auth", None),
        (7, "g", "f", "FUNCTION", None, "put", "x", "D"),
        (8, "g", "f", "FUNCTION", None, "save", None, None),
        (9, "g", "f", "FUNCTION", None, "over", "E.prototype", None),
        (10, "g", "f", "FUNCTION", None, "near", " ", None),
        (11, "g", "f", "FUNCTION", None, "login", "my.Authser", None),
        (12, "g", "f", "FUNCTION", None, "login", "authse", None),
        (13, "g", "f", "FUNCTION", None, "login", "uths", None),
    ]
    calls = spark.createDataFrame(rows, CALL)
    made = [("C", "C", "CLASS", None, "f"), ("C.get", "get", "METHOD", "C", "f"), ("away", "away", "FUNCTION", None, "h"), ("A", "AuthService", "CLASS", None, "h"), ("A.login", "login", "METHOD", "A", "h")]
    made += [("D1", "D", "CLASS", None, "h"), ("D2", "D", "CLASS", None, "i"), ("D1.put", "put", "METHOD", "D1", "h"), ("D1.save", "save", "METHOD", "D1", "h")]
    made += [("E", "E", "CLASS", None, "h"), ("E.over", "over", "METHOD", "E", "h"), ("E.over#2", "over", "METHOD", "E", "h"), ("near", "near", "FUNCTION", "mod", "f"), ("near2", "near", "FUNCTION", "other", "f")]
    targets = spark.createDataFrame(made, "entity_id string, name string, kind string, parent_id string, file_id string")
    scopes = spark.createDataFrame([("g", "mod")], "entity_id string, parent_id string")
    got = {}
    for r in resolve.resolve(calls, targets, scopes, ["k"]).collect():
        got.setdefault(r.k, set()).add((r.target_id, r.trust_class, r.reason))
    assert got == {
        1: {("C.get", "HEURISTIC", "same_class_receiver_without_binding")},
        2: {("C.get", "RESOLVED", "explicit_receiver_type")},
        3: {("C.get", "HEURISTIC", "class_name_receiver_without_binding")},
        4: {("away", "HEURISTIC", "unique_global_name_without_import_binding")},
        6: {("A.login", "HEURISTIC", "receiver_naming_convention")},
        7: {("D1.put", "HEURISTIC", "ambiguous_explicit_receiver_type")},
        9: {("E.over", "HEURISTIC", "ambiguous_exact_receiver_class"), ("E.over#2", "HEURISTIC", "ambiguous_exact_receiver_class")},
        10: {("near", "HEURISTIC", "same_file_name_without_binding")},
        11: {("A.login", "HEURISTIC", "receiver_naming_convention")},
        12: {("A.login", "HEURISTIC", "receiver_naming_convention")},
    }


def test_targets_of_a_call_that_is_there_twice_count_once(spark):
    rows = [
        (1, "g", "f", "FUNCTION", None, "near", None, None),
        (1, "g", "f", "FUNCTION", "B", "near", None, None),
        (2, "m", "f", "METHOD", "C", "get", "self", None),
        (2, "m", "f", "METHOD", "C", "get", "self", "T"),
        (3, "g", "f", "FUNCTION", None, "away", None, None),
        (3, "g", "f", "FUNCTION", None, "away", " ", None),
    ]
    made = [("C", "C", "CLASS", None, "f"), ("C.get", "get", "METHOD", "C", "f"), ("near", "near", "FUNCTION", "mod", "f"), ("away", "away", "FUNCTION", None, "h")]
    targets = spark.createDataFrame(made, "entity_id string, name string, kind string, parent_id string, file_id string")
    scopes = spark.createDataFrame([("g", "mod")], "entity_id string, parent_id string")
    got = sorted((r.k, r.target_id, r.reason) for r in resolve.resolve(spark.createDataFrame(rows, CALL), targets, scopes, ["k"]).collect())
    assert got == [(1, "near", "same_file_name_without_binding"), (2, "C.get", "same_class_receiver_without_binding"), (3, "away", "unique_global_name_without_import_binding")]


def test_exact_names(spark):
    e = spark.createDataFrame([("1", "b", "a.b"), ("2", "b", "x.a.b"), ("3", "b", "a.__init__.b"), ("4", "a.b", "q"), ("5", "b", "z.b")], "entity_id string, name string, qualified_name string")
    assert [(r.entity_id, r.stage) for r in resolve.exact_candidates(e, "a.b").collect()] == [("1", 0), ("2", 1), ("3", 2), ("4", 3)]
    assert [r.entity_id for r in resolve.exact_candidates(e, "b", limit=2).collect()] == ["1", "2"]
    assert resolve.init_variants("a.__init__.b") == ["a.__init__.__init__.b", "a.b"]
    assert len(resolve.init_variants(".".join("abcdefghijklmnopqrstuvwxyz"))) == 16


def test_postings_lead_to_the_same_scores(spark):
    texts = ["def reserve_seats(n): pass", "x" * 40, "Reserve_Seats(3); reserve_seats(4)", "reserve or seats", "ab"]
    df = spark.createDataFrame([("g", str(i), t) for i, t in enumerate(texts)], "generation_id string, chunk_id string, content string")
    lengths = search.corpus_stats(df, [], ["generation_id"])
    for query in ("reserve_seats", "reserve seats", "zzz", "xxx"):
        p = search.phrases(search.query_terms(query))
        plain = {r.chunk_id: round(r.score, 9) for r in search.bm25(df, p, ["generation_id"]).collect()}
        assert {r.chunk_id: round(r.score, 9) for r in search.bm25_indexed(df, search.postings(df), lengths, p).collect()} == plain
    assert search.base_terms("ab cde") == ["cde"] and search.base_terms("ab c") == ["ab"]


def test_documents():
    import pytest

    from tessera.functions import documents

    assert documents.metadata('{"a":[1,{"b":"[[["}]}') == {"a": [1, {"b": "[[["}]}
    assert documents.encoded({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    for bad in ('{"a":1,"a":2}', "[1]", '{"a":NaN}', '{"a":1e999}', '{"a":' + "[" * 70 + "]" * 70 + "}", '{"a":"' + "x" * 70000 + '"}'):
        with pytest.raises(ValueError):
            documents.metadata(bad)
    assert documents.failure_codes(["B_1", "A"]) == ["A", "B_1"]
    for bad in (["a"], ["A", "A"], "A", [""]):
        with pytest.raises(ValueError):
            documents.failure_codes(bad)


def test_receipts_and_artifacts(tmp_path):
    import pytest

    from tessera.functions import documents

    path = str(tmp_path / "r.json")
    documents.receipt(path, {"a": 1})
    assert documents.artifact(path) == b'{"a":1}\n'
    with pytest.raises(FileExistsError):
        documents.receipt(path, {})
    documents.append(path, b"x")
    with pytest.raises(ValueError):
        documents.append(path, b"y" * 10, 12)
    with pytest.raises(ValueError):
        documents.artifact(path, 3)
    (tmp_path / "link").symlink_to(path)
    with pytest.raises(OSError):
        documents.artifact(str(tmp_path / "link"))


def test_git_lists_what_is_not_ignored(tmp_path):
    import subprocess

    for name, text in {"a.py": "", "b.log": "", ".gitignore": "*.log\n", "vendor/c.py": "", "d.png": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert tree.git_candidates(str(tmp_path)) is None and tree.git_head(str(tmp_path)) is None
    before = tree.ignore_fingerprint(str(tmp_path))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert tree.git_candidates(str(tmp_path)) == [".gitignore", "a.py"]
    (tmp_path / ".gitignore").write_text("a.py\n")
    assert tree.git_candidates(str(tmp_path)) == [".gitignore", "b.log"] and tree.ignore_fingerprint(str(tmp_path)) != before


def test_expansion_order(spark):
    top = spark.createDataFrame([(1, ["a"], "x = named (1)", True)], "place int, entity_ids array<string>, text string, explicit boolean")
    rel = spark.createDataFrame([("a", "p", "CALLS", "HEURISTIC"), ("a", "q", "CALLS", "EXACT"), ("m", "r", "CALLS", "EXACT"), ("a", "m", "DEFINES", "EXACT"), ("u", "a", "CALLS", "RESOLVED"), ("a", "s", "CALLS", "EXACT"), ("m", "a", "CALLS", "EXACT")], "source_id string, target_id string, rel_type string, trust_class string")
    e = spark.createDataFrame([(x, "named" if x == "s" else x, "f", 1) for x in "apqmrus"], "entity_id string, name string, rel_path string, start_line int")
    got = [(r.entity_id, r.role, round(r.part, 6)) for r in graph.expand(top, rel, e, 12).orderBy("k").collect()]
    want = [("s", "callee", 2.5), ("u", "caller", 0.9), ("q", "callee", 2.5), ("r", "callee", 2.5), ("p", "callee", 0.9)]
    assert sorted(got[:2]) == sorted([("u", "caller", round(0.9 / 61, 6)), ("s", "callee", round(2.5 / 62, 6))])
    assert [(a, b, round(w / (61 + i + 2), 6)) for i, (a, b, w) in enumerate(want[2:])] == got[2:]


def test_python_syntax():
    text = '@deco\ndef f(x=lambda: g()):\n    """Doc."""\n    def inner():\n        return h(x)\n    return C().run(x)\n\nclass C:\n    if True:\n        def run(self): self.go()\n'
    out, calls = syntax.python_file("a/b.py", text)
    by = {e["qualified_name"]: e for e in out}
    assert by["f"]["start_line"] == 1 and by["f"]["start_col"] == 0 and by["f"]["docstring"] == "Doc."
    assert by["C.run"]["kind"] == "METHOD" and by["f.inner"]["kind"] == "FUNCTION" and by["a.b"]["kind"] == "MODULE"
    assert {(c["caller"], c["callee"], c["receiver"]) for c in calls} >= {("f.inner", "h", None), ("f", "run", "C()"), ("C.run", "go", "self")}


def test_properties_and_methods_declared_again():
    text = "class A:\n    @property\n    def x(self):\n        def inner(): return f()\n        return g()\n    @x.setter\n    def x(self, v): h(v)\n    @x.deleter\n    def x(self): pass\n    def m(self): a()\n    def m(self): b()\ndef f(): pass\ndef f(): c()\n"
    out, calls = syntax.python_file("p.py", text)
    got = {r["identity"]: (r["qualified_name"], r["accessor"], r["parent"]) for r in out}
    assert got["A.x"] == ("A.x", "property-getter", "A") and got["A.x#python-property-setter"] == ("A.x", "property-setter", "A") and got["A.x#python-property-deleter"][1] == "property-deleter"
    assert got["A.x.inner"][2] == "A.x" and got["A.m#python-method-2"] == ("A.m", None, "A") and got["f#2"] == ("f", None, None)
    assert {(c["caller"], c["callee"]) for c in calls} == {("A.x.inner", "f"), ("A.x", "g"), ("A.x#python-property-setter", "h"), ("A.m", "a"), ("A.m#python-method-2", "b"), ("f#2", "c")}
    assert syntax.clean_docstring(' """ a "b" """ ') == 'a "b"' and syntax.clean_docstring("''") is None and syntax.clean_docstring(None) is None


def test_broken_python_keeps_what_parses():
    out, _ = syntax.python_file("x.py", "def ok():\n    return 1\n\ndef broken(:\n    pass\n\ndef fine(): pass\n")
    assert {e["name"] for e in out} == {"x", "ok", "fine"}


def test_script_syntax():
    text = 'class A extends B {\n  go(x) { return this.run("}") }\n}\ninterface I { a(): void }\nconst f = async (a) => { g(a) }\nfunction h() { const inner = () => 1; return f(2) }\n'
    out, calls = syntax.script_file("m.ts", text)
    kinds = {(e["qualified_name"], e["kind"]) for e in out}
    assert {("A", "CLASS"), ("A.go", "METHOD"), ("I", "INTERFACE"), ("f", "FUNCTION"), ("h", "FUNCTION")} <= kinds
    assert not any(e["name"] == "inner" for e in out)
    assert {(c["caller"], c["callee"]) for c in calls} >= {("A.go", "run"), ("f", "g"), ("h", "f")}


def test_short_literal_and_round_robin(spark):
    rows = spark.createDataFrame([("c1", 'XY = "id"', "a"), ("c2", 'NOTE = "雪山"', "b")], "chunk_id string, content string, rel_path string")
    assert [r.chunk_id for r in search.short_literal(rows, ["雪"], ["rel_path"]).collect()] == ["c2"]
    ranked = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("b", 3, 1.0)], "g string, i int, s double")
    assert [r.i for r in search.round_robin(ranked, ["g"], [F.desc("s")], 3).collect()] == [1, 3, 2]


def test_receivers_have_their_parameters_types():
    from tessera.sources import syntax

    text = """export class Page<T> {
  show(a: Store, b: T, c?: ns.Store, d: Map<K, V> = mk()) { a.put(); b.put(); c.put(); d.put(); list.map(x => x.hit(1)); }
  assigned(a: Store) { a = other(); a.put(); }
  declared(a: Store, z: Store) { const { z } = k; a.put(); z.put(); }
  caught(a: Store) { try { go() } catch (a) { a.put(); } }
  around(a: Store) { const f = () => { a = 1; a.lost(); }; a.put(); function q(a) { a.lost(); } }
  same(a: Store) { if (a === b || a.x == 1) { a.put() } o.a = 1; }
}
function free<U>(s: Store, u: U) { for (const u2 of s) { s.put(); } u.put(); }
const arrow = (s: Store) => s.put();
"""
    got = {(c["caller"], c["callee"], c["receiver"]): c["receiver_type"] for c in syntax.script_file("p.ts", text)[1] if c["receiver"]}
    assert got == {
        ("Page.show", "put", "a"): "Store",
        ("Page.show", "put", "b"): None,
        ("Page.show", "put", "c"): "ns.Store",
        ("Page.show", "put", "d"): "Map<K, V>",
        ("Page.show", "map", "list"): None,
        ("Page.assigned", "put", "a"): None,
        ("Page.declared", "put", "a"): "Store",
        ("Page.declared", "put", "z"): None,
        ("Page.caught", "put", "a"): None,
        ("Page.around", "put", "a"): "Store",
        ("Page.same", "put", "a"): "Store",
        ("free", "put", "s"): "Store",
        ("free", "put", "u"): None,
        ("arrow", "put", "s"): "Store",
    }
