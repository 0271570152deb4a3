"""index, query, edit, stale, refresh, verify over a small tree."""

import pytest

from tessera import engine
from tessera.sources import tree

FILES = {
    "shop/__init__.py": "",
    "shop/stock.py": 'def reserve(n):\n    """Hold items."""\n    return check(n)\n\n\ndef check(n):\n    return n > 0\n',
    "shop/copy.py": "def check(n):\n    return n > 0\n",
    "web/page.ts": "export class Page {\n  show(): string { return render(this); }\n}\nfunction render(p) { return 'é'; }\n",
    "node_modules/x.js": "reserve()",
    "data.bin": None,
}


@pytest.fixture()
def made(spark, tmp_path):
    repo = tmp_path / "repo"
    for path, text in FILES.items():
        p = repo / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\x00\x01" if text is None else text.encode())
    return repo, engine.Engine(spark, str(repo), str(tmp_path / "store"))


def test_tree_lists_what_it_should(spark, made):
    repo, _ = made
    got = {r.rel_path: r.content for r in tree.read(spark, str(repo)).collect()}
    assert set(got) == {"shop/__init__.py", "shop/stock.py", "shop/copy.py", "web/page.ts"}


def test_life_of_an_index(made):
    repo, e = made
    assert e.query("reserve")["status"] == "INDEX_REQUIRED"
    first = e.index()
    assert first["status"] == "INDEXED" and first["files"] == 4
    assert e.index()["status"] == "REUSED"
    packet = e.query("reserve")
    assert packet["status"] == "OK" and packet["selected"][0]["path"] == "shop/stock.py" and "exact" in packet["selected"][0]["reason"]
    assert e.verify(packet) == "OK" and len(engine.canonical(packet)) <= 4096
    assert e.query("nothing_like_this")["status"] == "EMPTY"
    assert e.query("CHECK", literal=True)["selected"]
    (repo / "shop/stock.py").write_text(FILES["shop/stock.py"] + "\n# more\n")
    assert e.verify(packet) == "STALE_SOURCE"
    again = e.query("reserve")
    assert again["refreshed"] and e.verify(again) == "OK"
    forged = engine.strict_json(engine.canonical(again))
    forged["selected"][0]["source"] += "x"
    assert e.verify(forged) == "PROVENANCE_MISMATCH"
    assert e.verify({"x": 1}) == "INVALID_PACKET"


def test_packets_hold_whole_symbols_and_count_aliases(made):
    repo, e = made
    body = "def long_one(n):\n" + "".join(f"    n = n + {i}  # {'x' * 20}\n" for i in range(70)) + "    return n\n"
    (repo / "shop/long.py").write_text(body)
    (repo / "shop/again.py").write_text(body)
    assert e.index()["status"] == "INDEXED"
    packet = e.query("long_one", budget=8192)
    row = packet["selected"][0]
    assert row["source"] == body.rstrip("\n") and row["coverage"]["complete"] and row["span"] == row["coverage"]["symbol_span"]
    assert len(row["aliases"]) == packet["omitted"]["duplicate"] == 1 and row["aliases"][0]["coverage"]["complete"]
    assert e.verify(packet) == "OK"
    part = e.query("long_one", budget=2500)
    assert part["selected"] and not part["selected"][0]["coverage"]["complete"] and e.verify(part) == "OK"
    assert e.query("long_one", budget=1024)["status"] == "BUDGET_EXHAUSTED"
    forged = engine.strict_json(engine.canonical(part))
    forged["selected"][0]["coverage"]["complete"] = True
    assert e.verify(forged) == "INVALID_PACKET"
    assert len(e._pointer()["history"]) <= engine.KEEP_GENERATIONS


def test_strict_json():
    for bad in (b'{"a":1,"a":2}', b'{"a":NaN}', b"\xff"):
        with pytest.raises(ValueError):
            engine.strict_json(bad)


def test_typed_receivers_resolve(spark, made):
    repo, e = made
    (repo / "web/store.ts").write_text("export class Store {\n  put(): void { }\n}\n")
    (repo / "web/use.ts").write_text("export class Use {\n  a(x: Store) { x.put(); }\n  b(x: Store) { x = null; x.put(); }\n}\n")
    e.index()
    names = e.table("entities").select("entity_id", "qualified_name")
    r = e.table("relations").where("rel_type = 'CALLS'").join(names.withColumnRenamed("entity_id", "source_id"), "source_id")
    got = {(x["qualified_name"], x["trust_class"], x["reason"]) for x in r.collect() if x["qualified_name"].startswith("Use")}
    assert got == {("Use.a", "RESOLVED", "explicit_receiver_type")}
