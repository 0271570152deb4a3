"""Personal data, secrets and benchmark windows against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import op05_decontaminate as leaks
from tessera.llm import op07_pii as pii
from tessera.llm import op09_secrets as secrets


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def noisy(alphabet, n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


PII = ["a", "@", "b.c", ".", "1", "23", "256", "1.2.3.4", " ", "-", "+", "é", "𝒳", "(", ")", "_", "4111 1111 1111 1111", "x@y.zz", "+1 (743) 555-3824"]


def test_pii_base_spans(spark):
    texts = noisy(PII, 400, 5) + [None, "", "7" * 20000 + " " + "a." * 9000 + "@x" + ".y" * 9000, "1 " * 9000, "a" * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("clash"))
    for r in pii.find(docs).collect():
        want = base_pii(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in ("email", "ip", "card", "phone"))
        assert r.spans.startswith(said)


def test_pii_terms_that_give_an_entity_away(spark):
    rng = random.Random(3)
    some = lambda: " ".join(rng.choice(["walk", "green", "table", "window", "river"]) for _ in range(8))
    texts = [f"{some()} zorblax wrote from jane@corp.example {some()}" for _ in range(6)] + [some() for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i in range(6):
        a = texts[i].index("zorblax")
        assert f"removed:{a}:{a + 7}" in got[i].spans
        assert "green" not in texts[i] or f"removed:{texts[i].index('green')}:{texts[i].index('green') + 5}" not in got[i].spans.split(",")
    assert all(not got[i].spans for i in range(6, 206))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and "jane" not in clean[0]
    assert clean[10] == texts[10]


def test_copies_are_one_context(spark):
    docs = spark.createDataFrame([(i, "quuxword wrote from jane@corp.example today") for i in range(50)] + [(99, "else")], "doc_id long, text string")
    assert all("removed" not in r.spans and "generalised" not in r.spans for r in pii.find(docs).collect())


def test_terms_are_found_wherever_they_stand_in_a_document_of_the_entity(spark):
    far = "walk green table window river " * 30
    texts = [f"Jo7 {far} {k} Jo7 wrote from jane@corp.example {k}" for k in "abc"] + [f"{far} {k} wrote from" for k in range(100)] + ["Jo8 table"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.find(docs).collect()}
    for i in range(3):
        again = texts[i].rindex("Jo7")
        assert {"0:3", f"{again}:{again + 3}"} <= {x.partition(":")[2] for x in got[i]}
        assert len(got[i]) == 3
    assert got[len(texts) - 1] == [""]


def test_pii_of_no_rows_and_of_repeated_rows(spark, empty):
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0
    docs = spark.createDataFrame([(1, "a@b.cc"), (1, "a@b.cc"), (1, None)], "doc_id long, text string")
    assert sorted(r.spans for r in pii.find(docs).collect()) == ["", "email:0:6", "email:0:6"]


def test_pii_of_very_many_values(spark):
    """The time is in proportion to the matches: a text of 16 MB takes seconds."""
    n = 1_000_000
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("a@b.cc é 1 "), n).alias("text"))
    spans = docs.select(pii.base_spans(F.col("text")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert spans.n == n and (spans.last.start, spans.last.end) == (11 * (n - 1), 11 * (n - 1) + 6)


def base_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_base_spans_and_novelty(spark):
    texts = noisy(["token", "=", '"', " ", "Password", ":", "AKIA", "ABCD1234", "0123456789abcdef", "ff", "apiKEY", "z", "secret", "é"], 300, 9, 30) + [None, "", "a" * 50000, "token=" + "x" * 50000]
    texts += ["my secret key Zx9Qa7LmP02kTvB8 here", "the password is getUserNameByIdentifier22 here", "plain Zx9Qa7LmP02kTvB8 text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, t in enumerate(texts):
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_secrets(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    n = len(texts)
    assert got[n - 3].spans == "novel:14:30" and got[n - 2].spans == "" and got[n - 1].spans == ""


def test_long_secrets_are_read_to_their_end(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    names = "_".join(rng.choice(["user", "name2", "account", "table", "session", "config"]) for _ in range(400))
    texts = [f"{before} {key(n)} and so on" for n in (64, 511, 512, 513, 560, 561, 600, 1200, 1624, 3000, 40000) for before in ("the secret key is", "Authorization: Bearer", "credential" + " " * 47)]
    texts += [f"the secret key is {key(1624)}"]  # at the end of the text
    texts += [f"the secret key is {x} and so on" for x in (names, "getUserName2" * 100, "a1" * 700)] + ["plain " + key(1200), "credential" + " " * 49 + key(1200), "the secret key\n" + key(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, t in enumerate(texts[:-6]):
        a = max(re.finditer(r"[A-Za-z0-9+/]{17,}", t), key=lambda m: len(m[0])).span()
        assert f"novel:{a[0]}:{a[1]}" in got[i].spans.split(","), (len(t), t[:40])
    assert all(got[i].n_novel == 0 for i in range(len(texts) - 6, len(texts)))


def test_recall_of_planted_secrets():
    """Random keys beside a sensitive word are told, names and paths are not."""
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    parts = ["user", "account", "session", "config", "value", "Handler", "Manager", "request", "table", "index", "2", "v1"]
    name = lambda: rng.choice(["_", "-", ""]).join(rng.choice(parts) for _ in range(rng.randint(4, 7)))
    shapes = ["the password is {} for now", "Authorization: Bearer {}", "{} is the secret of it", 'credential("{}")', "my api key: <{}>", "auth {} end"]
    novelty = secrets.Novelty()
    found = wrong = 0
    for i in range(300):
        x = key(rng.randint(20, 60)) + "7a"
        text = "some text before. " + shapes[i % len(shapes)].format(x)
        a = text.index(x)
        taken = secrets.base_spans(text)
        found += (a, a + len(x)) in secrets.novel_spans(text, taken, novelty) or any(s <= a < e for s, _, e in taken)
        wrong += bool(secrets.novel_spans("some text before. " + shapes[i % len(shapes)].format(name()), [], novelty))
    assert found >= 290 and wrong <= 6, (found, wrong)


def test_names_beside_values_are_told_and_others_are_not(spark):
    """Of planted names that stand by a value in two texts or more nearly all are told, of other words none."""
    rng = random.Random(5)
    part = ["ka", "lo", "mi", "ren", "tu", "sa", "vor", "el", "bri", "na", "do", "qui", "zen", "pa", "hol"]
    pick = lambda low, high: "".join(rng.choice(part) for _ in range(rng.randint(low, high)))
    common = [pick(1, 3) for _ in range(600)]
    said = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [(said(rng.randint(20, 150)), (), 0) for _ in range(600)]
    for i in range(80):
        a, b, n = "Q" + pick(3, 3), "X" + pick(3, 3), rng.choice([1, 2, 3, 5])
        texts += [(f"{said(rng.randint(10, 40))} {a} {b} {said(rng.randint(0, 4))} user{i}.{a.lower()}@mail{i % 7}.example.org {said(rng.randint(10, 60))}", (a, b), n) for _ in range(n)]
    found = known = wrong = 0
    for r in pii.find(spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(texts)], "doc_id long, text string")).collect():
        text, names, n = texts[r.doc_id]
        told = [text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind in ("generalised", "removed")]
        wrong += sum(not any(x in t for x in names) for t in told)
        if n > 1:
            known += len(names)
            found += sum(any(x in t for t in told) for x in names)
    assert found >= 0.97 * known and wrong <= 2, (found, known, wrong)


class Length:
    """Prices each string at its length, so that all candidates that are met are told."""

    def marginal(self, candidate, before, after):
        return len(candidate)


def test_secrets_among_many_spans_and_contexts_equal_each_looked_up_alone():
    rng = random.Random(21)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    said = ["password = ", "token ", "key: ", "auth", "x", "\n", " " * 50]
    for _ in range(200):
        text = "".join(rng.choice(said) + rng.choice([pick("0123456789abcdef", 20), pick("abXY01", 18), "plain", "tokenauth1-secret-token2"]) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(1, 30)))
        taken = secrets.base_spans(text)
        contexts = [c.span() for c in secrets.CONTEXT.finditer(text)]
        want = []
        for m in secrets.CANDIDATE.finditer(text):
            a, b = m.span()
            near = any(e <= a and a - e <= secrets.REACH and "\n" not in text[e:a] for _, e in contexts[-1:] + [c for c in contexts if c[1] <= a][-1:]) or any(s >= b and s - b <= secrets.REACH and "\n" not in text[b:s] for s, _ in contexts)
            free = not any(s < b and a < e for s, _, e in taken)
            mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
            named = sum(map(len, secrets._KNOWN.findall(m[0].lower()))) >= secrets.NAMED * len(m[0])
            if near and free and mixed and not named:
                want.append((a, b))
        assert secrets.novel_spans(text, taken, Length()) == want


def test_secrets_of_long_texts_take_time_in_proportion():
    import time

    line = "password = 0123456789abcdef0123 token kJ8sd7Fjk2LmN0pQr5TuVw9x\n"
    took = []
    for n in (2_000, 16_000):
        text = line * n
        began = time.process_time()
        assert len(secrets.novel_spans(text, secrets.base_spans(text), Length())) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0], took


def test_secrets_of_no_rows_repeated_rows_and_clashing_columns(spark, empty):
    assert secrets.scan(empty).count() == 0
    docs = spark.createDataFrame([(1, "token=abcdefghijkl"), (1, "token=abcdefghijkl"), (2, None)], "doc_id long, text string").withColumn("spans", F.lit("mine"))
    assert sorted(r.spans for r in secrets.scan(docs).collect()) == ["", "assign:0:18", "assign:0:18"]


def test_leaks_of_long_texts_no_documents_and_clashing_columns(spark, empty):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string")
    long = "x y " * 100_000 + " ".join(f"w{i}" for i in range(14)) + " z" * 1000
    docs = spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string").withColumn("n_hit", F.lit("mine"))
    got = {r.doc_id: r.n_hit for r in leaks.decontaminate(docs, items).collect()}
    assert got == {1: 14, 2: 0} and [r.n_hit for r in leaks.clean(docs, items).collect()] == ["mine"]
    assert leaks.decontaminate(empty, items).count() == 0 and leaks.clean(empty, items).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks_brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            wins.setdefault(i, set()).update([tuple(w)] if len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)])
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, ws in wins.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    pick = lambda n: " ".join(rng.choice(["Aa", "bb", "c1", "é", "dd", "ee"]) for _ in range(n))
    items = [(i, pick(rng.choice([1, 3, 9, 10, 11, 14]))) for i in range(12)] + [(12, None), (13, "--"), (14, "aa " * 12), (14, "aa " * 12), (None, "bb bb bb")]
    docs = [(i, pick(rng.randint(0, 80))) for i in range(60)] + [(100 + i, pick(5) + " " + t + "!" + pick(4)) for i, t in items[:12]] + [(200, None), (201, ""), (202, "aa," * 500), (1, "bb"), (1, "bb")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_brute(docs, items)
    assert sorted(map(tuple, leaks.decontaminate(d, b).collect()), key=repr) == want
    monkeypatch.setattr(leaks, "MAX_BROADCAST_ANCHORS", 16)  # several parts, as for large benchmarks
    assert sorted(map(tuple, leaks.decontaminate(d, b).collect()), key=repr) == want
    assert leaks.clean(d, b).count() == sum(not r[-1] for r in want)
    nothing = b.limit(0)
    assert all(r.n_hit == 0 for r in leaks.decontaminate(d, nothing).collect())
