"""Whitening, product codes and fingerprints against dense and brute-force versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op11_whitening as white
from tessera.llm import op12_codes as codes
from tessera.llm import op13_simhash as simhash
from tessera.llm import textnum, vectors

INF, NAN = float("inf"), float("nan")


def table(spark, rows, label="int"):
    df = spark.createDataFrame([(*r, 5, "x", 0.5) for r in rows], f"vec_id long, embedding array<float>, label {label}, component int, code string, error double")
    return df.repartition(3)


@pytest.fixture(scope="module")
def mixed():
    """Vectors of 16: copies, repeated ids, nulls, non-finite entries, short ones, null ids and labels."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1 + np.arange(16) % 5)], i % 3 or None) for i in range(60)]
    rows += [rows[4]] * 40 + [(4, rows[5][1], 1), (None, rows[7][1], None), (None, rows[8][1], 2)]
    rows += [(100, None, 1), (101, [None, *rows[0][1][1:]], 1), (102, [NAN, *rows[0][1][1:]], 1), (103, [INF] * 16, 1), (104, [-INF] * 16, 1), (105, rows[0][1][:5], 1), (106, [], 1)]
    return rows


def sound(rows):
    keep = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    d = max(len(r[1]) for r in keep)
    return [r for r in keep if len(r[1]) == d]


def whole(rows, scale):
    return np.array([[int(np.floor(float(np.float32(v)) * scale)) for v in r[1]] for r in rows])


# ---- op11


def test_whitening_equals_a_dense_solver(spark, mixed):
    got = white.whitened(table(spark, mixed)).toPandas()
    rows = sound(mixed)
    x = whole(rows, 256)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    v = (u - s / n).T @ (u - s / n) / n
    w, e = np.linalg.eigh(v)
    w, e = w[::-1], e[:, ::-1]
    assert len(got) == 4 * len(rows)
    for j in range(4):
        ref = (x - s / n) @ e[:, j] / np.sqrt(w[j])
        own = got[got.component == j + 1]
        assert np.allclose(own.explained, w[j] / w.sum(), rtol=1e-12)
        assert (own.n == n).all() and (own.identity_error < 1e-9).all() and own.identity_error.nunique() == 1
        key = lambda i, dev, val: (str(i), int(dev), round(val, 8))
        told = sorted(key(-1 if i != i else int(i), dev, val) for i, dev, val in zip(own.vec_id.astype(float), own.deviation, own.whitened))
        want = [sorted(key(-1 if r[0] is None else r[0], ((n * q - s) ** 2).sum(), sign * val) for r, q, val in zip(rows, x, ref)) for sign in (1, -1)]
        assert told in want


def test_whitening_of_few_equal_or_no_vectors(spark):
    one = [0.5, 0.25]
    assert white.whitened(table(spark, [])).collect() == []
    assert white.whitened(table(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    assert white.whitened(table(spark, [(1, one, 1), (2, one, 1)])).collect() == []
    line = white.whitened(table(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and abs(line[0].explained - 1) < 1e-12
    assert sorted(round(abs(r.whitened), 6) for r in line) == [0, 0.707107, 0.707107, 1.414214, 1.414214]


def test_whitening_of_huge_entries(spark):
    rows = white.whitened(table(spark, [(i, [1e30 * (i - 2), float(i), 3e38 * (i % 2)], 1) for i in range(5)])).collect()
    assert rows and all(r.deviation is None and np.isfinite(r.whitened) for r in rows)


def test_deviations_are_exact_where_products_pass_64_bits():
    x = np.array([[1 << 40, -5], [3, 1 << 41]])
    sums = [int(v) for v in x.sum(axis=0)]
    assert white.deviations(x, 2, sums) == [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]


@pytest.mark.parametrize("spectrum, most", [([9, 7, 5, 3] + [1] * 60, 256), ([5] * 4 + [4] * 40 + [0] * 20, 256), (list(np.linspace(1, 2, 200)), 40), ([1, 1, 1, 1, 1, 1, 1, 1, 1, 1], 32), ([1] + [0] * 30, 32), ([0] * 12, 32)])
def test_lanczos_restarts_and_breaks_down_safely(spectrum, most):
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((len(spectrum),) * 2))
    a = q * np.array(spectrum, float) @ q.T
    values, vecs, residual = white.lanczos(lambda b: a @ b, len(a), 4, most=most)
    want = sorted(spectrum, reverse=True)[:4]
    assert np.allclose(values, want, atol=1e-12 * max(1, want[0]))
    assert np.abs(vecs.T @ vecs - np.eye(4)).max() < 1e-12 and np.abs(a @ vecs - vecs * values).max() < 1e-12 * max(1, want[0])


# ---- op12


def codes_brute(rows):
    kept = sound(rows)
    x = whole(kept, 4096).astype(object)
    d = x.shape[1]
    w = -(-d // 8)
    x = np.concatenate([x, np.zeros((len(x), 8 * w - d), object)], axis=1)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i].tolist()))[:16]
    books = [[x[i, p * w : (p + 1) * w] for i in order] for p in range(8)]
    near = lambda v, book: min((sum((v - c) ** 2), e) for e, c in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            own = [near(v, book)[1] for v in x[:, p * w : (p + 1) * w]]
            for e in set(own):
                mine = [v for v, o in zip(x[:, p * w : (p + 1) * w], own) if o == e]
                book[e] = np.array([int(s) // len(mine) for s in sum(mine)], object)
    told = [[near(v[p * w : (p + 1) * w], books[p]) for p in range(8)] for v in x]
    error = [sum(d for d, _ in t) for t in told]
    label = {}
    for r, e in zip(kept, error):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    long = lambda v: v if v < 1 << 63 else None
    return sorted([(r[0], "".join(f"{e:02x}" for _, e in t), long(e_), long(label[r[2]]), sha) for r, t, e_ in zip(kept, told, error)], key=repr)


def codes_of(df):
    return sorted(map(tuple, codes.product_codes(df).collect()), key=repr)


def test_codes_equal_brute_force(spark, mixed):
    assert codes_of(table(spark, mixed)) == codes_brute(mixed)


@pytest.mark.parametrize("block", [5, 4096])
def test_codes_with_ties_small_blocks_and_uneven_parts(spark, block, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.25, 0.0, 0.25, 0.5]) for _ in range(13)], rng.choice([None, 1])) for i in range(50)]
    assert codes_of(table(spark, rows)) == codes_brute(rows)


def test_codes_of_few_huge_or_no_vectors(spark):
    assert codes_of(table(spark, [])) == []
    assert codes_of(table(spark, [(1, None, 1)])) == []
    few = [(3, [0.1] * 8, None), (None, [0.2] * 8, None)]
    assert codes_of(table(spark, few)) == codes_brute(few)
    huge = [(i, [float(v) for v in np.float32([1e12 * i, -1e13, 3.0 * i, 1e9, 0, 1, 2, i * i * 1e11])], 1) for i in range(30)]
    assert codes_of(table(spark, huge)) == codes_brute(huge)


def test_codes_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    rel = db.sql(codes.ORACLES["op12_codes"])
    got = codes.op12_codes(spark, sf_dir)
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in rel.columns) for r in got.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=70), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=6))
def test_filtered_trees_assign_as_all_distances_do(points, book):
    x, book = np.array(points), np.array(book)
    x = x[codes.tree_order(x, 3)]
    boxes = codes.caches(x, 3)
    want = codes.squares(x, book).argmin(axis=1)
    taken, owner = codes.filtered(x, boxes, book, 3)
    for a, b, entry, node in taken:
        assert (owner[a:b] == -1).all() and (boxes[2][node] == x[a:b].sum(axis=0)).all()
        owner[a:b] = entry
    assert (owner == want).all()


def test_far_clusters_are_assigned_as_subtrees():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-20, 20, (500, 3)) + c for c in ([0, 0, 0], [5000, 0, 0], [0, 9000, 0])])
    x = x[codes.tree_order(x)]
    taken, owner = codes.filtered(x, codes.caches(x), np.array([[0, 0, 0], [5000, 1, 0], [0, 9000, 1]]))
    assert (owner == -1).mean() > 0.9 and len(taken) < 20


def test_numbers_that_pass_64_bits_are_told(spark):
    assert vectors.whole(table(spark, [(1, [1e30, 0.0], 1)]), 4096, "vec_id")[1:] == (2, True)
    assert vectors.whole(table(spark, [(1, [1.0, -0.3], 1)]), 4096, "vec_id")[1:] == (2, False)


# ---- op13


def print_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_brute(rows, prints):
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))], key=repr)


@pytest.mark.parametrize("dense", [2, 256])
def test_near_copies_equal_brute_force(docs, corpus, dense):
    got = sorted(map(tuple, simhash.near_duplicates(docs, dense).collect()), key=repr)
    assert got == near_brute(corpus, [print_brute(t) for _, t, *_ in corpus])


def test_near_copies_of_no_documents(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_hashes_equal_the_library():
    rng = random.Random(2)
    text = bytes(rng.randrange(256) for _ in range(5000))
    spans = [(a, a + n) for n in [*range(0, 70), 300] for a in (0, 1, rng.randrange(4000))] + [(4990, 5000), (4999, 5000)]
    got = simhash.xxh64(np.frombuffer(text, np.uint8), *np.array(spans).T)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(text[a:b], 42) for a, b in spans]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aBé \n\t.", max_size=60), min_size=1, max_size=8), st.sampled_from([3, 1 << 16]))
def test_fingerprints_equal_brute_force(texts, piece):
    before, simhash._PIECE = simhash._PIECE, piece
    try:
        texts = [*texts, "one two three " * 200]
        got = [int(p) for *_, raw, off in textnum.slices(pa.array(texts), 64) for p in simhash.fingerprints_of(raw, off)]
    finally:
        simhash._PIECE = before
    assert got == [print_brute(t) for t in texts]


def test_links_are_whole_in_dense_balls(spark):
    """Thousands of fingerprints near one another, and chains that leave the ball; keys are told apart several times."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(1500)]
    chain = [centre ^ ((1 << 3 * k) - 1) for k in range(1, 21)]
    fps = sorted({centre ^ f for f in flips} | set(chain))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    arr = np.array(fps, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3, 1))
    want = {tuple(sorted((signed[i], signed[j]))) for i, j in zip(a, b)}
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    for dense in (8, 256):
        got = simhash.links(df, dense).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
