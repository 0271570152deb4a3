"""Exact copies and near copies against brute force."""

import hashlib
import os
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import op04_jaccard as jaccard
from tessera.llm import op10_exact_dedup as exact
from tessera.llm.components import components


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]", "", t or "")


def exact_brute(corpus):
    by = {}
    for d, t, *_ in corpus:
        by.setdefault(norm(t), []).append((-len(t or ""), d is not None, d if d is not None else 0, d))
    out = []
    for d, t, *_ in corpus:
        g = by[norm(t)]
        keep = min(g)[3]
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_driver_plans_and_holds_no_more_than_is_needed(spark, monkeypatch):
    """Where the first pairs join all that could link, no plans are made to compare none; the Bloom filter is let go."""
    rng = np.random.default_rng(31)
    texts = [[f"w{x}" for x in rng.integers(0, 9999, 60)] for _ in range(6)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, ["new", *texts[0]], ["new", *texts[1]]])]
    compared, filters, verified, bloom_of = [], [], jaccard.verified, jaccard.bloom_of
    monkeypatch.setattr(jaccard, "verified", lambda pairs, reps: compared.append(pairs.count()) or verified(pairs, reps))
    monkeypatch.setattr(jaccard, "bloom_of", lambda shared: filters.append(bloom_of(shared)) or filters[-1])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(6)} | {6: 0, 7: 1}
    assert compared == [2]
    assert [os.path.exists(b._path) for b in filters] == [False]


def test_exact_equals_brute_force(docs, corpus):
    assert rows(exact.exact_dedup(docs)) == exact_brute(corpus)


def test_later_micro_batches_meet_the_state_of_earlier_ones(docs, corpus):
    prints = exact.fingerprints(common.numbered(docs))
    assert len(prints.inputFiles()) >= 2
    state = exact.stream_state(prints)
    assert len({f.rpartition("/")[0] for f in state.inputFiles()}) >= 2
    want = {}
    for _, t, *_ in corpus:
        k = hashlib.sha256(norm(t).encode()).hexdigest()
        want[k] = want.get(k, 0) + 1
    assert {r.digest: r.group_size for r in state.collect()} == want


def test_bytes_decide_when_digests_collide(docs, corpus):
    weak = exact.groups(common.numbered(docs), digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    got = rows(weak.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")), "text_sha256"))
    assert got == exact_brute(corpus)


def test_state_lasts_over_batches(docs, corpus):
    got = exact.groups(common.numbered(docs), max_files=1)
    assert rows(got.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")), "text_sha256")) == exact_brute(corpus)


def test_one_row_of_each_group_stays(docs, corpus):
    kept = exact.distinct_documents(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t, *_ in corpus})


def test_empty_table(empty):
    assert exact.exact_dedup(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard_brute(corpus):
    s = [shingles(t) for _, t, *_ in corpus]
    up = list(range(len(s)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, *_) in enumerate(corpus):
        ids.setdefault(root(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(s[i]), least[root(i)]) for i, (d, *_) in enumerate(corpus)), key=repr)


def test_jaccard_equals_brute_force(docs, corpus):
    assert rows(jaccard.near_duplicates(docs)) == jaccard_brute(corpus)


def test_one_row_of_each_component_stays(docs, corpus):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    alone = sum(1 for _, n, _ in jaccard_brute(corpus) if n == 0)
    groups = len({c for _, n, c in jaccard_brute(corpus) if n})
    assert kept.count() == alone + groups


def test_group_of_near_copies_is_not_made_into_pairs(spark, monkeypatch):
    """Near copies of one text, not all of them alike enough to link: the pairs looked at grow with the group, not its square."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(120), 2):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    corpus = list(enumerate(texts))
    looked, whole = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, reps: (looked.append(pairs.count()), whole(pairs, reps))[1])
    df = common.written(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert rows(jaccard.near_duplicates(df)) == jaccard_brute(corpus)
    assert sum(looked) <= 8 * len(texts), looked


def offsets(*sets):
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_linked_sets_share_keys(n, seed):
    """The pigeonhole: any two sets that link emit t common keys in their joint band, whatever the fineness."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    drop = int(rng.integers(0, len(a) // 4 + 1))
    add = int(rng.integers(0, len(a) // 4 + 1))
    b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2))))
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
        return
    h, off = offsets(a, b)
    levels = {}
    for joint, need in jaccard.joints(np.diff(off)):
        for j, level in zip(joint, jaccard.levels_needed(h, off, joint, need)):
            levels[int(j)] = max(levels.get(int(j), 0), int(level))
    key, row = jaccard.keys_of(h, off, levels)
    joint = int(jaccard.band_of(np.array([min(len(a), len(b))]))[0])
    common_keys = [k for k in np.intersect1d(key[row == 0], key[row == 1]) if int(k) & 1 == joint & 1]
    assert len(common_keys) >= jaccard.COMMON[joint]
    words, begin = jaccard.full_parity(h, off)
    assert jaccard.distance(words[begin[0] : begin[1]], words[begin[1] : begin[2]]) <= len(a) + len(b) - 2 * both


def varied(rng, n, at, word):
    w = list(n)
    for _ in range(at):
        w[rng.randrange(len(w))] = word()
    return w


def test_groups_that_share_much(spark):
    """A passage that many texts share, a group of copies at all distances, and long ones, against brute force."""
    rng = random.Random(23)
    word = lambda: "w" + str(rng.randrange(100000))
    some = lambda n: [word() for _ in range(n)]
    passage, base, long = some(200), some(90), some(3000)
    texts = [" ".join(some(rng.choice([30, 80, 150, 250])) + passage + some(rng.choice([30, 80]))) for _ in range(120)]
    texts += [" ".join(varied(rng, base, rng.randrange(6), word)) for _ in range(500)]
    texts += [" ".join(varied(rng, long, rng.choice([5, 60, 90, 120, 150]), word)) for _ in range(12)]
    corpus = list(enumerate(texts))
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    assert rows(jaccard.near_duplicates(docs)) == jaccard_brute(corpus)


def test_no_pattern_of_letters_makes_words_equal(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    got = jaccard.near_duplicates(spark.createDataFrame([(1, thue), (2, other), (3, thue.upper())], "doc_id long, text string"))
    assert rows(got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_columns_of_the_same_names_stay(docs):
    more = docs.withColumn("_row", F.lit("mine")).withColumn("__ROW", F.lit(1)).withColumn("_path", F.lit("x"))
    for f in (exact.distinct_documents, jaccard.representatives):
        kept = f(more)
        assert kept.columns == more.columns
        assert {r._row for r in kept.select("_row").collect()} == {"mine"}
        assert kept.count() == f(docs).count()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 8), (6, 6)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7)}


def test_components_make_no_round_to_see_that_nothing_changes(spark, monkeypatch):
    """Stars are told as such; what else there is takes the rounds that change it."""
    stored, written = [], common.written
    monkeypatch.setattr(common, "written", lambda *a: stored.append(1) or written(*a))
    stars = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    for edges, want, most in (([(1, 2), (3, 1), (4, 4), (8, 7)], stars, 1), ([(1, 2), (2, 3)], dict.fromkeys((1, 2, 3), 1), 3), ([(i, i + 1) for i in range(20)], dict.fromkeys(range(21), 0), 11)):
        stored.clear()
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want
        assert len(stored) <= most, (edges, len(stored))
