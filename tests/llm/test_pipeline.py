"""The pipeline's stages, one after another, against brute force; the registered names."""

import itertools
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, registry
from tessera.llm import op04_jaccard as jaccard
from tessera.llm import op05_decontaminate as leaks
from tessera.llm import op07_pii as pii
from tessera.llm import op08_langid as language
from tessera.llm import op10_exact_dedup as exact
from tests.llm.test_dedup import norm, shingles
from tests.llm.test_spans import leaks_brute

NUMBERS = range(1, 11)


def test_each_operator_is_registered_once():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(NUMBERS)
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_equal_brute_force(spark, corpus, docs):
    items = [(1, "the same five words here now"), (2, " ".join((corpus[6][1] or "").split()[:12]))]
    path = common.shared_dir(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    left = [(d, t) for d, t, *_ in corpus if any(c.isalpha() for c in t or "")]
    by = {}
    for d, t in left:
        k = (-len(t), d is not None, d or 0)
        if norm(t) not in by or k < by[norm(t)][0]:
            by[norm(t)] = (k, d, t)
    left = [(d, t) for _, d, t in by.values()]
    sets = [shingles(t) for _, t in left]
    group = list(range(len(left)))
    changed = True
    while changed:
        changed = False
        for i in range(len(left)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                    a, b = sorted((group[i], group[j]))
                    group = [a if g == b else g for g in group]
                    changed = True
    keep = {}
    for i, (d, _) in enumerate(left):
        k = (d is None, d or 0)
        if group[i] not in keep or k < keep[group[i]][0]:
            keep[group[i]] = (k, i)
    left = [left[i] for _, i in keep.values()]
    dirty = {r[0] for r in leaks_brute(left, items) if r[-1]}
    want = sorted((d for d, _ in left if d not in dirty), key=repr)
    got = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == want
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.written(stage(spark, frame, path))
        assert frame.columns == docs.columns, name


def test_the_rest_never_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in (root / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from tessera\.llm", p.read_text()), p


def test_rows_are_the_same_ones_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    """As after an executor is lost or joins: each table is planned with another number of splits than the one before."""
    key = "spark.sql.files.minPartitionNum"
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["walk", "green", "table", "window", "river", "stone", "cloud"]) + str(rng.randrange(99)) for _ in range(30))
    texts = [line() for _ in range(60)]
    texts += texts[:9] + [t + " end" for t in texts[10:20]] + ["", "\t", "12"] + [f"write to a{i}@corp.example {line()}" for i in range(9)]
    path = str(tmp_path)
    for k in range(3):  # files of unlike sizes, read in the order of size where they share a split
        spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(texts) if (i % 7) % 3 == k], "doc_id long, text string, lang string, n_tokens long").coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame([(1, texts[30]), (2, texts[41])], "item_id long, text string")

    def results():
        model = language.fit(language.learn_from(docs))
        frames = [language.understood(docs, model), exact.distinct_documents(docs), jaccard.near_duplicates(docs), jaccard.representatives(docs), leaks.decontaminate(docs, items), leaks.clean(docs, items), pii.find(docs), pii.sanitise(docs)]
        return [sorted(map(tuple, f.collect()), key=repr) for f in frames]

    want = results()
    write, turn = common.written, itertools.cycle(["8", "1"])

    def written(*args, **kwargs):
        out = write(*args, **kwargs)
        spark.conf.set(key, next(turn))
        return out

    monkeypatch.setattr(common, "written", written)
    try:
        spark.conf.set(key, "1")
        one = docs.select("doc_id", F.monotonically_increasing_id()).collect()
        spark.conf.set(key, "8")
        assert set(one) != set(docs.select("doc_id", F.monotonically_increasing_id()).collect())
        spark.conf.set(key, "1")
        got = results()
    finally:
        spark.conf.unset(key)
    for a, b in zip(want, got):
        assert a == b


def test_numbers_of_stored_rows_take_no_copy(spark, docs, monkeypatch):
    """Rows read from files get one number each without being written; others are stored."""
    n, made = docs.count(), []
    write = common.written
    monkeypatch.setattr(common, "written", lambda *args: made.append(1) or write(*args))
    few = common.numbered(docs.select("text", "doc_id").where("doc_id > 3"))
    assert not made and few.columns == ["text", "doc_id", "_row"]
    every = common.numbered(docs)
    assert not made and every.select("_row").distinct().count() == n
    assert {r._row for r in few.collect()} < {r._row for r in every.collect()}
    twice = common.numbered(docs.unionByName(docs))
    assert made and twice.select("_row").distinct().count() == 2 * n
    assert common.numbered(docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))).select("_row").distinct().count() == 2 * n
