import random

import pytest


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="session")
def corpus():
    """Small texts: copies, near copies, nulls, empties, short and long ones, repeated rows."""
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        texts.append(" ".join(word(rng) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 60, 200]))))
    for i in range(0, 40, 2):  # near copies of growing distance
        w = texts[i].split()
        for _ in range(1 + i // 8):
            w[rng.randrange(len(w))] = word(rng)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].replace(" ", "\t"), texts[5].upper(), texts[8] + " \n", None, None, "", " \t\n", "x" * 30000, "é🙂 " * 4000, "the same five words here", "the same five words here now"]
    rows = [(i, t, "l", 1) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, texts[9], "l", 1)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus, with other columns whose names clash with results."""
    df = spark.createDataFrame([(d, t, lang, n, -1, "k") for d, t, lang, n in corpus], "doc_id long, text string, lang string, n_tokens long, component_id long, key string")
    path = _stored(df)
    return spark.read.parquet(path)


def _stored(df):
    import tempfile

    path = tempfile.mkdtemp() + "/docs.parquet"
    df.repartition(3, "doc_id").write.parquet(path)
    return path


@pytest.fixture(scope="session")
def empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.schema(df.schema).parquet(_stored(df))
