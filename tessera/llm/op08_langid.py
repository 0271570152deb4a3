"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Character 1- to 3-grams (A-Z and Latin-1/Latin-Extended capitals lower-cased)
are hashed into a table of fixed size. Document frequencies come from every
training document, summed in Spark. The weights are learned by follow-the-
regularised-leader (FTRL-proximal) with an elastic-net penalty on a sample of
training documents, about ``PER_LANG`` of each language, chosen by a hash of
the id; a second such sample, apart from it, fixes one temperature. Whole texts
are used in training and in prediction.

Defined results: a null text or one without a letter is ``und`` with score 0;
a null lang teaches nothing; a null id is not held out; with no labelled
training document every text is ``und``; ties go to the first language by
name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textnum

#: Slots of the hashed n-gram table.
SLOTS = 1 << 17
#: About as many documents of each language are fitted on, a fifth of them for the temperature.
PER_LANG = 1000
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 1e-3, 1e-5, 4, 32
#: Relative frequencies are small; all are multiplied by this.
SCALE = 50

#: Least score of a document that the pipeline keeps.
SURE = 0.5

_luts: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of code points under 0x250 (others stay); which code points are letters."""
    if not _luts:
        lower = np.arange(0x250, dtype=np.uint32)
        for i in range(0x250):
            if len(x := chr(i).lower()) == 1:
                lower[i] = ord(x)
        letter = np.zeros(0x110000, bool)
        for i in range(0x110000):
            letter[i] = unicodedata.category(chr(i))[0] == "L"
        _luts.extend((lower, letter))
    return _luts[0], _luts[1]


def code_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the row offsets into them."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return cp, heads[off]


def grams(cp: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, where they belong) for n = 1, 2, 3: positions of ``cp``, n-grams across rows left out."""
    lower, _ = _tables()
    cp = np.where(cp < 0x250, lower[np.minimum(cp, 0x24F)], cp)
    h = np.zeros(len(cp), np.uint32)
    row_end = np.zeros(len(cp) + 1, bool)
    row_end[off[1:]] = True
    for n in (1, 2, 3):
        m = len(cp) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + (cp[n - 1 : n - 1 + m] + np.uint32(n)) * np.uint32(0x9E3779B1)
        ok = np.ones(m, bool)
        for i in range(1, n):
            ok &= ~row_end[i : i + m]
        at = np.flatnonzero(ok)
        x = h[at]
        yield ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 17)).astype(np.int64), at


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    seen = np.zeros(SLOTS, bool)
    for batch in batches:
        for _, _, raw, off in textnum.slices(batch.column("text")):
            cp, at = code_points(raw, off)
            found = list(grams(cp, at))
            for i in range(len(at) - 1):
                for slot, pos in found:
                    a, b = np.searchsorted(pos, at[i : i + 2])
                    seen[slot[a:b]] = True
                if at[i + 1] - at[i] < 2000:
                    some = np.unique(np.concatenate([slot[slice(*np.searchsorted(pos, at[i : i + 2]))] for slot, pos in found] or [np.zeros(0, np.int64)]))
                    total[some] += 1
                    seen[some] = False
                else:
                    total += seen
                    seen[:] = False
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int64()), "df": pa.array(total[some], pa.int64())})


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, counts = [], []
        for _, _, raw, off in textnum.slices(batch.column("text")):
            cp, at = code_points(raw, off)
            found = list(grams(cp, at))
            for i in range(len(at) - 1):
                s, c = np.unique(np.concatenate([slot[slice(*np.searchsorted(pos, at[i : i + 2]))] for slot, pos in found] or [np.zeros(0, np.int64)]), return_counts=True)
                slots.append(s.astype(np.int32))
                counts.append(c.astype(np.int32))
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "part": batch.column("part"), "slots": pa.array(slots, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))})


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal with elastic net; rows are sparse."""

    def __init__(self, slots: int, classes: int):
        self.z = np.zeros((slots, classes), np.float32)
        self.n = np.zeros((slots, classes), np.float32)
        self.bias = np.zeros(classes, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)

    def step(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        slot = np.concatenate([s for s, _ in rows])
        value = np.concatenate([v for _, v in rows])[:, None]
        row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
        used, inverse = np.unique(slot, return_inverse=True)
        w = self.weights(used)
        logits = np.zeros((len(rows), len(self.bias)), np.float32)
        np.add.at(logits, row, w[inverse] * value)
        p = softmax(logits + self.bias)
        p[np.arange(len(y)), y] -= 1
        g = np.zeros_like(w)
        np.add.at(g, inverse, p[row] * value / len(rows))
        n = self.n[used]
        self.z[used] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[used] += g * g
        self.bias -= 0.1 * p.mean(axis=0)


def _values(s: np.ndarray, c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of slots s with counts c."""
    return c / max(1.0, float(c.sum())) * idf[s] * SCALE


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The scale that makes the likelihood of held-back rows greatest."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 61):
        p = softmax(logits / t)
        best = min(best, (float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean()), float(t)))
    return best[1]


def fit(docs: DataFrame) -> dict:
    """languages, table (slots x languages, idf and temperature folded in), bias; from docs (doc_id, text, lang)."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return {"languages": [], "table": np.zeros((SLOTS, 0), np.float32), "bias": np.zeros(0, np.float32)}
    df = np.zeros(SLOTS)
    counted = train.select("text").mapInArrow(_document_frequencies, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column("slot").to_numpy()] = counted.column("df").to_numpy()
    total = sum(sizes.values())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, PER_LANG / n))).otherwise(share)
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0, 1).otherwise(0)
    sample = train.where(draw < share).select("lang", part.alias("part"), "text").mapInArrow(_term_counts, "lang string, part int, slots array<int>, counts array<int>").toArrow()
    code = {x: i for i, x in enumerate(languages)}
    y, parts = np.array([code[x] for x in sample.column("lang").to_pylist()], np.int64), sample.column("part").to_numpy()
    slots, counts = (sample.column(k).combine_chunks() for k in ("slots", "counts"))
    del sample
    # one array of values and one of slots, rows being parts of them: thousands of small arrays would stay with the driver
    slot, value, off = slots.values.to_numpy(), counts.values.to_numpy().astype(np.float32), slots.offsets.to_numpy()
    del counts
    for a, b in zip(off, off[1:]):
        value[a:b] = _values(slot[a:b], value[a:b], idf)
    rows = [(slot[a:b], value[a:b]) for a, b in zip(off, off[1:])]
    # the sample arrives in any order; the updates go by content, so a rerun learns the same

    def content(i: int, j: int) -> int:
        x, y_ = ((int(y[k]), len(rows[k][0])) for k in (i, j))
        if x == y_:  # bytes are made only of those that must be compared
            x, y_ = (rows[k][0].tobytes() for k in (i, j))
        return (x > y_) - (x < y_)

    order = sorted(range(len(rows)), key=cmp_to_key(content))
    rows, y, parts = [rows[i] for i in order], y[order], parts[order]
    learn = np.flatnonzero(parts == 0) if (parts == 0).any() else np.arange(len(rows))
    check = np.flatnonzero(parts == 1) if (parts == 1).any() else learn
    model = Ftrl(SLOTS, len(languages))
    rng = np.random.default_rng(8)
    for _ in range(EPOCHS):
        turn = rng.permutation(learn)
        for a in range(0, len(turn), BATCH):
            at = turn[a : a + BATCH]
            model.step([rows[i] for i in at], y[at])
    w = model.weights(np.arange(SLOTS))
    t = temperature(np.array([(w[s] * v[:, None]).sum(axis=0) for s, v in (rows[i] for i in check)]) + model.bias, y[check])
    del rows, slot, value, slots
    pa.default_memory_pool().release_unused()
    return {"languages": languages, "table": (w * idf[:, None] * (SCALE / t)).astype(np.float32), "bias": (model.bias / t).astype(np.float32)}


def scores(raw: np.ndarray, off: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, has a letter) of each row."""
    _, letter = _tables()
    cp, at = code_points(raw, off)
    n = len(at) - 1
    logits = np.zeros((n, len(model["languages"])), np.float64)
    total = np.zeros(n)
    for slot, pos in grams(cp, at):
        bounds = np.searchsorted(pos, at)
        total += np.diff(bounds)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            for k in range(logits.shape[1]):
                logits[full, k] += np.add.reduceat(model["columns"][k][slot], bounds[full], dtype=np.float64)
    known = np.zeros(n, bool)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        known[full] = np.maximum.reduceat(letter[cp], at[full])
    return softmax(logits / np.maximum(1, total)[:, None] + model["bias"]), known


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id with lang_pred, score; ``docs`` may have a boolean held_out, which is passed on."""
    keep = [c for c in ("held_out",) if c in docs.columns]
    model = model | {"columns": [np.ascontiguousarray(c) for c in model["table"].T]}
    model.pop("table")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m["languages"], "und"], object)
        for batch in batches:
            pred, score = [], []
            for a, b, raw, off in textnum.slices(batch.column("text")):
                if not m["languages"]:
                    pred.append(np.full(b - a, "und", object))
                    score.append(np.zeros(b - a))
                    continue
                p, known = scores(raw, off, m)
                best = p.argmax(axis=1)
                pred.append(names[np.where(known, best, -1)])
                score.append(np.where(known, p[np.arange(len(best)), best], 0.0))
            out = {k: batch.column(k) for k in ("doc_id", *keep)}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(np.concatenate(pred) if pred else [], pa.string()), "score": pa.array(np.concatenate(score) if score else [], pa.float64())})

    schema = "doc_id long, " + "held_out boolean, " * bool(keep) + "lang_pred string, score double"
    return docs.select(F.col("doc_id").cast("long"), *keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(predict, schema)


def understood(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs in some language: those predicted ``und`` go, and those of which the model is not sure.

    Sure is a calibrated score of ``SURE``: the language told is likelier than all the others together.
    """
    rows, own, number = common.numbered_apart(docs)
    told = identify(rows.select(F.col("_row").alias("doc_id"), "text"), model)
    rejected = common.written(told.where((F.col("lang_pred") == "und") | (F.col("score") < SURE)).select(F.col("doc_id").alias(number)))
    return common.drop_ids(own, rejected, number).drop(number)


def learn_from(docs: DataFrame) -> DataFrame:
    return docs.where(~common.in_bucket("doc_id", 4, 2))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(learn_from(docs))
    return identify(docs.select("doc_id", "text", common.in_bucket("doc_id", 4, 2).alias("held_out")), model)


QUERIES = {"op8_langid": op8_langid}
ORACLES: dict[str, str] = {}
