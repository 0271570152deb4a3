"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other training text, toxic or
not, is unlabelled. Numpy logistic classifiers over the words of a text minimise
the class-prior-corrected risk  pi*R+(P) + max(0, R-(U) - pi*R-(P));  where the
bracket turns negative it counts as 0, which keeps the classifier from fitting
the unlabelled set as if it were negative. ``VOTES`` classifiers are trained from
different orders and averaged; the offset then makes the mean score of the
unlabelled sample the class prior, which is the share of toxic among labelled
training documents.

The fit reads at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` other
documents, drawn by a hash of the id; every document's whole text is scored.

Defined results: a null or empty text has no words and gets the prior's score;
rows without a label are unlabelled, repeated labels of a document count once,
toxic if any says so; with no positives every score is 0; a null id is not held
out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textnum

MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: A word counts from so many sampled documents on; of those, at most MAX_WORDS, the most telling.
MIN_DOCS, MAX_WORDS = 3, 1 << 16
#: Standard errors by which a word's rates in positives and in other text must differ.
MIN_APART = 5.0
VOTES, EPOCHS, BATCH, RATE, DECAY = 3, 16, 1024, 0.05, 1e-2
THRESHOLD = 0.3
_LUT_BITS = 22


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of each row: runs of letters, digits and non-ASCII, A-Z lower-cased."""
    raw = textnum.LOWER[raw]
    start, end, row = textnum.spans(raw, off, textnum.IS_WORD)
    return textnum.word_hashes(raw, start, end), row


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: list[np.ndarray] = []
        for _, _, raw, off in textnum.slices(batch.column("text")):
            h, row = words(raw, off)
            at = np.searchsorted(row, np.arange(len(off)))
            sets += [np.unique(h[a:b]).view(np.int64) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "words": pa.array(sets, pa.list_(pa.int64()))})


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(distinct words of each sampled document, positive or not, class prior); docs and labels hold training rows only."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = told.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    prior = min(0.9, max(1e-3, (n["toxic"] or 0) / n["n"])) if n["n"] else 0.0
    order = F.xxhash64("doc_id")
    positive = told.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(order).limit(MAX_POSITIVE)
    other = docs.select("doc_id").where("doc_id IS NOT NULL").select("doc_id", F.lit(False).alias("positive")).orderBy(order).limit(MAX_UNLABELLED)
    # at most 16,000 ids: a bounded broadcast; a positive that is drawn as unlabelled too stays in both
    drawn = F.broadcast(positive.unionByName(other))
    got = docs.join(drawn, "doc_id").select("positive", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_distinct, "positive boolean, words array<long>").toArrow()
    sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in got.column("words")]
    flags = np.array(got.column("positive").to_pylist(), bool)
    at = sorted(range(len(sets)), key=lambda i: (flags[i], len(sets[i]), sets[i].tobytes()))
    return [sets[i] for i in at], flags[at], prior


def fit(sets: list[np.ndarray], positive: np.ndarray, prior: float) -> dict:
    """Word hashes (sorted), their weights, the offset of the log odds."""
    if not positive.any() or prior <= 0:
        return {"hash": np.zeros(0, np.uint64), "weight": np.zeros(0, np.float32), "bias": -np.inf}
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, inverse = np.unique(every, return_inverse=True)
    n_pos, n_all = int(positive.sum()), len(sets)
    in_pos = np.bincount(inverse, positive[row], minlength=len(names))
    in_other = np.bincount(inverse, ~positive[row], minlength=len(names))
    # how much commoner a word is in positives; shrunk towards none for rare words
    rate_pos, rate_other = (in_pos + 0.5) / (n_pos + 1), (in_other + 0.5) / (n_all - n_pos + 1)
    lift = np.log((rate_pos + 0.01) / (rate_other + 0.01))
    # how many standard errors the two rates lie apart: chance differences are no features
    both = (in_pos + in_other + 1) / (n_all + 2)
    apart = (rate_pos - rate_other) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / max(1, n_all - n_pos)))
    use = np.flatnonzero((in_pos + in_other >= MIN_DOCS) & (np.abs(apart) > MIN_APART))
    use = np.sort(use[np.argsort(-np.abs(apart[use]), kind="stable")[:MAX_WORDS]])
    to = np.full(len(names), -1)
    to[use] = np.arange(len(use))
    col = to[inverse]
    row, col = row[col >= 0], col[col >= 0]
    first = np.searchsorted(row, np.arange(n_all + 1))
    scale = lift[use]

    def logits(rows: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = np.concatenate([col[first[i] : first[i + 1]] for i in rows] or [col[:0]])
        at = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
        return np.bincount(at, w[cols], minlength=len(rows)), cols, at

    pos, other = np.flatnonzero(positive), np.flatnonzero(~positive)
    total, bias_total = np.zeros(len(use)), 0.0
    for vote in range(VOTES):
        rng = np.random.default_rng(vote)
        v = np.full(len(use), 0.5)  # weights are v * lift: a start at half of naive Bayes, decay towards it
        b = np.log(prior / (1 - prior))
        m, s, mb, sb, t = np.zeros(len(use)), np.zeros(len(use)), 0.0, 0.0, 0
        steps = max(20, len(other) // BATCH)
        for _ in range(EPOCHS):
            for _ in range(steps):
                p = rng.choice(pos, min(BATCH, len(pos)), replace=False)
                u = rng.choice(other, min(BATCH, len(other)), replace=False) if len(other) else p
                rows = np.concatenate((p, u))
                z, cols, at = logits(rows, v * scale)
                sig = 1 / (1 + np.exp(-np.clip(z + b, -30, 30)))
                sp, su = sig[: len(p)], sig[len(p) :]
                negative = -np.log(1 - su + 1e-12).mean() - prior * -np.log(1 - sp + 1e-12).mean()
                g = np.zeros(len(rows))
                if negative >= 0:  # gradient of  pi*R+(P) + R-(U) - pi*R-(P)
                    g[: len(p)] = prior * (sp - 1) / len(p) - prior * sp / len(p)
                    g[len(p) :] = su / len(u)
                else:  # the bracket counts as 0: only pi*R+(P) is left
                    g[: len(p)] = prior * (sp - 1) / len(p)
                gv = np.bincount(cols, g[at], minlength=len(use)) * scale + DECAY * (v - 0.5) / max(1, len(use))
                gb = g.sum()
                t += 1
                m, s = 0.9 * m + 0.1 * gv, 0.999 * s + 0.001 * gv * gv
                mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
                k = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                v -= k * m / (np.sqrt(s) + 1e-6)
                b -= k * mb / (np.sqrt(sb) + 1e-6)
        total += v * scale
        bias_total += b
    weight, bias = total / VOTES, bias_total / VOTES
    if len(other):
        z, low, high = logits(other, weight)[0], -40.0, 40.0
        for _ in range(60):
            bias = (low + high) / 2
            low, high = (bias, high) if (1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))).mean() < prior else (low, bias)
    return {"hash": names[use], "weight": weight.astype(np.float32), "bias": bias}


def score_batch(raw: np.ndarray, off: np.ndarray, model: dict, lut: np.ndarray) -> np.ndarray:
    """A score for each row: each known word counts once."""
    h, row = words(raw, off)
    at = lut[(h >> np.uint64(64 - _LUT_BITS)).astype(np.int64)]
    hit = np.flatnonzero(at >= 0)
    h, row = h[hit], row[hit]
    at = np.searchsorted(model["hash"], h)
    at[at == len(model["hash"])] = 0
    same = model["hash"][at] == h if len(h) else np.zeros(0, bool)
    pair = np.unique(row[same] * np.int64(1 << 17) + at[same])
    z = np.bincount(pair >> 17, model["weight"][pair & ((1 << 17) - 1)], minlength=len(off) - 1)
    return 1 / (1 + np.exp(-np.clip(z + model["bias"], -700, 700)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted of each row; a boolean held_out column is passed on."""
    keep = [c for c in ("held_out",) if c in docs.columns]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lut = np.full(1 << _LUT_BITS, -1, np.int8)
        lut[(m["hash"] >> np.uint64(64 - _LUT_BITS)).astype(np.int64)] = 0
        for batch in batches:
            s = [np.zeros(0)]
            same = 1 / (1 + np.exp(-m["bias"])) if np.isfinite(m["bias"]) else 0.0  # of texts without a known word
            for a, b, raw, off in textnum.slices(batch.column("text")):
                s.append(score_batch(raw, off, m, lut) if len(m["hash"]) else np.full(b - a, same))
            s = np.concatenate(s)
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", *keep)} | {"score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    schema = "doc_id long, " + "held_out boolean, " * bool(keep) + "score double, predicted int"
    return docs.select(F.col("doc_id").cast("long"), *keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.in_bucket("doc_id", 4, 2)
    model = fit(*sample(docs.where(~held).select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic")))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model)


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
