"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than a chunk is cut into chunks that overlap. The end of each
chunk is pre-tokenised from a sure boundary of the left chunk and again from the
right chunk's start inside the overlap; the chunks are stitched at the first
boundary that both have. A match depends on what follows its start only, so from
there on both agree. What stands before it must not depend on what follows: the
pattern looks ahead only at the end of a run of white space, so no piece ends in
white space. The pieces between stitches are then encoded, each match of the
pattern separately; ids follow one another, so decoding concatenates the bytes
of the ids.

Texts beyond ``LONG`` code points are dealt out: overlapping chunks of them become
rows, each is pre-tokenised by itself on any executor, neighbours are stitched by a
window over the boundaries they found in what they share, and the pieces between
stitches are encoded as rows again and put together by their number. A text of which
two neighbours share no boundary is cut by one task instead, with longer overlaps.

Defined results: a null or empty text has no ids; runs longer than a chunk
without a boundary stay whole (the chunk grows until one is found); a lone
surrogate can't occur in Arrow's UTF-8; equal rows give equal results, one for
each row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common

#: Code points of a chunk, and of the stretch it shares with the next.
CHUNK, OVERLAP = 1 << 12, 1 << 7
#: Texts of more code points are dealt out over executors by pieces.
LONG = 1 << 21
#: Chunks in a piece of those that are dealt out, and code points at its end whose boundaries what follows could change.
PIECE, MARGIN = 64, 8
#: Characters that regular-expression engines don't class alike; no cut is made beside them.
_DISPUTED = set("\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Coder:
    """Encodes and decodes by a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.name_of = [str(i) for i in range(len(self.bytes_of))]

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """The starts of pre-tokens in text from start on, up to end; what follows end is seen."""
        out = []
        for m in self.pattern.finditer(text, start):
            if m.start() > end:
                break
            out.append(m.start())
        return out

    def stitches(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Where the text may be cut: true pre-token boundaries, about a chunk apart."""
        cuts, at, n = [0], 0, len(text)
        while n - at > chunk + overlap:
            want = at + chunk
            span = overlap
            found = None
            while found is None:
                stop = min(n, want + span)
                # the left chunk's own tokens come from its start, a true boundary; the right
                # one's from inside the overlap. Where they meet, they agree from then on.
                left = set(self.boundaries(text, max(at, want - span) if self._sure(text, max(at, want - span)) else at, stop))
                right = self.boundaries(text, want, stop)
                found = next((p for p in right if p > want and p in left and self.apart(text, p)), None)
                if found is None:
                    if stop == n:
                        return cuts + [n]
                    span *= 4
            cuts.append(found)
            at = found
        return cuts + [n]

    @staticmethod
    def apart(text: str, at: int) -> bool:
        """A boundary that doesn't depend on what follows it, nor on how an engine classes the characters beside it."""
        return at > 0 and not text[at - 1].isspace() and not {text[at - 1], text[at]} & _DISPUTED

    @staticmethod
    def _sure(text: str, at: int) -> bool:
        """A boundary whatever stands before: white space after something else."""
        return at == 0 or (text[at].isspace() and not text[at - 1].isspace())

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if len(text) <= chunk + overlap:
            return self.core.encode_ordinary(text)
        cuts = self.stitches(text, chunk, overlap)
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.core.encode_ordinary(text[a:b])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.name_of.__getitem__, ids))


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The process's coder for these settings."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or os.environ.get("BYTE_BPE_RANKS") or default_ranks(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, long: int = LONG, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, if asked for), ids_sha256, decoded_sha256 of each row of docs."""
    path, pattern = _settings(path, pattern)
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(batch), 256):  # few texts at a time: ids take more room than texts
                n, every, said, back = [], [], [], []
                for text in texts.slice(a, 256):
                    ids = c.encode(text.as_py() or "", chunk, overlap)
                    n.append(len(ids))
                    said.append(hashlib.sha256(c.listed(ids).encode()).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if with_ids:
                        every.append(np.array(ids, np.int32))
                cols = {"doc_id": batch.column("doc_id").slice(a, 256), "n_tokens": pa.array(n, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(every, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols | {"ids_sha256": pa.array(said), "decoded_sha256": pa.array(back)})

    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= long).mapInArrow(whole, schema)
    longer = docs.where(F.length("text") > long)
    if longer.select("doc_id").isEmpty():
        return short
    return short.unionByName(_dealt(longer, path, pattern, chunk, overlap, with_ids))


def _dealt(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, with_ids: bool) -> DataFrame:
    """The same for very long texts, whose pieces are encoded apart from each other."""

    size, over = PIECE * chunk, max(overlap, 4 * MARGIN)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in ("_row", "doc_id", "text"))):
                for k in range(-(-len(text) // size)):
                    base = max(0, k * size - over)
                    yield pa.RecordBatch.from_pydict({"_row": pa.array([row], pa.int64()), "doc_id": pa.array([doc], pa.int64()), "k": pa.array([k], pa.int32()), "base": pa.array([base], pa.int64()), "text": pa.array([text[base : (k + 1) * size + over]])})

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk, pre-tokenised by itself, the boundaries fit for a cut in what it shares with its neighbours."""
        c = coder(path, pattern)
        for batch in batches:
            for row, k, base, text in zip(*(batch.column(x).to_pylist() for x in ("_row", "k", "base", "text"))):
                fit = [base + p for p in c.boundaries(text, 0, len(text) - MARGIN) if c.apart(text, p)]
                first = [p for p in fit if p < k * size + over]
                last = [p for p in fit if p >= (k + 1) * size - over]
                yield pa.RecordBatch.from_pydict({"_row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int32()), "first": pa.array([first], pa.list_(pa.int64())), "last": pa.array([last], pa.list_(pa.int64()))})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of texts of which some neighbours share no boundary: cut one after another, with as much overlap as it takes."""
        c = coder(path, pattern)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in ("_row", "doc_id", "text"))):
                cuts = c.stitches(text, chunk, overlap)
                # pieces of about PIECE chunks: neighbours go together again
                cuts = [0, *(b for a, b in zip(cuts, cuts[1:]) if b // size > a // size and b < len(text)), len(text)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield pa.RecordBatch.from_pydict({"_row": pa.array([row], pa.int64()), "doc_id": pa.array([doc], pa.int64()), "k": pa.array([k], pa.int32()), "text": pa.array([text[a:b]])})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            ids = [c.core.encode_ordinary(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("_row", "doc_id", "k")} | {"ids": pa.array(ids, pa.list_(pa.int32()))})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One document after another, each from its pieces in order; digests go on from piece to piece."""
        doc, now = None, None

        def done() -> pa.RecordBatch:
            cols = {"doc_id": pa.array([doc[1]], pa.int64()), "n_tokens": pa.array([doc[2]], pa.int64())}
            if with_ids:
                cols["ids"] = pa.array([np.concatenate(doc[5]) if doc[5] else np.zeros(0, np.int32)], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(cols | {"ids_sha256": pa.array([doc[3].hexdigest()]), "decoded_sha256": pa.array([doc[4].hexdigest()])})

        c = coder(path, pattern)
        for batch in batches:
            for row, doc_id, ids in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if row != now:
                    if doc:
                        yield done()
                    now, doc = row, [row, doc_id, 0, hashlib.sha256(), hashlib.sha256(), []]
                ids = ids.values
                some = ids.to_pylist()
                if some:
                    doc[3].update(((" " if doc[2] else "") + c.listed(some)).encode())
                    doc[4].update(c.decode(some))
                    doc[2] += len(some)
                    if with_ids:
                        doc[5].append(ids.to_numpy())
        if doc:
            yield done()

    docs = common.written(common.with_row_id(docs))
    cut_up = common.written(docs.mapInArrow(chunks, "_row long, doc_id long, k int, base long, text string").repartition("_row", "k"))
    at = cut_up.select("_row", "k", "base", "text").mapInArrow(starts, "_row long, k int, first array<long>, last array<long>")
    # a chunk begins where its left neighbour's boundaries and its own first agree
    before = F.lag("last").over(Window.partitionBy("_row").orderBy("k"))
    stitched = common.written(at.withColumn("begin", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(before, "first")))).select("_row", "k", "begin"))
    apart = stitched.where("begin IS NULL").select("_row").distinct()
    bounds = stitched.withColumn("stop", F.lead("begin").over(Window.partitionBy("_row").orderBy("k"))).join(apart, "_row", "left_anti")
    end = F.coalesce(F.col("stop"), F.col("base") + F.length("text"))
    met = cut_up.join(bounds, ["_row", "k"]).select("_row", "doc_id", "k", F.substring("text", (F.col("begin") - F.col("base") + 1).cast("int"), (end - F.col("begin")).cast("int")).alias("text"))
    other = docs.join(apart, "_row", "left_semi").mapInArrow(cut, "_row long, doc_id long, k int, text string")
    parts = common.written(met.unionByName(other).repartition("_row", "k").mapInArrow(pieces, "_row long, doc_id long, k int, ids array<int>"))
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return parts.repartition("_row").sortWithinPartitions("_row", "k").mapInArrow(joined, schema)


def decode(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, raw (binary) of each row of ids (doc_id, ids); a null list is empty."""
    path, pattern = _settings(path, pattern)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            raw = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "raw": pa.array(raw, pa.binary())})

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(back, "doc_id long, raw binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
