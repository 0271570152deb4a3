"""Near copies by SimHash fingerprints and tables of distances to pivots.

A fingerprint is the majority, bit by bit, of the hashes of a text's 3-word
shingles. For each distinct fingerprint the Hamming distances to PIVOTS reference
fingerprints are tabled, block of bits by block of bits. Two fingerprints that
differ in at most LINK bits agree on all of at least BLOCKS - LINK blocks, so the
distances of those blocks are the same: these runs of the table are the keys on
which rows meet. Rows of a key that more than DENSE rows share are told apart
further, by the distances over a quarter of the bits that may still differ (one of
four quarters holds none of three differences), until at most DENSE are left;
nothing is capped. Of rows that meet, the pairs of which some whole distance
differs by more than LINK are discarded (triangle inequality), the rest are
verified. Links lead to components; documents of one fingerprint are one node.

Defined results: a null or empty text, or one of white space, has the fingerprint
zero and is linked like any other; repeated rows and equal ids each give a row; a
component's id is the smallest id in it, null only if no id in it is known; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common, textnum
from tessera.llm.components import components

SHINGLE, SEED, LINK = 3, 42, 3
PIVOTS, BLOCKS, QUARTERS = 32, 6, 4
#: Rows of a key that are compared as they are; more are told apart further.
DENSE = 256
#: A fingerprint that more than this share of rows has meets its component by broadcast; at most 1 / HOT_SHARE do.
HOT_SHARE = 1 / 2000
#: Shingles whose bits are counted at a time.
_PIECE = 1 << 16

#: The pivots: reference fingerprints drawn once, by a fixed seed.
REFERENCES = np.random.default_rng(1302).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
_ODD = np.random.default_rng(1303).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def block_masks(bits: list[int], parts: int) -> list[int]:
    """The given bits dealt into parts of sizes as equal as possible, as masks."""
    return [sum(1 << b for b in bits[i::parts]) for i in range(parts)]


MASKS = block_masks(list(range(64)), BLOCKS)
AGREEING = list(itertools.combinations(range(BLOCKS), BLOCKS - LINK))


# ---- fingerprints


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed SEED) of spans of bytes: those under 32 bytes length by length, all of a length at once."""
    size = end - start
    out = np.zeros(len(start), _U)
    padded = np.append(text, np.zeros(8, np.uint8))
    eight, four = (np.ndarray((len(padded) - w + 1,), t, padded, strides=(1,)) for w, t in ((8, "<u8"), (4, "<u4")))
    whole = text.tobytes()
    with np.errstate(over="ignore"):
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n >= 32:
                out[rows] = np.fromiter((xxhash.xxh64_intdigest(whole[a : a + n], SEED) for a in start[rows].tolist()), _U, len(rows))
                continue
            at, h, done = start[rows], np.full(len(rows), SEED + int(n), _U) + _P5, 0
            while n - done >= 8:
                h = _turned(h ^ (_turned(eight[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
                done += 8
            if n - done >= 4:
                h = _turned(h ^ (four[at + done].astype(_U) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _turned(h ^ (padded[at + done].astype(_U) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> _U(33))) * _P2
            h = (h ^ (h >> _U(29))) * _P3
            out[rows] = h ^ (h >> _U(32))
    return out


def _spaced(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space after each, and where each begins (and the last one ends)."""
    size = end - start + 1
    to = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(to[-1]) - np.repeat(to[:-1] - start, size)
    text = raw[np.minimum(at, len(raw) - 1)]
    text[to[1:] - 1] = 0x20
    return text, to


def fingerprints_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprints of texts given as bytes, one after another, with their offsets."""
    raw = textnum.LOWER[raw]
    start, end, row = textnum.spans(raw, off, ~textnum.IS_SPACE)
    n = len(off) - 1
    counts, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    if not len(start):
        return np.zeros(n, _U)
    words = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(words)))
    shingles = np.where(words == 0, 0, np.maximum(words - SHINGLE + 1, 1))
    begin = np.concatenate(([0], np.cumsum(shingles)))
    for a in range(0, int(begin[-1]), _PIECE):
        b = min(a + _PIECE, int(begin[-1]))
        k = np.arange(a, b)
        r = np.searchsorted(begin, k, "right") - 1
        w = first[r] + k - begin[r]
        last = np.minimum(w + SHINGLE, first[r + 1])
        joined, to = _spaced(raw, start[w[0] : last[-1]], end[w[0] : last[-1]])
        h = xxh64(joined, to[w - w[0]], to[last - w[0]] - 1)
        # a bit of each byte at a time: sums of at most 255 fit the byte
        edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | ((k[1:] - begin[r[1:]]) % 255 == 0))))
        planes = np.stack([np.add.reduceat((h >> _U(i)) & _U(0x0101010101010101), edge) for i in range(8)], axis=1)
        each = planes.astype("<u8").view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        np.add.at(counts, r[edge], each)
        np.add.at(total, r[edge], np.diff(np.append(edge, len(r))))
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(_U)


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in textnum.slices(batch.column("text")):
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(fingerprints_of(raw, off).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (its 64 bits as a long) of each row of docs (doc_id, text), stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.written(docs.select("doc_id", "text").mapInArrow(_print_batches, f"doc_id {kind}, fp long"))


# ---- tables of distances


def distances(fp: np.ndarray, mask: int = (1 << 64) - 1) -> np.ndarray:
    """The Hamming distances of fingerprints to each pivot, over the bits of a mask."""
    return np.bitwise_count((fp[:, None] ^ REFERENCES) & _U(mask)).astype(np.uint8)


def _runs(fp: np.ndarray, mask: int) -> np.ndarray:
    """One number for each run of the table: the distances over a mask."""
    return textnum.mix(distances(fp, mask).astype(np.uint64) @ _ODD)


def _keyed(fp: np.ndarray, key: np.ndarray, free: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    at = np.arange(0, (len(fp) + 1) * PIVOTS, PIVOTS, dtype=np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(table))])
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(free.view(np.int64)), pa.array(fp.view(np.int64)), whole], names=["key", "free", "fp", "table"])


_ROWS = "key long, free long, fp long, table binary"
_STEP = 4096


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def _table_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = _longs(batch, "fp")
        for a in range(0, len(every), _STEP):
            fp = every[a : a + _STEP]
            table, runs = distances(fp), [_runs(fp, m) for m in MASKS]
            for k, agree in enumerate(AGREEING):
                with np.errstate(over="ignore"):
                    key = textnum.mix(sum((runs[j] * _ODD[j] for j in agree), np.full(len(fp), k, _U)))
                free = sum(MASKS[j] for j in range(BLOCKS) if j not in agree)
                yield _keyed(fp, key, np.full(len(fp), free, _U), table)


def _finer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, key, free = (_longs(batch, c) for c in ("fp", "key", "free"))
        table = np.frombuffer(b"".join(batch.column("table").to_pylist()), np.uint8).reshape(-1, PIVOTS)
        for mask in np.unique(free):
            at = np.flatnonzero(free == mask)
            for t, part in enumerate(block_masks([b for b in range(64) if int(mask) >> b & 1], QUARTERS)):
                with np.errstate(over="ignore"):
                    finer = textnum.mix(key[at] * _ODD[t] + _runs(fp[at], part))
                yield _keyed(fp[at], finer, np.full(len(at), int(mask) & ~part, _U), table[at])


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose key others have too, with how many (n), stored."""
    return common.written(rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "free"))).where("n > 1"))


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ta, tb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int16) for c in ("table", "other_table"))
        a, b = _longs(batch, "fp"), _longs(batch, "other")
        near = np.flatnonzero(np.abs(ta - tb).max(axis=1) <= LINK)  # the largest difference of a coordinate
        near = near[np.bitwise_count(a[near] ^ b[near]) <= LINK]
        yield pa.record_batch([pa.array(a[near].view(np.int64)), pa.array(b[near].view(np.int64))], names=["a", "b"])


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """a, b: the pairs (a < b) of fps (distinct longs) that differ in at most LINK bits, stored, each once."""
    rows = _met(fps.select("fp").mapInArrow(_table_batches, _ROWS))
    found = None
    while True:
        alike = (F.col("n") > dense) & (F.col("free") != 0)
        few = rows.where(~alike)
        other = few.select("key", "free", F.col("fp").alias("other"), F.col("table").alias("other_table"))
        pairs = few.join(other, ["key", "free"]).where("fp < other").select("fp", "table", "other", "other_table")
        pairs = common.written(pairs.mapInArrow(_link_batches, "a long, b long").distinct())
        found = pairs if found is None else found.unionByName(pairs)
        many = rows.where(alike)
        if many.isEmpty():
            return found.distinct()
        # each step fixes a quarter of the free bits, so that these run out and at most ``dense`` fingerprints are left
        rows = _met(many.select("key", "free", "fp", "table").mapInArrow(_finer_batches, _ROWS))


# ---- documents


def bits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text)."""
    prints = fingerprints(docs)
    own = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = common.written(links(own, dense))
    label = components(edges).distinct()
    root = common.written(own.join(label, own.fp == label.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")))
    # a fingerprint that stands alone needs no join: its smallest id is at hand
    least = common.written(root.where("linked").groupBy("root").agg(F.min("least").alias("component_id")))
    few = least.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    named = root.join(F.broadcast(least) if few else least, "root", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    named = common.written(named)
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("n") > max(1, total * HOT_SHARE)).select("fp", F.struct("component_id").alias("known")))  # at most 1 / HOT_SHARE rows
    first = prints.join(hot, "fp", "left")
    rest = first.where("known IS NULL").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")
    return first.where("known IS NOT NULL").select("doc_id", "fp", "known.component_id").unionByName(rest.select("doc_id", "fp", "component_id")).select("doc_id", bits(F.col("fp")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_simhash": op13_simhash}
#: XXH64 is no function of the oracle's; tests hold the query against brute force.
ORACLES: dict[str, str] = {}
