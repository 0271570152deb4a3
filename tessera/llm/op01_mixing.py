r"""Language-model scoring by online logistic context mixing.

A text is its words (A-Z lower-cased, divided by [\x20\x09-\x0D]+) and one end.
Each word is spelled in bytes with a blank after it, the end is one byte; bits
are those of a Huffman code of bytes, some five to a byte. Each bit is predicted
from hashed contexts: the text's register with none, the last one, two, three
and four bytes, and the whole prefix of the word. The register is one of
``REGISTERS`` groups of common words, found by which of them occur together
(languages and styles fall apart by themselves); it is told anew every ``SPAN``
words by the words before, so it adapts as the text goes on. The predictors' log
odds are mixed with weights from a set that a gate picks (by bit, and by how
much the longest contexts have seen); the mix is refined by an adaptive table
over the last byte and the mixed odds. Bits add up to the text's log10
probability.

Within a register these contexts don't reach over a word's start, so a word's
bits cost the same wherever it stands, and they are learned and priced by
vocabulary. What grows with the corpus are the counts on top of them, kept in
keyed tables: a word's probability is a mixture of its bits' and of its exact
counts, in the register and in all. And a text is mixed a second time, as it runs: it is cut into
segments of some ``SEGMENT`` words at places that the words themselves tell, so
that copies are cut alike; each segment is a mixture of a copy (by how often
other training documents hold it) and of its words. How likely a copy is, is
predicted from hashed contexts of what came before in the text, mixed by gated
weights that are updated after each segment. So all context goes as far as the
text does, and a passage that the corpus holds elsewhere costs next to nothing.

1. words are counted in all training text (summed in each task, then in Spark);
   so is how often the ``SEEDS`` commonest occur within one stretch of text;
2. words are counted by register, and segments; the contexts' bit counts are
   summed over all of these, by their counts, into tables of fixed size; the
   prefix table admits the prefixes of the ``ADMITTED`` commonest, each with a
   check of collisions (words beyond have exact counts all the same, see above);
3. mixing weights and refinement are learned online over all of them, in an order
   that is the same in each run; each word is predicted as if one of its own
   occurrences had not been seen, and the tasks' weights are averaged;
4. each word of a register is priced once, and the texts are summed: common ones
   by a table of at most ``COMMON`` sent to all executors, the rest by a join;
5. segments that recur are joined to the texts, a training document's own
   occurrences taken off.

Defined results: a null or empty text is one end token; a null id is training
text; with no training text all counts are 0 and bits cost what untrained
predictors say; each row of repeated rows is scored (and counted); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textnum

END, BLANK = b"\n", 0x20
#: Words whose cost and count each executor holds, and whose prefixes have counts of their own.
COMMON, ADMITTED = 1 << 18, 1 << 17
#: Groups of the commonest words, words between two looks at the register, and the stretch of co-occurrence.
REGISTERS, SEEDS, SPAN, STRETCH = 8, 256, 32, 256
FREE = REGISTERS  # the register of a text that has not told yet
#: log2 of the tables' sizes: orders 0 to 4, prefix.
BITS = (12, 18, 19, 20, 20, 21)
SIZES = tuple(1 << b for b in BITS)
STARTS = tuple(int(x) for x in np.concatenate(([0], np.cumsum(SIZES)[:-1])))
TOTAL = sum(SIZES)
BLOCK = 1 << 13
PRIOR = 0.08
GATES = 5 * 4
N_GATES, N_INPUTS = 8 * GATES, len(BITS) + 1
APM_STEPS = 24
RATE, APM_PRIOR = 0.002, 30.0
SLICE = 4 << 20
CHUNK_BYTES = 1 << 18
#: Bytes between two updates of the weights.
LEARN_BYTES = 1 << 15
#: Keys of the vocabulary that one task learns from.
TASK_KEYS = 500_000
#: Steps to a doubling of a count in the tables: 42 doublings fit into a byte.
STEPS = 6
#: Share of the counts in a word's probability, beside its bits.
COUNTED = 0.3
#: Words of a segment on average, and what begins its key.
SEGMENT, SEGMENT_KEY = 16, b"\xff"


# ---- words -----------------------------------------------------------------


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words as binary, row of each)."""
    raw = textnum.LOWER[raw]
    start, end, row = textnum.spans(raw, off, ~textnum.IS_SPACE)
    data = raw[~textnum.IS_SPACE[raw]]
    at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)]), row


def segments_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segments_in of the words of some rows."""
    words, row = words_of(raw, off)
    d = words.dictionary_encode()
    return segments_in(d.dictionary, d.indices.to_numpy(), row, len(off) - 1)


def segments_in(words: pa.Array, code: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each word, hash of each segment, first segment of each row and the end); the words by their code.

    A segment ends after a word that, with the one before it, hashes to one in
    SEGMENT, and at the row's end. Each distinct word is hashed once.
    """
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    h = textnum.word_hashes(np.frombuffer(words.buffers()[2], np.uint8)[: off[-1]], off[:-1], off[1:])[code]
    new = np.ones(len(h), bool)
    with np.errstate(over="ignore"):
        before = np.concatenate((np.zeros(1, np.uint64), h[:-1]))
        head = np.concatenate(([True], row[1:] != row[:-1]))
        before[head] = 0
        last = textnum.mix(before * np.uint64(3) + h) % np.uint64(SEGMENT) == 0
        new[1:] = last[:-1] | head[1:]
        segment = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        place = (np.arange(len(h)) - first[segment]).astype(np.uint64)
        said = textnum.mix(np.add.reduceat(textnum.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first))
    return segment, said, np.searchsorted(row[first], np.arange(n + 1))


def several(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in order, some ``most`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, small batches put together to some ``most`` bytes."""
    for held in several(batches, most):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for a, b, raw, off in textnum.slices(batch.column("text"), SLICE):
            words, row = words_of(raw, off)
            d = words.dictionary_encode()
            c = np.bincount(d.indices.to_numpy()[train[a:b][row]], minlength=len(d.dictionary))
            some = pa.array(np.flatnonzero(c))
            yield pa.RecordBatch.from_pydict({"word": d.dictionary.take(some).cast(pa.binary()), "c": pa.array(c[c > 0].astype(np.int64))})


def totals(docs: DataFrame) -> DataFrame:
    """word (binary), c (its count in training text), the end token among them; written."""
    counted = docs.select("train", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_plain, "word binary, c long")
    ends = docs.agg(F.count_if("train").alias("c")).where("c > 0").select(F.lit(END).cast("binary").alias("word"), "c")
    return common.written(counted.groupBy("word").agg(F.sum("c").alias("c")).unionByName(ends))


def seeds(words: DataFrame) -> list[bytes]:
    """The commonest words, at most SEEDS."""
    top = commonest(words, "c", SEEDS).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return [w for w in top.column("word").to_pylist() if w != END][:SEEDS]


def together(docs: DataFrame, seed: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many stretches of training text each two seeds occur (a table of fixed size); how many stretches there are."""
    shared = docs.sparkSession.sparkContext.broadcast(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(shared.value, pa.large_binary()), len(shared.value)
        total, every = np.zeros((n, n)), 0
        for batch in batches:
            for _, _, raw, off in textnum.slices(batch.column("text"), SLICE):
                words, row = words_of(raw, off)
                d = words.dictionary_encode()
                which = pc.index_in(d.dictionary, value_set=known).fill_null(-1).to_numpy()[d.indices.to_numpy()]
                _, stretch, first = _blocks(row, len(off) - 1, STRETCH)
                every += int(first[-1])
                hit = np.flatnonzero(which >= 0)
                for a in range(0, int(stretch[-1]) + 1 if len(stretch) else 0, 4096):
                    part = hit[slice(*np.searchsorted(stretch[hit], (a, a + 4096)))]
                    has = np.zeros((4096, n), np.float32)
                    has[stretch[part] - a, which[part]] = 1
                    total += has.T @ has
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, -1).astype(np.int32)), "j": pa.array(np.append(j, -1).astype(np.int32)), "n": pa.array(np.append(total[i, j], every).astype(np.int64))})

    out = np.zeros((len(seed), len(seed)))
    got = docs.where("train").select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    i, j, n = (got.column(c).to_numpy() for c in "ijn")
    out[i[i >= 0], j[i >= 0]] = n[i >= 0]
    return out, int(n[i < 0].sum())


def registers(seed: list[bytes], n: np.ndarray, stretches: int) -> dict[bytes, int]:
    """The register of each seed: spherical k-means over positive pointwise mutual information, from far apart seeds on."""
    if not seed:
        return {}
    own = np.diag(n)
    x = np.maximum(0, np.log((n + 0.01) * max(1, stretches) / np.outer(own + 1, own + 1)))
    np.fill_diagonal(x, 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    first = [0]
    while len(first) < min(REGISTERS, len(seed)):
        first.append(int(np.argmin((x @ x[first].T).max(axis=1))))
    centre = x[first]
    for _ in range(30):
        at = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[at == k].sum(axis=0) if (at == k).any() else centre[k] for k in range(len(centre))])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    return dict(zip(seed, np.argmax(x @ centre.T, axis=1).tolist()))


def _blocks(row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, block of each word, first block of each row): blocks of ``size`` words of one row."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(-(-count // size))))
    place = np.arange(len(row)) - np.concatenate(([0], np.cumsum(count)))[row]
    return count, first[row] + place // size, first


class Told:
    """The words of some rows by register."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, of: tuple[pa.Array, np.ndarray]):
        words, self.row = words_of(raw, off)
        d = words.dictionary_encode()
        code = d.indices.to_numpy()
        self.segments = segments_in(d.dictionary, code, self.row, len(off) - 1)
        known, register = of
        at = pc.index_in(d.dictionary, value_set=known).fill_null(len(known)).to_numpy() if len(known) else np.zeros(len(d.dictionary), np.int64)
        vote = np.append(register, REGISTERS)[at][code]
        n = len(off) - 1
        _, block, first = _blocks(self.row, n, SPAN)
        total = int(first[-1])
        votes = np.bincount(block[vote < REGISTERS] * REGISTERS + vote[vote < REGISTERS], minlength=total * REGISTERS).reshape(total, REGISTERS)
        # a block goes by the last one before it, of its own row, that had votes
        last = np.maximum.accumulate(np.where(votes.any(axis=1), np.arange(total), -1)) if total else np.zeros(0, np.int64)
        before = np.concatenate(([-1], last[:-1])) if total else last
        begin = np.repeat(first[:-1], np.diff(first))
        mine = np.where(before >= begin, votes.argmax(axis=1)[np.maximum(before, 0)] if total else 0, FREE)
        self.end = np.full(n, FREE, np.int64)
        full = np.flatnonzero(np.diff(first))
        self.end[full] = mine[first[full + 1] - 1]
        pair = code * np.int64(REGISTERS + 1) + mine[block] if total else code.astype(np.int64)
        count = np.bincount(pair, minlength=len(d.dictionary) * (REGISTERS + 1))
        some = np.flatnonzero(count)
        to = np.zeros(len(count), np.int64)
        to[some] = np.arange(len(some))
        #: for each word of the rows, its number among ``keys``
        self.code = to[pair]
        self.keys = _keyed(some % (REGISTERS + 1), d.dictionary.take(pa.array(some // (REGISTERS + 1))))


_FIRST = pa.array([bytes([k]) for k in range(REGISTERS + 1)], pa.large_binary())


def _keyed(register: np.ndarray, words: pa.Array) -> pa.Array:
    """A byte of the register, then the word."""
    return pc.binary_join_element_wise(_FIRST.take(pa.array(register)), words, pa.scalar(b"", pa.large_binary()))


def is_word() -> Column:
    """Whether a key is a word's, not a segment's."""
    return F.substring("key", 1, 1) != F.lit(SEGMENT_KEY)


def by_register(docs: DataFrame, of: tuple[pa.Array, np.ndarray]) -> DataFrame:
    """key (register and word), c (count in training text), every (in all text); the ends too; and the segments that recur; written."""
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, raw, off in textnum.slices(batch.column("text"), SLICE):
                told = Told(raw, off, shared.value)
                n = len(told.keys)
                c = np.bincount(told.code[train[a:b][told.row]], minlength=n)
                segment, said, first = told.segments
                which, at = np.unique(said, return_inverse=True)
                of_row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                seg_c, seg_every = np.bincount(at[train[a:b][of_row]], minlength=len(which)), np.bincount(at, minlength=len(which))
                named = np.concatenate((np.full((len(which), 1), 0xFF, np.uint8), which.view(np.uint8).reshape(-1, 8)), axis=1)
                seg_keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(9), len(which), [None, pa.py_buffer(np.ascontiguousarray(named))]).cast(pa.large_binary())
                ends = np.arange(REGISTERS + 1)
                end_c, end_every = (np.bincount(x, minlength=REGISTERS + 1) for x in (told.end[train[a:b]], told.end))
                keys = pa.concat_arrays([told.keys, _keyed(ends, pa.array([END] * (REGISTERS + 1), pa.large_binary())), seg_keys])
                every = np.concatenate((np.bincount(told.code, minlength=n), end_every, seg_every))
                yield pa.RecordBatch.from_pydict({"key": keys.cast(pa.binary()), "c": pa.array(np.concatenate((c, end_c, seg_c)).astype(np.int64)), "every": pa.array(every.astype(np.int64))})

    counted = docs.select("train", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key binary, c long, every long")
    return common.written(counted.groupBy("key").agg(F.sum("c").alias("c"), F.sum("every").alias("every")).where((F.col("every") > 0) & (is_word() | (F.col("every") > 1) & (F.col("c") > 0))))


def commonest(words: DataFrame, by: str, most: int) -> DataFrame:
    """Words with as large a count as at most ``most`` words have: a threshold from a histogram of some dozens of steps."""
    step = F.floor(F.log2(F.col(by).cast("double")) * 8)
    seen, least = 0, None
    for r in sorted(words.where(F.col(by) > 0).groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min(by).alias("least")).collect(), key=lambda r: -r["s"]):
        if seen + r["n"] > most:
            break
        seen, least = seen + r["n"], r["least"]
    return words.where(F.col(by) >= least) if least is not None else words.limit(0)


# ---- contexts --------------------------------------------------------------


def byte_code(words: pa.Array) -> np.ndarray:
    """A Huffman code of all bytes by their number in these words (each at least 1).

    (256, 2, depth) of int16: the node asked at each depth (-1 beyond the byte's
    leaf), and the answer.
    """
    data = b"".join(w[1:] for w in words.to_pylist())
    number = np.bincount(np.frombuffer(data, np.uint8), minlength=256) + 1
    number[BLANK] += len(words)
    heap = [(int(n), b, (b,)) for b, n in enumerate(number)]
    heapq.heapify(heap)
    asked: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (n, _, low), (m, _, high) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, leaves in enumerate((low, high)):
            for b in leaves:
                asked[b].append((node, bit))
        heapq.heappush(heap, (n + m, 256 + node, low + high))
    out = np.full((256, 2, max(map(len, asked))), -1, np.int16)
    for b, path in enumerate(asked):
        for j, (node, bit) in enumerate(reversed(path)):
            out[b, :, j] = node, bit
    return out


class Bytes:
    """The bytes to be coded of some words, and the hashes of their contexts."""

    def __init__(self, words: pa.Array, code: np.ndarray, counts: np.ndarray | None = None):
        self.code = code
        off = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_binary(words.type) else np.int64)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = words.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        off = off - off[0]
        lead = np.zeros(len(raw), bool)
        lead[off[:-1]] = True
        register = raw[off[:-1]].astype(np.uint32)
        raw = raw[~lead]
        off = off - np.arange(len(off))
        size = np.diff(off)
        end = np.zeros(len(words), bool)
        one = np.flatnonzero(size == 1)
        end[one] = raw[off[:-1][one]] == END[0]
        long = size + ~end  # a blank after each word, but not after the end
        first = np.concatenate(([0], np.cumsum(long)))
        self.first, n = first[:-1], int(first[-1])
        self.byte = np.full(n, BLANK, np.uint8)
        at = np.arange(len(raw)) + np.repeat(first[:-1] - off[:-1], size)
        self.byte[at] = raw
        self.word = np.repeat(np.arange(len(words)), long)
        self.weight = None if counts is None else counts[self.word].astype(np.float32)
        place = np.arange(n) - self.first[self.word]
        last = np.zeros((5, n), np.uint32)
        for k in range(1, 5):
            last[k, k:] = np.where(place[k:] >= k, self.byte[:-k] if n > k else 0, 0) if n > k else 0
        self.last = last[1]
        self.register = register[self.word]
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(textnum._BYTE[self.byte] * textnum._power("p", n)[:n], out=total[1:])
            begin = self.first[self.word]
            prefix = textnum.mix((total[:n] - total[begin]) * textnum._power("i", n)[begin] + place.astype(np.uint64) + (self.register.astype(np.uint64) << np.uint64(40)))
            two = last[1] | last[2] << np.uint32(8)
            three = two | last[3] << np.uint32(16)
            four = three | last[4] << np.uint32(24)
            side = self.register * np.uint32(0x632BE5AB)
            self.hash = [None, _scramble(last[1] + side + np.uint32(7)), _scramble(_scramble(two) + side), _scramble(_scramble(three + np.uint32(1)) + side), _scramble(_scramble(four + np.uint32(2)) + side), (prefix >> np.uint64(32)).astype(np.uint32)]
        self.check = prefix.astype(np.uint32)

    def slots(self, at: np.ndarray, node: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Where each predictor's counts are for these bytes at these nodes; the check of the prefix."""
        out = [(self.register[at] << np.uint32(8) | node).astype(np.int64)]
        with np.errstate(over="ignore"):
            turn = (node + np.uint32(1)) * np.uint32(0x9E3779B1)
            for k in range(1, len(BITS)):
                out.append((_scramble(self.hash[k][at] ^ turn) >> np.uint32(32 - BITS[k])).astype(np.int64))
            check = (_scramble(self.check[at] + turn) & np.uint32(0xFFFF)).astype(np.uint16)
        return out, np.maximum(check, 1)

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """(depth, up to 7; the bytes with a bit there; its values; slots; check) from the root on."""
        at, byte = np.arange(len(self.byte)), self.byte
        for j in range(self.code.shape[2]):
            node = self.code[:, 0, j][byte]
            more = node >= 0
            if not more.all():
                at, byte, node = at[more], byte[more], node[more]
            if not len(at):
                return
            s, check = self.slots(at, node.astype(np.uint32))
            yield min(j, 7), at, self.code[:, 1, j][byte].astype(np.uint8), s, check


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return x ^ (x >> np.uint32(16))


def first_bytes(words: pa.Array) -> np.ndarray:
    """The first byte of each of some binary values that have one."""
    if not len(words):
        return np.zeros(0, np.int64)
    off = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_binary(words.type) else np.int64)[words.offset : words.offset + len(words)]
    return np.frombuffer(words.buffers()[2], np.uint8)[off].astype(np.int64)


def chunks(words: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``most`` bytes."""
    size = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy() + 1)))
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(size, size[a] + most, "right")) - 1)
        yield a, b
        a = b


# ---- predictors ------------------------------------------------------------


def admit(words: pa.Array, code: np.ndarray) -> np.ndarray:
    """The prefix table's checks: of each slot, the first context that claims it (0: none)."""
    table = np.zeros(SIZES[-1], np.uint16)
    for a, b in chunks(words):
        for _, _, _, s, check in Bytes(words.slice(a, b - a), code).bits():
            free = table[s[-1]] == 0
            at, which = np.unique(s[-1][free], return_index=True)
            table[at] = check[free][which]
    return table


def _tally(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks, code = np.frombuffer(shared.value["checks"], np.uint16), shared.value["code"]
        table = np.zeros((TOTAL, 2), np.int64)
        flat = table.reshape(-1)
        for batch in gathered(batches, CHUNK_BYTES):
            words, counts = batch.column("key"), batch.column("c").to_numpy()
            for a, b in chunks(words):
                some = Bytes(words.slice(a, b - a), code)
                for _, here, bit, s, check in some.bits():
                    weight = counts[a:b][some.word[here]]
                    for k in range(len(BITS)):
                        at, w, one = STARTS[k] + s[k], weight, bit
                        if k == len(BITS) - 1:
                            ok = checks[s[k]] == check
                            at, w, one = at[ok], w[ok], bit[ok]
                        np.add.at(flat, at * 2 + one, w)
        for i in range(0, TOTAL, BLOCK):
            part = table[i : i + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int64()), "n": pa.array([part.tobytes()], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    raw = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n")).reshape(-1, 2)
    return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([quantised(raw).tobytes()], pa.binary())})


def tables(words: DataFrame, checks: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones, summed exactly, then quantised: at most TOTAL * 2 bytes come to the driver.

    Each task hands on tables of its own, nearly full ones however few its words.
    """
    shared = words.sparkSession.sparkContext.broadcast({"checks": checks.tobytes(), "code": code})
    parts = words.mapInArrow(_tally(shared), "block long, n binary").groupBy("block").applyInArrow(_summed, "block long, n binary")
    out, got = np.zeros(TOTAL, np.uint16), parts.toArrow()
    for block, n in zip(got.column("block"), got.column("n")):
        part = np.frombuffer(n.as_py(), np.uint16)
        out[block.as_py() : block.as_py() + len(part)] = part
    return out


# ---- mixing ----------------------------------------------------------------


def quantised(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as one 16-bit word each: two bytes, STEPS steps to each doubling; 1, 3, 7, ... are exact."""
    q = np.clip(np.rint(STEPS * np.log2(1.0 + counts)), 0, 255).astype(np.uint16)
    return q[:, 0] | q[:, 1] << np.uint16(8)


def _lookups() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each such word: the log odds, those as if a 0 or a 1 had been seen once less, and the counts' sum."""
    n = np.exp2(np.arange(256) / STEPS) - 1
    n0, n1 = np.meshgrid(n, n)  # the low byte is the zeros'
    odds = lambda a, b: np.log((np.maximum(b, 0) + PRIOR) / (np.maximum(a, 0) + PRIOR)).astype(np.float32).ravel()
    return odds(n0, n1), np.stack([odds(n0 - 1, n1), odds(n0, n1 - 1)]), (n0 + n1).astype(np.float32).ravel()


ODDS, ODDS_LESS, SEEN = _lookups()


def _inputs(model: dict, s: list[np.ndarray], check: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs x bits, gate of each without its bit number); given the bits, each as if it had been seen once less."""
    x = np.empty((N_INPUTS, len(s[0])), np.float32)
    seen = []
    less = None if bit is None else ODDS_LESS.ravel()
    one = None if bit is None else bit.astype(np.int64) << 16
    for k in range(len(BITS)):
        n = model["n"][STARTS[k] + s[k]].astype(np.int64)
        if k == len(BITS) - 1:
            n *= model["checks"][s[k]] == check
        x[k] = ODDS[n] if less is None else less[n + one]
        if k >= len(BITS) - 2:
            seen.append(SEEN[n] if bit is None else SEEN[n] - 1)
    x[-1] = 0.3
    full, four = seen[-1], seen[-2]
    gate = (full > 0).astype(np.int64) + (full > 3) + (full > 30) + (full > 300)
    gate = gate * 4 + (four > 0) + (four > 4) + (four > 60)
    return x, gate


def _mixed(w: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log odds: each bit's inputs by its gate's weights; w has inputs x gates."""
    z = w[0][gate] * x[0]
    for i in range(1, N_INPUTS):
        z += w[i][gate] * x[i]
    return z


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def _cell(z: np.ndarray, last: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The refinement cell below the log odds, and how far towards the next."""
    at = (np.clip(z, -11.9, 11.9) + 12) * ((APM_STEPS - 1) / 24)
    low = at.astype(np.int64)
    return (last.astype(np.int64) * 8 + j) * APM_STEPS + low, (at - low).astype(np.float32)


def refinement(apm: np.ndarray) -> np.ndarray:
    """Each cell's probability: its counts, and its own place in the log odds as so many counts."""
    n, one = apm
    grid = _squash((np.arange(APM_STEPS, dtype=np.float32) * (24 / (APM_STEPS - 1))) - 12)
    return (one + APM_PRIOR * np.resize(grid, one.shape)) / (n + APM_PRIOR)


def _refined(cells: np.ndarray, z: np.ndarray, p: np.ndarray, last: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, part = _cell(z, last, j)
    r = cells[cell] * (1 - part) + cells[cell + 1] * part
    return 0.5 * p + 0.5 * r, cell, part


def fresh() -> tuple[np.ndarray, np.ndarray]:
    """Starting weights (by depth, what the prefix and four bytes have seen) and refinement counts."""
    w = np.zeros((8, 5, 4, N_INPUTS), np.float32)
    # where the prefix is well known, it starts alone; else the longer contexts that have been seen
    for full, prefix in enumerate((0.0, 0.3, 0.6, 0.85, 0.97)):
        w[:, full, :, 5] = prefix
        w[:, full, :, 1:5] = (1 - prefix) * np.array([[0.3, 0.4, 0.3, 0], [0.1, 0.2, 0.4, 0.3], [0.05, 0.1, 0.35, 0.5], [0, 0, 0.3, 0.7]])
    w = np.ascontiguousarray(w.reshape(N_GATES, N_INPUTS).T)
    return w, np.zeros((2, 256 * 8 * APM_STEPS + 1), np.float32)


def _learn(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        w, apm = fresh()
        step = np.zeros_like(w)
        mass, updates = np.full(N_GATES, 1e-6), 0
        tokens = 0.0
        for held in several(batches, LEARN_BYTES * 4):
            # inputs don't depend on weights, so they are made of many batches at once
            words = pa.concat_arrays([batch.column("key") for batch in held])
            counts = np.concatenate([batch.column("c").to_numpy() for batch in held]).astype(np.float64)
            if not len(counts):
                continue
            tokens += counts.sum()
            some, end, base = Bytes(words, model["code"], counts), [0], 0
            for batch in held:
                end += [base + b for _, b in chunks(batch.column("key"), LEARN_BYTES)]
                base += len(batch)
            place, layers = np.append(some.first, len(some.byte))[end], []
            for j, here, bit, s, check in some.bits():
                x, gate = _inputs(model, s, check, bit)
                layers.append((j, some.weight[here], some.last[here], bit, x, gate + GATES * j, np.searchsorted(here, place)))
            for k in range(len(end) - 1):
                for j, *all_, x, gate, at in layers:
                    a, b = at[k], at[k + 1]
                    if a == b:
                        break
                    weight, last, bit = (y[a:b] for y in all_)
                    x, gate = x[:, a:b], gate[a:b]
                    z = _mixed(w, gate, x)
                    p = _squash(z)
                    cell, part = _cell(z, last, j)
                    g = (p - bit) * weight
                    # by the usual weight of this gate's bits, not this chunk's: tokens count, not words
                    mass += np.bincount(gate, weight, minlength=N_GATES)
                    updates += 1
                    for i in range(N_INPUTS):
                        d = (np.bincount(gate, g * x[i], minlength=N_GATES) * (updates / (8 * mass))).astype(np.float32)
                        step[i] += d * d
                        w[i] -= 8 * RATE * d / (np.sqrt(step[i]) + 1e-3)
                    for c, share in ((cell, 1 - part), (cell + 1, part)):
                        np.add.at(apm[0], c, weight * share)
                        np.add.at(apm[1], c, weight * share * bit)
        # the weights by their tokens, the refinement's counts, and the tokens themselves
        sums = np.concatenate(([tokens], (w.astype(np.float64) * tokens).ravel(), apm.astype(np.float64).ravel()))
        part = TaskContext.get().partitionId()
        for i in range(0, len(sums), BLOCK):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int64()), "part": pa.array([part], pa.int32()), "n": pa.array([sums[i : i + BLOCK].tobytes()], pa.binary())})

    return run


def _added(table: pa.Table) -> pa.Table:
    """One block of all tasks' sums, added in the tasks' order."""
    table = table.sort_by("part")
    return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("n")).tobytes()], pa.binary())})


def load(stored: dict) -> dict:
    return {"n": np.frombuffer(stored["n"], np.uint16), "checks": np.frombuffer(stored["checks"], np.uint16), **{k: stored[k] for k in ("code", "w", "apm") if k in stored}}


def costs(words: pa.Array, model: dict) -> np.ndarray:
    """-log10 of each word's probability."""
    out = np.zeros(len(words))
    cells = refinement(model["apm"])
    for a, b in chunks(words):
        some = Bytes(words.slice(a, b - a), model["code"])
        total = np.zeros(len(some.byte))
        for j, here, bit, s, check in some.bits():
            x, gate = _inputs(model, s, check, None)
            z = _mixed(model["w"], gate + GATES * j, x)
            p, _, _ = _refined(cells, z, _squash(z), some.last[here], j)
            p = np.clip(p, 1e-7, 1 - 1e-7)
            total[here] -= np.log10(np.where(bit == 1, p, 1 - p).astype(np.float64))
        out[a:b] = np.add.reduceat(total, some.first) if b > a else 0
    return out


def fit(words: DataFrame) -> dict:
    """The model, from key, c: every key with c > 0 is counted and learned from."""
    sc = words.sparkSession.sparkContext
    train = words.where(F.col("c") > 0).where(is_word()).select("key", "c")
    n = train.count()
    tasks = max(6, -(-n // TASK_KEYS))
    # dealt and ordered by hash: the same in each run, whatever the input's partitions
    dealt = train.repartition(tasks, "key").sortWithinPartitions(F.xxhash64("key"), "key")
    top = commonest(train, "c", ADMITTED).toArrow()
    top = top.sort_by([("c", "descending"), ("key", "ascending")]).column("key").combine_chunks() if n else pa.array([], pa.binary())
    code = byte_code(top)
    checks = admit(top, code)
    # sums are exact in any order, so the words are not dealt out for them; as many tables as the vocabulary asks for, not as there are partitions
    counts = tables(train.coalesce(tasks), checks, code)
    stored = {"n": counts.tobytes(), "checks": checks.tobytes(), "code": code}
    shared = sc.broadcast(stored)
    w, apm = fresh()
    if n:
        parts = dealt.mapInArrow(_learn(shared), "block long, part int, n binary").groupBy("block").applyInArrow(_added, "block long, n binary").toArrow().sort_by("block")
        sums = np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in parts.column("n")])
        w = (sums[1 : 1 + w.size] / max(1e-9, sums[0])).reshape(w.shape).astype(np.float32)
        apm = sums[1 + w.size :].reshape(apm.shape).astype(np.float32)
    return stored | {"w": w, "apm": apm}


# ---- scoring ---------------------------------------------------------------


def discount(counts: DataFrame) -> float:
    """What absolute discounting takes off each count: from how many are 1 and 2."""
    r = counts.agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    return min(0.95, max(0.05, r["one"] / max(1, r["one"] + 2 * r["two"])))


def priced(keys: DataFrame, words: DataFrame, model: dict, n: int, v: int) -> DataFrame:
    """key, c (of its word, in all registers), every, cost of each word's key; written.

    The cost is of a mixture of its bits and its counts; these are the word's
    discounted count in the register, the rest of the mass going to that in all
    registers, and the rest of that to the bits.
    """
    shared = keys.sparkSession.sparkContext.broadcast(model)
    own, all_ = discount(keys), discount(words)
    sizes = {bytes(r["r"])[0]: (r["n"], r["v"]) for r in keys.where("c > 0").groupBy(F.substring("key", 1, 1).alias("r")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_of, v_of = (np.array([sizes.get(k, (0, 0))[i] for k in range(REGISTERS + 1)], np.float64) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(shared.value)
        for batch in gathered(batches, CHUNK_BYTES):
            p = 10.0 ** -costs(batch.column("key"), m)
            c, here = (batch.column(k).to_numpy().astype(np.float64) for k in ("c", "here"))
            r = first_bytes(batch.column("key"))
            if n:
                q = (np.maximum(c - all_, 0) + all_ * v * p) / n
                size = np.maximum(1, n_of[r])
                q = np.where(n_of[r] > 0, (np.maximum(here - own, 0) + own * v_of[r] * q) / size, q)
                p = (1 - COUNTED) * p + COUNTED * q
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("key", "c", "every")} | {"cost": pa.array(-np.log10(np.maximum(p, 1e-300)))})

    whole = keys.select("key", "every", F.col("c").alias("here"), F.expr("substring(key, 2)").alias("word")).join(words, "word", "left")
    return common.written(whole.select("key", F.coalesce("c", F.lit(0)).alias("c"), "here", "every").mapInArrow(run, "key binary, c long, every long, cost double"))


# ---- copies ----------------------------------------------------------------


class Copies:
    """How likely the next segment of a text is a copy, from the text so far.

    Five hashed contexts of what came before (nothing, the last segment, the last
    three, the last eight, and how many in a row were alike) each predict the bit
    by their counts; the log odds are mixed by the weights of a gate (the last
    two bits), which are updated after each segment.
    """

    RATE = 0.05
    # Cells of the contexts one after another: 1, 2, 8, 256 and 32. What one has seen before it has
    # seen anything, zeros and ones, goes by the last bit (the first context has none).
    _LAST = [None, *[k & 1 for n in (2, 8, 256) for k in range(n)], *[k >> 4 for k in range(32)]]
    _FIRST = [(4.0, 0.4) if k is None else ((4.0, 0.1), (0.4, 3.6))[k] for k in _LAST]
    _ZEROS, _ONES, _ODDS = [a for a, _ in _FIRST], [b for _, b in _FIRST], [math.log(b / a) for a, b in _FIRST]

    def __init__(self):
        self.zeros, self.ones, self.odds = self._ZEROS.copy(), self._ONES.copy(), self._ODDS.copy()
        self.weights = [[0.4] * 5 for _ in range(4)]
        self.past, self.run = 0, 0

    def next(self, copied: bool) -> float:
        """The probability of a copy, then what it was."""
        past, odds, log = self.past, self.odds, math.log
        last, run = past & 1, self.run
        b, c, d, e = 1 + last, 3 + (past & 7), 11 + (past & 255), 267 + (last << 4 | (run if run < 15 else 15))
        w = self.weights[past & 3]
        x0, x1, x2, x3, x4 = odds[0], odds[b], odds[c], odds[d], odds[e]
        z = w[0] * x0 + w[1] * x1 + w[2] * x2 + w[3] * x3 + w[4] * x4
        p = 1 / (1 + math.exp(-z if -12.0 < z < 12.0 else -12.0 if z > 0 else 12.0))
        miss = self.RATE * (copied - p)
        w[0] += miss * x0
        w[1] += miss * x1
        w[2] += miss * x2
        w[3] += miss * x3
        w[4] += miss * x4
        zeros, ones = self.zeros, self.ones
        seen = ones if copied else zeros
        for k in (0, b, c, d, e):
            seen[k] += 1
            odds[k] = log(ones[k] / zeros[k])
        self.run = run + 1 if run and last == copied else 1
        self.past = (past << 1 | copied) & 0xFFFF
        return p


_alone: list = [Copies(), [0.0]]


def alone(n: int) -> float:
    """log10 of the probability that none of a text's n segments is a copy."""
    model, sums = _alone
    while len(sums) <= n:
        sums.append(sums[-1] + math.log10(1 - model.next(False)))
    return sums[n]


def mixed(n: int, said: float, own: list[float], at: list[int], copy: list[float]) -> float:
    """log10 of the probability of a text of n segments, of which those at ``at`` have occurred elsewhere.

    said: of all its words; own: of the words of each of those; copy: of the segment as a copy.
    """
    if not at:
        return said + alone(n)
    model, k, total = Copies(), 0, said - sum(own)
    for i in range(n):
        known = k < len(at) and at[k] == i
        p = model.next(known)
        if known:
            a, b = math.log10(p) + copy[k], math.log10(1 - p) + own[k]
            total += max(a, b) + math.log10(1 + 10.0 ** -min(300.0, abs(a - b)))
            k += 1
        else:
            total += math.log10(1 - p)
    return total


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", "held_out", (~F.col("held_out")).alias("train"))
    words = totals(docs)
    facts = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(facts["n"] or 0), int(facts["v"] or 0)
    seed = seeds(words)
    register = registers(seed, *together(docs, seed))
    of = (pa.array(list(register), pa.large_binary()), np.array(list(register.values()), np.int64))
    keys = by_register(docs, of)
    again = keys.where(~is_word()).select(F.expr("substring(key, 2)").alias("segment"), "c")
    copies = float(again.agg(F.sum("c")).first()[0] or 1)
    keys = keys.where(is_word())
    by_key = priced(keys, words, fit(keys), n, v)
    base_of = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    hot = commonest(by_key, "every", COMMON).select("key", "c", "cost").toArrow()
    ends = {r["key"][0]: r["cost"] for r in by_key.where(F.expr("substring(key, 2)") == F.lit(END).cast("binary")).select("key", "cost").collect()}
    end_cost = np.array([ends.get(k, 0.0) for k in range(REGISTERS + 1)])
    end_c = int((words.where(F.col("word") == F.lit(END).cast("binary")).select("c").first() or [0])[0])
    table = (hot.column("key").combine_chunks().cast(pa.large_binary()) if len(hot) else pa.array([], pa.large_binary()), hot.column("c").to_numpy(), hot.column("cost").to_numpy())
    shared = spark.sparkContext.broadcast((of, *table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known, count, cost = shared.value
        sums = np.stack([np.append(count > 0, False), np.append(base_of(count), 0.0), np.append(-cost, 0.0)]).astype(np.float64)
        none = lambda t, k: pa.nulls(k, t)
        for batch in batches:
            for a, b, raw, off in textnum.slices(batch.column("text"), SLICE):
                told = Told(raw, off, of)
                row, m = told.row, b - a
                at = pc.index_in(told.keys, value_set=known).fill_null(len(known)).to_numpy()
                rank = at[told.code]
                n_known, base, said = (np.bincount(row, s[rank], minlength=m) for s in sums)
                segment, named, first = told.segments
                part = np.bincount(segment, sums[2][rank], minlength=len(named))
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(named), [None, pa.py_buffer(named)]).cast(pa.binary())
                starts = pa.array(first.astype(np.int32))
                key, doc, held = (batch.column(c).slice(a, m) for c in ("_row", "doc_id", "held_out"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "_row": key,
                        "doc_id": doc,
                        "held_out": held,
                        "n_tokens": pa.array(np.bincount(row, minlength=m).astype(np.int64) + 1),
                        "n_bytes": pa.array(np.diff(off)),
                        "n_known": pa.array(n_known.astype(np.int64) + (end_c > 0)),
                        "base": pa.array(base + base_of(end_c)),
                        "said": pa.array(said - end_cost[told.end]),
                        "segments": pa.ListArray.from_arrays(starts, ids),
                        "parts": pa.ListArray.from_arrays(starts, pa.array(part)),
                        "k": none(pa.int32(), m),
                        "key": none(pa.binary(), m),
                        "tf": none(pa.int64(), m),
                    }
                )
                rest = np.flatnonzero(rank == len(known))
                if not len(rest):
                    continue
                pair, tf = np.unique(segment[rest] * np.int64(len(told.keys)) + told.code[rest], return_counts=True)
                k, where = len(pair), pair // len(told.keys)
                of_row = np.searchsorted(first, where, "right") - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "_row": key.take(pa.array(of_row)),
                        "doc_id": none(pa.int64(), k),
                        "held_out": none(pa.bool_(), k),
                        **{c: none(pa.int64(), k) for c in ("n_tokens", "n_bytes", "n_known")},
                        **{c: none(pa.float64(), k) for c in ("base", "said")},
                        "segments": none(pa.list_(pa.binary()), k),
                        "parts": none(pa.list_(pa.float64()), k),
                        "k": pa.array((where - first[of_row]).astype(np.int32)),
                        "key": told.keys.take(pa.array(pair % len(told.keys))).cast(pa.binary()),
                        "tf": pa.array(tf.astype(np.int64)),
                    }
                )

    schema = "_row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, said double, segments array<binary>, parts array<double>, k int, key binary, tf long"
    rows = common.with_row_id(docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")))
    parts = common.written(rows.mapInArrow(run, schema))
    whole = parts.where("key IS NULL").drop("key", "tf", "k")
    base = F.log10((F.col("c") + 0.1) / F.lit(n + 0.1 * (v + 1)))
    rest = parts.where("key IS NOT NULL").select("_row", "k", "key", "tf").join(by_key.select("key", "c", "cost"), "key")
    rest = common.written(rest.groupBy("_row", "k").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k2"), F.sum(F.col("tf") * base).alias("b2"), F.sum(F.col("tf") * -F.col("cost")).alias("s2")))
    sums = rest.groupBy("_row").agg(F.sum("k2").alias("k2"), F.sum("b2").alias("b2"), F.sum("s2").alias("s2"))

    # segments that other training documents hold: of a document's own occurrences none counts
    few = again.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    met = whole.select("_row", "held_out", F.posexplode("segments").alias("k", "segment")).join(F.broadcast(again) if few else again, "segment")
    mine = met.groupBy("_row", "segment").agg(F.first("held_out").alias("held_out"), F.first("c").alias("c"), F.collect_list("k").alias("at"))
    left = F.col("c") - F.when(F.col("held_out"), 0).otherwise(F.size("at"))
    found = mine.withColumn("left", left).where("left > 0").select("_row", F.explode("at").alias("k"), "left")
    found = found.join(rest.select("_row", "k", "s2"), ["_row", "k"], "left")
    hits = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("k", "left", F.coalesce("s2", F.lit(0.0)).alias("s2")))).alias("hits"))

    none = F.array().cast("array<struct<k:int,left:bigint,s2:double>>")
    made = whole.drop("segments").join(sums, "_row", "left").join(hits, "_row", "left").withColumn("hits", F.coalesce("hits", none))
    made = made.withColumn("own", F.transform("hits", lambda x: F.get("parts", x["k"]) + x["s2"])).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_bytes",
        (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0))).alias("base_score"),
        (F.col("said") + F.coalesce("s2", F.lit(0.0))).alias("said"),
        F.size("parts").alias("segments"),
        F.transform("hits", lambda x: x["k"]).alias("at"),
        "own",
        F.transform("hits", lambda x: F.log10(x["left"] / F.lit(copies))).alias("copy"),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("segments", "said", "own", "at", "copy"))
            out = [mixed(k, said, own, at, copy) for k, said, own, at, copy in zip(*cols)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score")} | {"score": pa.array(out, pa.float64())})

    done = made.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", common.in_bucket("doc_id", 10, 0).alias("held_out")))


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
