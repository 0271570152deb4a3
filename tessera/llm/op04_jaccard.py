"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct 5-word shingles. Documents with equal
sets form a class, and only one of each class goes on.

*Sketch.* For a band of sizes, the universe of shingles is cut into blocks by
hash; the sketch holds, for each block, the XOR of the 64-bit hashes of the
set's shingles in it. A shingle changes one block, so the number of blocks that
differ (and the Hamming distance of plain parity sketches, one bit a shingle) is
no more than the symmetric difference.

*Pigeonhole.* J >= 3/4 means a symmetric difference of at most (a + b) / 7, so
at most a / 3 for the smaller set a. Bands grow by 4/3: partners are in the same
or the next band, and each pair meets in the joint band of the smaller one. A
set emits its first a/3 + t blocks that are not empty (in the joint band below
its own: as many as the largest set there); of these at least t are equal in
both, whichever set's stops first; t is a twelfth of the joint band's smallest
set, and one. Equal empty blocks tell nothing, which is why they don't count; a
joint band takes finer blocks, up to one a shingle, until each of its sets has
enough of them.

*Candidates.* Keys (joint band, block, XOR) are summed to their smallest and
largest class; only keys with two classes matter. A Bloom filter of those, of
fixed size, lets a second pass emit just their members. First each class meets
the pivot (a key's smallest class) it shares most keys with, and is verified;
components follow. Keys in which several components are stay open: at these
a class meets the hubs (a key's smallest class of its largest component) that it
shares most of them with, so what links in a group of near copies is one
component before pairs are made. Then classes of different components meet at the
keys that are open yet:

- a class with fewer than t open keys links to no other component; of the others
  all but its t - 1 commonest keys are kept, for two sets that share t keys share
  one of these (prefix filter by rarity). So a passage common to many different
  texts brings them together only where it is much of each of them;
- at each key the largest component's members are not paired with one another,
  and no two of the same component are;
- a pair is made at one of its common keys only, not at each: with a class goes
  the list of its rarest keys, and a pair that shares a rarer one is left to that;
- sizes, and the Hamming distance of short parity sketches, rule out pairs within
  the join, that of full sketches the rest, before any text moves.

So no group of copies is expanded into all pairs, and no link between
components is missed.

*Verification* counts the intersection of the 64-bit shingle hashes exactly.

Defined results: null, empty and wordless texts have no shingles and stand
alone; with fewer than five words the sequence is one shingle; each row of
repeated rows gets a result; a null id is never the smallest; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textnum
from tessera.llm.components import components

K = 5
#: Blocks of a joint band as a multiple of its largest lower size; 0: one block a shingle.
FINENESS = (0.6, 1.0, 4.0, 0.0)
#: Words of the parity sketch that goes with a class into joins.
PARITY_WORDS = 16
#: The full sketch has this many bits a shingle, or up to twice as many.
FULL_BITS = 4
#: Rarest keys of a class that go with each of its keys, to make a pair once.
FIRST_KEYS = 16
#: Size of a set from which on the short sketch rules out nothing: half its bits differ at most by chance.
PARITY_TELLS = 7 * 64 * PARITY_WORDS // 4
#: Classes of larger components that a class meets, before all pairs are made.
HUBS = 4
#: Bits of the Bloom filter over shared keys.
BLOOM_BITS = 1 << 26


def _bands(up_to: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size bands; each at least 4/3 of the one before."""
    out = [1]
    while out[-1] < up_to:
        out.append(-(-4 * out[-1] // 3) if out[-1] > 2 else out[-1] + 1)
    return np.array(out)


BANDS = _bands()
#: t: keys that any two linking sets of a joint band share at least.
COMMON = 1 + BANDS // 12


def band_of(n: np.ndarray) -> np.ndarray:
    """The size band of each set of n shingles; -1 of the empty one."""
    return np.searchsorted(BANDS, n, "right") - 1


def joints(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(joint band, blocks to emit) for sets of n shingles: first their own band, then the one below; no blocks where there is none."""
    r = band_of(n)
    own = np.where(n > 0, n // 3 + COMMON[np.maximum(r, 0)], 0)
    low = np.maximum(r - 1, 0)
    below = np.where(r > 0, (BANDS[np.maximum(r, 0)] - 1) // 3 + COMMON[low], 0)
    return [(np.maximum(r, 0), own), (low, below)]


def _blocks(h: np.ndarray, row: np.ndarray, joint: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each shingle, whether it is the first of its row there); blocks are ranges of hashes, so sorted sets have them in order."""
    wide = BANDS[joint + 1] - 1
    k = (np.array(FINENESS)[level] * wide).astype(np.uint64) + np.uint64(4)
    high = np.uint64(32)
    block = np.where((level == len(FINENESS) - 1)[row], h, ((h >> high) * k[row]) >> high)
    first = np.ones(len(h), bool)
    first[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
    return block, first


def levels_needed(h: np.ndarray, off: np.ndarray, joint: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each set the coarsest fineness at which it has enough blocks that are not empty."""
    row = np.repeat(np.arange(len(need)), np.diff(off))
    level = np.zeros(len(need), np.int64)
    for _ in FINENESS[:-1]:
        _, first = _blocks(h, row, joint, level)
        short = np.bincount(row[first], minlength=len(need)) < need
        if not short.any():
            break
        level += short & (level < len(FINENESS) - 1)
    return level


def keys_of(h: np.ndarray, off: np.ndarray, levels: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys that the sets emit; the lowest bit of a key is that of its joint band."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not len(h):
        return keys[0], rows[0]
    table = np.zeros(len(BANDS), np.int64)
    for joint, level in levels.items():
        table[joint] = level
    for joint, need in joints(n):
        block, first = _blocks(h, row, joint, table[joint])
        at = np.flatnonzero(first)
        x, r = np.bitwise_xor.reduceat(h, at), row[at]
        place = np.arange(len(at)) - np.searchsorted(r, np.arange(len(n)))[r]
        some = place < need[r]
        j = joint[r[some]].astype(np.uint64)
        with np.errstate(over="ignore"):
            key = textnum.mix(x[some] + textnum.mix(block[at[some]] * np.uint64(128) + j))
        keys.append(key & ~np.uint64(1) | j & np.uint64(1))
        rows.append(r[some])
    return np.concatenate(keys), np.concatenate(rows)


def parity(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A row of PARITY_WORDS words for each set: each shingle flips one bit."""
    bits, out = 64 * PARITY_WORDS, np.zeros((n, PARITY_WORDS), np.int64)
    for a in range(0, n, 2048):
        b = min(n, a + 2048)
        i, j = np.searchsorted(row, [a, b])
        on = np.bincount((row[i:j] - a) * bits + (h[i:j] % np.uint64(bits)).astype(np.int64), minlength=(b - a) * bits).astype(np.uint8) & 1
        out[a:b] = np.packbits(on, bitorder="little").view(np.int64).reshape(b - a, PARITY_WORDS)
    return out


def full_parity(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets by set): the same over FULL_BITS bits a shingle, up to the next power of two, so that it can be folded."""
    n = np.diff(off)
    size = 1 << np.ceil(np.log2(np.maximum(FULL_BITS * n, 64))).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(n)), n)
    bit = begin[row] + (h & (size[row] - 1).astype(np.uint64)).astype(np.int64)
    on = np.bincount(bit, minlength=int(begin[-1])).astype(np.uint8) & 1
    return np.packbits(on, bitorder="little").view(np.int64), begin // 64


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two full parity sketches, the longer one folded to the shorter."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())  # of signed words it would count the absolute values


def _sum_by_row(f, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """f.reduce of each row's part of x; 0 of empty parts."""
    out = np.zeros(len(off) - 1, np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = f.reduceat(x, off[some])
    return out


def profile(rows: DataFrame) -> DataFrame:
    """_row, doc_id, n, d1, d2 (digest of the set), p0.. (parity), l0, l1 (fineness for its joint bands), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in textnum.slices(batch.column("text")):
                h, off = textnum.shingle_sets(raw, at, K)
                n = np.diff(off)
                row = np.repeat(np.arange(len(n)), n)
                with np.errstate(over="ignore"):
                    d1, d2 = _sum_by_row(np.bitwise_xor, h, off), _sum_by_row(np.add, textnum.mix(h + np.uint64(77)), off)
                p = parity(h, row, len(n))
                level = [levels_needed(h, off, joint, need) for joint, need in joints(n)]
                words, begin = full_parity(h, off)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(
                    {"_row": part.column("_row"), "doc_id": part.column("doc_id"), "n": pa.array(n.astype(np.int64)), "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64))}
                    | {f"p{i}": pa.array(np.ascontiguousarray(p[:, i])) for i in range(PARITY_WORDS)}
                    | {"l0": pa.array(level[0]), "l1": pa.array(level[1]), "sketch": pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(words))}
                )

    schema = "_row long, doc_id long, n long, d1 long, d2 long, " + "".join(f"p{i} long, " for i in range(PARITY_WORDS)) + "l0 long, l1 long, sketch array<long>"
    return rows.select("_row", F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _band() -> Column:
    """The band of size n, as an expression; n > 0."""
    return F.size(F.filter(F.array(*[F.lit(int(b)) for b in BANDS]), lambda b: b <= F.col("n"))) - 1


def fineness_by_band(profiles: DataFrame) -> dict[int, int]:
    """For each joint band the finest level that any of its sets needs (some dozens of rows)."""
    by = profiles.where("n > 0").groupBy("n").agg(F.max("l0").alias("l0"), F.max("l1").alias("l1")).select(_band().alias("r"), "l0", "l1")
    got = by.groupBy("r").agg(F.max("l0").alias("l0"), F.max("l1").alias("l1")).collect()
    out: dict[int, int] = {}
    for r in got:
        for joint, level in ((r["r"], r["l0"]), (r["r"] - 1, r["l1"])):
            out[joint] = max(out.get(joint, 0), int(level))
    return {j: level for j, level in out.items() if j >= 0}


def keys(reps: DataFrame, levels: dict[int, int], bloom=None) -> DataFrame:
    """key, rep for each set of reps (_row, text); with a Bloom filter, only keys that it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bloom.value, np.uint8) if bloom else None
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for a, b, raw, at in textnum.slices(batch.column("text")):
                k, r = keys_of(*textnum.shingle_sets(raw, at, K), levels)
                if bits is not None:
                    p = k & np.uint64(BLOOM_BITS - 1)
                    q = (k >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)
                    ok = (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & (bits[q >> np.uint64(3)] >> (q & np.uint64(7)).astype(np.uint8)) & 1
                    k, r = k[ok > 0], r[ok > 0]
                yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "rep": pa.array(rows[a:b][r])})

    return reps.select("_row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key long, rep long")


def bloom_of(shared: DataFrame):
    """A broadcast bit table of BLOOM_BITS bits, two a key, put together from OR-ed words of 64."""
    p = F.col("key").bitwiseAND(F.lit(BLOOM_BITS - 1))
    q = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(BLOOM_BITS - 1))
    bit = shared.select(F.explode(F.array(p, q)).alias("b"))
    one = F.expr("shiftleft(1L, cast(b & 63 as int))")
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("x")).toArrow()
    table = np.zeros(BLOOM_BITS // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return shared.sparkSession.sparkContext.broadcast(table.tobytes())


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b of those pairs (a, b: _row) whose sets link: 100 * intersection >= 75 * union."""
    nodes = common.written(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct())
    text = common.keep_ids(reps.select("_row", F.coalesce("text", F.lit("")).alias("text")), nodes, "_row")
    both = pairs.join(text.select(F.col("_row").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("_row").alias("b"), F.col("text").alias("tb")), "b")

    def sets(column) -> list[np.ndarray]:
        out = []
        for _, _, raw, at in textnum.slices(column):
            h, off = textnum.shingle_sets(raw, at, K)
            out += [h[i:j] for i, j in zip(off, off[1:])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(sets(batch.column("ta")), sets(batch.column("tb"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _linking(pairs: DataFrame | None, reps: DataFrame) -> DataFrame | None:
    """``verified`` pairs, written; None if there are none, without planning what would compare none."""
    if pairs is None or pairs.isEmpty():
        return None
    found = common.written(verified(pairs, reps))
    return None if found.isEmpty() else found


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root with the further links (a, b); what was linked goes on as stars, which takes few rounds."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _sizes_allow(x: str, y: str) -> Column:
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def _parity_allows(x: str, y: str) -> Column:
    """The short parity sketches of two classes allow J >= 3/4; evaluated within a join, before it makes a row."""
    apart = sum((F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    return 7 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _sketches_allow(x: str, y: str) -> Column:
    """The same of the full ones. Sizes that allow a link differ by less than two, so the longer one is folded once at most."""
    u, v = F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    words = F.least(F.size(u), F.size(v))
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = lambda s: F.when(F.size(s) == words, s).otherwise(F.zip_with(F.slice(s, 1, words), F.slice(s, words + 1, words), xor))
    differ = F.aggregate(F.zip_with(folded(u), folded(v), xor), F.lit(0), lambda a, w: a + F.bit_count(w))
    return 7 * differ <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _could_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b, ...) of classes that no sketch rules out."""
    facts = classes.select("rep", "n", "sketch", *(f"p{i}" for i in range(PARITY_WORDS)))
    x = pairs.join(facts, F.col("rep") == F.col("a")).drop("rep").alias("x")
    both = x.join(facts.alias("y"), (F.col("x.b") == F.col("y.rep")) & _sizes_allow("x", "y") & _parity_allows("x", "y") & _sketches_allow("x", "y"))
    return both.select(*(f"x.{c}" for c in pairs.columns))


def _open_keys(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, rep, root, major, hub, times of members (key, rep), of keys in which there are several components.

    times: how many classes have the key; major: the largest of its components;
    hub: that one's smallest class with the key.
    """
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    at = members.select("key", "rep").join(roots.join(sizes, "root").withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("members", F.lit(1)).alias("members"))
    most = F.min(F.struct((-F.col("members")).alias("c"), "root", "rep"))
    opened = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), most.alias("m"), F.count("*").alias("times")).where("x < y").select("key", F.col("m.root").alias("major"), F.col("m.rep").alias("hub"), "times")
    return at.drop("members").join(opened, "key")


def _with_enough(opened: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, root, n, t, all (times, key, major, hub; rarest first): each class's open keys of a joint band, if there are t."""
    own = opened.groupBy("rep", "root", F.col("key").bitwiseAND(F.lit(1)).alias("side")).agg(F.array_sort(F.collect_list(F.struct("times", "key", "major", "hub"))).alias("all"))
    band = _band()
    joint = F.when(F.pmod(band, F.lit(2)) == F.col("side"), band).otherwise(band - 1)
    t = F.get(F.array(*[F.lit(int(c)) for c in COMMON]), joint)
    return own.join(classes.select("rep", "n"), "rep").withColumn("t", t).where(F.size("all") >= F.col("t")).select("rep", "root", "n", "t", "all")


def _to_hubs(own: DataFrame, classes: DataFrame, tested: DataFrame) -> DataFrame:
    """a, b: for each class the HUBS hubs that it shares most keys with, of those of other components that it could link to and hasn't been tested with."""
    at = own.select("rep", "root", F.explode("all").alias("k")).where("root <> k.major")
    votes = at.groupBy(F.col("rep").alias("of"), F.col("k.hub").alias("hub")).count()
    votes = common.written(votes.select(F.least("of", "hub").alias("a"), F.greatest("of", "hub").alias("b"), "of", "count").join(tested, ["a", "b"], "left_anti"))
    by = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "a", "b")))
    best = _could_link(votes, classes).groupBy("of").agg(F.slice(by, 1, HUBS).alias("best"))
    return best.select(F.explode("best").alias("x")).select("x.a", "x.b").distinct()


def _between(own: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b of classes of different components that share t keys and whose sizes and short sketches allow a link; each pair about once."""
    words = [f"p{i}" for i in range(PARITY_WORDS)]
    told = F.col("n") <= PARITY_TELLS  # the others' are left out: they take room and rule out nothing
    rare = F.slice("all", 1, F.greatest(F.size("all") - F.col("t").cast("int") + 1, F.lit(0)))
    own = own.withColumn("rare", rare).join(classes.select("rep", *words), "rep").withColumns({p: F.when(told, F.col(p)).otherwise(0) for p in words})
    first = F.slice(F.transform("rare", lambda k: k["key"]), 1, FIRST_KEYS)
    facts = ["rep", "root", "n", *words]
    each = own.withColumn("first", first).select(*facts, "first", F.posexplode("rare").alias("place", "k"))
    left = common.written(each.select(F.col("k.key").alias("key"), F.col("k.major").alias("major"), F.slice("first", 1, F.least("place", F.lit(FIRST_KEYS))).alias("before"), *facts))
    x, y = left.where("root <> major").alias("x"), left.alias("y")
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.rep") < F.col("y.rep"))
    alike = (F.greatest("x.n", "y.n") > PARITY_TELLS) | _parity_allows("x", "y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & _sizes_allow("x", "y") & alike & ~F.arrays_overlap("x.before", "y.before")
    pairs = x.join(y, meet).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return common.written(pairs.distinct())


def linked(rows: DataFrame) -> DataFrame:
    """_row, doc_id, n_shingles, component (a _row), component_id of each of the numbered rows (_row, doc_id, text)."""
    profiles = common.written(profile(rows))
    some = profiles.where("n > 0")
    sets = [F.min("_row").alias("rep"), F.min("doc_id").alias("least"), *(F.min(f"p{i}").alias(f"p{i}") for i in range(PARITY_WORDS))]
    classes = common.written(some.groupBy("n", "d1", "d2").agg(*sets, F.min("sketch").alias("sketch"), F.count("*").alias("size")))
    copies = common.written(some.join(classes.where("size > 1").select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).where("_row <> rep").select("_row", "rep"))
    reps = common.drop_ids(rows, copies, "_row")
    levels = fineness_by_band(profiles)

    shared = common.written(keys(reps, levels).groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot"))
    bloom = bloom_of(shared)
    members = common.written(keys(reps, levels, bloom).join(shared, "key").select("key", "rep", "pivot"))
    bloom.destroy()  # the driver holds it too, and all that needs it is stored

    # first the pivot that a class shares most keys with, of those that it could link to
    votes = members.where("rep <> pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).count()
    # (a vote in four of those that linking sets have: pairs with fewer are left to what follows)
    least = F.get(F.array(*[F.lit(int(c)) for c in COMMON]), F.greatest(_band() - 1, F.lit(0)))
    votes = votes.join(classes.select(F.col("rep").alias("b"), "n"), "b").where(4 * F.col("count") >= least).select("a", "b", "count")
    best = _could_link(common.written(votes), classes).groupBy("b").agg(F.min(F.struct((-F.col("count")).alias("c"), "a")).alias("x"))
    first = common.written(best.select(F.col("x.a").alias("a"), "b"))
    roots = common.written(components(common.written(verified(first, reps))))

    # then hubs of larger components
    own = common.written(_with_enough(_open_keys(members, roots), classes))
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hubs = None if own.isEmpty() else common.written(_to_hubs(own, classes, tested))
    more = _linking(hubs, reps)
    if more is not None:
        tested = tested.unionByName(hubs)
        roots = common.written(_joined(roots, more))
        own = common.written(_with_enough(_open_keys(own.select(F.explode("all.key").alias("key"), "rep"), roots), classes))

    # then all classes of different components
    second = None if own.isEmpty() else common.written(_could_link(_between(own, classes).join(tested, ["a", "b"], "left_anti"), classes))
    more = _linking(second, reps)
    if more is not None:
        roots = common.written(_joined(roots, more))

    named = classes.select("rep", "least").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", F.coalesce("root", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # classes on their own, the most, need no second look
    grouped = common.written(named.where("component <> rep").select("rep", "component").unionByName(roots.where("node = root").select(F.col("node").alias("rep"), F.col("root").alias("component"))).join(least, "component").select("rep", "component", "component_id"))
    alone = classes.where("size > 1").join(grouped, "rep", "left_anti").select("rep", F.col("rep").alias("component"), F.col("least").alias("component_id"))
    by_class = grouped.unionByName(alone)
    by_row = by_class.withColumnRenamed("rep", "_row").unionByName(copies.join(by_class, "rep").select("_row", "component", "component_id"))
    by_row = common.written(by_row)
    few = by_row.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    return profiles.join(F.broadcast(by_row) if few else by_row, "_row", "left").select("_row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "_row").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    return linked(common.numbered(docs.select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id (then the first stored); all columns as they are."""
    rows, own, number = common.numbered_apart(docs)
    told = linked(rows)
    kept = told.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("k")).select(F.col("k._row").alias("_row"))
    dropped = common.written(told.select("_row").join(kept, "_row", "left_anti"))
    return common.drop_ids(own, dropped.withColumnRenamed("_row", number), number).drop(number)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: Components by repeated smallest label over all links; sets by joined words.
ORACLE = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, len(w) AS n_words,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM dw
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY ALL
), link AS (SELECT a, b FROM pair WHERE 100 * i >= 75 * (na + nb - i)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

QUERIES = {"op4_jaccard": op4_jaccard}
ORACLES = {"op4_jaccard": ORACLE}
