"""Product codes of vectors, by Lloyd's rounds that filter kd-trees.

Vectors are cut into PARTS consecutive parts. Each partition gathers its vectors
into blocks of at most BLOCK and builds a kd-tree over every part of a block, whose
nodes keep their bounding box and the sum and count of what lies below; the blocks
are stored and serve all rounds. A round sends the codebooks (of fixed size) down
the trees, a level of all nodes at once: an entry that no point of a box can have
as its nearest is eliminated; where one entry is left the whole subtree is its own,
and its cached sum and count are added; what remains at the leaves is compared point
by point. Partial sums are whole numbers, so results don't depend on blocks or order.

Defined results: rows whose vector is null, holds a null or non-finite component or
is shorter than the longest one are dropped; a length that PARTS doesn't divide is
filled up by zeros; rows of one id each count and each give a row, those with a null
id begin the order of ids last, equal ids go by vector; with fewer than ENTRIES rows
there are as many entries as rows; errors beyond the range of a long are null; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, and points of a leaf at most.
BLOCK, LEAF = 4096, 16


# ---- kd-trees of one part of a block, as flat arrays: the root first, then level by level


def levels(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Where the nodes of each level begin among n points (and n): halves of halves, until no node has more than ``leaf``."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        b = out[-1]
        out.append(np.append(np.stack([b[:-1], b[:-1] + np.diff(b) // 2], axis=1).reshape(-1), n))
    return out


def tree_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of points that has each node of ``levels`` cut at the median of its box's longest side."""
    n = len(x)
    order, cuts = np.arange(n), levels(n, leaf)
    for b in cuts[:-1]:
        at, node = x[order], np.repeat(np.arange(len(b) - 1), np.diff(b))
        side = (np.maximum.reduceat(at, b[:-1]) - np.minimum.reduceat(at, b[:-1])).argmax(axis=1)
        order = order[np.lexsort((at[np.arange(n), side[node]], node))]
    return order


def caches(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, sum) of each node, for points in the tree's order; its count is the length of its run."""
    b = [c[:-1] for c in levels(len(x), leaf)]
    return tuple(np.concatenate([f.reduceat(x, k) for k in b]) for f in (np.minimum, np.maximum, np.add))


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, d) to entries (k, d)."""
    return ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def survivors(low: np.ndarray, high: np.ndarray, open_: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Of the entries open at each node (n, k) those that some point of its box may have as its nearest.

    Against the entry nearest to the box's middle another one is out if it is
    farther, or as far and later, even at the corner that lies most to its side.
    """
    far = squares(low + high, 2 * book)
    far = np.where(open_, far, far.max() + 1)
    best = far.argmin(axis=1)
    own = book[best]
    towards = book[None, :, :] - own[:, None, :]
    corner = np.where(towards > 0, high[:, None, :], low[:, None, :])
    gain = ((corner - book[None, :, :]) ** 2 - (corner - own[:, None, :]) ** 2).sum(axis=2)
    index = np.arange(len(book))
    return open_ & ((gain < 0) | ((gain == 0) & (index <= best[:, None])))


def filtered(x: np.ndarray, boxes: tuple, book: np.ndarray, leaf: int = LEAF) -> tuple[list, np.ndarray]:
    """([(first, end, entry, node) of subtrees assigned as wholes], entry of each other point, -1 elsewhere), for points in the tree's order."""
    low, high, _ = boxes
    cuts = levels(len(x), leaf)
    owner, taken, first = np.full(len(x), -1), [], 0
    nodes, open_ = np.array([0]), np.ones((1, len(book)), bool)
    for depth, b in enumerate(cuts):
        at = first + nodes
        open_ = survivors(low[at], high[at], open_, book)
        lone = open_.sum(axis=1) == 1
        taken += [(int(b[j]), int(b[j + 1]), int(e), first + int(j)) for j, e in zip(nodes[lone], open_[lone].argmax(axis=1))]
        nodes, open_ = nodes[~lone], open_[~lone]
        if not len(nodes):
            break
        first += len(b) - 1
        if depth < len(cuts) - 1:
            nodes, open_ = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1), np.repeat(open_, 2, axis=0)
    b = cuts[-1]
    if len(nodes):
        size = b[nodes + 1] - b[nodes]
        node = np.repeat(np.arange(len(nodes)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + b[nodes][node]
        d = squares(x[at], book)
        owner[at] = np.where(open_[node], d, d.max() + 1).argmin(axis=1)
    return taken, owner


def totals(x: np.ndarray, boxes: tuple, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points of each entry."""
    taken, owner = filtered(x, boxes, book)
    s, n = np.zeros_like(book), np.zeros(len(book), np.int64)
    for a, b, entry, node in taken:
        s[entry] += boxes[2][node]
        n[entry] += b - a
    left = np.flatnonzero(owner >= 0)
    np.add.at(s, owner[left], x[left])
    np.add.at(n, owner[left], 1)
    return s, n


def assigned(x: np.ndarray, boxes: tuple, book: np.ndarray) -> np.ndarray:
    taken, owner = filtered(x, boxes, book)
    for a, b, entry, _ in taken:
        owner[a:b] = entry
    return owner


# ---- blocks, as rows of a table


def _packed(m: np.ndarray, wide: bool) -> list:
    return [str(v) for v in m.reshape(-1).tolist()] if wide else m.reshape(-1)


class _Layout:
    """How trees lie in a block's row: numbers as longs, or as decimal text if wide."""

    def __init__(self, width: int, wide: bool):
        self.width, self.wide = width, wide  # of a part
        self.number = "string" if wide else "long"

    def schema(self, ids: str) -> str:
        n = self.number
        return ids + f", trees array<struct<place: array<int>, x: array<{n}>, low: array<{n}>, high: array<{n}>, total: array<{n}>>>"

    def build(self, m: np.ndarray) -> list[dict]:
        out = []
        for p in range(PARTS):
            x = m[:, p * self.width : (p + 1) * self.width]
            order = tree_order(x)
            x = x[order]
            low, high, total = caches(x)
            out.append({"place": order.astype(np.int32)} | {k: _packed(v, self.wide) for k, v in (("x", x), ("low", low), ("high", high), ("total", total))})
        return out

    def _table(self, a: pa.Array) -> np.ndarray:
        m = a.to_numpy(zero_copy_only=False)
        return (np.array([int(v) for v in m], dtype=object) if self.wide else m).reshape(-1, self.width)

    def read(self, trees: pa.ListScalar) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        """(place of each point in the block, points, boxes) of each part."""
        t = trees.values
        for p in range(PARTS):
            cell = lambda k, p=p: t.field(k)[p].values
            yield cell("place").to_numpy(zero_copy_only=False), self._table(cell("x")), tuple(self._table(cell(k)) for k in ("low", "high", "total"))


def _blocks(kept: DataFrame, d: int, layout: _Layout) -> DataFrame:
    """rows (array of vec_id, label), trees of each block of kept (vec_id, label, x), stored."""
    wide, fill = layout.wide, layout.width * PARTS - d
    own = kept.select(F.struct("vec_id", "label").alias("own"), "x")
    ids = f"rows array<{own.schema['own'].dataType.simpleString()}>"

    def block(held: list) -> pa.RecordBatch:
        rows, x = (pa.concat_arrays([h.column(k) for h in held]) for k in ("own", "x"))
        m = vectors.matrix(x, d, wide)
        m = np.concatenate([m, np.zeros((len(m), fill), m.dtype)], axis=1) if fill else m
        whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        part = lambda v: pa.array(v, pa.string() if wide else pa.int64())
        trees = layout.build(m)
        column = {k: pa.ListArray.from_arrays(np.cumsum([0] + [len(t[k]) for t in trees]).astype(np.int32), pa.concat_arrays([part(t[k]) for t in trees])) for k in ("x", "low", "high", "total")}
        place = pa.ListArray.from_arrays(np.cumsum([0] + [len(rows)] * PARTS).astype(np.int32), pa.array(np.concatenate([t["place"] for t in trees]), pa.int32()))
        every = pa.StructArray.from_arrays([place, *column.values()], names=["place", *column])
        return pa.record_batch([whole, pa.ListArray.from_arrays(pa.array([0, PARTS], pa.int32()), every)], names=["rows", "trees"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK - n))
                batch, n = batch.slice(BLOCK - n), n + held[-1].num_rows
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return common.written(own.mapInArrow(build, layout.schema(ids)))


def _round(blocks: DataFrame, books: list[np.ndarray], layout: _Layout) -> list[np.ndarray]:
    """The codebooks after one round."""
    width, decimal = layout.width, pa.decimal128(38, 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros(b.shape, object), np.zeros(len(b), object)] for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                for p, (_, x, boxes) in enumerate(layout.read(batch.column("trees")[i])):
                    for into, more in zip(total[p], totals(x, boxes, books[p])):
                        into += more
        flat = [(p, e, [*s[e].tolist(), int(n[e])]) for p, (s, n) in enumerate(total) for e in range(len(n)) if n[e]]
        if flat:
            values = pa.array([[Decimal(int(v)) for v in row] for *_, row in flat], pa.list_(decimal))
            yield pa.record_batch([pa.array([p for p, *_ in flat], pa.int32()), pa.array([e for _, e, _ in flat], pa.int32()), values], names=["part", "entry", "v"])

    one = blocks.select("trees").mapInArrow(sums, "part int, entry int, v array<decimal(38,0)>")
    told = one.groupBy("part", "entry").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width + 1)]).collect()  # PARTS * ENTRIES rows at most
    out = [b.copy() for b in books]
    for r in told:
        n = int(r[f"v{width}"])
        out[r["part"]][r["entry"]] = [int(r[f"v{i}"]) // n for i in range(width)]
    return out


def fit(kept: DataFrame, d: int, wide: bool) -> tuple[DataFrame, list[np.ndarray], _Layout]:
    """(blocks, codebook of each part, layout) of kept (vec_id, label, x)."""
    layout = _Layout(-(-d // PARTS), wide)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()  # ENTRIES rows
    start = np.array([list(r["x"]) + [0] * (layout.width * PARTS - d) for r in first], dtype=object if wide else np.int64)
    books = [start[:, p * layout.width : (p + 1) * layout.width] for p in range(PARTS)]
    blocks = _blocks(kept, d, layout)
    for _ in range(ROUNDS):
        books = _round(blocks, books, layout)
    return blocks, books, layout


def encode(blocks: DataFrame, books: list[np.ndarray], layout: _Layout) -> DataFrame:
    """vec_id, label, code, error of each row of the blocks."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                code, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), object if layout.wide else np.int64)
                for p, (place, x, boxes) in enumerate(layout.read(batch.column("trees")[i])):
                    owner = assigned(x, boxes, books[p])
                    code[place, p] = owner
                    error[place] += ((x - books[p][owner]) ** 2).sum(axis=1)
                text = code.tobytes().hex()
                told = [text[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(rows))]
                yield pa.record_batch([pa.concat_arrays([rows]), pa.array(told), pa.array([v if v < 1 << 63 else None for v in error.tolist()], pa.int64())], names=["own", "code", "error"])

    own = blocks.schema["rows"].dataType.elementType.simpleString()
    return blocks.mapInArrow(codes, f"own {own}, code string, error long").select("own.vec_id", "own.label", "code", "error")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def product_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of rows (vec_id, embedding, label) that is kept."""
    kept, d, wide = vectors.whole(rows, SCALE, "vec_id", "label")
    if not d:
        return kept.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    blocks, books, layout = fit(kept, d, wide)
    coded = common.written(encode(blocks, books, layout))
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    by = common.written(coded.groupBy(F.struct("label").alias("of")).agg(total.alias("s")))
    few = by.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    fits = F.when(F.col("s") <= (1 << 63) - 1, F.col("s").cast("long"))
    told = coded.withColumn("of", F.struct("label")).join(F.broadcast(by) if few else by, "of")
    return told.select("vec_id", "code", "error", fits.alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT r, p, list_slice(x, p * w + 1, (p + 1) * w) AS x FROM kept, range({PARTS}) t(p))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM parts JOIN book{k} USING (p)) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)""")
        if k < ROUNDS:
            steps.append(f"""sum{k} AS (SELECT p, e, i, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY ALL),
new{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sum{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN new{k} n USING (p, e))""")
    last = f"""coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
all_ AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), all_"""
    return "WITH " + ",\n".join(steps) + ",\n" + last


QUERIES = {"op12_codes": op12_codes}
ORACLES = {"op12_codes": _oracle()}
