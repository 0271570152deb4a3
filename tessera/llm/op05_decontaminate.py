"""Benchmark decontamination as a prefix-filtered set join (native: DataFrame functions only).

Benchmark items are cut into windows of ``WINDOW`` words (a shorter item is one
window). Words are ordered by rarity over all documents; since a window must be
contained whole, the prefix that any match has to share is one word, the
window's rarest (its *anchor*). Document words meet the anchors by that word
alone; an anchor's place in its window bounds, before anything is compared,
where the window would begin and end in the document (positional bound) and
whether it fits there (length bound). What is left is compared word by word
over item-sized windows, so no hash decides.

Anchors are broadcast, some ``MAX_BROADCAST_ANCHORS`` windows at a time: more are
dealt into parts of that size by hash, and the documents are read once for each
part. Nothing of the documents is shuffled but what a window was found in.

Defined results: a null or wordless text has no words and no hits; wordless
items have no windows; windows that recur, in one item or several, count for
each item once; of repeated documents each row gets its own result; repeated
benchmark rows count once; an item with a null id is left out; an empty table
on either side gives rows without hits, or no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW = 10
MAX_BROADCAST_ANCHORS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(col: str = "text") -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text, A-Z lower-cased."""
    text = F.translate(common.text_or_empty(col), _UPPER, _LOWER)
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (array of words) for each window of each item, repeats once."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), words().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return cut.distinct()


def anchored(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window, anchor (its rarest word), place (0-based, the first such place); written."""
    win = common.written(windows(benchmark, size))
    vocabulary = win.select(F.explode("window").alias("word")).distinct()
    # how often each of these words occurs in all documents: summed map-side, a row a word and task
    said = documents.select(F.explode(words()).alias("word"))
    few = vocabulary.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    counts = said.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count() if few else said.groupBy("word").count().join(vocabulary, "word", "left_semi")
    counts = common.written(counts)
    placed = win.withColumn("w", F.xxhash64("window")).select("item_id", "window", "w", F.posexplode("window").alias("place", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "place")).alias("best"))
    return common.written(ranked.select("item_id", "window", F.col("best.word").alias("anchor"), F.col("best.place").alias("place")))


def occurrences(rows: DataFrame, anchors: DataFrame, size: int = WINDOW) -> DataFrame:
    """_row, item_id, start (0-based word), length of each place where a window occurs.

    ``rows`` has _row and text; each of its words that is an anchor goes on with
    the words within a window's reach of it, no more.
    """
    n = anchors.count()
    parts = max(1, -(-n // max(1, MAX_BROADCAST_ANCHORS)))
    if parts == 1:
        return _occurrences(rows, anchors, size)
    dealt = common.written(anchors.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)).cast("int")), "part")
    found = [_occurrences(rows, dealt.where(F.col("part") == k).drop("part"), size) for k in range(parts)]
    return reduce(DataFrame.unionByName, [common.written(f) for f in found])


def _occurrences(rows: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """occurrences of the windows of some MAX_BROADCAST_ANCHORS anchors, which are broadcast."""
    doc = rows.select("_row", words().alias("w"))
    reach = size - 1
    keys = [r["anchor"] for r in anchors.select("anchor").distinct().collect()]  # looked up in one hash set within the row
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(keys)) if keys else F.array().cast("array<int>")
    doc = doc.where(F.size("w") > 0)
    near = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get("w", i).alias("anchor"), F.greatest(i - reach, F.lit(0)).alias("from"), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1).alias("near")))
    found = doc.select("_row", F.explode(near).alias("c")).select("_row", "c.*")
    pairs = found.join(F.broadcast(anchors), "anchor")
    begin = F.col("pos") - F.col("from") - F.col("place")  # 0-based, within ``near``
    fits = (begin >= 0) & (begin + F.size("window") <= F.size("near"))
    return pairs.where(fits & (F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.size("window")) == F.col("window"))).select("_row", "item_id", (F.col("pos") - F.col("place")).alias("start"), F.size("window").alias("length"))


def hits(rows: DataFrame, anchors: DataFrame, size: int = WINDOW) -> DataFrame:
    """_row, n_hit, n_items, items_sha256 of the rows that hold a window."""
    found = occurrences(rows, anchors, size).groupBy("_row").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("_row", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of documents."""
    rows = common.numbered(documents.select("doc_id", "text"))
    found = common.written(hits(rows, anchored(rows, benchmark, size), size))
    few = found.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    none = F.lit(0).cast("long")
    base = rows.select("_row", "doc_id", F.size(words()).cast("long").alias("n_words"))
    return base.join(F.broadcast(found) if few else found, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of documents without a hit, all their columns as they are."""
    rows, own, number = common.numbered_apart(documents)
    found = common.written(hits(rows, anchored(rows, benchmark, size), size).select(F.col("_row").alias(number)))
    return common.drop_ids(own, found, number).drop(number)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The windows of each item, and the document's words by place; occurrences by equality of joined words.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), iw AS (
  SELECT DISTINCT item_id, w FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw)
), sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
occ AS (
  SELECT DISTINCT dp.doc_id, win.item_id, dp.i, win.n
  FROM dp JOIN sizes ON dp.i + sizes.n - 1 <= len(dp.w)
  JOIN win ON win.n = sizes.n AND win.win = array_to_string(dp.w[dp.i:dp.i + sizes.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {"op5_decontaminate": ORACLE}
