"""Full-text search: query terms, substring matching, BM25, and short literals.

A phrase matches as a substring in lower case; words of queries and literals are
folded in full (``functions.fold``). Scores follow BM25 over trigram
counts with k1 = 1.2 and b = 0.75; a phrase that stands in most texts still
counts a little (idf is at least 1e-6).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import runtime
from tessera.functions.fold import fold, fold_word

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MIN_TERM, MAX_TERMS = 3, 64
SHORT_CHUNKS, SHORT_BYTES = 4096, 4 << 20


def query_terms(text: str) -> list[str]:
    """Words of a query ([\\w/.-]+, three characters or more), first of equals ignoring case, at most 64."""
    seen: dict[str, str] = {}
    for t in re.findall(r"[\w/.\-]+", text):
        if len(t) >= MIN_TERM:
            seen.setdefault(t.casefold(), t)
    return list(seen.values())[:MAX_TERMS]


def phrases(terms: list[str]) -> list[str]:
    """What a query matches: its one term, or the terms as a phrase and each of them."""
    return terms if len(terms) < 2 else [" ".join(terms), *terms]


def terms_column(text: Column) -> Column:
    """query_terms over a column."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)[\w/.\-]+"), F.lit(0)), lambda t: F.length(t) >= MIN_TERM)
    low = F.transform(words, fold_word)
    return F.slice(F.transform(F.array_distinct(low), lambda t: F.get(words, F.array_position(low, t).cast("int") - 1)), 1, MAX_TERMS)


def occurrences(text: Column, phrase: str) -> Column:
    """Occurrences of a folded phrase in folded text, overlapping ones too."""
    return F.when(F.contains(text, F.lit(phrase)), F.regexp_count(text, F.lit("(?=" + re.escape(phrase).replace(r"\ ", " ") + ")"))).otherwise(0)


def matching(chunks: DataFrame, phrase_list: list[str], content: str = "content") -> DataFrame:
    """Chunks that hold one of the phrases, with counts f0, f1, ...; all of one scan."""
    low = F.lower(content)
    counted = chunks.withColumns({f"f{i}": occurrences(low, p.lower()) for i, p in enumerate(phrase_list)})
    return counted.where(F.greatest(*[F.col(f"f{i}") for i in range(len(phrase_list))], F.lit(0)) > 0)


def corpus_stats(chunks: DataFrame, phrase_list: list[str], by: list[str], content: str = "content") -> DataFrame:
    """n_docs, avg_len and each phrase's df (n0, n1, ...) of each corpus."""
    low = F.lower(content)
    length = F.greatest(F.length(content) - 2, F.lit(0))
    held = [F.count_if(F.contains(low, F.lit(p.lower()))).alias(f"n{i}") for i, p in enumerate(phrase_list)]
    return chunks.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_len"), *held)


def bm25(chunks: DataFrame, phrase_list: list[str], by: list[str] = (), content: str = "content") -> DataFrame:
    """Matching chunks with ``score``; statistics are those of each corpus (``by``), never mixed.

    Two scans and no shuffle of texts: the statistics are summed map-side and
    joined back, one row a corpus.
    """
    by = list(by)
    stats = corpus_stats(chunks, phrase_list, by, content)
    hits = matching(chunks, phrase_list, content)
    joined = hits.join(stats, by) if by else hits.crossJoin(F.broadcast(stats))  # one row
    return scored(joined, len(phrase_list), content)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of folded text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def postings(chunks: DataFrame, content: str = "content") -> DataFrame:
    """trigram, generation_id, chunk_id: one row for each distinct trigram of a chunk; stored by generation, sorted by trigram."""
    return chunks.select("generation_id", "chunk_id", F.explode(trigrams(F.col(content))).alias("trigram"))


def candidates(index: DataFrame, phrase_list: list[str]) -> DataFrame:
    """generation_id, chunk_id of chunks that hold all trigrams of one of the phrases; phrases under three characters have none."""
    sought = [sorted({p.lower()[i : i + 3] for i in range(len(p) - 2)}) for p in phrase_list]
    every = sorted({t for s in sought for t in s})
    if not every:
        return index.select("generation_id", "chunk_id").limit(0)
    # the trigrams asked for are pushed down to the scan of the sorted postings
    held = index.where(F.col("trigram").isin(every)).groupBy("generation_id", "chunk_id").agg(F.collect_set("trigram").alias("t"))
    some = F.lit(False)
    for s in filter(None, sought):
        some = some | (F.size(F.array_except(F.array(*[F.lit(t) for t in s]), F.col("t"))) == 0)
    return held.where(some).select("generation_id", "chunk_id")


def bm25_indexed(chunks: DataFrame, index: DataFrame, lengths: DataFrame, phrase_list: list[str], content: str = "content") -> DataFrame:
    """bm25 by generation with stored postings: only candidate chunks are read and counted.

    lengths: generation_id, n_docs, avg_len, as stored with the generation.
    """
    found = matching(chunks.join(candidates(index, phrase_list), ["generation_id", "chunk_id"], "left_semi"), phrase_list, content)
    found = runtime.settled(found)
    df = found.groupBy("generation_id").agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrase_list))])
    return scored(found.join(lengths, "generation_id").join(df, "generation_id"), len(phrase_list), content)


def scored(joined: DataFrame, phrases: int, content: str = "content") -> DataFrame:
    """BM25 of rows with f0, n0, f1, n1, ..., n_docs, avg_len."""
    length = F.greatest(F.length(content) - 2, F.lit(0))
    score = F.lit(0.0)
    for i in range(phrases):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.col("avg_len")))).otherwise(0.0)
    return joined.withColumn("score", score)


def base_terms(text: str) -> list[str]:
    """Words of a name for lookups: ASCII runs of three or more characters, of two if there are none."""
    words = re.findall(r"[A-Za-z0-9_]+", text)
    return [w for w in words if len(w) >= 3] or [w for w in words if len(w) == 2]


def short_terms(text: str) -> list[str]:
    """Words of one or two characters, for queries without a longer one."""
    if query_terms(text):
        return []
    return list(dict.fromkeys(t.casefold() for t in re.findall(r"\w+", text) if len(t) < MIN_TERM))


def byte_prefix(rows: DataFrame, order: list, size: Column, most_rows: int, most_bytes: int, by: list[str] = ()) -> DataFrame:
    """The longest prefix in this order within both budgets; nothing after the first row that breaks one is taken."""
    if not by:
        rows = rows.orderBy(*order).limit(most_rows)  # the window below sees a bounded number of rows
    w = Window.partitionBy(*by).orderBy(*order)
    taken = rows.withColumns({"_bytes": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_rank": F.row_number().over(w)})
    return taken.where((F.col("_bytes") <= most_bytes) & (F.col("_rank") <= most_rows)).drop("_bytes", "_rank")


def literal_hits(rows: DataFrame, phrase: str, content: str = "content") -> DataFrame:
    """The rows whose folded text holds the folded phrase."""
    return rows.where(F.contains(fold(content), F.lit(phrase.casefold())))


def short_literal(chunks: DataFrame, terms: list[str], order: list, content: str = "content") -> DataFrame:
    """Chunks of a bounded prefix (by chunk_id) that hold one of the short terms, score 1."""
    some = byte_prefix(chunks, ["chunk_id"], F.octet_length(content), SHORT_CHUNKS, SHORT_BYTES)
    held = F.lit(False)
    for t in terms:
        held = held | F.contains(fold(content), F.lit(t.casefold()))
    return some.where(held).withColumn("score", F.lit(1.0)).orderBy(*order)


def round_robin(ranked: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """Interleave rankings: first of each, then second of each; scores of different corpora are never compared."""
    w = Window.partitionBy(*by).orderBy(*order)
    turn = ranked.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return turn.orderBy("turn", *by).limit(limit)
