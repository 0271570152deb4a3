"""Personal data: rules, and information-theoretic sanitisation (native: DataFrame functions only).

The base rules find e-mail and IP addresses, card and phone numbers, with code
point positions. Each value found is a protected *entity*. The corpus then tells
which words near it give it away: for a term t and an entity e,

    PMI(t; e) = log2(P(e | t) / P(e)),      IC(e) = -log2 P(e),

with P over documents, P(e | t) smoothed by half a document of the usual mix;
PMI / IC is the share of e's information that t discloses. A term that stands
by e in at least ``MIN_CONTEXTS`` different contexts (copies of a passage are
one context, and what was seen once tells nothing of what it goes with) and
discloses at least ``GENERALISE`` of it is generalised, from ``REMOVE`` on
removed, wherever it stands in a document of e. A term is any run of two or
more letters and digits; counts cover all documents; only pairs are kept that
reach MIN_CONTEXTS, and those are shuffled, never collected.

Patterns are written so that each is linear in the text and needs no deep
recursion; the matches are those of the plain forms in the comments.

Defined results: a null or empty text has no spans; a failing match is dropped,
not retried; positions are code points, ends exclusive; each row of repeated
rows gets a result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match begins where a run does, or where the last match ended
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ of 13 digits or more; shorter ones would be dropped
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
VALID_IP = rf"^{PART}\.{PART}\.{PART}\.{PART}$"

#: Code points of context on either side of an entity.
REACH = 96
MIN_CONTEXTS = 2
GENERALISE, REMOVE = 0.90, 0.97
#: Runs of letters and digits, and what divides them; a term is a run of two characters or more.
WORD, BETWEEN_WORDS = r"[\p{L}\p{M}\p{N}]++", r"[^\p{L}\p{M}\p{N}]++"
#: Matches whose places are summed at a time.
RUN = 128

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def found(text: Column, pattern: str, kind: int, could: Column) -> Column:
    """The pattern's matches, leftmost first and not overlapping, where ``could`` holds (no match elsewhere).

    A match starts after all that came before it, earlier gaps and earlier
    matches. Lengths are summed over runs of RUN matches and then over the runs:
    appending to one list would copy it for each match.
    """
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
        F.concat(acc["ends"], F.array(acc["at"] + F.length(x["g"]) + F.length(x["m"]))).alias("ends"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def placed(both: Column) -> Column:
        n = F.size(both["m"])
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        pairs = lambda i: F.arrays_zip(F.slice(both["m"], i, RUN).alias("m"), F.slice(both["g"], i, F.least(F.lit(RUN), n - i + 1)).alias("g"))
        runs = F.transform(starts, lambda i: F.struct(F.slice(both["m"], i, RUN).alias("m"), F.aggregate(pairs(i), none, step).alias("s")))

        def whole(r: Column) -> Column:
            before = F.aggregate(F.transform(r, lambda x: x["s"]["at"]), none, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["ends"], F.array(acc["at"])).alias("ends")), lambda acc: acc["ends"])
            span = lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))
            return F.flatten(F.zip_with(r, before, lambda x, at: F.zip_with(x["m"], x["s"]["ends"], lambda m, end: span(m, at + end))))

        return _let(runs, whole)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(could, _let(both, placed)).otherwise(F.array().cast(SPAN))


def terms_in(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: F.length(w) > 1))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: each second digit from the right is doubled, its digits summed."""
    back = F.reverse(number)
    doubled = F.transform(F.split(back, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start."""
    email = found(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ip = F.filter(found(text, IP, 1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda s: s["value"].rlike(VALID_IP))
    card = F.filter(found(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda s: (F.length(digits(s["value"])) <= 19) & F.when(F.length(digits(s["value"])) <= 19, luhn(digits(s["value"]))).otherwise(False))
    phone = F.filter(found(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def spans_of(rows: DataFrame) -> DataFrame:
    """_row, doc_id, base: the base spans of each numbered row, written."""
    return common.written(rows.select("_row", "doc_id", base_spans(common.text_or_empty()).alias("base")))


def mentions(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """_row, entity, context (digest), terms (distinct) of each base span; written.

    Only rows with spans are read again; of a context cut in a word, that word is left out.
    """
    some = spans.where(F.size("base") > 0).select("_row", "base")
    few = common.written(some)
    small = few.limit(common.MAX_BROADCAST_IDS // 10 + 1).count() <= common.MAX_BROADCAST_IDS // 10
    rows = rows.select("_row", "text").join(F.broadcast(few) if small else few, "_row")
    begin = F.greatest(F.col("s.start") - REACH, F.lit(0))
    each = rows.select("_row", "text", F.explode("base").alias("s")).select(
        "_row",
        F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value")).alias("entity"),
        begin.alias("begin"),
        F.substring(F.col("text"), begin + 1, F.col("s.start") - begin).alias("left"),
        F.substring(F.col("text"), F.col("s.end") + 1, F.lit(REACH)).alias("right"),
    )
    # a word that the context's own end may have cut is left out
    before = F.when(F.col("begin") > 0, F.regexp_replace("left", "^" + WORD, "")).otherwise(F.col("left"))
    after = F.when(F.length("right") == REACH, F.regexp_replace("right", WORD + "$", "")).otherwise(F.col("right"))
    return common.written(
        each.select(
            "_row",
            "entity",
            F.xxhash64("left", "right").alias("context"),
            terms_in(F.concat(before, F.lit(" "), after)).alias("terms"),
        )
    )


def disclosing(docs: DataFrame, said: DataFrame) -> DataFrame:
    """entity, term, share (PMI / IC) of each pair that reaches GENERALISE; written."""
    pair = said.select("_row", "entity", "context", F.explode("terms").alias("term"))
    # one row a context first: copies don't make a term telling
    contexts = pair.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS)
    often = common.written(contexts)
    nothing = often.select("entity", "term", F.lit(0.0).alias("share")).limit(0)
    if often.isEmpty():
        return nothing
    together = pair.join(often, ["entity", "term"]).select("entity", "term", "_row").distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    entities = said.select("entity", "_row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = common.written(often.select("term").distinct())
    few = terms.limit(common.MAX_BROADCAST_IDS + 1).count() <= common.MAX_BROADCAST_IDS
    # documents that hold each such term: all documents are read, and summed before the shuffle
    every = docs.select(F.explode(terms_in(common.text_or_empty())).alias("term"))
    # an inner join (terms are distinct): a semi join would be pushed below the sums, where it makes a row an occurrence
    df = every.groupBy("term").count().withColumnRenamed("count", "n_term").join(F.broadcast(terms) if few else terms, "term")
    total = float(docs.count())
    p_entity = F.col("n_entity") / total
    # half a document more that holds the term, and the entity as often as any
    pmi = F.log2(F.least((F.col("both") + 0.5 * p_entity) / (F.col("n_term") + 0.5), F.lit(1.0)) / p_entity)
    ic = F.greatest(-F.log2(p_entity), F.lit(1e-9))
    return common.written(together.join(entities, "entity").join(df, "term").select("entity", "term", (pmi / ic).alias("share")).where(F.col("share") >= GENERALISE))


def term_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """_row, terms (kind, start, end) that the corpus tells to generalise or remove, wherever they stand in a document of the entity; written."""
    said = mentions(rows, spans)
    told = disclosing(rows, said)
    kind = F.when(F.col("share") >= REMOVE, 5).otherwise(4)
    here = said.select("_row", "entity").distinct().join(told, "entity").groupBy("_row", "term").agg(F.max(kind).alias("kind"))
    lists = common.written(here.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")))
    few = lists.limit(common.MAX_BROADCAST_IDS // 10 + 1).count() <= common.MAX_BROADCAST_IDS // 10
    texts = rows.select("_row", common.text_or_empty().alias("text")).join(F.broadcast(lists) if few else lists, "_row")
    words = texts.select("_row", "kinds", F.explode(found(F.col("text"), WORD, 0, F.lit(True))).alias("w")).select("_row", F.element_at("kinds", F.lower("w.value")).alias("kind"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    return common.written(words.where("kind IS NOT NULL").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", F.lit("").alias("value")))).alias("terms")))


def scan(rows: DataFrame) -> DataFrame:
    """_row, doc_id, base, every of numbered rows (_row, doc_id, text): base spans, and those with the terms' spans; in order of kind and start."""
    spans = spans_of(rows)
    terms = term_spans(rows, spans)
    few = terms.limit(common.MAX_BROADCAST_IDS // 10 + 1).count() <= common.MAX_BROADCAST_IDS // 10
    none = F.array().cast(SPAN)
    more = F.filter(F.coalesce(F.col("terms").cast(SPAN), none), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return spans.join(F.broadcast(terms) if few else terms, "_row", "left").select("_row", "doc_id", "base", F.concat("base", more).alias("every"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(common.numbered(docs.select("doc_id", "text"))).select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with base values and generalised terms replaced by their kind in brackets, removed terms cut."""
    rows = common.numbered(docs.select("doc_id", "text"))
    rows = rows.join(scan(rows).select("_row", "every"), "_row")
    by_place = F.array_sort(F.transform("every", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ("email", "ip", "card", "phone", "term")], F.lit(""))
    out = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"])),
    )
    return rows.select("doc_id", F.when(F.col("text").isNull(), F.lit(None)).otherwise(out).alias("text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
