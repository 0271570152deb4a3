"""The symbol graph: one-hop neighbours, trust, ownership, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import runtime
from tessera.functions import spans
from tessera.operators import intervals

#: Strongest first.
TRUST = ("EXACT", "RESOLVED", "HEURISTIC", "INFERRED")
TRUSTED = ("EXACT", "RESOLVED")


def trust_rank(trust: Column) -> Column:
    rank = F.lit(len(TRUST) - 1)
    for i, t in reversed(list(enumerate(TRUST))):
        rank = F.when(trust == t, i).otherwise(rank)
    return rank


def trust_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TRUST]), rank)


def seeds(relations: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """The entities and what they define, each once."""
    defined = relations.where("rel_type = 'DEFINES'").join(entity_ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("entity_id"))
    return entity_ids.select("entity_id").union(defined).distinct()


def neighbours(relations: DataFrame, entity_ids: DataFrame, side: str, limit: int = 50, heuristic: bool = False) -> DataFrame:
    """entity_id, trust of the callers (side "source_id") or callees ("target_id") of the entities and what they define.

    One hop of CALLS and REFERENCES; members of the seeds are no neighbours; each
    neighbour has its strongest trust; ordered by trust, then id.
    """
    other = "target_id" if side == "source_id" else "source_id"
    seed = seeds(relations, entity_ids)
    edges = relations.where(F.col("rel_type").isin("CALLS", "REFERENCES"))
    if not heuristic:
        edges = edges.where(F.col("trust_class").isin(*TRUSTED))
    touched = edges.join(seed.withColumnRenamed("entity_id", other), other, "left_semi")
    outside = touched.join(seed.withColumnRenamed("entity_id", side), side, "left_anti")
    best = outside.groupBy(F.col(side).alias("entity_id")).agg(F.min(trust_rank(F.col("trust_class"))).alias("rank"))
    return best.orderBy("rank", "entity_id").limit(limit).select("entity_id", trust_name(F.col("rank")).alias("trust"))


def preferred(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """entity_id, chunk_id: of the chunks of an entity's file (file_id, span) the one of exactly its span, else of those that hold its start the one of fewest lines."""
    # stored once: the joins and what they look at first read the chunks several times
    own, c = entities.select("entity_id", "file_id", F.col("span").alias("_own")), runtime.settled(chunks.select("chunk_id", "file_id", "span"))
    exact = own.join(c.withColumn("_own", F.col("span")), ["file_id", "_own"]).select("entity_id", "chunk_id", "span", F.lit(0).alias("fit"))
    begin = intervals.ends(F.col("_own"))[0]
    around = intervals.overlap_join(c, own, ["file_id"], intervals.ends(F.col("span")), (begin, begin + 1)).select("entity_id", "chunk_id", "span", F.lit(1).alias("fit"))
    s = F.col("span")
    order = F.struct("fit", s["end_line"] - s["start_line"], spans.start(s), "chunk_id")
    return exact.unionByName(around).groupBy("entity_id").agg(F.min_by("chunk_id", order).alias("chunk_id"))


#: Chunks that are expanded, entities of each, and bounds and weights of what is found.
TOP_CHUNKS, ENTITIES_EACH = 5, 2
LEAST_FOUND, MOST_FOUND = 4, 24
STRONG, WEAK, RANK_OFFSET = 2.5, 0.9, 60


def expand(top: DataFrame, relations: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """place, entity_id, role, trust, k, part: the neighbours of the best chunks' entities, in the order they are taken.

    top: place (from 1), entity_ids, text, explicit (an exact name led to it), a
    bounded list. entities: entity_id, name, rel_path, start_line. Callers and
    callees of each entity alternate, strongest trust first, then those that the
    chunk's text calls by name (callees), then by path, line and id; all together
    are counted by k up to twice the limit, and the part falls with k.
    """
    most = max(LEAST_FOUND, min(MOST_FOUND, 2 * limit))
    seed = top.where(F.col("place") <= min(TOP_CHUNKS, max(1, limit))).select("place", "text", "explicit", F.posexplode(F.slice("entity_ids", 1, ENTITIES_EACH)).alias("turn", "seed"))
    seed = F.broadcast(seed)  # at most TOP_CHUNKS * ENTITIES_EACH rows
    defined = relations.where("rel_type = 'DEFINES'").select(F.col("source_id").alias("seed"), F.col("target_id").alias("member"))
    members = seed.select("place", "turn", "seed", F.col("seed").alias("member")).unionByName(defined.join(seed, "seed").select("place", "turn", "seed", "member")).distinct()
    calls = relations.where(F.col("rel_type").isin("CALLS", "REFERENCES"))
    found = None
    for role, here, there in (("caller", "target_id", "source_id"), ("callee", "source_id", "target_id")):
        met = calls.join(members, calls[here] == members.member).select("place", "turn", F.col(there).alias("entity_id"), trust_rank(F.col("trust_class")).alias("rank"))
        out = met.join(members.select("place", "turn", F.col("member").alias("entity_id")), ["place", "turn", "entity_id"], "left_anti")
        out = out.groupBy("place", "turn", "entity_id").agg(F.min("rank").alias("rank")).withColumn("role", F.lit(role))
        found = out if found is None else found.unionByName(out)
    named = found.join(entities.select("entity_id", "name", "rel_path", "start_line"), "entity_id").join(seed.select("place", "turn", "text", "explicit"), ["place", "turn"])
    said = (F.col("role") == "callee") & (F.col("name") != "") & F.coalesce(F.regexp_count("text", F.concat(F.lit(r"(?U)\b\Q"), "name", F.lit(r"\E\s*\("))) > 0, F.lit(False))
    idx = F.row_number().over(Window.partitionBy("place", "turn", "role").orderBy("rank", F.desc(said), "rel_path", "start_line", "entity_id"))
    short = named.withColumn("idx", idx).where(F.col("idx") <= most)
    # at most 2 * most rows of each entity of the top are left
    k = F.row_number().over(Window.orderBy("place", "turn", "idx", F.desc("role")))
    taken = short.withColumn("k", k).where(F.col("k") <= most)
    weight = F.when(F.col("explicit") & (F.col("role") == "callee") & (F.col("rank") < len(TRUSTED)), STRONG).otherwise(WEAK)
    return taken.select("place", "entity_id", "role", trust_name(F.col("rank")).alias("trust"), F.col("k").cast("long").alias("k"), (weight / (RANK_OFFSET + F.col("k"))).alias("part"))


#: Depth up to which pairs are stored where every entity has one parent; deeper ones are met in steps of it.
NEAR = 32


def ancestors(parents: DataFrame) -> DataFrame:
    """entity_id, ancestor_id, depth (the shortest) along parent_id, however deep; in a cycle no entity is its own ancestor."""
    step = runtime.settled(parents.where("parent_id IS NOT NULL AND entity_id <> parent_id").select("entity_id", F.col("parent_id").alias("ancestor_id")).distinct())
    several = step.groupBy("entity_id").count().where("count > 1")
    return _of_single_parents(step) if several.isEmpty() else _of_several_parents(step)


def _of_several_parents(step: DataFrame) -> DataFrame:
    """Path doubling: what is known up to depth n, continued from every pair of depth n, is all up to 2 n.

    A shortest path begins with shortest paths, so where no pair has depth n there is
    nothing beyond; the rounds are the logarithm of the deepest chain.
    """
    found, n = runtime.settled(step.withColumn("depth", F.lit(1))), 1
    while True:
        far = found.where(F.col("depth") == n).select("entity_id", F.col("ancestor_id").alias("via"))
        if far.isEmpty():
            return found
        onward = found.select(F.col("entity_id").alias("via"), "ancestor_id", (F.col("depth") + n).alias("depth"))
        more = far.join(onward, "via").where("entity_id <> ancestor_id").select("entity_id", "ancestor_id", "depth")
        found = runtime.settled(found.unionByName(more).groupBy("entity_id", "ancestor_id").agg(F.min("depth").alias("depth")))
        n *= 2


def _ends(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, root, height of what leads to a root; entity_id, at, low of what leads to a cycle), by pointers of doubled length.

    ``at`` is the ancestor after at least as many steps as there are such rows, so it
    is on the cycle, and every row of a cycle is some row's; ``low`` is the least
    ancestor on that way.
    """
    state = step.select("entity_id", F.col("ancestor_id").alias("at"), F.col("ancestor_id").alias("low"), F.lit(1).cast("long").alias("height"), F.lit(None).cast(step.schema["ancestor_id"].dataType).alias("root"))
    open_, n = None, 1
    while True:
        onward = state.select(F.col("entity_id").alias("at"), F.col("at").alias("at2"), F.col("low").alias("low2"), F.col("height").alias("more"), F.col("root").alias("root2"))
        ended = F.col("at").isNotNull() & F.col("more").isNull()  # the pointer's end has no parent
        root = F.when(ended, F.col("at")).otherwise(F.coalesce("root", "root2"))
        # what has come to its root keeps no pointer, and is met by no row
        state = runtime.settled(state.join(onward, "at", "left").select("entity_id", F.col("at2").alias("at"), F.least("low", "low2").alias("low"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"), root.alias("root")))
        n *= 2
        last, open_ = open_, state.where("root IS NULL").count()
        if open_ == 0 or open_ == last and n >= open_:
            done = state.where("root IS NOT NULL").select("entity_id", "root", "height")
            return done, state.where("root IS NULL").select("entity_id", "at", "low")


def _of_single_parents(step: DataFrame) -> DataFrame:
    """Where an entity has one parent, its ancestors are the first ones of its way, as many as its height tells.

    Each pair is the meeting of a stop on the way, every NEAR steps, with one of the
    stop's own NEAR next ancestors. Stops and near ancestors are stored; the pairs are
    made once, and not moved.
    """
    done, turning = _ends(step)
    cycle = turning.join(turning.select(F.col("at").alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "low")
    lengths = cycle.join(cycle.groupBy("low").agg((F.count("*") - 1).alias("height")), "low").select("entity_id", "height")
    height = done.select("entity_id", "height")
    if not turning.isEmpty():
        lengths = runtime.settled(lengths)
        tail = step.join(turning, "entity_id", "left_semi").join(lengths, "entity_id", "left_anti")
        led, _ = _ends(tail)
        beyond = led.join(lengths.select(F.col("entity_id").alias("root"), F.col("height").alias("more")), "root")
        height = height.unionByName(lengths).unionByName(beyond.select("entity_id", (F.col("height") + F.col("more")).alias("height")))
    height = runtime.settled(height)

    def doubled(found: DataFrame, n: int, most: int | None, within) -> tuple[DataFrame, int]:
        """found (entity_id, ancestor_id, depth up to n, height) continued to twice the depth while there is more, at most to ``most``."""
        unit = n
        while most is None or n < most:
            far = found.where(F.col("depth") == n).select("entity_id", F.col("ancestor_id").alias("via"), "height")
            if far.isEmpty():
                break
            onward = found.select(F.col("entity_id").alias("via"), "ancestor_id", (F.col("depth") + n).alias("depth"))
            found = runtime.settled(found.unionByName(far.join(onward, "via").where(within).select("entity_id", "ancestor_id", "depth", "height")))
            n *= 2
        return found, n if most is not None else unit

    first = step.withColumn("depth", F.lit(1)).join(height, "entity_id").where("height >= 1")
    near, reach = doubled(runtime.settled(first.select("entity_id", "ancestor_id", "depth", "height")), 1, NEAR, F.col("depth") <= F.col("height"))
    stops = runtime.settled(near.where((F.col("depth") == reach) & (F.col("height") > reach)))
    stops, _ = doubled(stops, reach, None, F.col("depth") < F.col("height"))
    stops = near.where("depth = 1").select("entity_id", F.col("entity_id").alias("via"), F.lit(0).alias("off"), "height").unionByName(stops.select("entity_id", F.col("ancestor_id").alias("via"), F.col("depth").alias("off"), "height"))
    pairs = stops.join(near.select(F.col("entity_id").alias("via"), "ancestor_id", "depth"), "via").where("off + depth <= height")
    return pairs.select("entity_id", "ancestor_id", (F.col("off") + F.col("depth")).cast("int").alias("depth"))


def interleave(callers: DataFrame, callees: DataFrame, limit: int) -> DataFrame:
    """entity_id, role, k: first caller, first callee, second caller, ... of two bounded lists."""

    def turns(rows: DataFrame, role: str) -> DataFrame:  # at most some dozens of rows
        order = Window.orderBy(trust_rank(F.col("trust")), "entity_id")
        return rows.select("entity_id", F.lit(role).alias("role"), F.row_number().over(order).alias("idx"))

    both = turns(callers, "caller").unionByName(turns(callees, "callee"))
    k = F.row_number().over(Window.orderBy("idx", F.desc("role")))
    return both.select("entity_id", "role", k.cast("long").alias("k"), "idx").orderBy("k").limit(limit).select("entity_id", "role", "k")


def top_per(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group; of one row a group, aggregation on the key would do without a sort."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
