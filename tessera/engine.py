"""index, query and verify over stored generations of a source tree.

A generation is a set of Parquet tables under ``generation_id=...``; it becomes
active by one entry in a log of states (``operators.sinks.Log``), after its
validations passed. Queries fuse BM25, exact symbols and one hop of the call graph by
reciprocal rank and pack the winners into a byte budget; a packet carries the
literal text, spans and hashes, so that it can be verified against the sources
later on.
"""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import runtime
from tessera.functions import documents, identity, spans
from tessera.operators import admission, graph, intervals, ownership, packets, ranking, resolve, search, segment, sinks, storage
from tessera.sources import syntax, tree

KEEP_GENERATIONS = 3
MOST_QUERY = 1024
TABLES = ("files", "entities", "chunks", "calls", "relations", "postings", "lengths")
#: What holds in each generation.
CONSTRAINTS = [
    admission.Unique("files", ("file_id",)),
    admission.Unique("entities", ("entity_id",)),
    admission.Unique("chunks", ("chunk_id",)),
    admission.Reference("chunks", ("file_id",), "files", ("file_id",)),
    admission.Reference("entities", ("file_id",), "files", ("file_id",)),
    admission.Reference("entities", ("parent_id",), "entities", ("entity_id",)),
    admission.Reference("relations", ("source_id",), "entities", ("entity_id",)),
    admission.Reference("relations", ("target_id",), "entities", ("entity_id",)),
]


canonical, strict_json = documents.canonical, documents.strict


class Engine:
    def __init__(self, spark: SparkSession, repo: str, store: str):
        self.spark, self.repo, self.store = spark, os.path.realpath(repo), store
        self.repo_id = "repo_" + hashlib.sha256(self.repo.encode()).hexdigest()[:16]
        self.log = sinks.Log(spark, f"{store}/_log")
        runtime.ship(spark)

    # ---- generations

    def _pointer(self) -> dict:
        return self.log.state()[1] or {"active": None, "history": []}

    def table(self, name: str, generation: str | None = None) -> DataFrame:
        generation = generation or self._pointer()["active"]
        if not generation:
            raise LookupError("INDEX_REQUIRED")
        return self.spark.read.parquet(f"{self.store}/{name}/generation_id={generation}")

    def snapshot(self, files: DataFrame) -> str:
        return files.agg(identity.snapshot_hash(F.collect_list(F.array("rel_path", "content_hash"))).alias("h")).first()["h"]

    def index(self) -> dict:
        """Scan, parse, resolve, store, validate, activate; an unchanged tree is reused."""
        files = tree.read(self.spark, self.repo).persist()
        try:
            snap, (after, state) = self.snapshot(files), self.log.state()
            state = state or {"active": None, "history": []}
            if state["active"] and state["history"][-1]["snapshot"] == snap:
                return {"status": "REUSED", "generation_id": state["active"], "snapshot_sha256": snap}
            sequence = 1 + max([h["sequence"] for h in state["history"]], default=0)
            preimage = json.dumps([identity.GENERATION_TAG, self.repo_id, sequence, snap], separators=(",", ":"))
            generation = f"gen_{sequence:06d}_" + hashlib.sha256(preimage.encode()).hexdigest()
            self._write(files, generation)
            self._validate(generation)
            made = {"head": tree.git_head(self.repo), "ignore": tree.ignore_fingerprint(self.repo)}
            if self.snapshot(tree.read(self.spark, self.repo)) != snap:
                raise ValueError("SOURCE_CHANGED: the tree changed while it was indexed")
            history = state["history"] + [{"generation_id": generation, "sequence": sequence, "snapshot": snap, "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "metadata": documents.encoded(made)}]
            if not self.log.commit(after, {"active": generation, "history": history[-KEEP_GENERATIONS:]}):
                raise RuntimeError("CONFLICT: another writer made a generation active meanwhile")
            self.log.forget(KEEP_GENERATIONS)
            self.delete_retired()
            return {"status": "INDEXED", "generation_id": generation, "snapshot_sha256": snap, "files": files.count()}
        finally:
            files.unpersist()

    def delete_retired(self) -> list[str]:
        """Drop the stored tables of generations that the pointer no longer names, half-written ones too; their ids."""
        keep = {h["generation_id"] for h in self._pointer()["history"]}
        gone = set()
        for name in TABLES:
            for entry in self.log.children(f"{self.store}/{name}"):
                generation = entry.removeprefix("generation_id=")
                if entry.startswith("generation_id=") and generation not in keep:
                    self.log.delete(f"{self.store}/{name}/{entry}")
                    gone.add(generation)
        return sorted(gone)

    def _write(self, files: DataFrame, generation: str) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.store}/{name}/generation_id={generation}")
        file_id = identity.short_id("file_", F.lit(self.repo_id), F.col("rel_path"))
        put(files.select(file_id.alias("file_id"), "rel_path", "content_hash", "size_bytes"), "files")
        e = syntax.entities(files).withColumn("file_id", file_id)
        e = e.withColumn("span", spans.span(F.col("start_line"), F.col("start_col"), F.col("end_line"), F.col("end_col")))
        e = e.withColumn("entity_id", identity.entity_id(F.col("file_id"), F.col("identity"), F.col("kind")))
        parent = e.where("kind <> 'MODULE'").select("rel_path", F.col("identity").alias("parent"), F.col("entity_id").alias("parent_id"))
        put(e.join(parent, ["rel_path", "parent"], "left").select("entity_id", "file_id", "rel_path", "name", "qualified_name", "identity", "accessor", "kind", "parent_id", "span", "docstring"), "entities")
        entities = self.table("entities", generation)
        put(self._owned(segment.bound(self._pieces(files.withColumn("file_id", file_id), entities, generation)).drop("generation_id", "ordinal"), entities), "chunks")
        chunks = self.table("chunks", generation).withColumn("generation_id", F.lit(generation))
        put(search.postings(chunks).drop("generation_id").sort("trigram"), "postings")
        put(search.corpus_stats(chunks, [], ["generation_id"]).drop("generation_id"), "lengths")
        modules = entities.where("kind = 'MODULE'").select("file_id", F.col("entity_id").alias("module_id"))
        stored = entities.join(modules, "file_id", "left").withColumn("module_id", F.when(F.col("kind") != "MODULE", F.col("module_id")))
        calls = syntax.calls(files).join(stored.where("kind <> 'MODULE'").select("rel_path", F.col("identity").alias("caller"), F.col("entity_id").alias("source_id"), F.col("file_id"), F.col("kind").alias("source_kind"), F.col("parent_id").alias("source_parent")), ["rel_path", "caller"])
        # written with their numbers, which every rule below reads
        put(calls.withColumn("site", F.monotonically_increasing_id()), "calls")
        calls = self.table("calls", generation)
        scope = graph.ancestors(stored.select("entity_id", F.coalesce("parent_id", "module_id").alias("parent_id"))).select("entity_id", F.col("ancestor_id").alias("parent_id"))
        targets = stored.select("entity_id", "name", "qualified_name", "kind", F.coalesce("parent_id", "module_id").alias("parent_id"), "file_id")
        edges = resolve.resolve(calls, targets, scope, ["source_id", "site"]).where("source_id <> target_id")
        edges = edges.select("source_id", "target_id", F.lit("CALLS").alias("rel_type"), "trust_class", "reason").distinct()
        defines = stored.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("source_id"), F.col("entity_id").alias("target_id"))
        top = stored.where("parent_id IS NULL AND module_id IS NOT NULL").select(F.col("module_id").alias("source_id"), F.col("entity_id").alias("target_id"))
        put(edges.unionByName(defines.unionByName(top).select("source_id", "target_id", F.lit("DEFINES").alias("rel_type"), F.lit("EXACT").alias("trust_class"), F.lit("syntax").alias("reason"))), "relations")

    @staticmethod
    def _pieces(files: DataFrame, entities: DataFrame, generation: str) -> DataFrame:
        """Each file as what its definitions own; a file whose definitions can't be dealt out is one piece."""
        starts = F.transform(segment.prefix_sums(F.transform(F.split("content", "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)), lambda x: x)
        texts = runtime.settled(files.select("file_id", "rel_path", "content", starts.alias("starts")).where("content <> ''"))
        e = entities.join(texts.select("file_id", "starts", F.octet_length("content").cast("long").alias("n")), "file_id")
        at = lambda line, col: segment.offset_of(F.col("starts"), F.col(f"span.{line}"), F.col(f"span.{col}")).cast("long")
        module = F.col("kind") == "MODULE"
        own = F.first_value(F.when(module, F.col("entity_id")), ignoreNulls=True).over(Window.partitionBy("file_id").orderBy(F.desc(module.cast("int"))))
        # decorators and comments before a definition can put siblings on one place: what stands there is told as a fault
        d = e.select("file_id", "entity_id", "kind", F.when(~module, F.coalesce("parent_id", own)).alias("parent_id"), F.when(module, 0).otherwise(at("start_line", "start_col")).alias("start"), F.when(module, F.col("n")).otherwise(F.least(at("end_line", "end_col"), F.col("n"))).alias("end"))
        d = runtime.settled(d)
        bad = ownership.faults(d).select("file_id").unionByName(d.where("start IS NULL OR end IS NULL").select("file_id")).distinct()
        sound = d.join(bad, "file_id", "left_anti")
        pieces = ownership.owned(texts.select("file_id", "content"), sound).select("file_id", "start", "content")
        undealt = texts.join(sound.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(0).cast("long").alias("start"), "content")
        placed = pieces.unionByName(undealt).join(texts.select("file_id", "rel_path", "starts"), "file_id").withColumn("p", segment.point_of(F.col("starts"), F.col("start")))
        out = placed.select("file_id", "rel_path", F.lit(generation).alias("generation_id"), "content", spans.of(F.col("content"), F.col("p.line"), F.col("p.col")).alias("span"))
        return out.withColumn("content_hash", identity.sha256(F.col("content"))).withColumn("chunk_id", F.lit(""))

    @staticmethod
    def _owned(chunks: DataFrame, entities: DataFrame) -> DataFrame:
        """chunks with entity_ids: the definitions that overlap each, those that begin in it first, then the shorter."""
        e = entities.where("kind <> 'MODULE'").select("file_id", "entity_id", F.col("span").alias("_own"))
        both = intervals.overlap_join(chunks.select("chunk_id", "file_id", "span"), e, ["file_id"], intervals.ends(F.col("span")), intervals.ends(F.col("_own")))
        order = F.struct(F.when(spans.contains_start(F.col("span"), F.col("_own")), 0).otherwise(1).alias("o"), (F.col("_own.end_line") - F.col("_own.start_line")).alias("n"), spans.start(F.col("_own")).alias("s"), "entity_id")
        ids = both.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["entity_id"]).alias("entity_ids"))
        return chunks.join(ids, "chunk_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))

    def _validate(self, generation: str) -> None:
        tables = {t: self.table(t, generation) for t in ("chunks", "files", "entities", "relations")}
        broken = admission.violations(tables, CONSTRAINTS).collect()  # a row a constraint
        if broken:
            raise ValueError("INDEX_INCOHERENT: " + "; ".join(f"{r['constraint']}: {r['broken']}, such as {r['example']}" for r in broken))
        chunks = tables["chunks"]
        if not storage.symmetric_difference(self.table("postings", generation).select("chunk_id").distinct(), chunks.where(F.length("content") > 2).select("chunk_id"), "index", "chunks").isEmpty():
            raise ValueError("INDEX_INCOHERENT: postings are not those of the chunks")
        bad = chunks.withColumn("generation_id", F.lit(generation)).where(~storage.chunk_is_literal())
        if not bad.isEmpty():
            raise ValueError("INDEX_INCOHERENT: chunk is not its text")

    # ---- queries

    def _signals(self, text: str, limit: int) -> DataFrame | None:
        """chunk_id, signal, part of each way that leads to a chunk."""
        generation = self._pointer()["active"]
        here = lambda name: self.table(name).withColumn("generation_id", F.lit(generation))
        chunks, entities, relations = here("chunks"), self.table("entities"), self.table("relations")
        terms = search.query_terms(text)
        order = [F.desc("score"), "rel_path", "span", "chunk_id"]
        if terms:
            hits = search.bm25_indexed(chunks, here("postings"), here("lengths"), search.phrases(terms))
        elif short := search.short_terms(text):
            hits = search.short_literal(chunks, short, ["rel_path", "span", "chunk_id"])
        else:
            return None
        signals = ranking.ranked_signal(hits.orderBy(*order).limit(2 * limit), order, "lexical", 1.0)
        name = text.strip()
        if name and all(c.isalnum() or c in "_.:" for c in name):
            place = [storage.is_test_path(F.col("rel_path")), "rel_path", "span", "qualified_name"]
            exact = resolve.exact_candidates(entities, name, place).join(entities, "entity_id")
            rank = F.row_number().over(Window.orderBy(*place, "entity_id"))  # of at most MAX_EXACT rows
            found = exact.select("entity_id", "file_id", F.col("span").alias("own"), "reason", rank.alias("rank"))
            symbol = ranking.symbol_signal(found, chunks, limit)
            signals = signals.unionByName(symbol)
        signals = runtime.settled(signals)
        best = ranking.fuse(signals).orderBy(F.desc("score"), "chunk_id").limit(graph.TOP_CHUNKS)
        top = best.join(chunks, "chunk_id").select(F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("place"), "entity_ids", F.col("content").alias("text"), F.contains("reason", F.lit("exact_")).alias("explicit"))
        near = graph.expand(top, relations, entities.withColumn("start_line", F.col("span.start_line")), limit)
        literal = graph.preferred(entities.join(near.select("entity_id").distinct(), "entity_id", "left_semi"), chunks)
        return signals.unionByName(near.join(literal, "entity_id").select("chunk_id", F.lit("graph").alias("signal"), "part"))

    def _symbols(self, chunk_ids: DataFrame, text: str) -> DataFrame:
        """chunk_id, symbol_span: of the exact names' definitions that overlap a chunk, the widest."""
        name = text.strip()
        if not name or not all(c.isalnum() or c in "_.:" for c in name):
            return chunk_ids.select("chunk_id", F.lit(None).cast(spans.TYPE).alias("symbol_span"))
        entities = self.table("entities")
        found = resolve.exact_candidates(entities, name).join(entities, "entity_id").select("file_id", F.col("span").alias("own"))
        both = intervals.overlap_join(chunk_ids.select("chunk_id", "file_id", "span"), found, ["file_id"], intervals.ends(F.col("span")), intervals.ends(F.col("own")))
        widest = F.max_by("own", F.struct(F.col("own.end_line") - F.col("own.start_line"), -F.col("own.start_line"), F.col("own.end_col")))
        return both.groupBy("chunk_id").agg(widest.alias("symbol_span"))

    def query(self, text: str, budget: int = 4096, limit: int = 5, literal: bool = False) -> dict:
        """A packet of at most ``budget`` bytes; the index is refreshed first if the sources changed."""
        if type(budget) is not int or not packets.LEAST_BYTES <= budget <= packets.MOST_BYTES or type(limit) is not int or not 1 <= limit <= packets.MOST_FRAGMENTS:
            raise ValueError("INVALID_ARGUMENT")
        if not isinstance(text, str) or not text.strip() or len(text.encode("utf-8", "surrogatepass")) > MOST_QUERY or any(0xD800 <= ord(c) < 0xE000 for c in text):
            raise ValueError("INVALID_ARGUMENT")
        if not self._pointer()["active"]:
            return {"status": "INDEX_REQUIRED"}
        refreshed = self.index()["status"] == "INDEXED"
        chunks, files = self.table("chunks"), self.table("files").select("rel_path", F.col("content_hash").alias("file_sha256"))
        if literal:
            hits = search.literal_hits(chunks, text).withColumns({"score": F.lit(1.0), "reason": F.lit("literal")})
        else:
            signals = self._signals(text, packets.CANDIDATES)
            hits = chunks.join(ranking.fuse(signals), "chunk_id") if signals is not None else chunks.limit(0).withColumns({"score": F.lit(1.0), "reason": F.lit("")})
        top = runtime.settled(hits.join(files, "rel_path").orderBy(F.desc("score"), "rel_path", "span", "content_hash").limit(packets.CANDIDATES))
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "rel_path", "span", "content_hash"))  # of at most CANDIDATES rows
        ranked = top.join(self._symbols(top, "" if literal else text), "chunk_id", "left").withColumn("rank", rank)
        return self._packet(packets.rows_of(ranked, self._now(top.select("rel_path")), budget, limit), budget, limit, refreshed)

    def _now(self, paths: DataFrame) -> DataFrame:
        """rel_path, now: the present texts of the files named (rel_path), of those that are there; no other file is read."""
        names = paths.distinct().limit(tree.MAX_NAMED + 1).collect()
        files = tree.read(self.spark, self.repo).select("rel_path", F.col("content").alias("now"))
        if len(names) <= tree.MAX_NAMED:
            return files.where(F.col("rel_path").isin([r["rel_path"] for r in names]))
        return files.join(paths.distinct(), "rel_path", "left_semi")

    def _packet(self, rows: DataFrame, budget: int, limit: int, refreshed: bool) -> dict:
        told = runtime.settled(rows)
        place = told.where("taken").select(F.explode("places").alias("p")).select("p.path", "p.span", "p.symbol_span")
        whole = {(r["path"], *r["symbol_span"]): r["whole"] for r in packets.covered(place, []).collect()}
        every = told.orderBy("rank").collect()  # at most CANDIDATES

        def placed(p) -> dict:
            symbol = list(p["symbol_span"]) if p["symbol_span"] else None
            return {"path": p["path"], "span": list(p["span"]), "file_sha256": p["file_sha256"], "coverage": {"symbol_span": symbol, "complete": bool(symbol and whole[(p["path"], *symbol)])}}

        selected = [placed(r["places"][0]) | {"source": r["source"], "source_sha256": r["source_sha256"], "reason": r["reason"], "score": r["score"], "aliases": [placed(p) for p in r["places"][1:]]} for r in every if r["taken"]]
        left = sum(not r["taken"] for r in every)
        full = bool(every) and every[0]["full"]
        return {
            "schema": "tessera-packet",
            "version": 2,
            "status": "OK" if selected else "BUDGET_EXHAUSTED" if every else "EMPTY",
            "snapshot_sha256": self._pointer()["history"][-1]["snapshot"],
            "refreshed": refreshed,
            "limits": {"packet_bytes": budget, "fragments": limit, "candidates": packets.CANDIDATES, "unit": "UTF-8 bytes"},
            "selected": selected,
            "omitted": {"duplicate": sum(len(r["aliases"]) for r in selected), "budget": 0 if full else left, "limit": left if full else 0},
        }

    def verify(self, packet: dict) -> str:
        """OK, or what a packet is told against the present sources."""
        try:
            text = canonical(packet).decode("utf-8")
        except (TypeError, ValueError):
            return packets.VERDICTS[0]
        return self.verify_all(self.spark.createDataFrame([(0, text)], "packet_id int, packet string")).first()["verdict"]

    def verify_all(self, table: DataFrame) -> DataFrame:
        """packet_id, verdict of many packets (packet_id, packet: JSON text); each file they name is read once."""
        return packets.verdicts(table, lambda paths: self._now(paths.select(F.col("path").alias("rel_path"))))
