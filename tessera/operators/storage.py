"""Snapshots and tables: path policy, upserts, activation, diffs and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity, spans

MAX_FILE_BYTES = 16 << 20
BINARY_PROBE = 8192
# Directories that are never read, and endings of files that are no source.
EXCLUDED_DIRS = [
    ".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox",
    ".eggs", "target", "vendor", ".idea", ".vscode", "coverage", ".turbo", ".next", ".tessera",
]
EXCLUDED_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin",
    ".pyc", ".pkl", ".parquet", ".arrow", ".onnx", ".pt", ".safetensors", ".db", ".db-wal", ".db-shm", ".lbug", ".sqlite", ".sqlite3", ".jsonl",
]
LANGUAGES = {"python": [".py"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"]}


def path_allowed(path: Column, excluded_dirs: list[str] = EXCLUDED_DIRS, excluded_suffixes: list[str] = EXCLUDED_SUFFIXES) -> Column:
    """No step of the path is excluded or a database, and it has no excluded ending; a path out of the tree is not allowed."""
    normal = identity.normal_path(path)
    steps = F.split(normal, "/")
    excluded = F.arrays_overlap(steps, F.array(*[F.lit(x) for x in excluded_dirs])) | F.exists(steps, lambda x: x.endswith(".db"))
    ending = reduce(lambda a, b: a | b, [F.lower(normal).endswith(s) for s in excluded_suffixes])
    return F.coalesce(~(excluded | ending), F.lit(False))


def is_binary(raw: Column) -> Column:
    """A NUL or over a tenth control characters among the first bytes, or no UTF-8; empty is not."""
    probe = F.decode(F.substring(raw, 1, BINARY_PROBE), "ISO-8859-1")  # a character a byte
    controls = F.length(F.regexp_replace(probe, r"[^\x01-\x08\x0B\x0E-\x1F\x7F]", ""))
    odd = F.contains(probe, F.lit("\x00")) | (controls * 10 > F.length(probe)) | F.try_validate_utf8(raw.cast("string")).isNull()
    return (F.octet_length(raw) > 0) & odd


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ("/test", "test_", "_test", "tests/")])


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^(?U)[\p{Alnum}_.:]+$")


def module_name(path: Column, suffixes: list[str] | None = None) -> Column:
    """The path without its code suffix, steps joined by dots."""
    endings = suffixes or [s for x in LANGUAGES.values() for s in x]
    bare = path
    for s in endings:
        bare = F.when(path.endswith(s), F.substring(path, F.lit(1), F.length(path) - len(s))).otherwise(bare)
    return F.replace(bare, F.lit("/"), F.lit("."))


def language_of(path: Column) -> Column:
    out = F.lit("text")
    for name, endings in LANGUAGES.items():
        out = F.when(reduce(lambda a, b: a | b, [F.lower(path).endswith(s) for s in endings]), name).otherwise(out)
    return out


def bound_read(registered: DataFrame, now: DataFrame) -> DataFrame:
    """Files read again, with OK, MISMATCH or MISSING against the registered digest."""
    fresh = now.withColumn("_hash", identity.sha256(F.col("content")))
    state = F.when(F.col("_hash").isNull(), "MISSING").when(F.col("_hash") == F.col("content_hash"), "OK").otherwise("MISMATCH")
    return registered.join(fresh, "rel_path", "left").withColumn("state", state)


def lookup(rows: DataFrame, keys: DataFrame, generations: DataFrame) -> DataFrame:
    """The rows that keys name, by the keys' columns.

    Where these hold a generation_id, a row of that generation is meant; otherwise
    one of any active generation (generations: generation_id, is_active).
    """
    found = rows.join(keys.distinct(), keys.columns, "left_semi")
    if "generation_id" in keys.columns:
        return found
    return found.join(generations.where("is_active").select("generation_id"), "generation_id", "left_semi")


def with_paths(entities: DataFrame, generations: DataFrame, files: DataFrame) -> DataFrame:
    """entities of known generations, with the path of their file.

    An entity's generation must be one of its own repository. Its rel_path, if it
    has one, goes before that of its file in the same generation; ``~``, which
    sorts last, stands for neither.
    """
    known = entities.join(generations.select("generation_id", "repo_id").distinct(), ["generation_id", "repo_id"], "left_semi")
    of = files.select("generation_id", "file_id", F.col("rel_path").alias("_path"))
    path = F.coalesce(F.nullif(F.col("rel_path"), F.lit("")), F.col("_path"), F.lit("~"))
    return known.join(of, ["generation_id", "file_id"], "left").withColumn("rel_path", path).drop("_path")


def last_wins(rows: DataFrame, key: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Of each key the last row by ``order``: an aggregation, so map-side combined."""
    return rows.groupBy(*key).agg(*[F.max_by(v, F.struct(*order)).alias(k) for k, v in values.items()])


def replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def merge_metadata(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Maps merged in order; later keys win."""
    entry = rows.select(key, *order, F.explode(column).alias("k", "v"))
    last = entry.groupBy(key, "k").agg(F.max_by("v", F.struct(*order)).alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(column))


def activate(generations: DataFrame, target: DataFrame) -> DataFrame:
    """One active generation a repository: its target sequence (repo_id, target), if that is committed; none where there is none.

    Where the target is not committed, what was active before stays so.
    """
    aimed = F.coalesce(F.col("sequence") == F.col("target"), F.lit(False))
    may = F.coalesce(F.bool_or(aimed & (F.col("lifecycle") == "COMMITTED")).over(Window.partitionBy("repo_id")), F.lit(False))
    before = F.coalesce(F.col("is_active"), F.lit(False)) if "is_active" in generations.columns else F.lit(False)
    now = F.when(may, aimed).when(F.col("target").isNotNull(), before).otherwise(False)
    return generations.join(target, "repo_id", "left").withColumn("is_active", now).drop("target")


def delete_generations(rows: DataFrame, retired: DataFrame) -> DataFrame:
    """The rows of other generations than those retired (generation_id)."""
    return rows.join(retired.select("generation_id").distinct(), "generation_id", "left_anti")


def orphans(names: DataFrame, generations: DataFrame) -> DataFrame:
    """Stored collections (name) that belong to no generation (generation_id)."""
    return names.join(generations.select(F.col("generation_id").alias("name")), "name", "left_anti")


def ignore_fingerprint(files: DataFrame) -> DataFrame:
    """repo_id, fingerprint: the digest of each repository's ignore rules, from files (repo_id, rel_path, content_hash)."""
    rules = files.where(F.substring_index("rel_path", "/", -1).isin(".gitignore", ".ignore"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "rel_path", "content_hash")))
    return rules.groupBy("repo_id").agg(identity.sha256(F.array_join(listed, "\n")).alias("fingerprint"))


def batch_scope(rows: DataFrame, by: list[str], owners: dict[str, str]) -> DataFrame:
    """by, and for each name in ``owners`` whether all rows of the batch have the same value of its column."""
    return rows.groupBy(*by).agg(*[(F.count_distinct(c) == 1).alias(name) for name, c in owners.items()])


def unequal_names(have: list[str], want: list[str]) -> list[str]:
    """Names of tables that are missing (-) or too many (+), in order."""
    return sorted(f"-{x}" for x in set(want) - set(have)) + sorted(f"+{x}" for x in set(have) - set(want))


def retention(generations: DataFrame, keep: int) -> DataFrame:
    """KEEP the active and the newest ``keep`` committed generations of each repository, DROP the rest."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "lifecycle").orderBy(F.desc("sequence")))
    kept = F.col("is_active") | ((F.col("lifecycle") == "COMMITTED") & (F.col("_n") <= keep))
    return generations.withColumn("_n", rank).withColumn("action", F.when(kept, "KEEP").otherwise("DROP")).drop("_n")


def without_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row of each id; the query fails where an id has two values."""
    said = F.when(F.min(value) != F.max(value), F.raise_error(F.concat(F.lit("CONFLICT: "), F.col(key).cast("string"))).cast("string")).otherwise(F.min(value))
    return rows.groupBy(key).agg(said.alias(value))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Versions of each id; more than one is a conflict."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("versions")).withColumn("conflict", F.col("versions") > 1)


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """rel_path, change (ADDED, DELETED, MODIFIED) between two snapshots (rel_path, content_hash)."""
    both = now.withColumnRenamed("content_hash", "h").join(before.withColumnRenamed("content_hash", "g"), "rel_path", "full_outer")
    return both.where(~F.col("h").eqNullSafe(F.col("g"))).select("rel_path", F.when(F.col("g").isNull(), "ADDED").when(F.col("h").isNull(), "DELETED").otherwise("MODIFIED").alias("change"))


def symmetric_difference(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    key = a.columns
    return a.join(b, key, "left_anti").withColumn("side", F.lit(left)).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit(right)))


def inadmissible(rows: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows that break a rule; a rule without an answer is broken."""
    return rows.where(~reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules]))


def chunk_is_literal() -> Column:
    """A chunk's hash, end point and id are those of its text."""
    content, s = F.col("content"), F.col("span")
    end = spans.of(content, s["start_line"], s["start_col"])
    return (identity.sha256(content) == F.col("content_hash")) & (end == s) & (identity.chunk_id(F.col("file_id"), F.col("generation_id"), s, F.col("content_hash")) == F.col("chunk_id"))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def chunk_references(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, state: whether its file exists under its path; files has file_id, file_path."""
    state = F.when(F.col("file_path").isNull(), "NO_FILE").when(F.col("file_path") != F.col("rel_path"), "WRONG_PATH").otherwise("OK")
    return chunks.join(files, "file_id", "left").select("chunk_id", state.alias("state"))


def chunk_entity_references(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """chunk_id, state of chunks (chunk_id, file_id, entity_ids): whether each entity is named once, exists and is of the same file."""
    named = chunks.select("chunk_id", "file_id", F.explode_outer("entity_ids").alias("entity_id"))
    known = entities.select("entity_id", F.col("file_id").alias("_file"))
    each = named.join(known, "entity_id", "left").groupBy("chunk_id", "entity_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("entity_id").isNull(), 0).when(F.col("_file").isNull(), 3).when(F.col("_file") != F.col("file_id"), 2).otherwise(0)).alias("fault"))
    worst = F.max(F.greatest("fault", F.when(F.col("n") > 1, 1).otherwise(0)))
    return each.groupBy("chunk_id").agg(worst.alias("w")).select("chunk_id", F.get(F.array(*[F.lit(x) for x in ("OK", "REPEATED", "OTHER_FILE", "NO_ENTITY")]), F.col("w")).alias("state"))


def coherence(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """chunk_id, damage of what differs between chunks (chunk_id, content_hash) and index rows (chunk_id, indexed)."""
    posted = index.groupBy("chunk_id").agg(F.min("indexed").alias("indexed"), F.count("*").alias("posts"))
    both = chunks.join(posted, "chunk_id", "full_outer")
    damage = F.when(F.col("posts").isNull(), "MISSING").when(F.col("content_hash").isNull(), "ORPHAN").when(F.col("posts") > 1, "DUPLICATE").when(~F.col("indexed").eqNullSafe(F.col("content_hash")), "STALE")
    return both.select("chunk_id", damage.alias("damage")).where("damage IS NOT NULL")
