"""Content-derived identifiers, as column expressions.

Each id is a prefix and the first 16 hex digits of the SHA-256 of a
colon-separated preimage, so that the same content gets the same id anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags inside hashed documents; fixed, since ids depend on them.
GENERATION_TAG = "tessera-generation-v1"
SNAPSHOT_TAG = "tessera-snapshot-v1"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def short_id(prefix: str, *parts: Column) -> Column:
    """The query fails where a part is null: what is missing must not give the id of something else."""
    known = [F.coalesce(p.cast("string"), F.raise_error(F.lit(f"{prefix} id of a null part")).cast("string")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(sha256(F.concat_ws(":", *known)), 1, 16))


def repo_id(path: Column) -> Column:
    return short_id("repo_", path)


def file_id(repo: Column, path: Column) -> Column:
    return short_id("file_", repo, normal_path(path))


def entity_id(file: Column, qualified_name: Column, kind: Column) -> Column:
    return short_id("ent_", file, qualified_name, kind)


def span_text(span: Column) -> Column:
    """start_line:start_col-end_line:end_col"""
    return F.concat(span["start_line"].cast("string"), F.lit(":"), span["start_col"].cast("string"), F.lit("-"), span["end_line"].cast("string"), F.lit(":"), span["end_col"].cast("string"))


def relation_id(source: Column, rel_type: Column, target: Column, file: Column, span: Column) -> Column:
    return short_id("rel_", source, rel_type, target, file, span_text(span))


def chunk_id(file: Column, generation: Column, span: Column, content_hash: Column) -> Column:
    return short_id("chk_", file, generation, span_text(span), content_hash)


def evidence_id(generation: Column, file: Column, span: Column, content_hash: Column) -> Column:
    return short_id("evi_", generation, file, span_text(span), content_hash)


def generation_id(repo: Column, sequence: Column, snapshot: Column) -> Column:
    """gen_<sequence, six digits>_<SHA-256 of a JSON array>"""
    preimage = F.concat(F.lit(f'["{GENERATION_TAG}","'), repo, F.lit('",'), sequence.cast("string"), F.lit(',"'), snapshot, F.lit('"]'))
    return F.concat(F.lit("gen_"), F.lpad(sequence.cast("string"), 6, "0"), F.lit("_"), sha256(preimage))


def snapshot_hash(files: Column) -> Column:
    """Of an array of (path, hash) arrays: SHA-256 of the compact JSON of the sorted pairs."""
    return sha256(F.concat(F.lit('{"files":'), F.to_json(F.array_sort(files)), F.lit(f',"schema":"{SNAPSHOT_TAG}"}}')))


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or dot steps; null where it would leave the tree (absolute, drive, '..', NUL)."""
    slashed = F.translate(path, "\\", "/")
    steps = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    bad = slashed.startswith("/") | slashed.rlike(r"^[A-Za-z]:") | F.array_contains(steps, "..") | F.contains(slashed, F.lit("\x00")) | (F.size(steps) == 0)
    return F.when(~bad, F.array_join(steps, "/"))
