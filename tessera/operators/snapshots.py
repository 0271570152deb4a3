"""Digests of snapshots without one giant row: sorted files stream through one running digest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import identity


def hashes(files: DataFrame, by: str) -> DataFrame:
    """by, snapshot: the digest of each group's sorted (rel_path, content_hash), equal to ``identity.snapshot_hash``.

    Rows of a group lie together and in order, so a task holds one digest and no
    list: memory doesn't grow with the files. A SHA-256 is a fold and can't be
    split, so one group is one task's stream.
    """
    kind = files.select(by).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, first = None, None, True
        end = ('],"schema":' + json.dumps(identity.SNAPSHOT_TAG) + "}").encode()

        def told() -> pa.RecordBatch:
            digest.update(end)
            return pa.record_batch([own, pa.array([digest.hexdigest()])], names=[by, "snapshot"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0).slice(i, 1)
                if own is None or not own.equals(key):
                    if own is not None:
                        yield told()
                    own, digest, first = key, hashlib.sha256(b'{"files":['), True
                pair = [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()]
                digest.update((b"" if first else b",") + json.dumps(pair, ensure_ascii=False, separators=(",", ":")).encode())
                first = False
        if own is not None:
            yield told()

    rows = files.select(by, "rel_path", "content_hash").repartition(by).sortWithinPartitions(by, "rel_path", "content_hash")
    return rows.mapInArrow(run, f"{by} {kind}, snapshot string")
