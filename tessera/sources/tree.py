"""A source tree as a table: a Python data source that lists and reads files.

Names that begin with ``_`` or ``.`` are listed like others (the built-in file
source leaves them out). Listing happens once, when the scan is planned; files
are dealt over tasks and read there. On a cluster the tree must lie on storage
that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tessera.operators.storage import EXCLUDED_DIRS, EXCLUDED_SUFFIXES, MAX_FILE_BYTES

MAX_FILES, MAX_DIRS = 100_000, 100_000
FILES_A_TASK = 256
#: Endings of files that must be text.
CODE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx")


def allowed(path: str) -> bool:
    """No step is excluded or a database; no excluded ending."""
    return not any(x in EXCLUDED_DIRS or x.endswith(".db") for x in path.split("/")) and not path.lower().endswith(tuple(EXCLUDED_SUFFIXES))


def candidates(root: str) -> list[str]:
    """Relative paths of regular files, sorted; excluded and linked directories, and nested repositories, are pruned."""
    out: list[str] = []
    stack = [""]
    seen = 0
    while stack:
        here = stack.pop()
        seen += 1
        if seen > MAX_DIRS:
            raise ValueError(f"more than {MAX_DIRS} directories under {root}")
        for e in sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name):
            path = f"{here}/{e.name}" if here else e.name
            if e.is_dir(follow_symlinks=False):
                if allowed(e.name) and not os.path.exists(os.path.join(root, path, ".git")):
                    stack.append(path)
            elif e.is_file(follow_symlinks=False) and allowed(path):
                out.append(path)
                if len(out) > MAX_FILES:
                    raise ValueError(f"more than {MAX_FILES} files under {root}")
    return sorted(out)


def git_candidates(root: str, seconds: int = 30) -> list[str] | None:
    """What git lists (tracked, or new and not ignored) of the tree, sorted, with the same exclusions; None where git can't tell."""
    try:
        got = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    out = set()
    for raw in got.stdout.split(b"\x00"):
        try:
            path = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        full = os.path.join(root, path)
        if path and allowed(path) and os.path.isfile(full) and not os.path.islink(full):
            out.add(path)
    if len(out) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files under {root}")
    return sorted(out)


def git_head(root: str) -> str | None:
    """The commit that is checked out; None outside a repository."""
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, timeout=30, check=True, text=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def ignore_fingerprint(root: str) -> str:
    """A digest of the tree's ignore rules: of each ignore file its path and content."""
    rules = []
    for here, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS)
        for n in sorted({".gitignore", ".ignore"} & set(names)):
            with open(os.path.join(here, n), "rb") as f:
                rules.append(f"{os.path.relpath(os.path.join(here, n), root)}:{hashlib.sha256(f.read()).hexdigest()}")
    return hashlib.sha256("\n".join(rules).encode()).hexdigest()


def looks_binary(raw: bytes) -> bool:
    probe = raw[:8192]
    if b"\x00" in probe:
        return True
    if sum(b < 32 and b not in (9, 10, 12, 13) or b == 127 for b in probe) * 10 > len(probe):
        return True
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return True
    return False


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


#: Files that may be named in a filter; more are met by a join.
MAX_NAMED = 10_000


class _Reader(DataSourceReader):
    """Lists and reads; a filter that names files leaves only these to be listed and opened."""

    def __init__(self, root: str):
        self.root = root
        self.named: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
            if values is not None and f.attribute == ("rel_path",):
                self.named = set(values) if self.named is None else self.named & set(values)
            else:
                yield f

    def _named(self) -> list[str]:
        """Of the files named those that a listing would give."""
        top = os.path.realpath(self.root)
        out = []
        for path in sorted(self.named):
            full = os.path.join(top, path)
            inside = path and not path.startswith("/") and os.path.realpath(full) == full and full.startswith(top + os.sep)
            if inside and allowed(path) and os.path.isfile(full):
                out.append(path)
        return out

    def partitions(self):
        if self.named is not None:
            paths = self._named()
            return [_Part(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)] or [_Part([])]
        paths = git_candidates(self.root) if os.path.isdir(os.path.join(self.root, ".git")) else None
        paths = candidates(self.root) if paths is None else paths
        return [_Part(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)] or [_Part([])]

    def read(self, partition):
        for path in partition.paths:
            full = os.path.join(self.root, path)
            if os.path.getsize(full) > MAX_FILE_BYTES:
                raise ValueError(f"{path} exceeds {MAX_FILE_BYTES} bytes")
            with open(full, "rb") as f:
                raw = f.read(MAX_FILE_BYTES + 1)
            if looks_binary(raw):
                if path.lower().endswith(CODE_SUFFIXES):
                    raise ValueError(f"{path} has the name of a source file and is binary")
            else:
                yield path, raw.decode("utf-8"), hashlib.sha256(raw).hexdigest(), len(raw)


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(path): rel_path, content, content_hash, size_bytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "rel_path string, content string, content_hash string, size_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark, path: str):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(path)
