"""JSON documents: canonical and strict forms, bounded metadata, files that are written once."""

from __future__ import annotations

import json
import os
import stat

# Bounds of stored metadata and of artifacts.
MAX_METADATA_BYTES, MAX_DEPTH = 64 << 10, 64
MAX_ARTIFACT_BYTES = 16 << 20


def canonical(value) -> bytes:
    """Sorted keys, no spaces, UTF-8, one newline."""
    return (json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False) + "\n").encode()


def strict(raw: bytes):
    """JSON with unique keys and finite numbers only."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def finite(text):
        raise ValueError(f"{text} is no number")

    def number(text):
        value = float(text)
        if value in (float("inf"), float("-inf")):
            raise ValueError(f"{text} is no number")
        return value

    return json.loads(raw.decode("utf-8"), object_pairs_hook=unique, parse_constant=finite, parse_float=number)


def depth(value) -> int:
    """Levels of nesting; without recursion, so that deep documents are told, not failed on."""
    most, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        if isinstance(v, (dict, list)):
            most = max(most, d)
            todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return most


def metadata(raw: bytes | str) -> dict:
    """A generation's metadata: an object within the bounds of size and depth, with unique keys."""
    raw = raw.encode("utf-8") if isinstance(raw, str) else raw
    if len(raw) > MAX_METADATA_BYTES:
        raise ValueError("metadata is too long")
    nested = most = 0
    quoted = escaped = False
    for b in raw:  # brackets outside strings, before the parser recurses into them
        if quoted:
            quoted, escaped = escaped or b != 0x22, not escaped and b == 0x5C
        elif b == 0x22:
            quoted = True
        elif b in b"[{":
            nested += 1
            most = max(most, nested)
        elif b in b"]}":
            nested -= 1
    if most > MAX_DEPTH:
        raise ValueError("metadata is nested too deeply")
    value = strict(raw)
    if not isinstance(value, dict):
        raise ValueError("metadata must be an object")
    return value


def encoded(value: dict) -> str:
    """Metadata as it is stored; what could not be read back is refused."""
    raw = canonical(value).rstrip(b"\n")
    metadata(raw)
    return raw.decode("utf-8")


def failure_codes(codes) -> list[str]:
    """A list of distinct upper-case codes, sorted."""
    if not isinstance(codes, list) or any(not isinstance(c, str) or not c or not c.replace("_", "").isalnum() or c != c.upper() for c in codes) or len(set(codes)) != len(codes):
        raise ValueError("failure codes must be distinct upper-case names")
    return sorted(codes)


def receipt(path: str, value) -> None:
    """A document that must not exist yet, written whole and to disk; links are not followed."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o600)
    with os.fdopen(fd, "wb") as f:
        f.write(canonical(value))
        f.flush()
        os.fsync(f.fileno())


def artifact(path: str, most: int = MAX_ARTIFACT_BYTES) -> bytes:
    """A regular file of at most ``most`` bytes; links are not followed."""
    fd = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0))
    with os.fdopen(fd, "rb") as f:
        if not stat.S_ISREG(os.fstat(fd).st_mode):
            raise ValueError("no regular file")
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError("the file is too long")
    return raw


def append(path: str, raw: bytes, most: int = MAX_ARTIFACT_BYTES) -> None:
    """Bytes added to a regular file that stays within ``most`` bytes; links are not followed."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND | getattr(os, "O_NOFOLLOW", 0), 0o600)
    with os.fdopen(fd, "ab") as f:
        at = os.fstat(fd)
        if not stat.S_ISREG(at.st_mode):
            raise ValueError("no regular file")
        if at.st_size + len(raw) > most:
            raise ValueError("the file would be too long")
        f.write(raw)
        f.flush()
        os.fsync(f.fileno())
