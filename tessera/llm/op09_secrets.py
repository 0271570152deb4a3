"""Secret scanning: rules, and dictionary-primed zstandard novelty.

The base rules (assigned values, access keys, hex strings) are applied to whole
texts. Then candidates - strings of one kind of characters, mixed or long, that
stand in a sensitive context (a word such as ``password`` or ``key`` shortly
before or after) - are priced: the bytes that zstandard needs more for context plus
candidate than for the context alone, with a dictionary of common identifiers
and of the words around the candidate. Text that resembles its surroundings or
any known identifier compresses; a random string doesn't and is reported as
kind ``novel``, unless it overlaps a base span. A string that is mostly words of
the dictionary is a name, however zstandard codes so short a text.

Defined results: a null or empty text has no spans; positions are code points,
ends exclusive; a failing base match is dropped, not retried; equal rows give
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex")

#: A candidate: so many characters of the alphabet of keys or more, with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}+", re.A)
#: The words that make a context sensitive, and how far before or after a candidate they may stand in its line.
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase)?|secret|token|(?:api|access|private)[\x20_-]?key|credential|bearer|authorization|auth)\b", re.I | re.A)
REACH = 48
_HINTS = ("pass", "secret", "token", "key", "credential", "bearer", "auth")  # each context word holds one
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[+/_=-]")
#: Marginal bytes a character from which a candidate is novel, and the least in all.
NOVELTY, LEAST_BYTES = 0.8, 12
#: Beyond so many characters zstandard codes even random ones at their entropy, so NOVELTY is a share of that.
LONG = 512
#: Common identifiers of code, the fixed part of the dictionary.
IDENTIFIERS = (
    "abstract accept access account action active address admin alloc append application argument array async authentication authorization await "
    "backend base64 binary boolean buffer build bytes cache callback certificate change channel character charset class client collection column "
    "command commit component config configuration connect connection constant constructor container content context controller cookie count create "
    "credential current database datetime decode decrypt default delete dependency description destination device directory document domain download "
    "element email enable encode encrypt endpoint entity environment error event example exception execute expire export extends factory false field "
    "file filter format frame function generate getter global group handler hash header height hidden host http https identifier image implement "
    "import include index initialize input insert instance integer interface internal invalid iterator json key keyboard label language length level "
    "library license limit link list listener load local location login logout manager message metadata method migration model module mutable name "
    "namespace network node none null number object offset operation operator option order output package page parameter parent parse password path "
    "payload permission pointer port position prefix private process production profile project property protected protocol provider proxy public query "
    "queue random read receive record redirect reference register release remote remove render repository request require resource response result return "
    "route schema script search secret secure select self sender server service session setting signature size socket source static status storage stream "
    "string struct style submit success suffix super system table target template test thread throw timeout timestamp title token transaction transform "
    "true tuple type undefined unique update upload username utility validate value variable vector version view virtual visible warning width window worker wrapper write "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ placeholder changeme your_api_key_here example_token xxxxxxxxxxxxxxxx"
)


#: Words of the dictionary of four letters or more, the longer first; a candidate made of them to such a share is a name.
_KNOWN = re.compile("|".join(sorted({w for w in re.findall(r"[a-z]{4,}", IDENTIFIERS) if w != "abcdefghijklmnopqrstuvwxyz"}, key=lambda w: (-len(w), w))))
NAMED = 0.4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base rules, in that order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


class Novelty:
    """Prices strings by what they add to a compressed context."""

    def __init__(self, level: int = 3):
        import zstandard

        self.z, self.level = zstandard, level

    def size(self, data: bytes, dictionary) -> int:
        return len(self.z.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=False, write_checksum=False).compress(data))

    def marginal(self, candidate: str, before: str, after: str) -> int:
        """Bytes that the candidate adds between its surroundings, as it is or as the words of an identifier."""
        around = (before + " " + after).encode("utf-8", "replace")
        d = self.z.ZstdCompressionDict((IDENTIFIERS + " " + around.decode("utf-8", "replace").lower() + " ").encode() + around, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        without = self.size(around, d)
        words = " ".join(_WORDS.findall(candidate)).lower()
        return min(self.size(around + x.encode(), d) for x in (candidate, words)) - without


def random_bytes(word: str) -> float:
    """Bytes that zstandard needs for random characters as in ``word``."""
    n = len(word)
    if n <= LONG:
        return n
    return sum(-k * math.log2(k / n) for k in Counter(word).values()) / 8


def joined(taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What sorted spans (start, kind, end) cover together, as spans apart from each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in taken:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int]]:
    """(start, end) of incompressible strings in a sensitive context that no base span touches."""
    out: list[tuple[int, int]] = []
    low = text.lower()
    if not any(x in low for x in _HINTS):
        return out
    contexts, held = [c.span() for c in CONTEXT.finditer(text)], joined(taken)
    # candidates come in order, so each list is walked once
    k = j = 0
    for m in CANDIDATE.finditer(text) if contexts else ():
        a, b = m.span()
        while k < len(contexts) and contexts[k][1] <= a:
            k += 1
        if not (k > 0 and a - contexts[k - 1][1] <= REACH and "\n" not in text[contexts[k - 1][1] : a]):
            i = k
            while i < len(contexts) and contexts[i][0] < b:
                i += 1
            if i == len(contexts) or contexts[i][0] - b > REACH or "\n" in text[b : contexts[i][0]]:
                continue
        while j < len(held) and held[j][1] <= a:
            j += 1
        word = text[a:b]
        if j < len(held) and held[j][0] < b or not (re.search(r"\d", word, re.A) and re.search(r"[A-Za-z]", word)):
            continue
        if sum(len(w) for w in _KNOWN.findall(word.lower())) >= NAMED * len(word):
            continue
        cost = novelty.marginal(word, text[max(0, a - 256) : a], text[b : b + 256])
        if cost >= LEAST_BYTES and cost >= NOVELTY * random_bytes(word):
            out.append((a, b))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, by start), n_novel of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    out["n_" + KINDS[k]].append(sum(s[1] == k for s in base))
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
                out["base_sha256"].append(hashlib.sha256(",".join(said).encode()).hexdigest())
                more = novel_spans(text, base, novelty)
                out["n_novel"].append(len(more))
                if more:
                    every = sorted([(a, k, KINDS[k], b) for a, k, b in base] + [(a, 3, "novel", b) for a, b in more])
                    said = [f"{kind}:{a}:{b}" for a, _, kind, b in every]
                out["spans"].append(",".join(said))
            types = {k: pa.int64() if k.startswith("n_") else pa.string() for k in out}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, types[k]) for k, v in out.items()})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
