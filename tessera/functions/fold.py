"""Full case folding, as Python's ``str.casefold`` does it (sharp s, dotted I, final sigma, ligatures)."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What folding does to each character it changes, told by a rule over all characters.
_CHANGED = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c.casefold() != c}
_ONE = {c: t for c, t in _CHANGED.items() if len(t) == 1}
_MORE = {c: t for c, t in _CHANGED.items() if len(t) > 1}


def _folded(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "replace").casefold() for x in raw.to_pylist()], pa.string())


def fold(text: Column | str) -> Column:
    """The folded text. ASCII takes the short way, the rest goes to workers in batches; not for use in lambdas."""
    text = F.col(text) if isinstance(text, str) else text
    ascii = F.octet_length(text) == F.length(text)
    rest = F.arrow_udf(_folded, "string")(F.when(~ascii, text.cast("binary")))
    return F.when(ascii, F.lower(text)).otherwise(rest)


def fold_word(text: Column) -> Column:
    """``fold`` for use in lambdas, for words: each character is looked up on its own, which takes long over whole texts."""
    upper = "".join(map(chr, range(65, 91)))
    single = F.translate(text, upper + "".join(_ONE), upper.lower() + "".join(_ONE.values()))
    spelt = F.create_map(*[F.lit(x) for pair in _MORE.items() for x in pair])
    several = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")
    whole = F.when(single.rlike("[" + "".join(_MORE) + "]"), several).otherwise(single)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(whole)
