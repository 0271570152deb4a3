"""Admission of rows by rules that are data, and constraints that are declared once.

Rules are named expressions, looked at in one pass: each row is told the first one
it breaks. Shapes of JSON are such expressions over a variant. Constraints (keys,
references, unique values) are compiled into one report; those that ask the same
parent share its scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of JSON types and the variant types that are one.
JSON_TYPES = {"number": ("BIGINT", "DOUBLE", "DECIMAL"), "integer": ("BIGINT",), "string": ("STRING",), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def first_broken(rules: dict[str, Column]) -> Column:
    """The name of the first rule that doesn't hold (a rule without an answer doesn't); null where all do."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        out = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def parsed(text: Column) -> Column:
    """JSON text as a variant; null where it is none."""
    return F.try_parse_json(text)


def json_type(value: Column, path: str) -> Column:
    """The type of what stands at a path of a variant, by the names of JSON_TYPES; null where nothing does."""
    at = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    kind = F.regexp_extract(at, r"^[A-Z]+", 0)
    out = F.lit(None).cast("string")
    for name, kinds in JSON_TYPES.items():
        if name != "integer":
            out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def is_json(value: Column, path: str, name: str) -> Column:
    """Whether what stands at a path of a variant has a JSON type."""
    at = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.regexp_extract(at, r"^[A-Z]+", 0).isin(*JSON_TYPES[name])


@dataclass(frozen=True)
class Unique:
    """No two rows of a table have the same values; rows with a null among them aside."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Present:
    """A column is never null."""

    table: str
    column: str


@dataclass(frozen=True)
class Reference:
    """Each value is a key of the parent's; null refers to nothing."""

    table: str
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]


def name_of(c) -> str:
    if isinstance(c, Unique):
        return f"{c.table}({','.join(c.columns)}) unique"
    if isinstance(c, Present):
        return f"{c.table}.{c.column} present"
    return f"{c.table}({','.join(c.columns)}) -> {c.parent}({','.join(c.keys)})"


def _values(columns) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def _keys(sides: list[tuple[DataFrame, tuple[str, ...]]]) -> list[Column]:
    """What stands for the values of each side: whole numbers or texts as they are, if all sides have single ones, else arrays of texts."""
    kinds = {t.schema[columns[0]].dataType.typeName() if len(columns) == 1 else "" for t, columns in sides}
    if kinds <= {"byte", "short", "integer", "long"}:
        return [F.col(columns[0]).cast("long") for _, columns in sides]
    if kinds == {"string"}:
        return [F.col(columns[0]) for _, columns in sides]
    return [_values(columns) for _, columns in sides]


def _shown(rows: DataFrame, v: str) -> Column:
    return F.array_join(v, ",") if rows.schema[v].dataType.typeName() == "array" else F.col(v).cast("string")


def violations(tables: dict[str, DataFrame], constraints: list) -> DataFrame:
    """constraint, broken (rows, or values that recur), example (the least such value, comma-joined), of each declared constraint that is broken."""
    found = []
    for i, c in enumerate(constraints):
        t, said = tables[c.table], F.lit(i).alias("constraint")  # names are as long as rows, and come last
        if isinstance(c, Unique):
            known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in c.columns])
            seen = t.where(known).groupBy(_keys([(t, c.columns)])[0].alias("v")).agg(F.count("*").alias("n")).where("n > 1")
            found.append(seen.select(said, _shown(seen, "v").alias("example")))
        elif isinstance(c, Present):
            found.append(t.where(F.col(c.column).isNull()).select(said, F.lit("").alias("example")))
    by_parent: dict[tuple, list] = {}
    for i, c in enumerate(constraints):
        if isinstance(c, Reference):
            by_parent.setdefault((c.parent, c.keys), []).append((i, c))
    for (parent, keys), of in by_parent.items():
        asked, (own, *values) = [], _keys([(tables[parent], keys), *[(tables[c.table], c.columns) for _, c in of]])
        for (i, c), v in zip(of, values):
            known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in c.columns])
            asked.append(tables[c.table].where(known).groupBy(v.alias("v")).agg(F.count("*").alias("n")).select(F.lit(i).alias("constraint"), "v", "n"))
        every = reduce(DataFrame.unionByName, asked)
        held = tables[parent].select(own.alias("v"))
        # values that recur are asked once; the parent is read once for all that refer to it
        found.append(every.join(held, "v", "left_anti").select("constraint", _shown(every, "v").alias("example"), "n"))
    rows = reduce(DataFrame.unionByName, [f if "n" in f.columns else f.withColumn("n", F.lit(1).cast("long")) for f in found])
    total = rows.groupBy("constraint").agg(F.sum("n").alias("broken"), F.min("example").alias("example"))
    names = F.array(*[F.lit(name_of(c)) for c in constraints])
    return total.select(F.get(names, F.col("constraint")).alias("constraint"), "broken", "example")
