"""Duplicates hidden by formatting differences: dictionary-encoded columns, grouped integer tuples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.address import id128
from capturelake.session import materialise, once, require_skew_splitting


@dataclass(frozen=True)
class Field:
    """A field of the duplicate key: a column, and the form in which its values are compared (the value itself, if None)."""

    column: str
    canonical: Callable[[Column], Column] | None = None


def dictionary(values: DataFrame, canonical: Callable[[Column], Column]) -> DataFrame:
    """(_value, _c1, _c2): each distinct value with the integer identifier of its canonical form.

    A value is canonicalised once, however many rows hold it. The identifier is 128 bits, two
    integers, taken from the canonical form itself, so no numbering pass over the dictionary is
    needed and a recomputed task gives the same identifiers; for 10^11 values the chance of any
    collision is below 1e-16. Values without a canonical form are not in the dictionary.
    """
    forms = once(values.distinct(), canonical(F.col("_value")), "_form")
    c1, c2 = id128(F.col("_form"))
    return forms.select("_value", c1.alias("_c1"), c2.alias("_c2"))


#: Tables of one call, by name: rows, their id column, and the fields of their key.
Tables = dict[str, tuple[DataFrame, str, list[Field]]]


def encode(tables: Tables) -> DataFrame:
    """(table_name, row_id, k0, k1, ...): each record as its identifier and the tuple of its fields' integers.

    The tables go through one pipeline with one dictionary: a value that several of them hold is canonicalised once. Fields
    with a canonical form come first in a tuple, each part in field name order; shorter tuples end in zeros. Rows
    with a NULL canonical form are left out; NULL and '' of a field compared as it is are values.
    """
    forms = {f.canonical for _, _, fields in tables.values() for f in fields if f.canonical}
    if len(forms) > 1:
        raise ValueError("one canonical form per call")
    split = {n: ([f for f in sorted(fs, key=lambda f: f.column) if f.canonical], [f for f in sorted(fs, key=lambda f: f.column) if not f.canonical]) for n, (_, _, fs) in tables.items()}
    slots, plain = max(len(c) for c, _ in split.values()), max(len(p) for _, p in split.values())
    parts = []
    for name, (df, row_id, _) in tables.items():
        own, others = split[name]
        codes = []
        for f in others:
            codes += [F.when(F.col(f.column).isNull(), F.lit(0)).otherwise(c) for c in id128(F.col(f.column))]
        codes += [F.lit(0)] * (2 * plain - len(codes))
        texts = [F.col(f.column) for f in own] + [F.lit(None)] * (slots - len(own))
        row = df.select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), *[t.cast("string").alias(f"_t{j}") for j, t in enumerate(texts)], *[c.cast("long").alias(f"k{2 * slots + i}") for i, c in enumerate(codes)])
        parts.append(row.dropna(subset=[f"_t{j}" for j in range(len(own))]) if own else row)
    rows = reduce(DataFrame.unionByName, parts)
    if slots:
        texts = reduce(DataFrame.unionByName, [rows.select(F.col(f"_t{j}").alias("_value")) for j in range(slots)])
        codes = dictionary(texts.dropna(), forms.pop())
    for j in range(slots):
        everywhere = all(len(c) > j for c, _ in split.values())
        coded = codes.select(F.col("_value").alias("_w"), F.col("_c1").alias(f"k{2 * j}"), F.col("_c2").alias(f"k{2 * j + 1}"))
        rows = rows.join(coded, F.col(f"_t{j}") == F.col("_w"), "inner" if everywhere else "left").filter(F.col(f"_t{j}").isNull() | F.col(f"k{2 * j}").isNotNull()).drop("_w", f"_t{j}")
    return rows.select("table_name", "row_id", *[F.coalesce(f"k{i}", F.lit(0)).alias(f"k{i}") for i in range(2 * (slots + plain))])


def group_sizes(encoded: DataFrame) -> DataFrame:
    """Of each group of equal tuples of a table the smallest id and the number of rows, combined map-side."""
    keys = [c for c in encoded.columns if c != "row_id"]
    return encoded.groupBy(*keys).agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies_in(tables: Tables) -> DataFrame:
    """(table_name, first_id, copy_id): each row but the smallest id of a group of formatting duplicates of its table.

    The encoded tuples are written once and read twice: to find the groups with more than one row,
    and to name their rows. A group that holds a third of all rows is one row on the grouped side,
    and its rows are split by the runtime where they are too many for a task. Rows that share an id
    with the first one do not come out; an empty table gives an empty result.
    """
    require_skew_splitting(next(iter(tables.values()))[0].sparkSession)
    encoded = materialise(encode(tables), "encoded")
    keys = [c for c in encoded.columns if c != "row_id"]
    groups = group_sizes(encoded).filter(F.col("copies") > 1).drop("copies")
    return (
        encoded.join(groups, keys)
        .filter(F.col("row_id") != F.col("first_id"))
        .select("table_name", "first_id", F.col("row_id").alias("copy_id"))
    )


def copies(df: DataFrame, row_id: str, fields: list[Field]) -> DataFrame:
    """(first_id, copy_id) of one table, see ``copies_in``."""
    return copies_in({"": (df, row_id, fields)}).drop("table_name")


def collapse_in(tables: Tables) -> DataFrame:
    """(table_name, first_id, copies): one record per group of formatting duplicates, with the number of its rows."""
    require_skew_splitting(next(iter(tables.values()))[0].sparkSession)
    return group_sizes(encode(tables)).select("table_name", "first_id", "copies")


def collapse(df: DataFrame, row_id: str, fields: list[Field]) -> DataFrame:
    """(first_id, copies) of one table, see ``collapse_in``."""
    return collapse_in({"": (df, row_id, fields)}).drop("table_name")
