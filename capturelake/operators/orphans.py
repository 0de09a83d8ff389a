"""References to rows that do not exist: parent and child keys in one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.address import id128


class Reference:
    """One reference: the child rows, their key, and the rows and key of the table they refer to.

    Keys are lists of columns; a row with a NULL in a key refers to nothing, or is no parent.
    ``period`` is any text of the child row, NULL for rows without a valid one.
    """

    def __init__(self, name: str, child: DataFrame, row_id: str, child_key: list[Column], parent: DataFrame, parent_key: list[Column], period: Column | None = None):
        self.name, self.child, self.row_id, self.child_key = name, child, row_id, child_key
        self.parent, self.parent_key, self.period = parent, parent_key, period


def _keyed(df: DataFrame, key: list[Column], **more: Column) -> DataFrame:
    """128-bit identifiers of the keys in place of their texts."""
    names = [f"_k{i}" for i in range(len(key))]
    rows = df.select(*[c.alias(n) for n, c in more.items()], *[k.cast("string").alias(n) for k, n in zip(key, names)])
    # rows with a NULL in the key go by a generator: a filter would be pushed down and compute the key again
    complete = F.filter(F.array(F.array(*names)), lambda ks: ~F.exists(ks, lambda k: k.isNull()))
    a, b = id128(*[F.col("_key")[i] for i in range(len(key))])
    return rows.select(*more, F.explode(complete).alias("_key")).select(a.alias("k1"), b.alias("k2"), *more)


def _children(refs: list[Reference]) -> DataFrame:
    parts = [
        _keyed(r.child, r.child_key, row_id=F.col(r.row_id).cast("long"), table_name=F.lit(r.name), period=r.period if r.period is not None else F.lit(None).cast("string"))
        for r in refs
    ]
    return reduce(DataFrame.unionByName, parts)


def _orphan_keys(refs: list[Reference]) -> DataFrame:
    """Keys of the long table that no parent has, by reference."""
    tagged = []
    for r in refs:
        tagged.append(_keyed(r.parent, r.parent_key, table_name=F.lit(r.name), parent=F.lit(1)))
        tagged.append(_keyed(r.child, r.child_key, table_name=F.lit(r.name), parent=F.lit(0)))
    long = reduce(DataFrame.unionByName, tagged)
    return long.groupBy("table_name", "k1", "k2").agg(F.max("parent").alias("parent")).filter(F.col("parent") == 0).drop("parent")


def orphan_rows(refs: list[Reference]) -> DataFrame:
    """(table_name, row_id, period) of each row whose key no parent row has, whatever the order of arrival.

    The tagged keys are grouped with map-side combination, so a key that a third of all rows hold
    is one row per task; the groups without a parent are joined back to the child rows, where the
    runtime splits a partition that is too large. Repeated rows come out as often as they are stored.
    """
    return _children(refs).join(_orphan_keys(refs), ["table_name", "k1", "k2"]).select("table_name", "row_id", "period")


def orphan_counts(refs: list[Reference]) -> DataFrame:
    """(table_name, period, orphans, keys): orphan references and their distinct keys by period; NULL is a period of its own.

    In this form the long table is grouped once, by key and period, and needs no join.
    """
    tagged = []
    for r in refs:
        tagged.append(_keyed(r.parent, r.parent_key, table_name=F.lit(r.name), period=F.lit(None).cast("string"), parent=F.lit(1)))
        period = r.period if r.period is not None else F.lit(None).cast("string")
        tagged.append(_keyed(r.child, r.child_key, table_name=F.lit(r.name), period=period, parent=F.lit(0)))
    long = reduce(DataFrame.unionByName, tagged)
    # first by key and period: a few rows for each key from here on, since there are only so many periods
    by_period = long.groupBy("table_name", "k1", "k2", "period", "parent").agg(F.count(F.lit(1)).alias("n"))
    keys = by_period.groupBy("table_name", "k1", "k2").agg(
        F.max("parent").alias("parent"),
        F.collect_list(F.when(F.col("parent") == 0, F.struct("period", "n"))).alias("periods"),
    )
    return (
        keys.filter(F.col("parent") == 0)
        .select("table_name", F.explode("periods").alias("p"))
        .groupBy("table_name", F.col("p.period").alias("period"))
        .agg(F.sum("p.n").alias("orphans"), F.count(F.lit(1)).alias("keys"))
    )
