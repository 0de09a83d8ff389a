"""Row numbers and running values in a given order, without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators.skew import plan_loads
from capturelake.session import materialise, task_count


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_part``, its range of the order; written once, so that the ranges are the same in every use."""
    return materialise(df.repartitionByRange(task_count(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with a number from 0 in the order given, which must be total.

    Rows are range-partitioned by the order and written once, so that the ranges are the same in both
    uses; each range is numbered on its own, and the offset of a range is the sum of the sizes
    before it: one row per range, which is all that a single task sees.
    """
    ranged = _ranges(df, order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order)
    # one row per range: bounded by the number of tasks
    joined = ranged.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.row_number().over(within) - 1 + F.col("_offset")).drop("_part", "_offset")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, including: bool = False) -> DataFrame:
    """``df`` with the largest ``value`` of the rows before each row among those of its key; with ``including`` also its own.

    ``order`` must be total within a key. Keys are counted first, map-side combined. The rows of one that holds more than
    half a task's share are cut into ranges of the order, see ``_over_ranges``; those of any other key are run through in
    one task. NULL keys are one key; NULL values do not count.
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    in_one_task = lambda r: r.withColumn(name, F.max(value).over(frame))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("total")).first()
    heavy = plan_loads(df.select(*keys), keys).heavy if (sizes["most"] or 0) * 2 * task_count(df.sparkSession) > (sizes["total"] or 0) else ()
    if not heavy:
        return in_one_task(df)
    fields = [df.schema[k] for k in keys]
    hot = df.sparkSession.createDataFrame([(tuple(k),) for k, _ in heavy], "_h struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields) + ">")
    tagged = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), F.struct(*keys).eqNullSafe(F.col("_h")), "left").drop("_h")  # two rows a task at most
    rows = tagged.filter("_hot").select(F.struct(*keys).alias("_k"), F.struct(*order).alias("_o"), F.struct(*df.columns).alias("_row"), value.alias("_v"))
    return in_one_task(tagged.filter("_hot is null").drop("_hot")).unionByName(_over_ranges(rows, name, including))


def _over_ranges(rows: DataFrame, name: str, including: bool) -> DataFrame:
    """The same for rows of hot keys: range-partitioned by key and order, so that each lies in several ranges.

    Each range is run through on its own, and its first key goes on from the largest value which that key has in the
    ranges before: two rows per range, which is all that a window over several ranges sees.
    """
    ranged = _ranges(rows, [F.col("_k"), F.col("_o")])
    frame = Window.partitionBy("_part", "_k").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    groups = ranged.groupBy("_part", "_k").agg(F.max("_v").alias("_v"))
    ends = groups.groupBy("_part").agg(F.min("_k").alias("_first"), F.max_by("_v", "_k").alias("_v"), F.max("_k").alias("_last"))
    asks = ends.select(F.col("_first").alias("_k"), "_part", F.lit(0).alias("_give"), F.when(F.lit(False), F.col("_v")).alias("_v"))
    gives = ends.select(F.col("_last").alias("_k"), "_part", F.lit(1).alias("_give"), "_v")
    before = Window.partitionBy("_k").orderBy("_part", "_give").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.unionByName(gives).withColumn("_carry", F.max("_v").over(before)).filter("_give = 0")
    carried = carried.select(F.col("_part").alias("_p"), F.col("_k").alias("_first"), "_carry")
    inner = ranged.withColumn("_run", F.max("_v").over(frame))
    # one row per range: bounded by the number of tasks
    joined = inner.join(F.broadcast(carried), F.col("_part") == F.col("_p"))
    carry = F.when(F.col("_k").eqNullSafe(F.col("_first")), F.col("_carry"))
    return joined.select("_row.*", F.greatest("_run", carry).alias(name))
