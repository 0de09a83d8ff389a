"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.session import task_count

#: Hash buckets of a task for the keys that are too small to be planned one by one.
BUCKETS_PER_TASK = 32


@dataclass(frozen=True)
class LoadPlan:
    """Where the rows of each key go.

    ``heavy`` has one entry for each key above half a task's mean load, so at most ``2 * tasks``;
    ``buckets`` has the task of each hash bucket of the other keys, 32 a task. Neither grows with the data.
    """

    keys: tuple[str, ...]
    tasks: int
    total: int
    heavy: tuple[tuple[tuple, tuple[int, ...]], ...]
    buckets: tuple[int, ...]
    loads: tuple[float, ...]


def plan_loads(df: DataFrame, keys: list[str], tasks: int | None = None) -> LoadPlan:
    """Bin-pack keys to tasks by their row counts; split large keys into proportionate shards.

    Counts are combined map-side in one scan; the driver gets the heavy keys (at most ``2 * tasks`` rows)
    and one load per hash bucket. A NULL key is a key of its own; an empty table gives a plan without loads.
    """
    tasks = tasks or task_count(df.sparkSession)
    n_buckets = BUCKETS_PER_TASK * tasks
    bucket = F.pmod(F.hash(*keys), F.lit(n_buckets))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    key = F.struct(*[F.col(k) for k in keys])
    whole = counts.agg(F.sum("_n").alias("_total"))  # one row, from the same exchange
    large = F.col("_n") * (2 * tasks) > F.col("_total")
    loads = (
        counts.join(F.broadcast(whole))
        .groupBy(F.when(large, key).alias("_key"), F.when(~large, bucket).alias("_bucket"))
        .agg(F.sum("_n").alias("_n"))
        .collect()
    )
    total = sum(r["_n"] for r in loads)
    mean = max(1.0, total / tasks)
    pieces: list[tuple[float, object]] = []
    for r in loads:
        if r["_bucket"] is not None:
            pieces.append((r["_n"], r["_bucket"]))
        else:
            shards = -(-r["_n"] // max(1, int(mean / 2)))
            pieces += [(r["_n"] / shards, tuple(r["_key"]))] * min(shards, 2 * tasks)
    heap = [(0.0, t) for t in range(tasks)]
    placed: dict[object, list[int]] = {}
    sums = [0.0] * tasks
    for load, what in sorted(pieces, key=lambda p: (-p[0], repr(p[1]))):
        at, t = heapq.heappop(heap)
        placed.setdefault(what, []).append(t)
        sums[t] = at + load
        heapq.heappush(heap, (sums[t], t))
    heavy = tuple((k, tuple(v)) for k, v in placed.items() if isinstance(k, tuple))
    buckets = tuple(placed.get(b, [b % tasks])[0] for b in range(n_buckets))
    return LoadPlan(tuple(keys), tasks, total, heavy, buckets, tuple(sums))


def _with_tasks(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """``df`` with ``_tasks``: the tasks of its key's shards. What is broadcast has at most ``34 * tasks`` rows."""
    spark = df.sparkSession
    buckets = spark.createDataFrame(list(enumerate(plan.buckets)), "_bucket int, _light int")
    placed = df.withColumn("_b", F.pmod(F.hash(*plan.keys), F.lit(len(plan.buckets)))).join(F.broadcast(buckets), F.col("_b") == F.col("_bucket"), "left").drop("_b", "_bucket")
    if not plan.heavy:
        return placed.withColumn("_tasks", F.array("_light")).drop("_light")
    fields = [f for k in plan.keys for f in df.schema.fields if f.name == k]
    names = [f"_k{i}" for i in range(len(fields))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)) + ", _shards array<int>"
    heavy = spark.createDataFrame([(*k, list(t)) for k, t in plan.heavy], schema)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(plan.keys, names)])
    return placed.join(F.broadcast(heavy), same, "left").withColumn("_tasks", F.coalesce("_shards", F.array("_light"))).drop(*names, "_shards", "_light")


def fragment(df: DataFrame, plan: LoadPlan, spread: list[str]) -> DataFrame:
    """Rows of ``df`` at the task of their shard, in ``_task``; rows with equal ``spread`` columns meet."""
    tasks = F.col("_tasks")
    shard = F.pmod(F.xxhash64(*spread), F.size(tasks).cast("long")).cast("int")
    return (
        _with_tasks(df, plan)
        .withColumn("_task", F.element_at(tasks, shard + 1))
        .drop("_tasks")
        .repartitionById(plan.tasks, F.col("_task"))
    )


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Rows of the matching side, once for each task that has a shard of their key, in ``_task``."""
    return (
        _with_tasks(df, plan)
        .withColumn("_task", F.explode(F.array_distinct("_tasks")))
        .drop("_tasks")
        .repartitionById(plan.tasks, F.col("_task"))
    )


def fragment_replicate_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], *, how: str = "inner", plan: LoadPlan | None = None
) -> DataFrame:
    """Join on ``keys`` where a few keys hold most rows of ``left``.

    The shards of a key's left rows go to different tasks, and its right rows only to those. ``how``
    is inner or left. NULL keys match nothing. Right columns that are called like left ones, apart
    from the keys, are dropped.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    plan = plan or plan_loads(left, keys)
    others = [c for c in right.columns if c not in left.columns]
    names = [f"key{i}" for i in range(len(keys))]
    own = LoadPlan(tuple(names), plan.tasks, plan.total, plan.heavy, plan.buckets, plan.loads)
    # rows travel as one column each, so that no column name of theirs can clash with those of the plan
    pick = lambda df, row, columns: df.select(F.struct(*columns).alias(row), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    l_rows = pick(left, "left_row", left.columns).withColumn("spread", F.xxhash64(*[F.col(f"left_row.`{c}`") for c in spread]))
    r_rows = pick(right, "right_row", others or keys)
    joined = fragment(l_rows, own, ["spread"]).join(replicate(r_rows, own), ["_task", *names], how)
    return joined.select("left_row.*", *[F.col(f"right_row.`{c}`").alias(c) for c in others])


def balanced_summary(
    df: DataFrame, keys: list[str], item: str, *, first_last: str | None = None, plan: LoadPlan | None = None
) -> DataFrame:
    """For each key: ``rows``, distinct ``items`` and, with ``first_last``, its smallest and largest value.

    Rows are first combined by key and item, map-side, so that an item with very many rows is one
    row. The items of a large key are split over the tasks of its shards and counted there; what
    goes to the last step is one row for each key and shard. NULL keys form a group, NULL items are
    no items, and an empty table gives an empty result.
    """
    plan = plan or plan_loads(df, keys)
    value = F.col(first_last) if first_last else F.lit(None).cast("string")
    by_item = df.groupBy(*keys, item).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_first"), F.max(value).alias("_last")
    )
    shards = (
        fragment(by_item, plan, [item])
        .groupBy("_task", *keys)
        .agg(
            F.sum("_rows").alias("_rows"), F.count(item).alias("_items"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
        )
    )
    out = shards.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.sum("_items").alias("items"), F.min("_first").alias("first"), F.max("_last").alias("last")
    )
    return out if first_last else out.drop("first", "last")
