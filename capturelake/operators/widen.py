"""Attribute-value rows into wide typed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.values import clean_value, key_name, to_bigint, to_boolean, to_double, to_timestamp
from capturelake.session import let, once

#: Largest number of attributes, which bounds the broadcast attribute table and the rows of an entity.
MAX_ATTRIBUTES = 4096

_BUFFERS = {
    "string": (object, pa.string(), "v_string"),
    "bigint": (np.int64, pa.int64(), "v_bigint"),
    "double": (np.float64, pa.float64(), "v_double"),
    "boolean": (np.bool_, pa.bool_(), "v_boolean"),
    "timestamp": (np.int64, pa.timestamp("us", tz="UTC"), "v_timestamp"),
}


def filled_cells(df: DataFrame, attributes: DataFrame, *, entity: str, key: str, value: str, order: str) -> DataFrame:
    """One row for each filled cell: entity, attribute index and one typed value column that is set.

    A cell with several readable values takes the one with the largest ``order`` (then the larger
    text). Values are reduced map-side before the exchange, so an entity with very many rows, or a
    cell with very many values, is a few rows from there on.
    """
    attributes = attributes.select(F.col("attr"), "value_type", key_name(F.col("attr")).alias("_name"))
    n = attributes.count()
    if n > MAX_ATTRIBUTES:
        raise ValueError(f"{n} attributes; at most {MAX_ATTRIBUTES} are columns")
    # the index of an attribute is its place in name order, by a comparison with the bounded table
    names = [r["attr"] for r in attributes.select("attr").distinct().orderBy("attr").collect()]
    index = F.array_position(F.array(*[F.lit(a) for a in names]), F.col("attr")).cast("int") - 1
    known = attributes.withColumn("_ix", index).dropDuplicates(["_name"])
    rows = df.filter(F.col(entity).isNotNull()).select(
        F.col(entity).alias("_entity"), key_name(F.col(key)).alias("_name"), F.col(value).alias("_raw"), F.col(order).alias("_order")
    )
    cleaned = once(rows.join(F.broadcast(known), "_name"), clean_value(F.col("_raw")), "_v")
    v, kind = F.col("_v"), F.col("value_type")
    buffers = [b[2] for b in _BUFFERS.values()]
    typed = F.struct(
        F.when(kind == "string", v).alias("v_string"),
        F.when(kind == "bigint", to_bigint(v)).alias("v_bigint"),
        F.when(kind == "double", to_double(v)).alias("v_double"),
        F.when(kind == "boolean", to_boolean(v)).alias("v_boolean"),
        F.when(kind == "timestamp", to_timestamp(v)).alias("v_timestamp"),
    )
    filled = let(typed, lambda t: F.when(F.coalesce(*[F.when(t[c].isNotNull(), 1) for c in buffers]).isNotNull(), t))
    readable = once(cleaned.select("_entity", "_ix", "_order", "_v", "value_type"), filled, "_typed")
    best = readable.groupBy("_entity", "_ix").agg(F.max_by("_typed", F.struct("_order", "_v")).alias("_best"))
    return best.select("_entity", "_ix", *[F.col(f"_best.{c}").alias(c) for c in buffers])


def widen(
    df: DataFrame, attributes: DataFrame, *, entity: str = "record_id", key: str = "key", value: str = "value", order: str = "meta_id"
) -> DataFrame:
    """One row per entity with at least one filled cell, and one typed column per attribute.

    ``attributes`` has attr and value_type (string, bigint, double, boolean, timestamp). A key means an
    attribute if both agree apart from letter case and anything but letters and digits. Rows with a
    NULL entity, a foreign key or no readable value fill nothing; an attribute called like the entity
    column gets the suffix ``_value``; empty tables give an empty result.

    Cells are sorted by entity and streamed, batch by batch, into column builders: the index of the
    entity and of the attribute address a typed buffer and its validity mask. An entity has at most one
    row per attribute here; the last entity of a batch waits for the next one.
    """
    cells = filled_cells(df, attributes, entity=entity, key=key, value=value, order=order)
    kinds = {r["attr"]: r["value_type"] for r in attributes.collect()}  # at most MAX_ATTRIBUTES, checked above
    names = sorted(kinds)
    for a in names:
        if kinds[a] not in _BUFFERS:
            raise ValueError(f"unknown type {kinds[a]} of {a}")
    column = {a: f"{a}_value" if a == entity else a for a in names}
    id_field = next(f for f in cells.schema.fields if f.name == "_entity")
    schema = ", ".join([f"`{entity}` {id_field.dataType.simpleString()}", *(f"`{column[a]}` {kinds[a]}" for a in names)])
    plan = [(column[a], *_BUFFERS[kinds[a]]) for a in names]

    def build(batch: pa.Table) -> pa.RecordBatch:
        entities = batch.column("_entity").combine_chunks()
        ids = entities.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[True], ids[1:] != ids[:-1]])
        row = np.cumsum(starts) - 1
        n = int(row[-1]) + 1
        attr = batch.column("_ix").to_numpy()
        arrays = [entities.filter(pa.array(starts))]
        for k, (_, dtype, kind, source) in enumerate(plan):
            at = np.flatnonzero(attr == k)
            missing = np.ones(n, dtype=bool)
            buffer = np.zeros(n, dtype=dtype) if dtype is not object else np.empty(n, dtype=object)
            if len(at):
                values = batch.column(source).take(pa.array(at))
                if source == "v_timestamp":
                    values = values.cast(pa.int64())
                buffer[row[at]] = values.to_numpy()
                missing[row[at]] = False
            arrays.append(pa.array(buffer, mask=missing, from_pandas=False).cast(kind) if dtype is not object else pa.array(buffer, type=kind, mask=missing))
        return pa.RecordBatch.from_arrays(arrays, names=[entity, *(p[0] for p in plan)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if waiting is not None:
                t = pa.concat_tables([waiting, t])
            if not t.num_rows:
                continue
            ids = t.column("_entity").to_numpy()
            changes = np.flatnonzero(ids[1:] != ids[:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield build(t.slice(0, cut))
            waiting = t.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield build(waiting)

    return cells.repartition("_entity").sortWithinPartitions("_entity", "_ix").mapInArrow(stream, schema)


def cells_of(wide: DataFrame, entity: str = "record_id") -> DataFrame:
    """(entity, attr) of each filled cell of a wide table."""
    attrs = [c for c in wide.columns if c != entity]
    filled = F.array_compact(F.array(*[F.when(F.col(f"`{a}`").isNotNull(), F.lit(a)) for a in attrs]))
    return wide.select(entity, F.explode(filled).alias("attr"))
