"""Best representative of each duplicate group, field by field, and what to take where times are missing."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions.address import address, id128
from capturelake.functions.instants import utc_seconds, zone_of
from capturelake.session import once

#: Texts of a hit, which are unknown if blank or '-'; those that are states, which change in time.
TEXTS, CURRENT = ("url", "archive", "status", "mimetype", "download_url"), ("status", "mimetype")
#: Criteria by which a hit is better, as TESTDATA.md states them.
STATED = ("confidence", "instant", "hit_id")


def prepare(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with an address: its identifier (a1, a2), their fields where known, the UTC second, and a confidence that is no NaN."""
    texts = [c for c in TEXTS if c in hits.columns]
    named = once(hits.select("hit_id", "timestamp", "size", "confidence", *texts), address(F.col("url")), "_address")
    a1, a2 = id128(F.col("_address"))
    confidence = F.when(~F.isnan("confidence"), F.col("confidence"))
    return named.select(
        a1.alias("a1"), a2.alias("a2"), "hit_id", *[F.when(~F.trim(c).isin("", "-"), F.col(c)).alias(c) for c in texts], "timestamp", confidence.alias("confidence"),
        F.when(F.col("size") > 0, F.col("size")).alias("size"), utc_seconds(F.col("timestamp"), zone_of(F.col("archive"), sources)).alias("instant"),
    )


def rank(stated: tuple[str, ...] = STATED, current: tuple[str, ...] = ()) -> Column:
    """Precedence of a hit: the larger of each stated criterion, then the later learned state of each field, then the smaller id; unknown comes last in each."""
    id_ = [(-F.col("hit_id")).alias("neg_id")]
    criteria = [x for c in stated for x in (id_ if c == "hit_id" else [F.col(c)])]
    return F.struct(*criteria, *[F.col(f"_place_{c}") for c in current], *([] if "hit_id" in stated else id_))


def best_hits(prepared: DataFrame, stated: tuple[str, ...] = STATED, current: tuple[str, ...] = CURRENT) -> DataFrame:
    """For each address with two or more rows: smallest hit, best hit, best with a size, best with an instant (0: none).

    The hits of a group are ordered by the stated criteria and, where these leave them equal, by the learned precedence
    of their states; the topologically latest hit is the maximum of both. Where ``hit_id`` is a stated criterion only rows
    of one id are left equal. Maxima are combined map-side and no group is ever collected. Repeated rows count as rows.
    ``prepared`` is read twice.
    """
    current = tuple(c for c in current if c in prepared.columns)
    order = rank(stated, current)

    def best(known: Column | None = None) -> Column:
        return F.coalesce(-F.max(order if known is None else F.when(known, order))["neg_id"], F.lit(0).cast("long"))

    return (
        placed(prepared, current)
        .groupBy("a1", "a2")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("hit_id").alias("group_hit_id"), best().alias("top_hit_id"),
            best(F.col("size").isNotNull()).alias("size_hit_id"), best(F.col("instant").isNotNull()).alias("timestamp_hit_id"),
        )
        .filter("n > 1")
        .select("group_hit_id", "top_hit_id", "size_hit_id", "timestamp_hit_id")
    )


def _value_spans(prepared: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Last instant of each value of each field (by its number) within its group; map-side combined."""
    return (
        prepared.filter(F.col("instant").isNotNull())
        .select("a1", "a2", "instant", F.posexplode(F.array(*fields)).alias("field", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("a1", "a2", "field", "value")
        .agg(F.max("instant").alias("last"))
    )


def learn_precedences(prepared: DataFrame, fields: tuple[str, ...]) -> dict[str, dict[str, int]]:
    """For each field, the rank of each of its values in the order of change that timestamped rows show.

    Within a group the values are put in the order of their last sight; neighbours are a transition.
    A value precedes another if more groups change to the other than back. The relation is
    reduced to its strongest edges without a cycle and numbered topologically; a later value has the
    larger number. All fields are learned in one pass; the driver holds the distinct transitions.
    """
    if not fields:
        return {}
    order = Window.partitionBy("a1", "a2", "field").orderBy("last", "value")
    pairs = _value_spans(prepared, fields).withColumn("before", F.lag("value").over(order)).filter("before is not null")
    seen: dict[str, dict[tuple[str, str], int]] = {f: {} for f in fields}
    for r in pairs.groupBy("field", "before", "value").agg(F.count(F.lit(1)).alias("n")).collect():
        seen[fields[r["field"]]][r["before"], r["value"]] = r["n"]
    return {f: _numbered(counts) for f, counts in seen.items()}


def learn_precedence(prepared: DataFrame, field: str) -> dict[str, int]:
    """Rank of each value of one field, as by ``learn_precedences``."""
    return learn_precedences(prepared, (field,))[field]


def _numbered(seen: dict[tuple[str, str], int]) -> dict[str, int]:
    """Topological numbers of the values of counted transitions."""
    net = sorted(((n - seen.get((b, a), 0), a, b) for (a, b), n in seen.items() if n > seen.get((b, a), 0)), key=lambda e: (-e[0], e[1], e[2]))
    after = acyclic((a, b) for _, a, b in net)
    degree = {v: 0 for pair in seen for v in pair}
    for targets in after.values():
        for b in targets:
            degree[b] += 1
    ready = [v for v, k in degree.items() if not k]
    heapq.heapify(ready)
    ranks: dict[str, int] = {}
    while ready:
        v = heapq.heappop(ready)
        ranks[v] = len(ranks)
        for b in after.get(v, ()):
            degree[b] -= 1
            if not degree[b]:
                heapq.heappush(ready, b)
    return ranks


def acyclic(edges: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """The edges, in their order, without those that would close a cycle with the ones before them.

    Positions agree with the edges kept so far, so that only what lies between the two ends of a new edge is searched and moved.
    """
    after: dict[str, set[str]] = defaultdict(set)
    before: dict[str, set[str]] = defaultdict(set)
    position: dict[str, int] = {}

    def reached(start: str, follow: dict[str, set[str]], low: int, high: int) -> list[str]:
        met, todo = {start}, [start]
        while todo:
            new = {x for x in follow.get(todo.pop(), ()) if low <= position[x] <= high} - met
            met |= new
            todo += new
        return sorted(met, key=position.__getitem__)

    for a, b in edges:
        for v in (a, b):
            position.setdefault(v, len(position))
        low, high = position[b], position[a]
        if low < high:
            ahead = reached(b, after, low, high)
            if ahead[-1] == a:  # the only value at ``high``
                continue
            moved = reached(a, before, low, high) + ahead
            position.update(zip(moved, sorted(position[v] for v in moved), strict=True))
        after[a].add(b)
        before[b].add(a)
    return dict(after)


def placed(prepared: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``prepared`` with ``_place_<field>``: the learned rank of each field's value, -1 if it has none."""
    for field, ranks in learn_precedences(prepared, fields).items():
        place = f"_place_{field}"
        places = prepared.sparkSession.createDataFrame(pa.table({field: pa.array(list(ranks), pa.string()), place: pa.array(list(ranks.values()), pa.int32())}))
        prepared = prepared.join(places, field, "left").withColumn(place, F.coalesce(place, F.lit(-1)))
    return prepared


def survivors(prepared: DataFrame, current: tuple[str, ...] = CURRENT) -> DataFrame:
    """One built record per address: (group_hit_id, hits, each field of a hit, instant, from_precedence, and the like).

    Each field comes from the best hit that has it; timestamp and instant from the best that names an instant.
    Where no hit that has a field of ``current`` has an instant, the field is the topologically latest
    value by the learned precedence, unknown values first, then the best hit's: ``from_precedence`` says so for
    the first of these fields, ``<field>_from_precedence`` for the others.
    """
    rows, built = placed(prepared, current), {}
    best = lambda c, known=None: F.max_by(c, F.when(F.col(known or c).isNotNull(), rank()))
    fields = [c for c in (*TEXTS, "size", "confidence", "instant") if c in prepared.columns]
    for field in fields:
        built[field] = best(field)
    built["timestamp"] = best("timestamp", "instant")
    for field in current:
        built[f"_inferred_{field}"] = F.max_by(field, F.when(F.col(field).isNotNull(), F.struct(f"_place_{field}", rank())))
        built[f"_seen_{field}"] = F.coalesce(F.bool_or(F.col(field).isNotNull() & F.col("instant").isNotNull()), F.lit(False))
    value = lambda c: F.when(F.col(f"_seen_{c}"), F.col(c)).otherwise(F.col(f"_inferred_{c}")).alias(c) if c in current else F.col(c)
    inferred = [(~F.col(f"_seen_{c}") & F.col(c).isNotNull()).alias(f"{c}_from_precedence" if k else "from_precedence") for k, c in enumerate(current)]
    return (
        rows.groupBy("a1", "a2")
        .agg(F.min("hit_id").alias("group_hit_id"), F.count(F.lit(1)).alias("hits"), *[v.alias(k) for k, v in built.items()])
        .select("group_hit_id", "hits", *[value(c) for c in (*fields, "timestamp")], *inferred)
    )
