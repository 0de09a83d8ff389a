"""History of changing attributes: presence bitmaps over the snapshots of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions.instants import utc_seconds, utc_text
from capturelake.session import once

#: valid_to of the last version.
OPEN_END = "99991231235959"


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def version_history(
    df: DataFrame, *, entity: str = "url", attribute: str = "content_hash", time: str = "timestamp", block_seconds: int = 86400
) -> DataFrame:
    """Every version of every entity: (entity, attribute, valid_from, valid_to, captures).

    A version is a longest run of snapshots with the same attribute, letter case ignored. For each
    entity and attribute one bit is set per snapshot; a version starts where a bit is set and the
    bit before it is not, so ``bits & ~(bits << 1 | carry)`` has the starts. Missing snapshots need
    no care, since only those that exist have a position.

    Snapshots are numbered within blocks of one day, so that what is collected for an entity and
    block is bounded by the seconds of a day (times the values that share a second), however many
    snapshots a hot entity has. Runs that go on from block to block are joined through one row per
    entity and block. Rows without entity or attribute (NULL or '') or without a valid time are left
    out, repeated snapshots count once, snapshots of one second are taken in the order of their
    attribute. Times are 14-digit UTC texts.
    """
    seconds = utc_seconds(F.col("_text"), F.lit("UTC"))
    value = F.lower(F.col(attribute))
    known = df.filter((value != "") & F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), value.alias("_a"), F.col(time).alias("_text"))
    snapshots = once(known, seconds, "_t").drop("_text").withColumn("_block", F.floor(F.col("_t") / block_seconds))
    # what a join would infer on one of its sides holds on both, so that the blocks are made once, in one exchange
    snapshots = snapshots.filter("_e is not null and _block is not null")
    blocks = snapshots.groupBy("_e", "_block").agg(F.array_sort(F.collect_set(F.struct("_t", "_a"))).alias("_snaps"))

    # presence bitmaps: a word of 64 snapshots for each entity, block and attribute
    rows = blocks.select("_e", "_block", F.posexplode("_snaps").alias("_pos", "_snap"))
    words = rows.groupBy("_e", "_block", F.col("_snap._a").alias("_a"), F.expr("_pos >> 6").alias("_word")).agg(
        F.bit_or(_bit(F.col("_pos") % 64)).alias("_bits"),
        F.collect_list(F.struct((F.col("_pos") % 64).alias("k"), F.col("_snap._t").alias("t"))).alias("_times"),
    )
    by_attribute = Window.partitionBy("_e", "_block", "_a").orderBy("_word")
    high = F.call_function("shiftrightunsigned", F.lag("_bits").over(by_attribute), F.lit(63))
    follows = F.lag("_word").over(by_attribute) == F.col("_word") - 1
    carry = F.when(follows, high).otherwise(F.lit(0).cast("long"))
    shifted = F.call_function("shiftleft", F.col("_bits"), F.lit(1)).bitwiseOR(F.col("_carry"))
    starts = (
        words.withColumn("_carry", F.coalesce(carry, F.lit(0).cast("long")))
        .withColumn("_starts", F.col("_bits").bitwiseAND(F.bitwise_not(shifted)))
        .select(
            "_e", "_block", "_a",
            F.explode(F.filter("_times", lambda x: F.col("_starts").bitwiseAND(_bit(x["k"])) != 0)).alias("_at"), "_word",
        )
        .select("_e", "_block", "_a", F.col("_at.t").alias("_from"), (F.col("_word") * 64 + F.col("_at.k")).alias("_pos"))
    )

    # one row per entity and block: does its first run go on from the block before; when does the next run start?
    # the first start that is no continuation lies at the first change of value, so no block needs its rows again
    changed = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("_snaps")), lambda k: F.when((k > 1) & (F.col("_snaps")[k - 1]["_a"] != F.col("_snaps")[F.greatest(k - 2, F.lit(0))]["_a"]), F.col("_snaps")[k - 1]["_t"])),
        lambda t: t.isNotNull(),
    )
    edges = blocks.select(
        "_e", "_block", F.col("_snaps")[0]["_a"].alias("_head"), F.col("_snaps")[0]["_t"].alias("_head_t"),
        F.element_at("_snaps", -1)["_a"].alias("_tail"), F.get(changed, F.lit(0)).alias("_second"),
    )
    by_block = Window.partitionBy("_e").orderBy("_block")
    edges = edges.withColumn("_goes_on", F.coalesce(F.lag("_tail").over(by_block) == F.col("_head"), F.lit(False)))
    edges = edges.withColumn("_first", F.when(F.col("_goes_on"), F.col("_second")).otherwise(F.col("_head_t")))
    later = by_block.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.withColumn("_next", F.first("_first", ignorenulls=True).over(later)).select("_e", "_block", "_goes_on", "_next")

    in_block = Window.partitionBy("_e", "_block").orderBy("_pos")
    return (
        starts.join(edges, ["_e", "_block"])
        .withColumn("_to", F.coalesce(F.lead("_from").over(in_block), "_next"))
        .filter(~(F.col("_goes_on") & (F.col("_pos") == 0)))
        .select(
            F.col("_e").alias(entity), F.col("_a").alias(attribute), utc_text(F.col("_from")).alias("valid_from"),
            F.coalesce(utc_text(F.col("_to")), F.lit(OPEN_END)).alias("valid_to"),
        )
    )
