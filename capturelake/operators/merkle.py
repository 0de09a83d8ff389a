"""Merkle roots over content hashes, level by level, and verification of stored contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.operators.numbering import numbered
from capturelake.session import let, materialise

#: Levels folded in one exchange: a node then has up to 2 ** STRIDE leaves below it, collected in its group.
STRIDE = 10


def _fold(hashes: Column, levels: int) -> Column:
    """Parent hashes of an array, ``levels`` times; an odd level repeats its last node, a single node stays."""
    out = hashes
    for _ in range(levels):

        def up(level: Column) -> Column:
            pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
            parent = lambda k: F.sha2(F.concat(level[2 * k], F.coalesce(F.get(level, 2 * k + 1), level[2 * k])), 256)
            return F.transform(pairs, parent)

        out = let(out, up)
    return out


def merkle_root(df: DataFrame, digest: str, order: list[Column]) -> DataFrame:
    """One row with ``root`` and ``leaves``: the Merkle root over the digests in the order given.

    A parent is SHA-256 of the two hex texts of its children; an odd level repeats its last node. No leaf
    gives SHA-256 of the empty text; one leaf is its own root. Leaves are numbered by ranges and folded a
    thousandfold per exchange: what is grouped is at most 1,024 hashes, so 10^12 leaves take four rounds.
    """
    leaves = df.filter(F.coalesce(F.col(digest), F.lit("")) != "")
    level = numbered(leaves.select(F.col(digest).alias("h"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [F.col(f"_o{i}") for i in range(len(order))], "i").select("i", "h")
    level = materialise(level, "leaves")
    total = n = level.count()
    depth = max(0, (n - 1).bit_length())
    while depth > 0:
        k = min(STRIDE, depth)
        # a group is complete but for the last one, which repeats its last node on each level
        groups = level.groupBy(F.expr(f"i >> {k}").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("hs"))
        level = materialise(groups.select("i", _fold(F.col("hs"), k)[0].alias("h")), "level")
        depth -= k
    empty = F.sha2(F.lit(""), 256)
    return level.agg(F.coalesce(F.max("h"), empty).alias("root")).select("root", F.lit(total).cast("long").alias("leaves"))


def verify(records: DataFrame, blobs: DataFrame, *, url: str | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row: records with a hash, how many are verified, corrupted or missing, ok if none is bad, and the root of their hashes.

    With ``url`` only the captures of that url, in order of timestamp and id. The root is NULL where there is no
    record with a hash. Each distinct blob is hashed once, however many records refer to it.
    """
    chosen = records.filter(F.coalesce("content_hash", F.lit("")) != "")
    if url is not None:
        chosen, order = chosen.filter(F.col("url") == url), ("timestamp", "id")
    checked = blobs.select("content_hash", (F.sha2("body", 256) == F.col("content_hash")).alias("_good")).groupBy("content_hash").agg(F.min("_good").alias("_good"))
    known = chosen.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_n"))
    joined = known.join(checked, "content_hash", "left")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))
    good = F.col("_good")
    out = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), count(good).alias("verified"), count(~good).alias("corrupted"), count(good.isNull()).alias("missing")
    )
    root = merkle_root(chosen, "content_hash", [F.col(c) for c in order]).select(F.when(F.col("leaves") > 0, F.col("root")).alias("root"))
    return out.withColumn("ok", (F.col("corrupted") + F.col("missing")) == 0).join(F.broadcast(root))  # one row each
