"""The queries of the general problems, over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.address import address
from capturelake.functions.instants import utc_seconds, utc_text, zone_of
from capturelake.operators.history import version_history
from capturelake.operators.orphans import Reference, orphan_counts, orphan_rows
from capturelake.operators.skew import balanced_summary, fragment_replicate_join, plan_loads
from capturelake.operators.timestamps import to_be_normalised
from capturelake.operators.widen import cells_of, widen
from capturelake.plans.problem_sql import SQL
from capturelake.session import spread, table

#: Smallest share of a table's rows, in percent, at which a domain dominates it.
DOMINANT_PERCENT = 3


def _domains(spark: SparkSession, d: str, times: bool) -> DataFrame:
    parts = []
    for name in ("cdx_records", "records"):
        df = table(spark, d, name).select("domain", "url", "timestamp", "source")
        if times:
            second = utc_seconds(F.col("timestamp"), zone_of(F.col("source"), table(spark, d, "archive_sources")))
            df = spread(df)
        else:
            second = F.lit(None).cast("long")
        parts.append(df.select(F.lit(name).alias("table_name"), "domain", "url", second.alias("second")))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _domains(spark, d, times=False)
    counts = balanced_summary(rows, ["table_name", "domain"], "url")
    totals = {n: table(spark, d, n).count() for n in ("cdx_records", "records")}  # from the file footers, no column is read
    total = F.when(F.col("table_name") == "records", totals["records"]).otherwise(totals["cdx_records"])
    return counts.filter(F.col("domain").isNotNull() & (F.col("rows") * 100 >= total * DOMINANT_PERCENT)).select("table_name", "domain")


def p1_domains(spark: SparkSession, d: str) -> DataFrame:
    """Captures, distinct urls, first and last capture of every domain of both tables."""
    rows = _domains(spark, d, times=True)
    plan = plan_loads(_domains(spark, d, times=False), ["table_name", "domain"])
    return balanced_summary(rows, ["table_name", "domain"], "url", first_last="second", plan=plan).select(
        "table_name", "domain", F.col("rows").alias("captures"), F.col("items").alias("urls"), utc_text(F.col("first")).alias("first_capture"), utc_text(F.col("last")).alias("last_capture")
    )


def p1_shared_domains(spark: SparkSession, d: str) -> DataFrame:
    """Index captures by domain and status next to the stored records of the domain, joined shard by shard."""
    cdx = table(spark, d, "cdx_records").select("id", "domain", "status_code")
    stored = table(spark, d, "records").groupBy("domain").agg(F.count(F.lit(1)).alias("stored"))
    joined = fragment_replicate_join(cdx, stored, ["domain"], ["id"])
    return joined.groupBy("domain", "status_code").agg(F.count(F.lit(1)).alias("captures"), F.max("stored").alias("stored"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return version_history(spread(table(spark, d, "version_chains").select("url", "timestamp", "content_hash"))).select("url", "valid_from", "valid_to")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cells_of(p4_wide(spark, d))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per record id, one typed column per attribute."""
    return widen(spread(table(spark, d, "metadata").select("meta_id", "record_id", "key", "value")), table(spark, d, "meta_attributes"))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """The typed values of the wide table, one row for each filled cell, by the type of its column."""
    wide = p4_wide(spark, d)

    def cell(f) -> Column:
        value, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        of = lambda k, name, x=value: (x if kind == k else F.lit(None).cast("string" if k == "timestamp" else k)).alias(name)
        text = value if kind == "string" else F.date_format(value, "yyyyMMddHHmmss") if kind == "timestamp" else F.lit(None).cast("string")
        return F.when(value.isNotNull(), F.struct(F.lit(f.name).alias("attr"), of("bigint", "whole"), of("double", "number"), of("boolean", "flag"), text.alias("text")))

    cells = F.array_compact(F.array(*[cell(f) for f in wide.schema.fields if f.name != "record_id"]))
    return wide.select("record_id", F.explode(cells).alias("c")).select("record_id", "c.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "archive_sources")
    parts = []
    for name, row_id, source in (("cdx_records", "id", "source"), ("records", "id", "source"), ("archive_hits", "hit_id", "archive")):
        df = table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), F.col(source).alias("source"), "timestamp")
        parts.append(to_be_normalised(spread(df), sources))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("table_name", "row_id", "utc_time")


def _month(column: str):
    return F.substring(utc_text(utc_seconds(F.col(column), F.lit("UTC"))), 1, 6)


def _references(spark: SparkSession, d: str, periods: bool = False) -> list[Reference]:
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    month = _month if periods else (lambda _: None)
    records, chains = table(spark, d, "records"), table(spark, d, "version_chains")
    links, pages = spread(table(spark, d, "link_graph").select("id", "target_url", "source_timestamp")), spread(records.select("url"))
    return [
        Reference("metadata", table(spark, d, "metadata"), "meta_id", [F.col("record_id")], records, [F.col("id")], month("timestamp")),
        Reference("link_graph", links, "id", [address(F.col("target_url"))], pages, [address(F.col("url"))], month("source_timestamp")),
        Reference("version_chains", chains, "version_id", [F.col("url"), F.lower(text("prev_hash"))], chains, [F.col("url"), F.lower(text("content_hash"))], month("timestamp")),
    ]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(_references(spark, d)).select("table_name", "row_id")


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month (UTC); a timestamp without a zone is UTC here."""
    return orphan_counts(_references(spark, d, periods=True))


__all__ = ["QUERIES", "SQL"]
QUERIES = {f.__name__: f for f in (p1_found, p1_domains, p1_shared_domains, p2_found, p4_found, p4_wide, p4_values, p5_found, p7_found, p7_periods)}
