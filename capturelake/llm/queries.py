"""The queries of the problems on texts and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.address import address
from capturelake.llm import duplicates, leakage, survivor, tokens, truncation
from capturelake.llm.duplicates import Field
from capturelake.llm.sql import SQL
from capturelake.session import materialise, spread, table

#: Tables of problem 3, each with its id and the fields of its key.
ADDRESSED = {
    "cdx_records": ("id", [Field("url", address), Field("timestamp"), Field("source")]),
    "link_graph": ("id", [Field("target_url", address), Field("source_url"), Field("source_timestamp")]),
    "discoveries": ("discovery_id", [Field("url", address)]),
}


def _addressed(spark: SparkSession, d: str) -> duplicates.Tables:
    return {name: (table(spark, d, name), row_id, fields) for name, (row_id, fields) in ADDRESSED.items()}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies_in(_addressed(spark, d))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per group, with the number of its copies."""
    return duplicates.collapse_in(_addressed(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return survivor.prepare(spread(table(spark, d, "archive_hits")), table(spark, d, "archive_sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Best hits by the stated order, then by learned precedence; the hits are parsed once, for learning and for the choice."""
    hits = _hits(spark, d).select("a1", "a2", "hit_id", "confidence", "size", "instant", *survivor.CURRENT)
    return survivor.best_hits(materialise(hits, "hits"))


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """One built record per address, each field from the best hit that has it, none by currency."""
    return survivor.survivors(_hits(spark, d), current=())


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One built record per address, its status and type by currency where no hit has an instant; the hits are parsed once."""
    return survivor.survivors(materialise(_hits(spark, d), "hits"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_texts(spark, d))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters of the corpus by source."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text", F.length("text").alias("chars")))
    coded = tokens.encode(docs, keep=("source", "chars"))
    return coded.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.sum("chars").alias("chars"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_texts(spark, d), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items that leaked, with the number of documents that hold them."""
    return p9_found(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


def _inspected(spark: SparkSession, d: str) -> DataFrame:
    return materialise(truncation.inspect(_texts(spark, d)), "endings")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(_inspected(spark, d)).filter("cut").select(F.col("row_id").alias("doc_id"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut texts per source."""
    judged = truncation.judge(_inspected(spark, d))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"),
        F.round(F.count_if("cut") / F.count(F.lit(1)), 6).alias("share"),
    )


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden length limits of each source."""
    return truncation.hidden_limits(_inspected(spark, d)).withColumn("share", F.round("share", 6))


__all__ = ["QUERIES", "SQL"]
QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_collapsed, p6_found, p6_fields, p6_survivors, p8_ids, p8_lengths, p9_found, p9_items, p10_found, p10_sources, p10_limits)
}
