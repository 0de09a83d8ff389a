"""Writers: index lines, tables of an archive, JSON results, and the tables that one batch of captures derives."""

from __future__ import annotations

import gzip
import struct
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.functions import urls
from capturelake.operators.extract import page_links_udf
from capturelake.operators.fulltext import postings
from capturelake.operators.index import new_rows
from capturelake.operators.versions import version_chain

HEADER = " CDX N b a m s k S"


def cdx_lines(records: DataFrame, compat: bool = False) -> DataFrame:
    """(line) of each record: urlkey, timestamp, url, media type, status, digest, size; ``-`` for what is missing.

    The media type is bare, without parameters. ``compat`` writes the nine fields of an older form: the full
    type, and two ``-`` before the size.
    """
    mime = F.col("mime_type") if compat else F.trim(F.substring_index("mime_type", ";", 1))
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))
    fields = [dash(urls.urlkey(F.col("url"))), dash(F.col("timestamp")), dash(F.col("url")), dash(mime), dash(F.col("status_code")), dash(F.col("content_hash"))]
    fields += [F.lit("-"), F.lit("-")] if compat else []
    return records.select(*[c for c in ("id", "url", "timestamp") if c in records.columns], F.concat_ws(" ", *fields, dash(F.col("content_size"))).alias("line"))


def write_cdx(records: DataFrame, path: str, compat: bool = False, single: bool = False) -> None:
    """Index text in order of url and timestamp: sorted ranges, each a file, or one file with ``single``; the header is a file's first line there."""
    lines = cdx_lines(records, compat).select("url", "timestamp", "line")
    if single:
        header = records.sparkSession.createDataFrame([("", "", HEADER)], "url string, timestamp string, line string").withColumn("k", F.lit(0))
        rows = header.unionByName(lines.withColumn("k", F.lit(1)))
        rows.coalesce(1).sortWithinPartitions("k", "url", "timestamp").select("line").write.text(path)
    else:
        lines.orderBy("url", "timestamp").select("line").write.text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a Parquet folder; rows with a year of capture are partitioned by it and sorted by domain and url."""
    for name, df in tables.items():
        if {"timestamp", "domain", "url"} <= set(df.columns):
            year = F.substring("timestamp", 1, 4)
            dated = df.withColumn("crawl_year", F.when(year.rlike(r"^[0-9]{4}\z"), year).otherwise("none"))
            # years of very different sizes are spread by domain within the year, so none is one task
            dated = dated.repartitionByRange("crawl_year", "domain", "url").sortWithinPartitions("crawl_year", "domain", "url")
            dated.write.partitionBy("crawl_year").option("compression", "zstd").parquet(f"{path}/{name}")
        else:
            df.write.option("compression", "zstd").parquet(f"{path}/{name}")


def write_json_result(results: DataFrame, path: str, query: str, fields: list[str] | None = None) -> None:
    """Results as JSON lines of the chosen fields, each with the query and the number of all results."""
    count = results.agg(F.count(F.lit(1)).alias("count"))  # one row
    rows = results.select(F.struct(*(fields or results.columns)).alias("result")).join(F.broadcast(count))
    rows.select(F.lit(query).alias("query"), "count", "result").write.json(path)


@F.pandas_udf(T.LongType())
def packed_size(body: pd.Series) -> pd.Series:
    """Bytes of a body under gzip, level 6."""
    return body.map(lambda b: None if b is None else len(gzip.compress(bytes(b), 6, mtime=0)) + 1)


def unpack(data: bytes) -> bytes:
    """Content of a stored blob: a marker byte (0 gzip, 1 zstd, 2 plain) and the payload."""
    marker, payload = data[:1], data[1:]
    if marker == b"\x00":
        return gzip.decompress(payload)
    if marker == b"\x01":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(payload)
    return payload


def pack(data: bytes) -> bytes:
    """A blob as it is stored: zstd where it is installed, else gzip, behind its marker byte."""
    try:
        import zstandard
    except ImportError:
        return b"\x00" + gzip.compress(data, 6, mtime=0)
    return b"\x01" + zstandard.ZstdCompressor(level=6).compress(data)


@F.pandas_udf(T.BinaryType())
def packed(body: pd.Series) -> pd.Series:
    """Bodies as stored blobs; NULL for NULL."""
    return body.map(lambda b: None if b is None else pack(bytes(b)))


@F.pandas_udf(T.BinaryType())
def unpacked(blob: pd.Series) -> pd.Series:
    """Contents of stored blobs; NULL for NULL."""
    return blob.map(lambda b: None if b is None else unpack(bytes(b)))


def metadata_rows(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """Attribute rows (url, timestamp, key, value) as they are appended: with the id of their record, NULL where there is none.

    Of several records of one url and time the smallest id counts.
    """
    ids = records.groupBy("url", "timestamp").agg(F.min("id").alias("record_id"))
    return incoming.join(ids, ["url", "timestamp"], "left").select("record_id", "url", "timestamp", "key", "value")


def header_bytes(magic: bytes, version: int, records: int, content_size: int, created: float | None = None) -> bytes:
    """A file header of 64 bytes, little-endian: magic, version, flags, time, counts, and zeros."""
    return struct.pack("<5sBHqqqq", magic, version, 0, int(created if created is not None else time.time()), records, content_size, 0).ljust(64, b"\0")


def media_type(headers: Column) -> Column:
    """Content type of a header map, by its two usual spellings."""
    return F.coalesce(F.element_at(headers, "content-type"), F.element_at(headers, "Content-Type"), F.lit(""))


def derive_tables(captures: DataFrame, stored_records: DataFrame | None = None, stored_blobs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a batch of captures adds to an archive: records, blobs, versions, links, postings, metadata.

    ``captures`` has id, url, timestamp, status_code, http_headers (map), body (binary), source and,
    optionally, attributes (map). Captures whose (url, timestamp) is stored, or comes twice in the batch,
    add nothing at all. Each table is written on its own; atomicity is per table. Hashes are SHA-256.
    """
    rows = captures.withColumn("mime_type", media_type(F.col("http_headers"))).withColumn("content_hash", F.sha2("body", 256)).withColumn("domain", urls.domain(F.col("url")))
    if stored_records is not None:
        rows = new_rows(rows, stored_records, ["url", "timestamp"])
    else:
        rows = rows.dropDuplicates(["url", "timestamp"])
    records = rows.select(
        "id", "url", "domain", "timestamp", "status_code", "mime_type", "content_hash", F.octet_length("body").cast("long").alias("content_size"),
        packed_size("body").alias("compressed_size"), F.to_json("http_headers").alias("http_headers"), "source",
    )
    blobs = rows.select("content_hash", "body").dropDuplicates(["content_hash"])
    if stored_blobs is not None:
        blobs = blobs.join(stored_blobs.select("content_hash"), "content_hash", "left_anti")
    page = F.decode("body", "UTF-8")
    links = rows.filter(F.col("mime_type").contains("text/html")).select("url", "timestamp", F.explode(page_links_udf(page)).alias("l"))
    texts = rows.filter(F.col("mime_type").rlike("text/|html")).select("url", page.alias("text"))
    tables = {
        "records": records, "blobs": blobs, "versions": version_chain(records.filter(F.col("content_hash") != "")),
        "links": links.select(F.col("url").alias("source_url"), F.col("l.url").alias("target_url"), F.col("l.text").alias("link_text"), F.col("l.rel").alias("rel"), F.col("timestamp").alias("source_timestamp")),
        "postings": postings(texts, doc="url", text="text"),
    }
    if "attributes" in captures.columns:
        tables["metadata"] = rows.select("url", "timestamp", F.explode("attributes").alias("key", "value"))
    return tables
