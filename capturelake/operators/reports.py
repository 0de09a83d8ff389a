"""Aggregates and reports over captures, hits and discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import urls
from capturelake.functions.captures import month, year
from capturelake.operators.numbering import numbered


def sparkline(captures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, year, captures): captures per year of the timestamp text, all statuses; only years of four digits."""
    keys = keys or ["domain"]
    return captures.filter(year(F.col("timestamp")).rlike(r"^[0-9]{4}\z")).groupBy(*keys, year(F.col("timestamp")).alias("year")).agg(F.count(F.lit(1)).alias("captures"))


def sparkline_cache(captures: DataFrame) -> DataFrame:
    """(domain, counts, earliest, latest): the sparkline as a map from year to captures, and its first and last year."""
    entries = F.array_sort(F.collect_list(F.struct("year", "captures")))
    return sparkline(captures).groupBy("domain").agg(F.map_from_entries(entries).alias("counts"), F.min("year").alias("earliest"), F.max("year").alias("latest"))


def sparkline_map(captures: DataFrame) -> DataFrame:
    """(domain, counts): the sparkline as a map from year to captures, in year order."""
    entries = F.array_sort(F.collect_list(F.struct("year", "captures")))
    return sparkline(captures).groupBy("domain").agg(F.map_from_entries(entries).alias("counts"))


def fill_years(line: DataFrame) -> DataFrame:
    """The sparkline with a row for each year between a domain's first and last; 0 captures in the gaps."""
    spans = line.groupBy("domain").agg(F.min("year").cast("int").alias("a"), F.max("year").cast("int").alias("b"))
    years = spans.select("domain", F.explode(F.sequence("a", "b")).alias("y")).select("domain", F.lpad(F.col("y").cast("string"), 4, "0").alias("year"))
    return years.join(line, ["domain", "year"], "left").select("domain", "year", F.coalesce("captures", F.lit(0)).alias("captures"))


def domain_months(captures: DataFrame, domain: str | None = None) -> DataFrame:
    """Captures by year and month of one domain, or by year of all."""
    y = year(F.col("timestamp")).alias("year")
    if domain is None:
        return captures.groupBy(y).agg(F.count(F.lit(1)).alias("captures"))
    return captures.filter(F.col("domain") == domain).groupBy(y, month(F.col("timestamp")).alias("month")).agg(F.count(F.lit(1)).alias("captures"))


def index_stats(captures: DataFrame) -> DataFrame:
    """One row: captures, distinct domains and urls, domains with a sparkline."""
    dated = year(F.col("timestamp")).rlike(r"^[0-9]{4}\z")
    return captures.agg(
        F.count(F.lit(1)).alias("captures"), F.countDistinct("domain").alias("domains"), F.countDistinct("url").alias("urls"),
        F.countDistinct(F.when(dated, F.col("domain"))).alias("sparklines"),
    )


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_domains(captures: DataFrame, limit: int = 20) -> DataFrame:
    """The domains with most captures, with their distinct urls; ties by name."""
    per = captures.groupBy("domain", "url").agg(F.count(F.lit(1)).alias("n")).groupBy("domain").agg(F.sum("n").alias("captures"), F.count("url").alias("urls"))
    return per.orderBy(F.desc("captures"), "domain").limit(limit)


def domain_totals(captures: DataFrame) -> DataFrame:
    """(domain, captures, urls) of every domain; urls are counted after a combination by url, not in one task's set."""
    per_url = captures.groupBy("domain", "url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("domain").agg(F.sum("n").alias("captures"), F.count("url").alias("urls"))


def dedupe_ratio(records: DataFrame) -> DataFrame:
    """One row: records, total bytes, distinct contents, stored bytes (each content once) and the share saved."""
    known = F.coalesce(F.col("content_hash"), F.lit("")) != ""
    per = records.groupBy(F.when(known, F.col("content_hash")).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("content_size").alias("total"), F.max("compressed_size").alias("stored")
    )
    out = per.agg(
        F.sum("n").alias("records"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_bytes"), F.count("h").alias("contents"),
        F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("stored"))), F.lit(0)).alias("stored_bytes"),
    )
    n, total = F.greatest("records", F.lit(1)), F.greatest("total_bytes", F.lit(1))
    return out.select(
        F.coalesce("records", F.lit(0)).alias("records"), "total_bytes", "contents", "stored_bytes",
        F.round(100 * (1 - F.col("contents") / n), 1).alias("saved_percent"), F.round(100.0 * F.col("stored_bytes") / total, 1).alias("stored_percent"),
    )


def archive_info(records: DataFrame, links: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row: records, domains, urls, edges, indexed texts, first and last timestamp, and the columns of ``dedupe_ratio``.

    Single-row frames are joined; ``postings`` has a row per text and term.
    """
    a = records.agg(F.countDistinct("domain").alias("domains"), F.countDistinct("url").alias("urls"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    texts = postings.agg(F.countDistinct("doc").alias("texts")) if postings is not None else a.agg(F.lit(None).cast("long").alias("texts"))
    edges = links.agg(F.count(F.lit(1)).alias("edges"))
    return a.join(F.broadcast(edges)).join(F.broadcast(texts)).join(F.broadcast(dedupe_ratio(records)))


def report_by_extension(captures: DataFrame) -> DataFrame:
    """(ext, captures, bytes, first_year, last_year, sample): by extension, the sample is the earliest url."""
    ext = urls.extension_anywhere(F.col("url"))
    y = F.when(year(F.col("timestamp")).rlike(r"^[0-9]{4}\z"), year(F.col("timestamp")))
    return captures.groupBy(ext.alias("ext")).agg(
        F.count(F.lit(1)).alias("captures"), F.coalesce(F.sum("content_length"), F.lit(0)).alias("bytes"), F.min(y).alias("first_year"),
        F.max(y).alias("last_year"), F.min_by("url", F.struct("timestamp", "id")).alias("sample"),
    )


def category_counts(df: DataFrame, url: str = "url") -> DataFrame:
    return df.groupBy(urls.category(urls.extension_of_file(F.col(url))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its rank from 1 in a total order, by ranges, so that no task sees all rows."""
    return numbered(df, order, "_n").withColumn("rank", (F.col("_n") + 1).cast("int")).drop("_n")


def counts_of_top(df: DataFrame, column: str, n: int, *, first: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """The ``n`` most frequent values with their counts, ties by value; only of the ``first`` rows of an order, if given."""
    rows = df if first is None else df.orderBy(*order).limit(first)
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(n)


def top_years(sparklines: DataFrame, n: int = 5) -> DataFrame:
    """Of each domain its ``n`` years with most captures, the earlier one at a tie."""
    best = Window.partitionBy("domain").orderBy(F.desc("captures"), "year")  # a row per year
    return sparklines.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= n).drop("_k")


def leaderboard(discoveries: DataFrame, finder: str = "found_by") -> DataFrame:
    """Finders by files found: files, pages they found them on, files per page, rank; ties by name."""
    per = discoveries.groupBy(finder, "found_on").agg(F.count(F.lit(1)).alias("n")).groupBy(finder).agg(F.sum("n").alias("files"), F.count("found_on").alias("pages"))
    per = per.withColumn("per_page", F.round(F.col("files") / F.greatest("pages", F.lit(1)), 4))
    return _ranked(per, [F.desc("files"), F.col(finder)])


def bytes_board(discoveries: DataFrame, finder: str = "found_by") -> DataFrame:
    """Finders by bytes: sum, largest file and its url, rank; ties by name and by url."""
    size = F.coalesce("download_size", F.lit(0))
    per = discoveries.groupBy(finder).agg(
        F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.max_by("url", F.struct(size, "url")).alias("largest_url")
    )
    return _ranked(per, [F.desc("bytes"), F.col(finder)])


def best_per_group(df: DataFrame, group: Column, size: Column, tie: Column, name: str = "grp") -> DataFrame:
    """(group, n, size, the best row's tie value): the largest row of each group."""
    return df.groupBy(group.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("largest"), F.max_by(tie, F.struct(size, tie)).alias("best"))


def domain_prospects(captures: DataFrame, minimum: int = 50) -> DataFrame:
    """Of each domain with at least ``minimum`` captures, one counted per url and month: first, last and peak year."""
    monthly = captures.filter(year(F.col("timestamp")).rlike(r"^[0-9]{4}\z")).select("domain", "url", F.substring("timestamp", 1, 6).alias("m")).distinct()
    yearly = monthly.groupBy("domain", F.substring("m", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return (
        yearly.groupBy("domain")
        .agg(
            F.sum("n").alias("captures"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
            F.max_by("year", F.struct(F.col("n"), -F.col("year").cast("int"))).alias("peak_year"), F.max("n").alias("peak_captures"),
        )
        .filter(F.col("captures") >= minimum)
    )


def hits_by(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by each of two columns and in total, in one pass over grouping sets."""
    return (
        df.groupingSets([[df[first]], [df[second]], []], df[first], df[second])
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    )


def confidence_buckets(df: DataFrame, column: str = "confidence") -> DataFrame:
    """One row: hits, hits at .6 or more, and hits labelled high (.7), medium (.5) or low."""
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(c >= 0.6).alias("likely"), F.count_if(c >= 0.7).alias("high"),
        F.count_if((c >= 0.5) & (c < 0.7)).alias("medium"), F.count_if((c < 0.5) | c.isNull()).alias("low"),
    )


def top_slice_counts(df: DataFrame, key: Column, order: list[Column], n: int = 50) -> DataFrame:
    """Counts by key among the top ``n`` rows only: what a report of the top rows shows."""
    return df.orderBy(*order).limit(n).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def samples_per_archive(hits: DataFrame, n: int = 5) -> DataFrame:
    """(archive, hits, sample): the first ``n`` hit ids of each archive. Only ``n`` rows per archive are collected."""
    w = Window.partitionBy("archive").orderBy("hit_id")
    # the filter on the rank is applied in each task first, so few rows of a large archive are sorted in one place
    first = hits.select("archive", "hit_id").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    samples = first.groupBy(F.col("archive").alias("a")).agg(F.sort_array(F.collect_list("hit_id")).alias("sample"))
    counts = hits.groupBy("archive").agg(F.count(F.lit(1)).alias("hits"))
    return counts.join(samples, F.col("archive").eqNullSafe(F.col("a"))).select("archive", "hits", "sample")


def findings_log(discoveries: DataFrame) -> DataFrame:
    """(found_by, line_no, extension, url): the findings of each finder in order of extension and url."""
    fields = ("found_by", "extension", "url", "discovery_id")
    lines = numbered(discoveries.select(*fields), [F.col(c) for c in fields], "_n")
    # numbers run through all finders; a finder's lines start where its smallest number is
    starts = lines.groupBy(F.col("found_by").alias("_f")).agg(F.min("_n").alias("_start"))
    placed = lines.join(starts, F.col("found_by").eqNullSafe(F.col("_f")))
    return placed.select("found_by", (F.col("_n") - F.col("_start") + 1).cast("int").alias("line_no"), "extension", "url", "discovery_id")


def round_robin(df: DataFrame, buckets: int, order: list[Column]) -> DataFrame:
    """Rows dealt over ``buckets`` in a given order.

    The order is cut into ranges, numbered within each, and the ranges' sizes (one row per task) are added
    up, so that no task sees all rows.
    """
    return numbered(df, order, "_n").withColumn("bucket", (F.col("_n") % buckets).cast("int")).drop("_n")
