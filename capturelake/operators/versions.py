"""Version chains, latest captures, links, and lookups across tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.operators.numbering import running_max


def _change(prev: Column, current: Column) -> Column:
    return F.when(prev.isNull(), "new").when(prev == current, "unchanged").otherwise("content_update")


def version_chain(records: DataFrame, *, url: str = "url", time: str = "timestamp", digest: str = "content_hash", row_id: str = "id") -> DataFrame:
    """(row_id, url, timestamp, digest, prev, change): each capture with the one before in time order.

    Rows without a digest are left out. change is new, unchanged or content_update. A url with very many captures
    is spread over several tasks.
    """
    rows = records.filter(F.col(digest).isNotNull()).select(row_id, url, time, digest)
    prev = running_max(rows, [url], [time, row_id], F.struct(time, row_id, digest), "_prev").withColumn("prev_hash", F.col("_prev")[digest]).drop("_prev")
    return prev.withColumn("change", _change(F.col("prev_hash"), F.col(digest)))


def version_chain_by_arrival(records: DataFrame, *, url: str = "url", time: str = "timestamp", digest: str = "content_hash", row_id: str = "id") -> DataFrame:
    """The same, where a capture is compared with the latest one among those that arrived before it (by ``row_id``)."""
    rows = records.filter(F.col(digest).isNotNull()).select(row_id, url, time, digest)
    prev = running_max(rows, [url], [row_id], F.struct(time, row_id, digest), "_prev").withColumn("prev_hash", F.col("_prev")[digest]).drop("_prev")
    return prev.withColumn("change", _change(F.col("prev_hash"), F.col(digest)))


def latest_capture(records: DataFrame, *, url: str = "url", time: str = "timestamp", row_id: str = "id") -> DataFrame:
    """The latest capture of each url, as a whole row; combined map-side."""
    best = records.groupBy(url).agg(F.max_by(F.struct(*records.columns), F.struct(time, row_id)).alias("_row"))
    return best.select("_row.*")


def capture_at(records: DataFrame, blobs: DataFrame | None, url: str, timestamp: str | None = None) -> DataFrame:
    """The capture of a url at a timestamp, or its latest; with its body, if there is a blob table (NULL where it is missing)."""
    rows = records.filter(F.col("url") == url)
    rows = rows.filter(F.col("timestamp") == timestamp) if timestamp else rows
    one = rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(1)
    return one if blobs is None else one.join(blobs, "content_hash", "left")


def links_from(links: DataFrame, url: str) -> DataFrame:
    return links.filter(F.col("source_url") == url)


def links_to(links: DataFrame, url: str) -> DataFrame:
    return links.filter(F.col("target_url") == url)


def in_degree(links: DataFrame) -> DataFrame:
    """(target_url, links, pages): edges and distinct source pages of each target; NULL and '' targets are left out."""
    known = links.filter(F.coalesce("target_url", F.lit("")) != "")
    per = known.groupBy("target_url", "source_url").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("target_url").agg(F.sum("n").alias("links"), F.count("source_url").alias("pages"))


def two_hops(links: DataFrame) -> DataFrame:
    """Distinct (source, via, target) paths of two edges between different pages; copies of an edge count once."""
    edges = links.filter(F.coalesce("target_url", F.lit("")) != "").select("source_url", "target_url").distinct()
    a = edges.select(F.col("source_url").alias("source"), F.col("target_url").alias("via"))
    b = edges.select(F.col("source_url").alias("via"), F.col("target_url").alias("target"))
    return a.join(b, "via").filter("source <> target").select("source", "via", "target")


def reachable(links: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """(url, depth): pages that links lead to from a page, each with its least depth; of ``depth`` edges at most, if given.

    A round is one join of the pages found last; the rounds end when none is new.
    """
    from capturelake.session import materialise

    edges = links.filter(F.coalesce("target_url", F.lit("")) != "").select("source_url", "target_url").distinct()
    seen = links.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    frontier, k = seen, 0
    while depth is None or k < depth:
        k += 1
        step = frontier.join(edges, F.col("url") == F.col("source_url")).select(F.col("target_url").alias("url")).distinct()
        frontier = materialise(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def with_metadata(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records with the number of their metadata rows, by url and timestamp."""
    counts = metadata.groupBy("url", "timestamp").agg(F.count(F.lit(1)).alias("attributes"))
    return records.join(counts, ["url", "timestamp"], "left").withColumn("attributes", F.coalesce("attributes", F.lit(0)))


def link_page_times(links: DataFrame, records: DataFrame, default: str = "20100101000000") -> DataFrame:
    """Links with the latest timestamp of the page they stand on, or a default."""
    times = records.groupBy(F.col("url").alias("source_url")).agg(F.max("timestamp").alias("page_time"))
    return links.join(times, "source_url", "left").withColumn("page_time", F.coalesce("page_time", F.lit(default)))


def found_or_missing(wanted: DataFrame, first: DataFrame, second: DataFrame, url: str = "url") -> DataFrame:
    """(url, found_in): each wanted url with the first of two tables that has it, or ``missing``."""
    tag = lambda df, name: df.select(url).distinct().withColumn(name, F.lit(True))
    joined = wanted.select(url).distinct().join(tag(first, "_a"), url, "left").join(tag(second, "_b"), url, "left")
    return joined.select(url, F.when(F.col("_a"), "first").when(F.col("_b"), "second").otherwise("missing").alias("found_in"))


def wish_matches(captures: DataFrame, wishes: DataFrame) -> DataFrame:
    """(wish, id): captures that match a wish's prefix or domain.

    A wish is (wish, kind, pattern). A prefix that goes beyond its host is matched by an equality join on the
    domain it names and a test of the rest. One that ends inside the host, or before it, is matched by an equality
    join on the urls' beginnings of the lengths that such prefixes have, of which there are few. So no pair
    of rows is compared that does not share a domain or a beginning.
    """
    from capturelake.functions.urls import domain

    named = wishes.withColumn("_d", F.when(F.col("kind") == "domain", F.lower("pattern")).otherwise(domain(F.col("pattern"))))
    beyond = (F.col("kind") == "domain") | F.col("pattern").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[/?#]")
    joined = captures.join(named.filter(beyond), F.lower(captures["domain"]) == F.col("_d"))
    whole = joined.filter((F.col("kind") == "domain") | F.col("url").startswith(F.col("pattern"))).select("wish", "id")
    short = wishes.filter("kind <> 'domain'").filter(~F.coalesce(beyond, F.lit(False)) & F.col("pattern").isNotNull())
    lengths = sorted(r[0] for r in short.select(F.length("pattern")).distinct().collect())  # at most the length of a host name
    if not lengths:
        return whole
    begun = captures.select("id", F.col("url").alias("_u"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n"))
    begun = begun.filter(F.length("_u") >= F.col("_n")).select("id", F.substring("_u", F.lit(1), F.col("_n")).alias("_b"))
    return whole.unionByName(begun.join(short.select("wish", "pattern"), F.col("_b") == F.col("pattern")).select("wish", "id"))


def expand_templates(subjects: DataFrame, templates: list[str], column: str = "domain") -> DataFrame:
    """Each subject put into each template at ``{domain}``; templates with another placeholder are skipped.

    The templates are a short literal array, exploded row by row; there is no join.
    """
    usable = [t for t in templates if "{" not in t.replace("{domain}", "")]
    exploded = subjects.select(column, F.explode(F.array(*[F.lit(t) for t in usable])).alias("template"))
    return exploded.select(column, F.replace("template", F.lit("{domain}"), F.col(column)).alias("variant"))


# ---- merging of sources
def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of several sources with their name, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_name", F.lit(n)) for n, df in frames.items()])


def keep_largest(hits: DataFrame, *, key: Column, size: Column, rank: Column, tie: Column) -> DataFrame:
    """One hit per key: the largest; ties go to the smaller source rank, then the smaller tie value."""
    row = F.struct(*hits.columns)
    best = hits.groupBy(key.alias("_key")).agg(F.max_by(row, F.struct(F.coalesce(size, F.lit(0)), -rank, -tie)).alias("_row"))
    return best.select("_key", "_row.*").withColumnRenamed("_key", "merge_key")


def first_nonempty(frames: list[DataFrame]) -> DataFrame:
    """Rows of the first frame that has any."""
    tagged = [df.withColumn("source_no", F.lit(k)) for k, df in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, tagged)
    best = rows.agg(F.min("source_no").alias("_best"))
    return rows.join(F.broadcast(best), F.col("source_no") == F.col("_best")).drop("_best")


def new_blobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Contents to write: one row per hash that is not stored yet; rows without a hash are none."""
    known = incoming.filter(F.coalesce("content_hash", F.lit("")) != "")
    return known.select("content_hash", "content_size").groupBy("content_hash").agg(F.max("content_size").alias("content_size")).join(stored.select("content_hash"), "content_hash", "left_anti")
