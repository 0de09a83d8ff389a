"""Readers of capture indexes, records and lists, each into rows of a fixed schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions import urls
from capturelake.functions.captures import falsy_coalesce
from capturelake.operators.index import normalise_records
from capturelake.operators.numbering import numbered

INDEX_COLUMNS = ("domain", "url", "timestamp", "status_code", "mime_type", "content_length", "digest", "source")


def cdx_text(spark: SparkSession, path: str, source: str = "cdx_import") -> DataFrame:
    """Rows of an index text: urlkey, timestamp, url, type, status, digest, length, separated by blanks.

    Blank lines, comments and header lines are no rows, nor are lines of fewer than seven fields or with
    a status or length that is no number. ``-`` stands for status 200, digest '' and length 0.
    """
    parts = F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+\z", "")), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") >= 7) & ~F.get("p", F.lit(0)).startswith("#"))

    def number(k: int, default: int) -> Column:
        return F.when(F.get("p", F.lit(k)) == "-", F.lit(default)).otherwise(F.get("p", F.lit(k)).try_cast("bigint"))

    text = lambda k: F.when(F.get("p", F.lit(k)) == "-", "").otherwise(F.get("p", F.lit(k)))
    rows = lines.select(
        urls.domain(F.get("p", F.lit(2))).alias("domain"), F.get("p", F.lit(2)).alias("url"), F.get("p", F.lit(1)).alias("timestamp"), number(4, 200).cast("int").alias("status_code"),
        text(3).alias("mime_type"), number(6, 0).alias("content_length"), text(5).alias("digest"), F.lit(source).alias("source"),
    )
    return rows.filter(F.col("status_code").isNotNull() & F.col("content_length").isNotNull())


def cdx_json(df: DataFrame, column: str = "json", query_url: str | None = None, source: str = "wayback") -> DataFrame:
    """Rows of JSON answers of the form ``[[header...],[row...]...]``, all strings; anything else has none."""
    table = F.from_json(F.col(column), "array<array<string>>")
    rows = df.select(table.alias("t")).filter(F.size("t") > 1).select(F.get("t", F.lit(0)).alias("h"), F.posexplode("t").alias("k", "r")).filter("k > 0")
    named = rows.select(F.map_from_arrays(F.col("h"), F.slice(F.concat("r", F.array_repeat(F.lit(None).cast("string"), F.size("h"))), F.lit(1), F.size("h"))).alias("m"))
    fields = ("url", "original", "timestamp", "statuscode", "status_code", "mimetype", "mime_type", "length", "content_length", "digest")
    return normalise_records(named.select(*[F.element_at("m", f).alias(f) for f in fields]), query_url=query_url, source=source)


_CDXJ = "url string, mime string, `mime-detected` string, status string, digest string, length string, offset string, filename string"


def cdxj(spark: SparkSession, path: str, domain: str | None = None, path_part: str | None = None, source: str = "commoncrawl") -> DataFrame:
    """Rows of shard lines ``urlkey timestamp {json}``; with ``domain`` and ``path_part`` only of urls that hold them."""
    parts = F.split("value", " ", 3)
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 3)
    rows = rows.select(F.get("p", F.lit(0)).alias("urlkey"), F.get("p", F.lit(1)).alias("timestamp"), F.from_json(F.get("p", F.lit(2)), _CDXJ).alias("r")).filter(F.col("r.url").isNotNull())
    bare = urls.strip_scheme(F.lower(F.col("r.url")))
    if domain:
        rows = rows.filter(bare.contains(domain.lower()))
    if path_part:
        rows = rows.filter(bare.contains(path_part.lower()))
    return normalise_records(rows.select("timestamp", "r.*"), source=source)


def shard_ranges(index: DataFrame, prefix: str) -> DataFrame:
    """(file, offset, length) of the shards that may hold a key prefix.

    ``index`` has key, file, offset, length, a row for the first key of each shard. Wanted are the shards
    whose key begins with the prefix, the one before the first key not below it, and one past the last.
    Which shards lie next to each other is known within a range of keys from two extreme values.
    """
    keys = index.select("key", "file", "offset", "length")
    bounds = keys.agg(
        F.max(F.when(F.col("key") < prefix, F.col("key"))).alias("_before"), F.min(F.when((F.col("key") > prefix) & ~F.col("key").startswith(prefix), F.col("key"))).alias("_past")
    )
    joined = keys.join(F.broadcast(bounds))  # one row
    wanted = F.col("key").startswith(prefix) | (F.col("key") == F.col("_before")) | (F.col("key") == F.col("_past"))
    return joined.filter(wanted).select("file", "offset", "length").distinct()


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; lines that are no JSON objects of the schema are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def jsonl_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture rows of object lines; missing fields are ''."""
    fields = ("original", "timestamp", "mimetype", "statuscode", "length", "digest")
    return jsonl(spark, path, ", ".join(f"{f} string" for f in fields)).fillna("").filter(F.col("original") != "")


def as_cdx_strings(captures: DataFrame) -> DataFrame:
    """Stored rows under the names of index answers, all as strings."""
    names = {"urlkey": urls.urlkey(F.col("url")), "timestamp": F.col("timestamp"), "original": F.col("url"), "mimetype": F.col("mime_type"), "statuscode": F.col("status_code"), "digest": F.col("digest"), "length": F.col("content_length")}
    return captures.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in names.items()])


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The http urls of a list, one per line, without blanks."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter(F.lower("url").startswith("http"))


def domain_list(df: DataFrame, column: str) -> DataFrame:
    """Domains of texts that are separated by commas: no scheme, no slash at the end, no empty ones."""
    item = F.explode(F.split(column, ",")).alias("domain")
    clean = F.rtrim(F.regexp_replace(F.trim("domain"), "^https?://", ""), F.lit("/"))
    return df.select(item).select(clean.alias("domain")).filter("domain <> ''")


def crawl_ids(ids: DataFrame, years: list[str], n: int) -> DataFrame:
    """The first ``n`` crawls, newest first, whose id holds one of the years."""
    return ids.filter(F.col("crawl_id").rlike("|".join(years))).orderBy(F.desc("crawl_id")).limit(n)


def html_samples(spark: SparkSession, path: str, files: int = 10, chars: int = 10000) -> DataFrame:
    """The first files of a folder in name order, each with its first characters: a sample of a site's pages."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.substring("value", 1, chars).alias("html"))
    return pages.orderBy("file").limit(files)


def item_files(df: DataFrame, identifier: str, column: str = "json", extensions: list[str] | None = None) -> DataFrame:
    """Files of an item's JSON list without its own metadata and thumbnails; (url, name, size, format)."""
    files = df.select(F.col(identifier).alias("item"), F.explode(F.from_json(F.col(column), "array<struct<name:string,size:string,format:string>>")).alias("f"))
    rows = files.select("item", "f.*").filter(~F.col("name").rlike(r"_(?:meta|files)\.xml\z|(?i)thumb"))
    if extensions:
        rows = rows.filter(F.lower(F.element_at(F.split("name", r"\."), -1)).isin([e.lower() for e in extensions]))
    return rows.select(F.concat(F.lit("archive://"), "item", F.lit("/"), "name").alias("url"), "name", F.coalesce(F.col("size").try_cast("bigint"), F.lit(0)).alias("size"), "format")


_POST = (
    "id string, title string, score bigint, url string, preview struct<images:array<struct<source:struct<url:string>>>>, "
    "media_metadata map<string, struct<status:string, s:struct<u:string>>>"
)


def social_media_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """(id, title, score, url, kind) of the media of posts: direct urls, preview sources, and valid gallery entries."""
    posts = df.select(F.from_json(F.col(column), _POST).alias("p")).select("p.*")
    plain = lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))
    head = ("id", "title", "score")
    direct = posts.filter(F.lower("url").rlike(r"\.(?:jpe?g|png|gif|webp|mp4|webm|gifv)(?:\?.*)?\z")).select(*head, plain(F.col("url")).alias("url"), F.lit("direct").alias("kind"))
    preview = posts.select(*head, F.explode("preview.images").alias("i")).select(*head, plain(F.col("i.source.url")).alias("url"), F.lit("preview").alias("kind"))
    gallery = posts.select(*head, F.explode("media_metadata").alias("k", "m")).filter("m.status = 'valid'").select(*head, plain(F.col("m.s.u")).alias("url"), F.lit("gallery").alias("kind"))
    return reduce(DataFrame.unionByName, [direct, preview, gallery]).filter(F.col("url").isNotNull())


def board_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """(id, url, tags, rating, score) of image board posts, with defaults for what is missing."""
    post = F.from_json(F.col(column), "id string, file_url string, sample_url string, tags string, tag_string string, rating string, score bigint")
    p = df.select(post.alias("p")).select("p.*")
    return p.select(
        "id", falsy_coalesce(F.col("file_url"), F.col("sample_url"), F.lit("")).alias("url"), falsy_coalesce(F.col("tags"), F.col("tag_string"), F.lit("")).alias("tags"),
        F.coalesce("rating", F.lit("")).alias("rating"), F.coalesce("score", F.lit(0)).alias("score"),
    )


def source_hits(df: DataFrame, archive: str, confidence: float) -> DataFrame:
    """Rows of one source as hits: url, archive, timestamp, size, mimetype, status, confidence; a constant confidence per source."""
    rows = normalise_records(df, source=archive)
    return rows.select(
        "url", F.lit(archive).alias("archive"), "timestamp", F.col("content_length").alias("size"), F.col("mime_type").alias("mimetype"),
        F.col("status_code").cast("string").alias("status"), F.lit(float(confidence)).alias("confidence"),
    )


def known_sitemaps(pages: DataFrame, start: str) -> DataFrame:
    """(url, nested, confidence) of all locations that are reached from one sitemap through those that are in ``pages``.

    ``pages`` has url and body. Nested sitemaps are followed until no new one is met, a round being one join of those found last.
    """
    from capturelake.operators.extract import sitemap_locations
    from capturelake.session import materialise

    seen = pages.sparkSession.createDataFrame([(start, True)], "url string, nested boolean")
    frontier = seen
    while True:
        found = pages.join(frontier.filter("nested").select("url"), "url", "left_semi").select(F.explode(sitemap_locations(F.col("body"))).alias("x")).select("x.*").distinct()
        frontier = materialise(found.join(seen, "url", "left_anti"), "sitemaps")
        seen = seen.unionByName(frontier)
        if frontier.filter("nested").isEmpty():
            break
    return seen.filter(F.col("url") != start).withColumn("confidence", F.when(F.col("nested"), 0.0).otherwise(0.8))


def arrival_order(df: DataFrame, column: str = "cached_at", row_id: str = "id") -> DataFrame:
    """Rows with the place of each among those of its domain in order of arrival; a hot domain is spread over several tasks."""
    lines = numbered(df, [F.col("domain"), F.col(column), F.col(row_id)], "_n")
    starts = lines.groupBy(F.col("domain").alias("_d")).agg(F.min("_n").alias("_start"))
    placed = lines.join(starts, F.col("domain").eqNullSafe(F.col("_d")))
    return placed.withColumn("arrival", (F.col("_n") - F.col("_start") + 1).cast("int")).drop("_n", "_start", "_d")


def profiles(df: DataFrame, column: str = "json") -> DataFrame:
    """(id, name, service, indexed, updated, posts) of creator profiles, with defaults for what is missing."""
    p = df.select(F.from_json(F.col(column), "id string, name string, service string, indexed string, updated string, post_count bigint").alias("p")).select("p.*")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return p.select(*[text(c) for c in ("id", "name", "service", "indexed", "updated")], F.coalesce("post_count", F.lit(0)).alias("posts"))


def curated_sites(domains: DataFrame, sites: DataFrame, column: str = "domain") -> DataFrame:
    """Domains with the category and name of the curated site of that domain, letter case ignored: the first one listed.

    ``sites`` has place, domain, category and name; it is combined to one row per domain before the join. NULLs where there is none.
    """
    first = sites.groupBy(F.lower("domain").alias("_d")).agg(F.min_by(F.struct("category", "name"), "place").alias("_s"))
    joined = domains.join(first, F.lower(F.col(column)) == F.col("_d"), "left")
    return joined.select(*domains.columns, F.col("_s.category").alias("site_category"), F.col("_s.name").alias("site_name"))


def one_capture(spark: SparkSession, url: str, timestamp: str, status: int = 200, mime: str = "text/html", length: int = 0, digest: str = "") -> DataFrame:
    """The row of a single capture of one's own crawl, to be appended to an index."""
    row = spark.createDataFrame([(url, timestamp, status, mime, length, digest)], "url string, timestamp string, status_code int, mime_type string, content_length long, digest string")
    return row.withColumn("domain", urls.domain(F.col("url"))).withColumn("source", F.lit("own_crawl")).select(*INDEX_COLUMNS)


def bodyless_captures(index: DataFrame) -> DataFrame:
    """Index rows as captures with an empty body, as an import of an index into an archive makes them."""
    mime = F.create_map(F.lit("content-type"), F.coalesce("mime_type", F.lit("")))
    return index.select("url", "timestamp", "status_code", mime.alias("http_headers"), F.lit(b"").alias("body"), F.lit("cdx_import").alias("source"))
