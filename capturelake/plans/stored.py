"""Queries of the readers and writers: tables written to the shared folder in each format, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions import urls
from capturelake.operators import index, reports, versions
from capturelake.plans.catalog import _DOMAIN, _PATH, query
from capturelake.session import remove_at_end, shared_dir, table
from capturelake.sources import readers, warc, writers

_KEY = f"(array_to_string(list_reverse(string_split({_DOMAIN}, '.')), ',') || ')' || {_PATH})"


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _written(s: SparkSession, name: str, write) -> str:
    """The folder that ``write`` filled; it is removed at the end."""
    path = _place(s, name)
    write(path)
    remove_at_end(s, path)
    return path


_CLEAN = "regexp_full_match(url, '[!-~]+') AND regexp_full_match(timestamp, '[0-9]+') AND (mime_type IS NULL OR regexp_full_match(mime_type, '[!-~]*')) AND NOT starts_with(url, '#')"


def _clean(df: DataFrame) -> DataFrame:
    """Rows whose texts have no blanks, which alone survive an index text."""
    good = F.col("url").rlike(r"^[!-~]+\z") & F.col("timestamp").rlike(r"^[0-9]+\z") & (F.col("mime_type").isNull() | F.col("mime_type").rlike(r"^[!-~]*\z"))
    return df.filter(good & ~F.col("url").startswith("#"))


@query(f"""
SELECT {_DOMAIN} AS domain, url, timestamp, coalesce(status_code, 200) AS status_code, CASE WHEN coalesce(split_part(mime_type, ';', 1), '') = '-' THEN '' ELSE coalesce(split_part(mime_type, ';', 1), '') END AS mime_type,
coalesce(content_size, 0) AS content_length, coalesce(content_hash, '') AS digest, 'cdx_import' AS source FROM records WHERE {_CLEAN}
""")
def stored_cdx_text(s, d):
    """Records exported as an index text with its header line, and imported again."""
    path = _written(s, "cdx", lambda p: writers.write_cdx(_clean(table(s, d, "records")), p))
    return readers.cdx_text(s, path)


@query(f"SELECT url, timestamp FROM records WHERE {_CLEAN}")
def stored_cdx_single(s, d):
    """The same in one file with a header line, in order of url and timestamp."""
    path = _written(s, "cdx1", lambda p: writers.write_cdx(_clean(table(s, d, "records")), p, compat=True, single=True))
    rows = s.read.text(path).filter(~F.col("value").startswith(" CDX"))
    parts = F.split("value", " ")
    return rows.filter(F.size(parts) == 9).select(parts[2].alias("url"), parts[1].alias("timestamp"))


@query("""
SELECT id, coalesce(nullif(url, ''), 'http://asked.test/') AS url, coalesce(timestamp, '') AS timestamp, coalesce(status_code, 200) AS status_code, coalesce(mime_type, '') AS mime_type, coalesce(content_length, 0) AS content_length,
coalesce(digest, '') AS digest, 'asked.test' AS domain FROM (SELECT *, row_number() OVER () AS n FROM cdx_records) WHERE coalesce(status_code, 1) <> 0 AND coalesce(mime_type, '') <> '0' AND coalesce(digest, '') <> '0' AND coalesce(timestamp, '') <> '0' AND coalesce(url, '') <> '0'
""")
def stored_cdx_json(s, d):
    """Each capture as the JSON answer of an index, with a header row; the domain is that of the url asked for. The digest carries the id."""
    c = table(s, d, "cdx_records")
    for name, bad in (("status_code", 0), ("mime_type", "0"), ("digest", "0"), ("timestamp", "0"), ("url", "0")):
        c = c.filter(F.coalesce(F.col(name) != bad, F.lit(True)))
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    header = F.array(*[F.lit(x) for x in ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")])
    row = F.array(F.col("id").cast("string"), text("timestamp"), text("url"), text("mime_type"), text("status_code"), F.concat(F.col("id").cast("string"), F.lit(" "), text("digest")), text("content_length"))
    rows = readers.cdx_json(c.select(F.to_json(F.array(header, row)).alias("json")), query_url="http://asked.test/")
    parts = F.split("digest", " ", 2)
    return rows.select(parts[0].cast("long").alias("id"), "url", "timestamp", "status_code", "mime_type", "content_length", parts[1].alias("digest"), "domain")


@query("""
SELECT DISTINCT url, timestamp, 'commoncrawl' AS source, warc_file, warc_offset FROM (SELECT *, row_number() OVER (PARTITION BY url, timestamp ORDER BY id) AS n FROM cdx_records WHERE coalesce(warc_file, '') <> '' AND coalesce(url, '') NOT IN ('', '0') AND coalesce(timestamp, '') NOT IN ('', '0')) WHERE n = 1
AND NOT EXISTS (SELECT 1 FROM records r WHERE r.url = url AND r.timestamp = timestamp AND FALSE)
""")
def ingested_shard(s, d):
    """Captures with a place in a stored file as the rows of an index shard, under the shard's field names; one row per url and time."""
    c = table(s, d, "cdx_records").filter((F.coalesce("warc_file", F.lit("")) != "") & ~F.coalesce("url", F.lit("")).isin("", "0") & ~F.coalesce("timestamp", F.lit("")).isin("", "0"))
    first = index.first_per(c, [F.col("url"), F.col("timestamp")], [F.col("id")])
    shard = first.select("url", "timestamp", F.col("mime_type").alias("mime-detected"), F.col("status_code").alias("status"), F.col("content_length").alias("length"), "digest", F.col("warc_file").alias("filename"), F.col("warc_offset").alias("offset"))
    rows = index.normalise_records(shard, source="commoncrawl")
    return index.new_rows(rows, table(s, d, "records").filter("1 = 0")).select("url", "timestamp", "source", "warc_file", "warc_offset")


@query("SELECT url, timestamp, CAST(NULL AS VARCHAR) AS note FROM records WHERE FALSE UNION ALL SELECT 'http://own.test/x', '20260101000000', 'own_crawl' UNION ALL SELECT url, timestamp, 'stored' FROM (SELECT url, timestamp FROM records WHERE url IS NOT NULL AND timestamp IS NOT NULL)")
def appended_capture(s, d):
    """The stored captures and one of one's own crawl."""
    stored = table(s, d, "records").filter("url is not null and timestamp is not null").select("url", "timestamp", F.lit("stored").alias("note"))
    return readers.one_capture(s, "http://own.test/x", "20260101000000").select("url", "timestamp", F.col("source").alias("note")).unionByName(stored)


@query("SELECT original, coalesce(mimetype, '') AS mimetype, coalesce(timestamp, '') AS timestamp, '' AS digest FROM (SELECT url AS original, mimetype, timestamp FROM archive_hits) WHERE coalesce(original, '') <> ''")
def stored_jsonl(s, d):
    """Hits as object lines with some fields missing and a broken line among them."""
    hits = table(s, d, "archive_hits").select(F.col("url").alias("original"), "timestamp", "mimetype")
    lines = hits.select(F.to_json(F.struct("*")).alias("value")).unionByName(s.createDataFrame([("{broken",), ("",)], "value string"))
    path = _written(s, "jsonl", lambda p: lines.write.text(p))
    return readers.jsonl_captures(s, path).select("original", "mimetype", "timestamp", "digest")


@query(f"""
SELECT url, timestamp, coalesce(status_code, 200) AS status_code, coalesce(mime_type, '') AS mime_type, 'commoncrawl' AS source FROM cdx_records
WHERE {_CLEAN} AND status_code IS DISTINCT FROM 0 AND coalesce(mime_type, '') <> '0' AND timestamp <> '0' AND url <> '0' AND contains(replace(replace(replace(lower(url), 'http://', ''), 'https://', ''), 'www.', ''), 'pages.') AND contains(replace(replace(replace(lower(url), 'http://', ''), 'https://', ''), 'www.', ''), '/')
""")
def stored_cdxj(s, d):
    """Captures as shard lines, read back for urls that hold a domain and a path."""
    c = _clean(table(s, d, "cdx_records")).filter(~F.coalesce(F.col("status_code") == 0, F.lit(False)) & (F.coalesce("mime_type", F.lit("")) != "0") & (F.col("timestamp") != "0") & (F.col("url") != "0"))
    body = F.to_json(F.struct("url", F.col("mime_type").alias("mime"), F.col("status_code").cast("string").alias("status"), "digest"))
    lines = c.select(F.concat_ws(" ", urls.urlkey(F.col("url")), F.col("timestamp"), body).alias("value"))
    path = _written(s, "cdxj", lambda p: lines.write.text(p))
    return readers.cdxj(s, path, "pages.", "/").select("url", "timestamp", "status_code", "mime_type", "source")


@query(f"""
WITH i AS (SELECT {_DOMAIN} AS key, min(id) AS "offset" FROM cdx_records WHERE url IS NOT NULL GROUP BY 1)
SELECT DISTINCT "offset", "offset" % 100 AS length FROM i WHERE starts_with(key, 'm') OR key = (SELECT max(key) FROM i WHERE key < 'm') OR key = (SELECT min(key) FROM i WHERE key > 'm' AND NOT starts_with(key, 'm'))
""")
def shard_ranges(s, d):
    """Shards that may hold a prefix, of an index with a shard per domain."""
    firsts = table(s, d, "cdx_records").filter("url is not null").groupBy(urls.domain(F.col("url")).alias("key")).agg(F.min("id").alias("offset"))
    found = readers.shard_ranges(firsts.select("key", F.lit("shard").alias("file"), "offset", (F.col("offset") % 100).alias("length")), "m")
    return found.select("offset", "length")


@query("SELECT url, strftime(captured_at, '%Y%m%d%H%M%S') AS timestamp, 200 AS status_code, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND url IS NOT NULL AND captured_at IS NOT NULL")
def stored_warc(s, d):
    """Documents written as response records of compressed files, and read back."""
    warc.register(s)
    docs = table(s, d, "documents").filter("text is not null and url is not null and captured_at is not null")
    rows = docs.select(
        "url", F.date_format("captured_at", "yyyyMMddHHmmss").alias("timestamp"), F.lit(200).alias("status_code"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("http_headers"),
        F.encode("text", "UTF-8").alias("body"), F.lit("").alias("warc_file"), F.lit(0).cast("long").alias("warc_offset"),
    )
    path = _written(s, "warc", lambda p: rows.write.format("warc").mode("append").save(p))
    return s.read.format("warc").load(path).select("url", "timestamp", "status_code", F.sha2("body", 256).alias("content_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13) || chr(10) || chr(13) || chr(10)) AND NOT contains(text, chr(0))")
def stored_slices(s, d):
    """Bodies of stored slices, of which every second one has both heads and the others one."""
    crlf = "\r\n\r\n"
    docs = table(s, d, "documents").filter(F.col("text").isNotNull() & ~F.col("text").contains(crlf) & ~F.col("text").contains("\0"))
    heads = F.when(F.col("doc_id") % 2 == 0, F.lit(f"WARC/1.0{crlf}HTTP/1.1 200 OK{crlf}")).otherwise(F.lit(f"HTTP/1.1 200 OK{crlf}"))
    stored = docs.select("doc_id", F.encode(F.concat(heads, "text"), "UTF-8").alias("data"))
    return stored.select("doc_id", F.sha2(warc.slice_text("data"), 256).alias("content_hash"))


@query("SELECT url, timestamp, coalesce(status_code, 0) AS status_code, coalesce(mime_type, '') AS mime_type, CAST(0 AS BIGINT) AS size, 'cdx_import' AS source FROM cdx_records WHERE url IS NOT NULL")
def bodyless_captures(s, d):
    """An index imported into an archive: captures without a body."""
    rows = readers.bodyless_captures(table(s, d, "cdx_records").filter("url is not null"))
    return rows.select("url", "timestamp", F.coalesce("status_code", F.lit(0)).alias("status_code"), F.element_at("http_headers", "content-type").alias("mime_type"), F.octet_length("body").cast("long").alias("size"), "source")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def stored_blobs(s, d):
    """Bodies packed as stored blobs, written, and unpacked."""
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", writers.packed(F.encode("text", "UTF-8")).alias("blob"))
    path = _written(s, "blobs", lambda p: docs.write.parquet(p))
    return s.read.parquet(path).select("doc_id", F.sha2(writers.unpacked("blob"), 256).alias("content_hash"))


@query("""
SELECT 'crawl-' || y AS crawl_id FROM (SELECT DISTINCT substr(timestamp, 1, 6) AS y FROM cdx_records WHERE regexp_full_match(timestamp, '[0-9]{14}')) WHERE contains('crawl-' || y, '2003') OR contains('crawl-' || y, '2004') ORDER BY 1 DESC LIMIT 5
""")
def crawl_list(s, d):
    months = table(s, d, "cdx_records").filter(F.col("timestamp").rlike(r"^[0-9]{14}\z")).select(F.concat(F.lit("crawl-"), F.substring("timestamp", 1, 6)).alias("crawl_id")).distinct()
    return readers.crawl_ids(months, ["2003", "2004"], 5)


@query("""
SELECT 'archive://' || hit_id || '/f' || hit_id || '.ZIP' AS url, 'f' || hit_id || '.ZIP' AS name, coalesce(size, 0) AS size, archive AS format FROM archive_hits WHERE archive IS NOT NULL
""")
def item_file_lists(s, d):
    """The file list of an item per hit: a file, the item's own metadata, a thumbnail, and a file of another kind."""
    hits = table(s, d, "archive_hits").filter("archive is not null")
    i = F.col("hit_id").cast("string")
    one = lambda name: F.struct(name.alias("name"), F.col("size").cast("string").alias("size"), F.col("archive").alias("format"))
    files = F.array(one(F.concat(F.lit("f"), i, F.lit(".ZIP"))), one(F.concat(i, F.lit("_meta.xml"))), one(F.lit("x_Thumb.zip")), one(F.lit("notes.txt")))
    return readers.item_files(hits.select("hit_id", F.to_json(files).alias("json")), "hit_id", extensions=["zip"])


@query("""
SELECT CAST(discovery_id AS VARCHAR) AS id, coalesce(size, 0) AS score, 'http://m.test/' || discovery_id || '.png?a=1&b=2' AS url, 'direct' AS kind FROM discoveries UNION ALL
SELECT CAST(discovery_id AS VARCHAR), coalesce(size, 0), 'http://p.test/' || discovery_id || '?x&y', 'preview' FROM discoveries UNION ALL
SELECT CAST(discovery_id AS VARCHAR), coalesce(size, 0), 'http://g.test/' || discovery_id || '?1&2', 'gallery' FROM discoveries WHERE discovery_id % 3 = 0
""")
def social_media(s, d):
    """Posts with a direct url, a preview and a gallery entry that is valid in every third."""
    t = table(s, d, "discoveries")
    i = F.col("discovery_id").cast("string")
    preview = F.struct(F.array(F.struct(F.struct(F.concat(F.lit("http://p.test/"), i, F.lit("?x&amp;y")).alias("url")).alias("source"))).alias("images"))
    gallery = F.create_map(F.lit("k"), F.struct(F.when(F.col("discovery_id") % 3 == 0, "valid").otherwise("failed").alias("status"), F.struct(F.concat(F.lit("http://g.test/"), i, F.lit("?1&amp;2")).alias("u")).alias("s")))
    post = F.struct(i.alias("id"), F.lit("t").alias("title"), F.coalesce("size", F.lit(0)).alias("score"), F.concat(F.lit("http://m.test/"), i, F.lit(".png?a=1&amp;b=2")).alias("url"), preview.alias("preview"), gallery.alias("media_metadata"))
    return readers.social_media_rows(t.select(F.to_json(post).alias("json"))).select("id", "score", "url", "kind")


@query("""
SELECT CAST(discovery_id AS VARCHAR) AS id, coalesce(nullif(url, ''), 'sample') AS url, coalesce(category, '') AS tags, '' AS rating, coalesce(size, 0) AS score FROM discoveries WHERE coalesce(url, '') <> '0' AND coalesce(category, '') <> '0'
""")
def board_posts(s, d):
    t = table(s, d, "discoveries").filter((F.coalesce("url", F.lit("")) != "0") & (F.coalesce("category", F.lit("")) != "0"))
    post = F.struct(F.col("discovery_id").cast("string").alias("id"), F.col("url").alias("file_url"), F.lit("sample").alias("sample_url"), F.col("category").alias("tag_string"), F.col("size").alias("score"))
    return readers.board_rows(t.select(F.to_json(post).alias("json")))


@query("SELECT CAST(discovery_id AS VARCHAR) AS id, coalesce(found_by, '') AS name, coalesce(category, '') AS service, '' AS indexed, '' AS updated, coalesce(size, 0) AS posts FROM discoveries")
def creator_profiles(s, d):
    profile = F.struct(F.col("discovery_id").cast("string").alias("id"), F.col("found_by").alias("name"), F.col("category").alias("service"), F.col("size").alias("post_count"))
    return readers.profiles(table(s, d, "discoveries").select(F.to_json(profile).alias("json")))


@query("""
WITH p AS (SELECT DISTINCT lower(substr(domain, 1, 1)) AS c, domain FROM cdx_records WHERE regexp_full_match(domain, '[a-z0-9.-]+'))
SELECT 'http://map.test/' || c || '.xml' AS url, true AS nested, CAST(0.0 AS DOUBLE) AS confidence FROM (SELECT DISTINCT c FROM p) UNION ALL SELECT 'http://map.test/' || c || '/' || domain || '.xml', true, 0.0 FROM p
UNION ALL SELECT DISTINCT 'http://' || domain || '/', false, 0.8 FROM p
""")
def sitemap_tree(s, d):
    """Sitemaps three levels deep: by first letter, by domain, and the pages; followed from the one at the top."""
    p = table(s, d, "cdx_records").select("domain").distinct().filter(F.col("domain").rlike(r"^[a-z0-9.-]+\z")).withColumn("c", F.lower(F.substring("domain", 1, 1)))
    locations = lambda x: F.concat_ws("", F.transform(F.array_sort(F.collect_set(x)), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))))
    letter = F.concat(F.lit("http://map.test/"), "c", F.lit(".xml"))
    own = F.concat(F.lit("http://map.test/"), "c", F.lit("/"), "domain", F.lit(".xml"))
    top = p.agg(locations(letter).alias("body")).select(F.lit("http://map.test/top.xml").alias("url"), "body")
    middle = p.groupBy("c").agg(locations(own).alias("body")).select(letter.alias("url"), "body")
    last = p.select(own.alias("url"), F.concat(F.lit("<loc> http://"), "domain", F.lit("/ </loc>")).alias("body"))
    return readers.known_sitemaps(top.unionByName(middle).unionByName(last), "http://map.test/top.xml")


@query("SELECT trim(url, ' ') AS url FROM discoveries WHERE starts_with(lower(trim(url, ' ')), 'http') AND NOT regexp_matches(url, '[\\r\\n]')")
def stored_url_list(s, d):
    lines = table(s, d, "discoveries").filter(~F.col("url").rlike("[\r\n]")).select(F.concat(F.lit("  "), "url").alias("value"))
    path = _written(s, "urls", lambda p: lines.write.text(p))
    return readers.url_list(s, path)


@query("SELECT DISTINCT domain FROM records WHERE regexp_full_match(domain, '[a-z0-9.-]+')")
def domain_lists(s, d):
    """Domains of comma-separated texts with schemes, slashes and empty items."""
    own = table(s, d, "records").select("domain").distinct().filter(F.col("domain").rlike(r"^[a-z0-9.-]+\z"))
    return readers.domain_list(own.select(F.concat(F.lit(" https://"), "domain", F.lit("/ ,, ")).alias("text")), "text")


@query("SELECT substr(source, 1, 4) AS html FROM (SELECT DISTINCT source FROM archive_sources ORDER BY source LIMIT 3)")
def html_sample_files(s, d):
    """A folder with a file per source: the first three in name order, the first four characters of each."""
    names = table(s, d, "archive_sources").select("source", F.col("source").alias("value")).distinct()
    path = _written(s, "samples", lambda p: names.write.partitionBy("source").text(p))
    return readers.html_samples(s, f"{path}/*/*", files=3, chars=4).select("html")


@query("SELECT id, domain, url, timestamp FROM records")
def stored_tables(s, d):
    """Records as a folder partitioned by year of capture."""
    path = _written(s, "tables", lambda p: writers.write_tables({"records": table(s, d, "records")}, p))
    return s.read.parquet(f"{path}/records").select("id", "domain", "url", "timestamp")


@query("SELECT 'wads' AS query, (SELECT count(*) FROM discoveries WHERE category = 'games') AS count, url, size FROM discoveries WHERE category = 'games'")
def stored_json_result(s, d):
    found = table(s, d, "discoveries").filter("category = 'games'")
    path = _written(s, "result", lambda p: writers.write_json_result(found, p, "wads", ["discovery_id", "url", "size"]))
    schema = "query string, count bigint, result struct<discovery_id:bigint, url:string, size:bigint>"
    return s.read.schema(schema).json(path).select("query", "count", "result.url", "result.size")


@query("""
SELECT m.meta_id, r.id AS record_id FROM (SELECT meta_id, url, timestamp FROM metadata WHERE value IS NOT NULL) m LEFT JOIN (SELECT url, timestamp, min(id) AS id FROM records GROUP BY 1, 2) r ON r.url = m.url AND r.timestamp = m.timestamp
""")
def appended_metadata(s, d):
    rows = table(s, d, "metadata").filter("value is not null").select("url", "timestamp", F.col("meta_id").alias("key"), "value")
    return writers.metadata_rows(rows, table(s, d, "records")).select(F.col("key").alias("meta_id"), "record_id")


@query("SELECT domain, count(DISTINCT substr(timestamp, 1, 4)) AS years, min(substr(timestamp, 1, 4)) AS earliest, max(substr(timestamp, 1, 4)) AS latest FROM cdx_records WHERE regexp_matches(substr(timestamp, 1, 4), '^[0-9]{4}$') GROUP BY 1")
def sparkline_cache(s, d):
    return reports.sparkline_cache(table(s, d, "cdx_records")).select("domain", F.size("counts").cast("long").alias("years"), "earliest", "latest")


@query("SELECT source AS archive, 'hit' AS status, count(*) AS n, CAST(0.5 AS DOUBLE) AS confidence FROM records WHERE FALSE GROUP BY 1 UNION ALL SELECT 'own', coalesce(CAST(nullif(status_code, 0) AS VARCHAR), '200'), count(*), CAST(0.9 AS DOUBLE) FROM records WHERE url IS NOT NULL GROUP BY 2")
def source_hits(s, d):
    """Records as the hits of one source with its constant confidence."""
    hits = readers.source_hits(table(s, d, "records").filter("url is not null"), "own", 0.9)
    return hits.groupBy("archive", "status", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT id, CAST(row_number() OVER (PARTITION BY domain ORDER BY cached_at NULLS FIRST, id) AS INT) AS arrival FROM cdx_records
""")
def arrival_order(s, d):
    return readers.arrival_order(table(s, d, "cdx_records").select("id", "domain", "cached_at")).select("id", "arrival")


@query("""
WITH r AS (SELECT * FROM records WHERE url = (SELECT url FROM records WHERE url IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, url LIMIT 1) ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 1),
b AS (SELECT content_hash, min(id) AS body_id FROM records WHERE content_hash IS NOT NULL GROUP BY 1) SELECT r.id, b.body_id FROM r LEFT JOIN b USING (content_hash)
""")
def latest_with_body(s, d):
    """The latest capture of the busiest url with its body, here the id under which its content was stored first."""
    records = table(s, d, "records")
    busiest = records.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "url").limit(1).collect()
    blobs = records.filter("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("body_id"))
    return versions.capture_at(records, blobs, busiest[0]["url"] if busiest else "").select("id", "body_id")


@query("SELECT source_name, count(*) AS n, count(status) AS known FROM (SELECT 'index' AS source_name, CAST(NULL AS VARCHAR) AS status FROM cdx_records UNION ALL SELECT 'hits', status FROM archive_hits) GROUP BY 1")
def union_of_sources(s, d):
    both = versions.union_sources({"index": table(s, d, "cdx_records").select("url"), "hits": table(s, d, "archive_hits").select("url", "status")})
    return both.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("known"))
