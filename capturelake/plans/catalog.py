"""Queries of the capture operators over the tables of a data directory, each with its SQL where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions import captures as cap
from capturelake.functions import urls
from capturelake.operators import classify, extract, fulltext, index, merkle, reports, versions
from capturelake.session import table
from capturelake.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PREFIX = "http://pages."
WORD = "guestbook"

# the domain and the url with most captures; ties by name
_TOP_DOMAIN = "(SELECT domain FROM cdx_records GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1)"
_TOP_URL = "(SELECT url FROM cdx_records GROUP BY url ORDER BY count(*) DESC, url LIMIT 1)"
_YEARS = "regexp_matches(substr(timestamp, 1, 4), '^[0-9]{4}$')"


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` gives the same rows and column names."""

    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cdx(s, d):
    return table(s, d, "cdx_records")


def _busiest(df: DataFrame, column: str) -> str:
    """The most frequent value: one row to the driver."""
    row = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).collect()
    return row[0][0] if row and row[0][0] is not None else ""


# ---- lookups and filters
@query(f"SELECT id, url, timestamp FROM cdx_records WHERE url = {_TOP_URL}")
def cdx_exact(s, d):
    c = _cdx(s, d)
    return index.search(c, _busiest(c, "url"), limit=None).select("id", "url", "timestamp")


@query(f"SELECT id, url, timestamp, status_code FROM cdx_records WHERE domain = {_TOP_DOMAIN}")
def cdx_domain(s, d):
    c = _cdx(s, d)
    return index.search(c, _busiest(c, "domain"), "domain", limit=None).select("id", "url", "timestamp", "status_code")


@query(f"SELECT id, domain FROM cdx_records WHERE domain = {_TOP_DOMAIN} OR ends_with(domain, '.' || {_TOP_DOMAIN})")
def cdx_subdomains(s, d):
    c = _cdx(s, d)
    return index.search(c, _busiest(c, "domain"), "subdomains", limit=None).select("id", "domain")


@query("SELECT id, url FROM cdx_records WHERE url ILIKE 'http://PAGES.%'")
def cdx_prefix_ci(s, d):
    return index.search(_cdx(s, d), "http://PAGES.", "prefix", limit=None).select("id", "url")


@query(f"SELECT id, url FROM cdx_records WHERE starts_with(url, '{PREFIX}')")
def cdx_prefix_strict(s, d):
    return index.search(_cdx(s, d), PREFIX, "prefix", limit=None, strict=True).select("id", "url")


@query(f"SELECT id, url, status_code FROM cdx_records WHERE starts_with(url, '{PREFIX}') AND status_code = 404")
def cdx_status_filter(s, d):
    return index.search(_cdx(s, d), PREFIX, "prefix", limit=None, status=404, strict=True).select("id", "url", "status_code")


@query(
    "SELECT id, url, mime_type FROM cdx_records WHERE starts_with(url, 'http') AND NOT regexp_full_match(coalesce(mime_type, ''), 'text/html') "
    "AND coalesce(CAST(status_code AS VARCHAR), '') = '200' AND regexp_full_match(coalesce(url, ''), '.*\\.mid')"
)
def cdx_filter_language(s, d):
    filters = ["!mimetype:text/html", "=statuscode:200", r"original:.*\.mid"]
    return index.search(_cdx(s, d), "http", "prefix", limit=None, filters=filters, strict=True).select("id", "url", "mime_type")


@query("SELECT id, timestamp FROM cdx_records WHERE timestamp >= '2004' AND timestamp < '2007'")
def cdx_year_range(s, d):
    return _cdx(s, d).filter(index.between_years(2004, 2006)).select("id", "timestamp")


@query("SELECT id, url FROM cdx_records WHERE ends_with(lower(url), '.mp3') OR contains(lower(url), '.mp3?') OR ends_with(lower(url), '.mid') OR contains(lower(url), '.mid?')")
def cdx_extension(s, d):
    return _cdx(s, d).filter(index.has_extension(["mp3", "mid"])).select("id", "url")


@query("SELECT domain, count(*) AS captures FROM cdx_records WHERE NOT contains(domain, 'mirror.') AND NOT contains(domain, 'www.') GROUP BY domain")
def junk_filter(s, d):
    return reports.counts_by(_cdx(s, d).filter(index.no_junk_host(["mirror.", "www."])), "domain", name="captures")


_EXT_ANY = r"CASE WHEN length(regexp_extract(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '\.([^.]*)$', 1)) <= 6 THEN regexp_extract(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '\.([^.]*)$', 1) ELSE '' END"
_EXT_FILE = _EXT_ANY.replace("([^.]*)$", "([^./]*)$")


@query(f"SELECT id, mime_type FROM cdx_records WHERE NOT contains(coalesce(mime_type, ''), 'text/html') OR ({_EXT_ANY}) IN ('html', 'htm', 'php', 'asp')")
def html_in_binary_filter(s, d):
    return _cdx(s, d).filter(index.no_page_as_file()).select("id", "mime_type")


@query(
    f"SELECT id, content_length FROM (SELECT *, {_EXT_FILE} AS e FROM cdx_records) WHERE content_length >= CASE e WHEN 'mp3' THEN 10000 WHEN 'zip' THEN 5000 ELSE 100 END"
)
def minimum_size(s, d):
    ext = urls.extension_of_file(F.col("url"))
    return _cdx(s, d).filter(index.at_least_size({"mp3": 10000, "zip": 5000}, 100, ext=ext, size=F.col("content_length"))).select("id", "content_length")


@query(
    f"SELECT id, (e IN ('html','htm','php','asp','aspx','jsp','cgi','shtml','pl','') OR ends_with(url, '/')) AS page FROM (SELECT *, {_EXT_FILE} AS e FROM cdx_records)"
)
def page_split(s, d):
    return _cdx(s, d).select("id", index.is_page(F.col("url"), urls.extension_of_file(F.col("url"))).alias("page"))


@query(
    "WITH t AS (SELECT id, CASE WHEN status_code = 200 AND content_length > 100000000 THEN 0 WHEN status_code = 200 AND mime_type = 'audio/midi' THEN 1 WHEN status_code = 200 THEN 2 END AS tier FROM cdx_records) "
    "SELECT id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"
)
def tiered_relaxation(s, d):
    ok = F.col("status_code") == 200
    return index.tiered(_cdx(s, d), [ok & (F.col("content_length") > 100_000_000), ok & (F.col("mime_type") == "audio/midi"), ok]).select("id", "tier")


# ---- collapsing
_KNOWN_DIGEST = "coalesce(digest, '') <> ''"


@query(
    f"SELECT id, digest FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY timestamp, id) AS n FROM cdx_records WHERE {_KNOWN_DIGEST}) WHERE n = 1 "
    f"UNION ALL SELECT id, digest FROM cdx_records WHERE NOT ({_KNOWN_DIGEST})"
)
def cdx_collapse_digest(s, d):
    return index.collapse_digest(_cdx(s, d), [F.col("timestamp"), F.col("id")]).select("id", "digest")


@query(
    f"WITH l AS (SELECT * FROM cdx_records WHERE starts_with(url, '{PREFIX}') ORDER BY timestamp DESC NULLS LAST, id LIMIT 200) "
    f"SELECT id, digest FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY timestamp DESC NULLS LAST, id) AS n FROM l WHERE {_KNOWN_DIGEST}) WHERE n = 1 "
    f"UNION ALL SELECT id, digest FROM l WHERE NOT ({_KNOWN_DIGEST})"
)
def cdx_limit_then_collapse(s, d):
    return index.search(_cdx(s, d), PREFIX, "prefix", limit=200, collapse="digest", strict=True).select("id", "digest")


@query("SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY timestamp NULLS FIRST, id) AS n FROM cdx_records) WHERE n = 1")
def cdx_collapse_urlkey(s, d):
    return index.first_per(_cdx(s, d), [F.col("url")], [F.col("timestamp"), F.col("id")]).select("id", "url")


@query("SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url, substr(timestamp, 1, 6) ORDER BY timestamp NULLS FIRST, id) AS n FROM cdx_records) WHERE n = 1")
def cdx_collapse_ts6(s, d):
    return index.collapse_timestamp(_cdx(s, d), 6, keys=["url"]).select("id", "url")


@query(
    "SELECT id, digest FROM (SELECT *, lag(digest) OVER (PARTITION BY url ORDER BY timestamp NULLS FIRST, id) AS p FROM cdx_records) WHERE digest IS NULL OR digest IS DISTINCT FROM p"
)
def cdx_collapse_adjacent(s, d):
    return index.collapse_adjacent_digest(_cdx(s, d)).select("id", "digest")


@query(
    f"SELECT timestamp, coalesce(content_length, 0) AS length FROM cdx_records WHERE url = {_TOP_URL} AND status_code = 200 ORDER BY content_length DESC NULLS LAST, timestamp, id LIMIT 10"
)
def best_timestamps(s, d):
    c = _cdx(s, d)
    return index.best_timestamps(c, _busiest(c, "url"))


@query("SELECT id, url, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY timestamp DESC NULLS LAST, id DESC) AS n FROM records) WHERE n = 1")
def latest_capture(s, d):
    return versions.latest_capture(table(s, d, "records")).select("id", "url", "timestamp")


@query(f"SELECT count(*) > 0 AS known FROM cdx_records WHERE domain = {_TOP_DOMAIN}")
def has_domain(s, d):
    c = _cdx(s, d)
    return index.has_domain(c, _busiest(c, "domain"))


@query(
    "SELECT l.id, max(r.timestamp) AS found FROM link_graph l LEFT JOIN records r ON r.url = l.source_url AND r.timestamp <= l.source_timestamp GROUP BY l.id, l.source_url, l.source_timestamp"
)
def nearest_capture(s, d):
    asks = table(s, d, "link_graph").select("id", F.col("source_url").alias("url"), F.col("source_timestamp").alias("at"))
    found = index.nearest(asks.select("url", "at").distinct(), table(s, d, "records").filter("timestamp is not null"))
    same = asks["url"].eqNullSafe(found["url"]) & asks["at"].eqNullSafe(found["at"])
    return asks.join(found, same).select("id", "found")


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY CASE WHEN digest IS NULL THEN 'u ' || url ELSE 'd ' || digest END ORDER BY timestamp NULLS FIRST, id) AS n FROM cdx_records) WHERE n = 1")
def first_by_digest_or_url(s, d):
    return index.first_by_digest_or_url(_cdx(s, d), [F.col("timestamp"), F.col("id")]).select("id")


@query("SELECT discovery_id, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(string_split(split_part(url, '?', 1), '/')[-1]) ORDER BY discovery_id) AS n FROM discoveries) WHERE n = 1")
def first_by_file_name(s, d):
    return index.first_by_file_name(table(s, d, "discoveries"), [F.col("discovery_id")]).select("discovery_id", "url")


@query("SELECT discovery_id, url FROM (SELECT *, row_number() OVER (PARTITION BY string_split(split_part(url, '?', 1), '/')[-1] ORDER BY discovery_id) AS n FROM discoveries) WHERE n = 1")
def first_by_exact_file_name(s, d):
    return index.first_by_file_name(table(s, d, "discoveries"), [F.col("discovery_id")], keep_case=True).select("discovery_id", "url")


# ---- targets
@query("SELECT discovery_id FROM discoveries WHERE coalesce(extension, '') <> '' AND ai_confidence >= 0.3")
def likely_files(s, d):
    return table(s, d, "discoveries").filter(index.likely_file(F.col("extension"), F.col("ai_confidence"))).select("discovery_id")


@query("""
SELECT discovery_id FROM (SELECT *, CASE WHEN discovery_id % 5 = 0 THEN 'potential_download' ELSE category END AS c FROM discoveries)
WHERE coalesce(extension, '') IN ('.mid', '.wad') OR c = 'potential_download' AND coalesce(extension, '') NOT IN ('.mid', '.wad', '.zip', '.mp3')
""")
def wanted_targets(s, d):
    """Targets of two extensions; every fifth link is one that only promises a download."""
    category = F.when(F.col("discovery_id") % 5 == 0, "potential_download").otherwise(F.col("category"))
    return table(s, d, "discoveries").filter(index.wanted_target(F.col("extension"), category, [".mid", ".wad"], [".mid", ".wad", ".zip", ".mp3"])).select("discovery_id")


@query("SELECT hit_id, status FROM archive_hits WHERE contains(lower(coalesce(status, '')), '404') OR contains(lower(coalesce(status, '')), '30')")
def hits_by_status_words(s, d):
    return table(s, d, "archive_hits").filter(index.status_among(F.col("status"), ["404", "30"])).select("hit_id", "status")


@query("SELECT id, url FROM cdx_records WHERE domain = " + _TOP_DOMAIN)
def cdx_host(s, d):
    c = _cdx(s, d)
    return index.search(c, "http://" + _busiest(c, "domain") + "/any", "host", limit=None).select("id", "url")


@query("SELECT discovery_id FROM discoveries ORDER BY ai_confidence DESC NULLS LAST, category NULLS FIRST, discovery_id LIMIT 100")
def surest_by_category(s, d):
    order = index.by_confidence_and_category(F.col("ai_confidence"), F.col("category"))
    return table(s, d, "discoveries").orderBy(*order, "discovery_id").limit(100).select("discovery_id")


@query("SELECT hit_id, size FROM archive_hits ORDER BY size DESC NULLS LAST, hit_id LIMIT 100")
def largest_first(s, d):
    return table(s, d, "archive_hits").orderBy(*index.by_size(F.col("size")), "hit_id").limit(100).select("hit_id", "size")


@query("SELECT hit_id FROM archive_hits ORDER BY confidence DESC NULLS LAST, size DESC NULLS LAST, hit_id LIMIT 100")
def surest_by_size(s, d):
    return table(s, d, "archive_hits").orderBy(*index.by_confidence_and_size(F.col("confidence"), F.col("size")), "hit_id").limit(100).select("hit_id")


@query(f"""
SELECT domain, year, captures FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY captures DESC, year) AS k FROM
(SELECT domain, substr(timestamp, 1, 4) AS year, count(*) AS captures FROM cdx_records WHERE {_YEARS} GROUP BY 1, 2)) WHERE k <= 5
""")
def top_years(s, d):
    return reports.top_years(reports.sparkline(_cdx(s, d)))


@query("SELECT extension, count(*) AS n FROM discoveries GROUP BY 1 ORDER BY n DESC, extension NULLS FIRST LIMIT 12")
def top_extensions(s, d):
    return reports.counts_of_top(table(s, d, "discoveries"), "extension", 12)


@query("SELECT mime_type, count(*) AS n FROM (SELECT * FROM cdx_records ORDER BY id LIMIT 100) GROUP BY 1 ORDER BY n DESC, mime_type NULLS FIRST LIMIT 5")
def top_types_of_first(s, d):
    """Media types of the first hundred rows of a result, as its report shows them."""
    return reports.counts_of_top(_cdx(s, d), "mime_type", 5, first=100, order=[F.col("id")])


@query("""
WITH s AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS k, first(category ORDER BY discovery_id) AS site_category, first(found_by ORDER BY discovery_id) AS site_name FROM discoveries WHERE contains(url, '://') GROUP BY 1)
SELECT c.domain, s.site_category, s.site_name FROM (SELECT DISTINCT domain FROM cdx_records) c LEFT JOIN s ON s.k = lower(c.domain)
""")
def curated_sites(s, d):
    """Domains with the first site listed for them, the list being that of the discoveries' hosts."""
    found = table(s, d, "discoveries").filter(F.col("url").contains("://"))
    sites = found.select(F.col("discovery_id").alias("place"), F.upper(urls.domain(F.col("url"))).alias("domain"), "category", F.col("found_by").alias("name"))
    return readers.curated_sites(_cdx(s, d).select("domain").distinct(), sites)


@query("""
SELECT w.wish, c.id FROM (VALUES ('w1', 'http://pages.'), ('w2', 'http://f'), ('w3', 'https'), ('w4', 'http://nowhere')) w(wish, p) JOIN cdx_records c ON starts_with(c.url, w.p)
""")
def prefix_inside_host(s, d):
    wishes = s.createDataFrame([("w1", "prefix", "http://pages."), ("w2", "prefix", "http://f"), ("w3", "prefix", "https"), ("w4", "prefix", "http://nowhere")], "wish string, kind string, pattern string")
    return versions.wish_matches(_cdx(s, d), wishes)


@query("SELECT id, regexp_matches(domain, 'pages\\..*\\.test') AS pages FROM cdx_records")
def name_patterns(s, d):
    return _cdx(s, d).select("id", F.col("domain").rlike(classify.glob_regex("pages.*.test")).alias("pages"))


# ---- aggregates
@query(f"SELECT domain, substr(timestamp, 1, 4) AS year, count(*) AS captures FROM cdx_records WHERE {_YEARS} GROUP BY 1, 2")
def sparkline(s, d):
    return reports.sparkline(_cdx(s, d))


@query(
    f"WITH s AS (SELECT domain, CAST(substr(timestamp, 1, 4) AS INT) AS y, count(*) AS n FROM cdx_records WHERE regexp_full_match(timestamp, '(19|20)[0-9]{{12}}') GROUP BY 1, 2), "
    "b AS (SELECT domain, unnest(range(min(y), max(y) + 1)) AS y FROM s GROUP BY domain) "
    "SELECT b.domain, lpad(CAST(b.y AS VARCHAR), 4, '0') AS year, coalesce(s.n, 0) AS captures FROM b LEFT JOIN s ON s.domain = b.domain AND s.y = b.y"
)
def sparkline_gap_filled(s, d):
    return reports.fill_years(reports.sparkline(_cdx(s, d).filter(F.col("timestamp").rlike(r"^(?:19|20)[0-9]{12}\z"))))


@query(f"SELECT substr(timestamp, 1, 4) AS year, substr(timestamp, 5, 2) AS month, count(*) AS captures FROM cdx_records WHERE domain = {_TOP_DOMAIN} GROUP BY 1, 2")
def domain_month_stats(s, d):
    c = _cdx(s, d)
    return reports.domain_months(c, _busiest(c, "domain"))


@query("SELECT substr(timestamp, 1, 4) AS year, count(*) AS captures FROM records GROUP BY 1")
def all_year_stats(s, d):
    return reports.domain_months(table(s, d, "records"))


@query(
    f"SELECT count(*) AS captures, count(DISTINCT domain) AS domains, count(DISTINCT url) AS urls, count(DISTINCT CASE WHEN {_YEARS} THEN domain END) AS sparklines FROM cdx_records"
)
def index_stats(s, d):
    return reports.index_stats(_cdx(s, d))


@query("SELECT source, count(*) AS captures FROM cdx_records GROUP BY 1")
def captures_by_source(s, d):
    return reports.counts_by(_cdx(s, d), "source", name="captures")


@query("SELECT domain, count(*) AS captures, count(DISTINCT url) AS urls FROM cdx_records GROUP BY 1 ORDER BY captures DESC, domain LIMIT 20")
def top_domains(s, d):
    return reports.top_domains(_cdx(s, d))


@query("SELECT domain, count(*) AS captures, count(DISTINCT url) AS urls FROM cdx_records GROUP BY 1")
def domain_meta(s, d):
    return reports.domain_totals(_cdx(s, d))


@query("""
WITH p AS (SELECT CASE WHEN coalesce(content_hash, '') <> '' THEN content_hash END AS h, count(*) AS n, sum(content_size) AS t, max(compressed_size) AS st FROM records GROUP BY 1),
o AS (SELECT CAST(sum(n) AS BIGINT) AS records, CAST(coalesce(sum(t), 0) AS BIGINT) AS total_bytes, count(h) AS contents, CAST(coalesce(sum(CASE WHEN h IS NOT NULL THEN st END), 0) AS BIGINT) AS stored_bytes FROM p)
SELECT records, total_bytes, contents, stored_bytes, round(100 * (1 - CAST(contents AS DOUBLE) / greatest(records, 1)), 1) AS saved_percent,
round(100.0 * CAST(stored_bytes AS DOUBLE) / greatest(total_bytes, 1), 1) AS stored_percent FROM o
""")
def dedupe_ratio(s, d):
    return reports.dedupe_ratio(table(s, d, "records"))


@query(f"""
SELECT *, (SELECT count(*) FROM link_graph) AS edges, (SELECT count(*) FROM documents WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) AS texts
FROM (SELECT count(DISTINCT domain) AS domains, count(DISTINCT url) AS urls, min(timestamp) AS first, max(timestamp) AS last FROM records), ({SQL['dedupe_ratio']})
""")
def archive_info(s, d):
    return reports.archive_info(table(s, d, "records"), table(s, d, "link_graph"), fulltext.postings(table(s, d, "documents"), stemmed=False))


@query(f"""
SELECT {_EXT_ANY} AS ext, count(*) AS captures, CAST(coalesce(sum(content_length), 0) AS BIGINT) AS bytes,
min(CASE WHEN {_YEARS} THEN substr(timestamp, 1, 4) END) AS first_year, max(CASE WHEN {_YEARS} THEN substr(timestamp, 1, 4) END) AS last_year,
first(url ORDER BY timestamp NULLS FIRST, id) AS sample FROM cdx_records GROUP BY 1
""")
def scan_report_by_ext(s, d):
    return reports.report_by_extension(_cdx(s, d))


def _case(column: str) -> str:
    seen: set[str] = set()
    parts = []
    for name, exts in urls.CATEGORIES:
        own = [e for e in exts.split() if e not in seen]
        seen |= set(own)
        parts.append(f"WHEN {column} IN ({', '.join(repr(e) for e in own)}) THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


@query(f"SELECT {_case('e')} AS category, count(*) AS n FROM (SELECT {_EXT_FILE} AS e FROM discoveries) GROUP BY 1")
def category_counts(s, d):
    return reports.category_counts(table(s, d, "discoveries"))


@query("SELECT status_code, count(*) AS n FROM cdx_records GROUP BY 1")
def outcome_counts(s, d):
    return reports.counts_by(_cdx(s, d), "status_code")


@query("""
WITH p AS (SELECT found_by, count(*) AS files, count(DISTINCT found_on) AS pages FROM discoveries GROUP BY 1)
SELECT *, round(CAST(files AS DOUBLE) / greatest(pages, 1), 4) AS per_page, CAST(row_number() OVER (ORDER BY files DESC, found_by) AS INT) AS rank FROM p
""")
def contributor_leaderboard(s, d):
    return reports.leaderboard(table(s, d, "discoveries"))


@query("""
WITH p AS (SELECT found_by, CAST(sum(coalesce(download_size, 0)) AS BIGINT) AS bytes, max(coalesce(download_size, 0)) AS largest,
first(url ORDER BY coalesce(download_size, 0) DESC, url DESC) AS largest_url FROM discoveries GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, found_by) AS INT) AS rank FROM p
""")
def contributor_bytes(s, d):
    return reports.bytes_board(table(s, d, "discoveries"))


@query("SELECT category AS grp, count(*) AS n, max(size) AS largest, first(url ORDER BY size DESC NULLS LAST, url DESC) AS best FROM discoveries GROUP BY 1")
def best_per_group(s, d):
    return reports.best_per_group(table(s, d, "discoveries"), F.col("category"), F.col("size"), F.col("url"))


@query(f"""
WITH m AS (SELECT DISTINCT domain, url, substr(timestamp, 1, 6) AS m FROM cdx_records WHERE {_YEARS}),
y AS (SELECT domain, substr(m, 1, 4) AS year, count(*) AS n FROM m GROUP BY 1, 2)
SELECT domain, CAST(sum(n) AS BIGINT) AS captures, min(year) AS first_year, max(year) AS last_year, first(year ORDER BY n DESC, year) AS peak_year, max(n) AS peak_captures
FROM y GROUP BY 1 HAVING sum(n) >= 50
""")
def domain_prospect(s, d):
    return reports.domain_prospects(_cdx(s, d))


@query("SELECT archive, status, count(*) AS n, CAST(grouping(archive, status) AS BIGINT) AS level FROM archive_hits GROUP BY GROUPING SETS ((archive), (status), ())")
def hits_grouping_sets(s, d):
    return reports.hits_by(table(s, d, "archive_hits"), "archive", "status")


@query("""
SELECT count(*) AS hits, count(*) FILTER (confidence >= 0.6) AS likely, count(*) FILTER (confidence >= 0.7) AS high,
count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium, count(*) FILTER (confidence < 0.5 OR confidence IS NULL) AS low FROM archive_hits
""")
def confidence_buckets(s, d):
    return reports.confidence_buckets(table(s, d, "archive_hits"))


@query("SELECT category AS key, count(*) AS n FROM (SELECT * FROM discoveries ORDER BY ai_confidence DESC NULLS LAST, discovery_id LIMIT 50) GROUP BY 1")
def top50_counts(s, d):
    return reports.top_slice_counts(table(s, d, "discoveries"), F.col("category"), [F.desc_nulls_last("ai_confidence"), F.col("discovery_id")])


@query("SELECT archive, count(*) AS hits, array_to_string(list_slice(list(hit_id ORDER BY hit_id), 1, 5), ',') AS sample FROM archive_hits GROUP BY 1")
def archive_samples(s, d):
    return reports.samples_per_archive(table(s, d, "archive_hits")).withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query("SELECT count(DISTINCT archive) AS archives FROM archive_hits")
def distinct_archives(s, d):
    return table(s, d, "archive_hits").agg(F.countDistinct("archive").alias("archives"))


@query(
    "SELECT found_by, CAST(row_number() OVER (PARTITION BY found_by ORDER BY extension NULLS FIRST, url NULLS FIRST, discovery_id) AS INT) AS line_no, extension, url, discovery_id FROM discoveries"
)
def findings_log(s, d):
    return reports.findings_log(table(s, d, "discoveries"))


@query("SELECT id, CAST((row_number() OVER (ORDER BY url, id) - 1) % 5 AS INT) AS bucket FROM cdx_records")
def round_robin_buckets(s, d):
    return reports.round_robin(_cdx(s, d).select("id", "url"), 5, [F.col("url"), F.col("id")]).select("id", "bucket")


@query("""
SELECT discovery_id FROM discoveries ORDER BY CASE WHEN extension IN ('.wad', '.mid', '.swf') THEN 0 ELSE 1 END,
CASE category WHEN 'games' THEN 1 WHEN 'audio' THEN 2 WHEN 'software' THEN 3 ELSE 50 END, discovery_id LIMIT 100
""")
def priority_order(s, d):
    place = F.create_map(*[F.lit(x) for kv in {"games": 1, "audio": 2, "software": 3}.items() for x in kv])
    order = [F.when(F.col("extension").isin(".wad", ".mid", ".swf"), 0).otherwise(1), F.coalesce(F.element_at(place, F.col("category")), F.lit(50)), F.col("discovery_id")]
    return table(s, d, "discoveries").orderBy(*order).limit(100).select("discovery_id")


@query("SELECT discovery_id FROM discoveries ORDER BY discovery_id DESC LIMIT 12")
def last_arrivals(s, d):
    return table(s, d, "discoveries").orderBy(F.desc("discovery_id")).limit(12).select("discovery_id")


# ---- scalars
_DOMAIN = "lower(CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE split_part(url, '/', 1) END)"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@query(f"SELECT id, {_DOMAIN} AS domain_of, {_PATH} AS path, lower(rtrim(url, '/')) AS merge_key, split_part(url, '#', 1) AS bare FROM cdx_records")
def url_parts(s, d):
    u = F.col("url")
    return _cdx(s, d).select("id", urls.domain(u).alias("domain_of"), urls.path(u).alias("path"), urls.merge_key(u).alias("merge_key"), urls.without_fragment(u).alias("bare"))


@query(f"""
SELECT id, array_to_string(list_reverse(string_split(replace(split_part(split_part(string_split(url, '//')[-1], '/', 1), '?', 1), 'www.', ''), '.')), ',') || ')' AS surt,
array_to_string(list_reverse(string_split({_DOMAIN}, '.')), ',') || ')' || {_PATH} AS urlkey,
replace(replace(replace(url, 'http://', ''), 'https://', ''), 'www.', '') AS bare FROM cdx_records
""")
def surt_key(s, d):
    u = F.col("url")
    return _cdx(s, d).select("id", urls.surt(u).alias("surt"), urls.urlkey(u).alias("urlkey"), urls.strip_scheme(u).alias("bare"))


@query(f"""
SELECT id, {_EXT_ANY} AS anywhere, {_EXT_FILE} AS of_file,
CASE WHEN contains(string_split(url, '/')[-1], '.') THEN split_part(lower(string_split(url, '.')[-1]), '?', 1) ELSE '' END AS of_text,
{_case(_EXT_FILE)} AS category FROM cdx_records
""")
def ext_variants(s, d):
    u = F.col("url")
    file = urls.extension_of_file(u)
    return _cdx(s, d).select("id", urls.extension_anywhere(u).alias("anywhere"), file.alias("of_file"), urls.extension_of_text(u).alias("of_text"), urls.category(file).alias("category"))


@query(r"""
SELECT discovery_id, substr(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+\z', '', 'g'), 1, 196) AS safe FROM discoveries
""")
def safe_filename(s, d):
    return table(s, d, "discoveries").select("discovery_id", F.substring(urls.sanitise(F.col("url")), 1, 196).alias("safe"))


@query(f"""
WITH x AS (SELECT discovery_id, url, {_EXT_FILE} AS e, url_decode(replace(string_split(split_part(url, '?', 1), '/')[-1], '+', '%2B')) AS last FROM discoveries WHERE url IS NOT NULL AND NOT regexp_matches(url, '%(?:[^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)|%[89A-Fa-f]')),
n AS (SELECT discovery_id, e, CASE WHEN last = '' THEN 'file_' || substr(md5(url), 1, 8) ELSE last END AS named FROM x)
SELECT discovery_id, substr(regexp_replace(CASE WHEN e = '' OR ends_with(lower(named), '.' || e) THEN named ELSE named || '.' || e END, '[<>:"/\\\\|?*]', '_', 'g'), 1, 200) AS filename FROM n
""")
def url_filenames(s, d):
    u = F.col("url")
    rows = table(s, d, "discoveries").filter(u.isNotNull() & ~u.rlike("%(?:[^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?\\z)|%[89A-Fa-f]"))
    return rows.select("discovery_id", urls.filename(u, urls.extension_of_file(u)).alias("filename"))


@query("SELECT id, 'archive://web/' || timestamp || 'id_/' || url AS snapshot FROM records")
def snapshot_url(s, d):
    return table(s, d, "records").select("id", urls.snapshot_url("archive://web", F.col("timestamp"), F.col("url")).alias("snapshot"))


@query("""
WITH y AS (SELECT id, list_transform(regexp_extract_all(url, '((?:19|20)[0-9]{2})', 1), lambda x: CAST(x AS INT)) AS ys FROM cdx_records)
SELECT id, list_min(ys) AS first_year, list_max(ys) AS last_year FROM y WHERE len(ys) > 0
""")
def years_in_url(s, d):
    y = urls.years_in(F.col("url"))
    return _cdx(s, d).select("id", y.alias("y")).filter("y is not null").select("id", F.col("y.first").alias("first_year"), F.col("y.last").alias("last_year"))


@query(r"""
SELECT id, regexp_matches(url, '(?i)[?&](?:x-amz-signature|signature|sig|token|sv|se|sp|spr)=') AS signed,
CASE WHEN regexp_matches(url, '(?i)[?&](?:x-amz-signature|signature|sig|token|sv|se|sp|spr)=') THEN split_part(url, '?', 1) ELSE url END AS shown FROM cdx_records
""")
def signed_urls(s, d):
    return _cdx(s, d).select("id", urls.is_signed(F.col("url")).alias("signed"), urls.redacted(F.col("url")).alias("shown"))


@query(
    "SELECT version_id, substr(translate(timestamp, '-:TZ', ''), 1, 14) AS compact, concat_ws('-', substr(timestamp, 1, 4), substr(timestamp, 5, 2), substr(timestamp, 7, 2)) AS label FROM version_chains"
)
def timestamp_forms(s, d):
    t = F.col("timestamp")
    return table(s, d, "version_chains").select("version_id", cap.compact(t).alias("compact"), cap.label(t).alias("label"))


@query("""
SELECT discovery_id, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0)
ELSE printf('%.2f GB', size / 1073741824.0) END AS shown FROM discoveries WHERE size IS NOT NULL
""")
def human_bytes(s, d):
    return table(s, d, "discoveries").filter("size is not null").select("discovery_id", cap.human_bytes(F.col("size")).alias("shown"))


@query("SELECT doc_id, sha256(text) AS content_hash, md5(url) AS url_digest FROM documents WHERE text IS NOT NULL")
def content_hashes(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", cap.content_hash(F.col("text")).alias("content_hash"), cap.url_digest(F.col("url")).alias("url_digest"))


_KINDS = [n for n, _ in cap.MAGIC] + ["unknown"]


@query(f"SELECT doc_id, ([{', '.join(repr(k) for k in _KINDS)}])[doc_id % {len(_KINDS)} + 1] AS kind FROM documents WHERE text IS NOT NULL")
def magic_type(s, d):
    """Texts behind the first bytes of each format in turn, and of none."""
    prefixes = F.array(*[F.lit(p) for _, p in cap.MAGIC], F.lit("00"))
    prefix = F.unhex(F.element_at(prefixes, (F.col("doc_id") % len(_KINDS) + 1).cast("int")))
    return table(s, d, "documents").filter("text is not null").select("doc_id", cap.magic_type(F.concat(prefix, F.encode("text", "UTF-8"))).alias("kind"))


# ---- extraction
@query("""
SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)href="([^"]+)"', 1))) AS href FROM documents WHERE text IS NOT NULL
""")
def html_links(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(extract.hrefs(F.col("text"))).alias("href"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL
""")
def stripped_text(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.trim(cap.stripped(F.col("text"))).alias("plain"))


@query(r"""
WITH h AS (SELECT doc_id, domain, lower(unnest(regexp_extract_all(text, '(?i)\b(?:src|href|data-src|poster|action)=["''](?:https?:)?//([^/"''?#\s]+)', 1))) AS host FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, host FROM h WHERE NOT contains(host, domain)
""")
def cdn_hosts(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(extract.asset_hosts(F.col("text"), F.col("domain"))).alias("host"))


@query(r"""
SELECT doc_id, coalesce(regexp_matches(text, '(?i)<title>\s*index of|>\s*parent directory\s*<|\?C=[NMSD](?:;|&amp;)O=[AD]|directory listing for|\[to parent directory\]'), false) AS listing FROM documents
""")
def directory_listing_pages(s, d):
    return table(s, d, "documents").select("doc_id", extract.is_directory_listing(F.col("text")).alias("listing"))


# ---- links and versions
@query("SELECT target_url, count(*) AS links, count(DISTINCT source_url) AS pages FROM link_graph WHERE coalesce(target_url, '') <> '' GROUP BY 1")
def link_in_degree(s, d):
    return versions.in_degree(table(s, d, "link_graph"))


@query("SELECT id, target_url FROM link_graph WHERE source_url = (SELECT source_url FROM link_graph GROUP BY 1 ORDER BY count(*) DESC, source_url LIMIT 1)")
def links_from(s, d):
    g = table(s, d, "link_graph")
    return versions.links_from(g, _busiest(g, "source_url")).select("id", "target_url")


@query("SELECT id, source_url FROM link_graph WHERE target_url = (SELECT target_url FROM link_graph WHERE target_url LIKE 'http%' GROUP BY 1 ORDER BY count(*) DESC, target_url LIMIT 1)")
def links_to(s, d):
    g = table(s, d, "link_graph")
    return versions.links_to(g, _busiest(g.filter(F.col("target_url").startswith("http")), "target_url")).select("id", "source_url")


@query("""
WITH e AS (SELECT DISTINCT source_url, target_url FROM link_graph WHERE coalesce(target_url, '') <> ''), o AS (SELECT source_url AS via, count(*) AS n FROM e GROUP BY 1)
SELECT e.source_url, CAST(sum(o.n) AS BIGINT) AS paths FROM e JOIN o ON o.via = e.target_url GROUP BY 1
""")
def two_hop_links(s, d):
    """Paths of two edges per page: edges joined with the degree of their target, so that no pair of edges is made."""
    edges = table(s, d, "link_graph").filter(F.coalesce("target_url", F.lit("")) != "").select("source_url", "target_url").distinct()
    degree = edges.groupBy(F.col("source_url").alias("via")).agg(F.count(F.lit(1)).alias("n"))
    return edges.join(degree, F.col("target_url") == F.col("via")).groupBy("source_url").agg(F.sum("n").alias("paths"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_url, target_url FROM link_graph WHERE coalesce(target_url, '') <> ''),
r AS (SELECT (SELECT source_url FROM link_graph GROUP BY 1 ORDER BY count(*) DESC, source_url LIMIT 1) AS url UNION SELECT e.target_url FROM r JOIN e ON e.source_url = r.url)
SELECT url FROM r
""")
def reachable_pages(s, d):
    """All pages that links lead to from the page with most of them, to the fixpoint."""
    g = table(s, d, "link_graph")
    return versions.reachable(g, _busiest(g, "source_url")).select("url")


_CHAIN = "CASE WHEN p IS NULL THEN 'new' WHEN p = content_hash THEN 'unchanged' ELSE 'content_update' END"


@query(
    f"SELECT id, p AS prev_hash, {_CHAIN} AS change FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY timestamp NULLS FIRST, id) AS p FROM records WHERE content_hash IS NOT NULL)"
)
def version_chain(s, d):
    return versions.version_chain(table(s, d, "records")).select("id", "prev_hash", "change")


@query(f"""
WITH w AS (SELECT *, max(struct_pack(t := timestamp, i := id, h := content_hash)) OVER (PARTITION BY url ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).h AS p FROM records WHERE content_hash IS NOT NULL)
SELECT id, p AS prev_hash, {_CHAIN} AS change FROM w
""")
def version_chain_insert_order(s, d):
    return versions.version_chain_by_arrival(table(s, d, "records")).select("id", "prev_hash", "change")


@query(
    f"SELECT {_CHAIN} AS change, count(*) AS n FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY timestamp NULLS FIRST, id) AS p FROM records WHERE content_hash IS NOT NULL) GROUP BY 1"
)
def change_type_counts(s, d):
    return reports.counts_by(versions.version_chain(table(s, d, "records")), "change")


@query(
    "SELECT r.id, coalesce(m.n, 0) AS attributes FROM records r LEFT JOIN (SELECT url, timestamp, count(*) AS n FROM metadata GROUP BY 1, 2) m ON m.url = r.url AND m.timestamp = r.timestamp"
)
def record_metadata(s, d):
    return versions.with_metadata(table(s, d, "records"), table(s, d, "metadata")).select("id", "attributes")


@query(
    "SELECT l.id, coalesce(r.t, '20100101000000') AS page_time FROM link_graph l LEFT JOIN (SELECT url, max(timestamp) AS t FROM records GROUP BY 1) r ON r.url = l.source_url"
)
def link_page_times(s, d):
    return versions.link_page_times(table(s, d, "link_graph"), table(s, d, "records")).select("id", "page_time")


@query("""
SELECT content_hash, max(content_size) AS content_size FROM records WHERE coalesce(content_hash, '') <> '' AND content_hash NOT IN (SELECT content_hash FROM version_chains WHERE content_hash IS NOT NULL) GROUP BY 1
""")
def new_blobs_anti(s, d):
    return versions.new_blobs(table(s, d, "records"), table(s, d, "version_chains").filter("content_hash is not null"))


@query("""
SELECT url, CASE WHEN url IN (SELECT url FROM cdx_records WHERE url IS NOT NULL) THEN 'first' WHEN url IN (SELECT url FROM records WHERE url IS NOT NULL) THEN 'second' ELSE 'missing' END AS found_in
FROM (SELECT DISTINCT target_url AS url FROM link_graph WHERE target_url IS NOT NULL)
""")
def lookup_found_missing(s, d):
    wanted = table(s, d, "link_graph").filter("target_url is not null").select(F.col("target_url").alias("url"))
    return versions.found_or_missing(wanted, _cdx(s, d), table(s, d, "records"))


@query(f"""
WITH w AS (SELECT 'w' || row_number() OVER (ORDER BY domain) AS wish, domain AS d, 'http://' || domain || '/' AS p FROM (SELECT domain FROM cdx_records GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 18))
SELECT w.wish, c.id FROM w JOIN cdx_records c ON lower(c.domain) = w.d AND starts_with(c.url, w.p)
""")
def prefix_theta_join(s, d):
    c = _cdx(s, d)
    names = sorted(r["domain"] for r in reports.top_domains(c, 18).collect())
    wishes = s.createDataFrame([(f"w{k + 1}", "prefix", f"http://{n}/") for k, n in enumerate(names)], "wish string, kind string, pattern string")
    return versions.wish_matches(c, wishes)


@query("""
SELECT domain, replace(t, '{domain}', domain) AS variant FROM (SELECT DISTINCT domain FROM records), (VALUES ('cdn.{domain}'), ('static.{domain}'), ('{domain}/files')) v(t)
""")
def cdn_variant_expand(s, d):
    return versions.expand_templates(table(s, d, "records").select("domain").distinct(), ["cdn.{domain}", "static.{domain}", "{domain}/files", "x.{hash}.net"])


@query("""
SELECT merge_key, hit_id, size FROM (SELECT *, lower(rtrim(url, '/')) AS merge_key, row_number() OVER (PARTITION BY lower(rtrim(url, '/')) ORDER BY coalesce(size, 0) DESC,
CASE lower(trim(archive)) WHEN 'wayback' THEN 0 WHEN 'commoncrawl' THEN 1 ELSE 9 END, hit_id) AS n FROM archive_hits) WHERE n = 1
""")
def union_keep_largest(s, d):
    name = F.lower(F.trim("archive"))
    rank = F.when(name == "wayback", 0).when(name == "commoncrawl", 1).otherwise(9)
    best = versions.keep_largest(table(s, d, "archive_hits"), key=urls.merge_key(F.col("url")), size=F.col("size"), rank=rank, tie=F.col("hit_id"))
    return best.select("merge_key", "hit_id", "size")


@query("""
WITH u AS (SELECT url, 0 AS source_no, id FROM cdx_records UNION ALL SELECT url, 1, id FROM records UNION ALL SELECT url, 2, hit_id FROM archive_hits)
SELECT url, source_no, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_no, id) AS n FROM u) WHERE n = 1
""")
def union_first_seen(s, d):
    parts = [_cdx(s, d).select("url", F.lit(0).alias("source_no"), "id"), table(s, d, "records").select("url", F.lit(1).alias("source_no"), "id"), table(s, d, "archive_hits").select("url", F.lit(2).alias("source_no"), F.col("hit_id").alias("id"))]
    return index.first_per(parts[0].unionByName(parts[1]).unionByName(parts[2]), [F.col("url")], [F.col("source_no"), F.col("id")])


@query("SELECT id, 1 AS source_no FROM records WHERE status_code = 200")
def first_nonempty_source(s, d):
    return versions.first_nonempty([_cdx(s, d).filter("status_code = 999").select("id"), table(s, d, "records").filter("status_code = 200").select("id"), _cdx(s, d).select("id")])


@query("SELECT c.id, c.url FROM cdx_records c WHERE c.url NOT IN (SELECT url FROM discoveries WHERE url IS NOT NULL)")
def unseen_urls(s, d):
    return index.unseen(_cdx(s, d).filter("url is not null"), table(s, d, "discoveries"), F.col("url"), "url").select("id", "url")


@query("""
SELECT url, timestamp, source FROM (SELECT DISTINCT url, timestamp, source FROM cdx_records) c
WHERE url IS NULL OR timestamp IS NULL OR source IS NULL OR NOT EXISTS (SELECT 1 FROM records r WHERE r.url = c.url AND r.timestamp = c.timestamp AND r.source = c.source)
""")
def ingest_new_rows(s, d):
    return index.new_rows(_cdx(s, d).select("url", "timestamp", "source"), table(s, d, "records"))


# ---- texts
@query(f"""
SELECT doc_id, CAST(len(string_split(lower(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '{WORD}')) - 1 AS INT) AS hits FROM documents
WHERE contains(lower(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '{WORD}')
""")
def keyword_hit_counts(s, d):
    hits = F.size(cap.keyword_hits(F.col("text"), F.lit(WORD)))
    return table(s, d, "documents").filter(F.lower("text").contains(WORD)).select("doc_id", hits.alias("hits")).filter("hits > 0")


_STRIPPED = "regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b]+', ' ', 'g')"


@query(f"""
WITH t AS (SELECT doc_id, {_STRIPPED} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, t, string_split(lower(t), '{WORD}') AS parts FROM t WHERE contains(lower(t), '{WORD}')),
k AS (SELECT doc_id, t, parts, unnest(range(1, len(parts))) AS k FROM p), h AS (SELECT doc_id, t, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * {len(WORD)} AS INT) AS position FROM k)
SELECT doc_id, position, trim(substr(t, greatest(position - 120, 0) + 1, position - greatest(position - 120, 0) + {len(WORD)} + 120)) AS context FROM h
""")
def keyword_hits(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(cap.keyword_hits(F.col("text"), F.lit(WORD))).alias("h")).select("doc_id", "h.*")


@query(f"""
WITH p AS (SELECT doc_id, text, instr(lower(text), '{WORD}') AS pos FROM documents WHERE contains(lower(text), '{WORD}'))
SELECT doc_id, substr(trim(regexp_replace(replace(substr(text, greatest(pos - 100, 1), pos - greatest(pos - 100, 1) + {len(WORD)} + 100), chr(10), ' '), '<[^>]+>', '', 'g')), 1, 200) AS snippet FROM p
""")
def keyword_first_snippet(s, d):
    return table(s, d, "documents").select("doc_id", cap.first_snippet(F.col("text"), F.lit(WORD)).alias("snippet")).filter("snippet is not null")


@query("""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS doc FROM t WHERE w IN ('server', 'guestbook') GROUP BY 1 HAVING count(*) = 2
""")
def term_and_search(s, d):
    return fulltext.search_all(fulltext.postings(table(s, d, "documents"), stemmed=False), ["server", "guestbook"], stemmed=False)


@query(r"SELECT doc_id AS doc FROM documents WHERE regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}])error[^\p{L}\p{N}]+page(?:[^\p{L}\p{N}]|$)')")
def phrase_search(s, d):
    return fulltext.search(fulltext.postings(table(s, d, "documents"), stemmed=False), '"error page"', stemmed=False)


@query(r"""
WITH t AS (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(substr(text, 1, 1000)), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc, count(*) AS words, count(DISTINCT w) AS terms FROM t GROUP BY 1
""")
def capped_postings(s, d):
    """Words of the first thousand characters of each text: the cap of an archive's text field, which is a parameter."""
    index_ = fulltext.postings(table(s, d, "documents"), stemmed=False, cap=1000)
    return index_.groupBy("doc").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("term").alias("terms"))


@query()
def stemmed_search(s, d):
    return fulltext.search(fulltext.postings(table(s, d, "documents")), "downloads AND archive* OR mirrored")


# ---- classification
def _topic_sql(low: str) -> str:
    scores = [" + ".join(f"CAST(contains({low}, '{w}') AS INT)" for w in words.split()) for _, words in classify.TOPICS]
    best = f"greatest({', '.join(f'({x})' for x in scores)})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN ({x}) = {best} THEN '{n}'" for x, (n, _) in zip(scores, classify.TOPICS)) + " END"


@query(f"SELECT doc_id, {_topic_sql('low')} AS topic FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def site_topic(s, d):
    return table(s, d, "documents").select("doc_id", classify.site_topic(F.col("text")).alias("topic"))


@query(f"""
WITH u AS (SELECT DISTINCT domain, url FROM cdx_records), p AS (SELECT domain, url, string_split(regexp_extract({_PATH}, '^(.*/)?', 1), '/') AS parts FROM u),
x AS (SELECT domain, url, unnest(CASE WHEN len(parts) >= 2 THEN list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/') || '/') ELSE ['/'] END) AS directory FROM p)
SELECT domain, directory, count(*) AS urls FROM x GROUP BY 1, 2
""")
def dir_tree(s, d):
    return classify.directory_tree(_cdx(s, d))


@query(f"""
WITH u AS (SELECT DISTINCT domain, {_PATH} AS p, regexp_extract({_PATH}, '([^/]*)$', 1) AS n, url FROM cdx_records),
g AS (SELECT domain, count(*) FILTER (regexp_matches(n, '[0-9]+\\.[A-Za-z0-9]+$')) AS numbered, count(*) FILTER (regexp_matches(p, '/(?:19|20)[0-9]{{2}}/')) AS dated,
count(*) FILTER (contains(n, '_')) AS underscores, count(*) FILTER (contains(n, '-')) AS hyphens FROM u GROUP BY 1)
SELECT *, CASE WHEN underscores > hyphens THEN 'underscore' WHEN hyphens > underscores THEN 'hyphen' ELSE 'mixed' END AS style FROM g
""")
def naming_conventions(s, d):
    return classify.naming_conventions(_cdx(s, d))


_WORDS = [(k, w) for k, (_, ws) in enumerate(classify.TOPICS) for w in ws.split()]
_SCORES = [" + ".join(f"w{i}" for i, (t, _) in enumerate(_WORDS) if t == k) for k in range(len(classify.TOPICS))]
_BEST = "greatest(" + ", ".join(f"({x})" for x in _SCORES) + ")"


@query(f"""
WITH u AS (SELECT DISTINCT domain, url FROM cdx_records), x AS (SELECT domain, url, {_EXT_FILE} AS e, list_transform(regexp_extract_all(url, '(?:19|20)[0-9]{{2}}'), lambda y: CAST(y AS INT)) AS ys FROM u),
g AS (SELECT domain, count(*) AS urls, coalesce(array_to_string(list_sort(list(DISTINCT e) FILTER (e <> '')), ','), '') AS extensions, min(list_min(ys)) AS first_year, max(list_max(ys)) AS last_year,
{', '.join(f"bool_or(regexp_matches(url, '{p}')) AS m{i}" for i, (_, p) in enumerate(classify.URL_MARKS))}, {', '.join(f"CAST(bool_or(contains(lower(url), '{w}')) AS INT) AS w{i}" for i, (_, w) in enumerate(_WORDS))} FROM x GROUP BY 1)
SELECT domain, urls, extensions, coalesce(nullif(concat_ws(', ', {', '.join(f"CASE WHEN m{i} THEN '{n}' END" for i, (n, _) in enumerate(classify.URL_MARKS))}), ''), 'unknown') AS software,
CASE WHEN {_BEST} = 0 THEN 'general' {' '.join(f"WHEN ({x}) = {_BEST} THEN '{n}'" for x, (n, _) in zip(_SCORES, classify.TOPICS))} END AS topic, first_year, last_year FROM g
""")
def site_profile(s, d):
    return classify.site_profile(_cdx(s, d))


_RULE_SQL = " UNION ALL ".join(
    f"SELECT domain, {k} AS seq, '{p}' AS path, CAST({c} AS DOUBLE) AS confidence, '{r}' AS reason FROM k GROUP BY domain"
    + (f" HAVING bool_or(regexp_matches(url, '{dict(classify.URL_MARKS)[m]}'))" if m else "")
    for k, (m, p, c, r) in enumerate(classify.PATH_RULES)
)


@query(f"""
WITH k AS (SELECT DISTINCT domain, url FROM cdx_records WHERE url IS NOT NULL), y AS (SELECT domain, url, regexp_extract(url, '((?:19|20)[0-9]{{2}})', 1) AS y FROM k),
n AS (SELECT DISTINCT domain, replace(url, y, CAST(CAST(y AS INT) + o AS VARCHAR)) AS url FROM y, (VALUES (-2), (-1), (1), (2)) v(o) WHERE y <> ''),
c AS ({_RULE_SQL} UNION ALL SELECT domain, {len(classify.PATH_RULES)}, {_PATH}, CAST(0.6 AS DOUBLE), 'year series' FROM n WHERE url NOT IN (SELECT url FROM k)),
f AS (SELECT domain, path, first(confidence ORDER BY seq) AS confidence, first(reason ORDER BY seq) AS reason FROM c GROUP BY 1, 2)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT domain, {_PATH} AS path FROM k) p WHERE p.domain = f.domain AND p.path = f.path)
""")
def path_predictions(s, d):
    return classify.path_predictions(_cdx(s, d))


@query("""
WITH c AS (SELECT domain, count(*) AS n FROM cdx_records GROUP BY 1), v AS (SELECT domain, CASE WHEN n >= 1000 THEN 40 ELSE 0 END + CASE WHEN n >= 100 THEN 20 ELSE 0 END + CASE WHEN length(domain) <= 16 THEN 30 ELSE 0 END AS score,
concat_ws('; ', CASE WHEN n >= 1000 THEN 'very large' END, CASE WHEN n >= 100 THEN 'large' END, CASE WHEN length(domain) <= 16 THEN 'short' END) AS reasons FROM c)
SELECT domain, CAST(score AS INT) AS score, reasons, CASE WHEN score >= 80 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS label FROM v
""")
def domain_value(s, d):
    """An additive score with rules of the caller; these three only show it."""
    n = F.col("captures")
    score, reasons = classify.additive_score([(n >= 1000, 40, "very large"), (n >= 100, 20, "large"), (F.length("domain") <= 16, 30, "short")])
    rows = reports.counts_by(_cdx(s, d), "domain", name="captures").select("domain", score.cast("int").alias("score"), reasons.alias("reasons"))
    return rows.withColumn("label", classify.score_label(F.col("score")))


@query(r"SELECT id, CASE WHEN regexp_matches(url, '(?i)\.(mp3|mid)\b') THEN 'sound' WHEN regexp_matches(url, '(?i)\.(gif|jpg)\b') THEN 'picture' ELSE 'none' END AS kind FROM cdx_records")
def ordered_classify(s, d):
    return _cdx(s, d).select("id", urls.ordered_class(F.col("url"), [("sound", r"(?i)\.(mp3|mid)\b"), ("picture", r"(?i)\.(gif|jpg)\b")], "none").alias("kind"))


@query(f"""
SELECT discovery_id, CASE WHEN e IN ('wad', 'lzh') THEN 'rare' WHEN c IN ('audio', 'video', 'flash') THEN 'media' WHEN ai_confidence > 0 THEN 'analysed' WHEN c = 'image' THEN 'image' ELSE 'file' END AS badge
FROM (SELECT *, {_EXT_FILE} AS e, {_case(_EXT_FILE)} AS c FROM discoveries)
""")
def discovery_badge(s, d):
    ext = urls.extension_of_file(F.col("url"))
    return table(s, d, "discoveries").select("discovery_id", classify.badge(ext, F.col("ai_confidence"), urls.category(ext), ["wad", "lzh"]).alias("badge"))


@query("""
WITH k AS (SELECT DISTINCT domain, url FROM cdx_records), y AS (SELECT domain, url, regexp_extract(url, '((?:19|20)[0-9]{2})', 1) AS y FROM k),
p AS (SELECT domain, url, replace(url, y, CAST(CAST(y AS INT) + o AS VARCHAR)) AS predicted FROM y, (VALUES (-2), (-1), (1), (2)) v(o) WHERE y <> '')
SELECT domain, min(url) AS url, predicted FROM p WHERE predicted NOT IN (SELECT url FROM k WHERE url IS NOT NULL) GROUP BY domain, predicted
""")
def year_predictions(s, d):
    return classify.year_predictions(_cdx(s, d).filter("url is not null"))


# ---- integrity and export
def _root_sql(leaves: str) -> str:
    """Root over ``leaves`` (i from 0, h) and their number, level by level."""
    return f"""
WITH RECURSIVE l0 AS ({leaves}), t AS (SELECT 0 AS lv, i, h, (SELECT count(*) FROM l0) AS n FROM l0
 UNION ALL SELECT lv + 1, i // 2, sha256(h || coalesce(nh, h)), (n + 1) // 2 FROM (SELECT lv, i, h, n, lead(h) OVER (PARTITION BY lv ORDER BY i) AS nh FROM t) x WHERE i % 2 = 0 AND n > 1)
SELECT coalesce((SELECT h FROM t WHERE n = 1), sha256('')) AS root, (SELECT count(*) FROM l0) AS leaves"""


@query(_root_sql("SELECT row_number() OVER (ORDER BY id) - 1 AS i, content_hash AS h FROM records WHERE coalesce(content_hash, '') <> ''"))
def merkle_root(s, d):
    return merkle.merkle_root(table(s, d, "records"), "content_hash", [F.col("id")])


_LEAVES = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256(text) AS h FROM documents WHERE text IS NOT NULL"


@query(f"""
WITH v AS (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY text) AS m FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS records, count(*) FILTER (m % 7 NOT IN (0, 1)) AS verified, count(*) FILTER (m % 7 = 1) AS corrupted, count(*) FILTER (m % 7 = 0) AS missing, count(*) FILTER (m % 7 IN (0, 1)) = 0 AS ok,
(SELECT root FROM ({_root_sql(_LEAVES)})) AS root FROM v
""")
def merkle_verify(s, d):
    """Every document as a record; of the blob table some contents are missing and some are others than their hash says."""
    docs = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), "text")
    blobs = docs.groupBy("content_hash").agg(F.min("id").alias("id"), F.min("text").alias("text")).filter("id % 7 <> 0")
    body = F.encode(F.when(F.col("id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8")
    return merkle.verify(docs, blobs.select("content_hash", body.alias("body")))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) - 1 AS i FROM records WHERE url = (SELECT url FROM records WHERE url IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, url LIMIT 1) AND coalesce(content_hash, '') <> '')
SELECT count(*) AS records, CAST(0 AS BIGINT) AS verified, CAST(0 AS BIGINT) AS corrupted, count(*) AS missing, count(*) = 0 AS ok, (SELECT root FROM ({_root_sql("SELECT i, content_hash AS h FROM r")})) AS root FROM r
""")
def merkle_verify_url(s, d):
    """The captures of the busiest url, in order of time, against a blob table that has none of them."""
    records = table(s, d, "records")
    blobs = records.filter("1 = 0").select("content_hash", F.lit(b"").alias("body"))
    return merkle.verify(records, blobs, url=_busiest(records.filter("url is not null"), "url"))


_DASH = "coalesce(nullif(CAST({} AS VARCHAR), ''), '-')"


@query(
    "SELECT id, concat_ws(' ', "
    + ", ".join(_DASH.format(x) for x in (f"(array_to_string(list_reverse(string_split({_DOMAIN}, '.')), ',') || ')' || {_PATH})", "timestamp", "url", "trim(split_part(mime_type, ';', 1))", "status_code", "content_hash", "content_size"))
    + ") AS line FROM records"
)
def cdx_export_lines(s, d):
    return writers.cdx_lines(table(s, d, "records")).select("id", "line")


@query("""
SELECT lower(CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE split_part(url, '/', 1) END) AS domain, url, coalesce(timestamp, '') AS timestamp,
coalesce(try_cast(CASE WHEN coalesce(status, '') IN ('', '0') THEN '200' ELSE status END AS INT), 200) AS status_code, coalesce(mimetype, '') AS mime_type,
coalesce(CASE WHEN size <> 0 THEN size END, 0) AS content_length, archive AS source FROM archive_hits WHERE url IS NOT NULL AND archive = 'wayback' AND coalesce(mimetype, '') <> '0' AND coalesce(timestamp, '') <> '0' AND regexp_full_match(coalesce(status, ''), '[0-9]*')
""")
def normalised_hits(s, d):
    """Hits of one archive as index rows, by the field names that its answers use."""
    hits = table(s, d, "archive_hits").filter((F.col("archive") == "wayback") & F.col("url").isNotNull() & F.coalesce("status", F.lit("")).rlike(r"^[0-9]*\z"))
    rows = index.normalise_records(hits.select(F.col("url").alias("original"), "timestamp", F.col("status").alias("statuscode"), "mimetype", F.col("size").alias("length")), source="wayback")
    return rows.select("domain", "url", "timestamp", "status_code", "mime_type", "content_length", "source")


@query(r"""
WITH c AS (SELECT *, coalesce(mime_type, 'text/html') AS mt, strftime(captured_at, '%Y%m%d%H%M%S') AS ts FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY url, ts ORDER BY doc_id) AS n FROM c)
SELECT 'records' AS table_name, count(*) AS rows FROM r WHERE n = 1 OR url IS NULL OR ts IS NULL UNION ALL SELECT 'versions', count(*) FROM r WHERE n = 1 OR url IS NULL OR ts IS NULL
""")
def archive_tables(s, d):
    """Documents written as captures into an archive: rows of the tables whose size does not depend on which of two captures of one time stays."""
    docs = table(s, d, "documents").filter("text is not null").select(
        F.col("doc_id").alias("id"), "url", cap.from_time(F.col("captured_at")).alias("timestamp"), F.lit(200).alias("status_code"),
        F.create_map(F.lit("content-type"), F.coalesce("mime_type", F.lit("text/html"))).alias("http_headers"), F.encode("text", "UTF-8").alias("body"), "source",
    )
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in writers.derive_tables(docs).items() if n in ("records", "versions")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT urlkey, timestamp, original, mimetype, statuscode, digest, length FROM (SELECT array_to_string(list_reverse(string_split(" + _DOMAIN + ", '.')), ',') || ')' || " + _PATH + " AS urlkey, timestamp, url AS original, coalesce(mime_type, '') AS mimetype, coalesce(CAST(status_code AS VARCHAR), '') AS statuscode, coalesce(digest, '') AS digest, coalesce(CAST(content_length AS VARCHAR), '') AS length FROM cdx_records)")
def cdx_as_strings(s, d):
    return readers.as_cdx_strings(_cdx(s, d))


# ---- streams
def _stream(s: SparkSession, d: str, start: Callable[[DataFrame, str, str], None], files: int = 4) -> DataFrame:
    """Records of a folder as a stream, processed once into a folder that is read back."""
    import uuid

    from capturelake.session import remove_at_end, shared_dir

    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    records = table(s, d, "records").withColumn("time", F.col("created_at").cast("timestamp"))
    records.repartition(files).write.parquet(f"{base}/in")
    remove_at_end(s, base)
    start(s.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out")


@query("SELECT url, count(*) AS n FROM (SELECT DISTINCT url, timestamp FROM records) GROUP BY 1")
def stream_first_seen(s, d):
    from capturelake.streaming import captures as stream

    rows = _stream(s, d, lambda df, out, state: stream.run_once(stream.first_seen(df, ["url", "timestamp"], "time", "3650 days").select("url", "timestamp"), out, state))
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH r AS (SELECT *, max(struct_pack(t := timestamp, h := content_hash)) OVER (PARTITION BY url ORDER BY timestamp, content_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).h AS p FROM records WHERE content_hash IS NOT NULL AND timestamp IS NOT NULL)
SELECT url, timestamp, content_hash, p AS prev_hash, {_CHAIN} AS change FROM r
""")
def stream_versions(s, d):
    """Versions of a stream whose records arrive in one batch: each with the hash before it."""
    from capturelake.streaming import captures as stream

    known = lambda df: df.filter("content_hash is not null and timestamp is not null")
    return _stream(s, d, lambda df, out, state: stream.run_once(stream.version_stream(known(df), "time"), out, state), files=1)
