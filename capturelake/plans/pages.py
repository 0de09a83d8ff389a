"""Queries of the page extractors: over the stored texts, and over pages made of a discovery's columns, which hold every place they look in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions import captures as cap
from capturelake.functions import urls
from capturelake.operators import classify, extract, index
from capturelake.plans.catalog import query
from capturelake.session import table

#: Pieces of a page; a name in braces is a column.
_PIECES = (
    '<html><body style="background-image: url(/bg/{category}.png)"><img src="', "{url}", '" data-src="', "{url}", '"><a href="', "{url}", '">', "{category}", '</a><a href="/go/', "{discovery_id}", '.zip">all</a>',
    '<embed src="', "{url}", '"><video poster="/p/', "{discovery_id}", '.jpg" src="', "{url}", '"></video><source srcset="', "{url}", '"><meta property="og:image" content="', "{url}",
    '"><object data="/files/', "{discovery_id}", '.swf"></object><div class="post reply"><b class="subject">', "{category}", ' of the day</b><span class="postername">', "{found_by}",
    "</span> 12/04/98(Mon) 10:00 <blockquote>Saved from <i>", "{found_on}", '</i> on the last day</blockquote></div><script>var a = {"contentUrl": "', "{url}", '"}; fetch("/api/v1/', "{category}",
    '"); x.get("', "{url}", '"); baseURL = "', "{found_on}", '"; endpoint: "rel/x"</script><a href="http://cdn7.x.test/', "{discovery_id}", '.mp3">c</a><meta name="generator" content="', "{found_by}",
    '"><p>Powered by ', "{category}", ".</p></body></html>",
)
_PIECES = tuple(x for p in _PIECES for x in ([p] if p.startswith("{") and p.endswith("}") else p.replace("{category}", "\0{category}\0").split("\0")))


def _is_column(piece: str) -> bool:
    return piece.startswith("{") and piece.endswith("}") and " " not in piece


_PAGE_SQL = " || ".join(f"coalesce(CAST({p[1:-1]} AS VARCHAR), '')" if _is_column(p) else "'" + p.replace("'", "''") + "'" for p in _PIECES)
_PAGES = f"(SELECT discovery_id, coalesce(found_on, '') AS base, {_PAGE_SQL} AS page FROM discoveries)"


def _page() -> Column:
    return F.concat(*[F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if _is_column(p) else F.lit(p) for p in _PIECES])


def _pages(s, d):
    return table(s, d, "discoveries").select("discovery_id", F.coalesce("found_on", F.lit("")).alias("base"), _page().alias("page"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _all_sql(patterns, text: str = "page") -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({text}, {_quoted(p)}, 1)" for p in patterns) + "])"


_ROOT = "regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_SCHEME = "lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_FOLDER = "coalesce(nullif(regexp_extract(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/')"
_LINK = r"regexp_replace(u, '^[\x00-\x20]+|[\t\r\n]', '', 'g')"
_NAMED = f"lower(regexp_extract({_LINK}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_TAIL = f"regexp_replace(regexp_extract({_LINK}, '(?s)^[^?#]*(.*)$', 1), '^[?]$|#$', '')"


def _steps_sql(path: str, empty: bool = False) -> str:
    """A path without '.' and (up to three times) climbed segments, and without empty ones unless ``empty``."""
    left_out = "('.')" if empty else "('', '.')"
    out = f"'/' || array_to_string(list_filter(string_split(regexp_replace({path}, '^/', ''), '/'), lambda x: x NOT IN {left_out}), '/')"
    for _ in range(3):
        out = rf"regexp_replace({out}, '/[^/]+/\.\.(/|$)', '/')"
    return f"{out} || CASE WHEN regexp_matches({path}, '[^/].*/[.]{{{1 if empty else 0},2}}$') THEN '/' ELSE '' END"


_OWN = f"regexp_extract({_LINK}, '^([^?#]*)', 1)"
#: ``u`` joined to ``base``, and resolved as a page's links are.
_JOINED = (
    f"CASE WHEN u = '' THEN base WHEN {_ROOT} = '' OR {_NAMED} NOT IN ('', {_SCHEME}) THEN u WHEN {_LINK} = '' THEN split_part(base, '#', 1) WHEN {_NAMED} <> '' THEN {_SCHEME} || regexp_replace({_LINK}, '^[^:]*', '') WHEN starts_with({_LINK}, '//') THEN {_SCHEME} || ':' || {_LINK} "
    f"WHEN starts_with({_LINK}, '#') THEN split_part(base, '#', 1) || {_TAIL} WHEN starts_with({_LINK}, '?') THEN regexp_extract(base, '^([^?#]*)', 1) || {_TAIL} "
    f"WHEN starts_with({_OWN}, '/') THEN {_ROOT} || {_steps_sql(_OWN, True)} || {_TAIL} ELSE {_ROOT} || {_steps_sql(f'({_FOLDER} || {_OWN})')} || {_TAIL} END"
)
_RESOLVED = (
    "CASE WHEN u = '' OR starts_with(u, 'data:') OR starts_with(u, 'javascript:') THEN NULL WHEN starts_with(u, '//') THEN 'http:' || u WHEN starts_with(u, 'http') THEN u WHEN base = '' THEN NULL "
    f"WHEN starts_with(u, '/') THEN {_ROOT} || u ELSE {_JOINED} END"
)
_KNOWN = ", ".join(f"'{e}'" for e in sorted({e for _, es in urls.CATEGORIES for e in es.split()}))
_EXT = r"regexp_extract(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '\.([^./]*)$', 1)"


@query(f"""
WITH h AS (SELECT doc_id, coalesce(url, '') AS base, unnest(regexp_extract_all(text, '(?i)href="([^"]+)"', 1)) AS u FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, {_RESOLVED} AS link FROM h WHERE ({_RESOLVED}) IS NOT NULL
""")
def resolved_links(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(extract.links(F.col("text"), F.col("url"))).alias("link"))


_BUCKETS = " UNION ALL ".join(
    f"SELECT discovery_id, '{kind}' AS kind, base, unnest({_all_sql([extract._media_pattern(*p) for p in places])}) AS u FROM {_PAGES}" for kind, places in extract.MEDIA_PLACES.items()
)


@query(f"SELECT DISTINCT discovery_id, kind, {_RESOLVED} AS media FROM ({_BUCKETS}) WHERE ({_RESOLVED}) IS NOT NULL")
def media_urls(s, d):
    found = _pages(s, d).select("discovery_id", F.explode(extract.media_urls(F.col("page"), F.col("base"))).alias("kind", "found"))
    return found.select("discovery_id", "kind", F.explode("found").alias("media"))


@query(f"""
WITH g AS (SELECT discovery_id, base, unnest({_all_sql(['(?is)' + p for p in extract.EMBED_PLACES])}) AS g FROM {_PAGES}),
u AS (SELECT discovery_id, unnest(regexp_extract_all(g, '(https?://[^\\s"'']+)', 1)) AS u FROM g
 UNION ALL SELECT discovery_id, {_JOINED} FROM (SELECT discovery_id, base, unnest(regexp_extract_all(g, '(/[^\\s"'']+)', 1)) AS u FROM g)),
b AS (SELECT discovery_id, split_part(u, '#', 1) AS u FROM u)
SELECT DISTINCT discovery_id, u AS media FROM b WHERE starts_with(u, 'http') AND {_EXT} IN ({_KNOWN})
""")
def embeds(s, d):
    return _pages(s, d).select("discovery_id", F.explode(extract.embeds(F.col("page"), F.col("base"))).alias("media"))


@query(f"""
WITH e AS (SELECT discovery_id, base, unnest({_all_sql(extract.API_PLACES)}) AS u FROM {_PAGES})
SELECT DISTINCT discovery_id, CASE WHEN starts_with(u, '/') THEN {_ROOT} || u ELSE u END AS endpoint FROM e WHERE starts_with(u, '/') OR starts_with(u, 'http')
""")
def api_mentions(s, d):
    return _pages(s, d).select("discovery_id", F.explode(extract.api_mentions(F.col("page"), F.col("base"))).alias("endpoint"))


_ATTRIBUTES = [rf"(?i){a}\s*=\s*[\"']([^\"']+)[\"']" for a in extract.FILE_ATTRIBUTES]


@query(f"""
WITH a AS (SELECT discovery_id, base, regexp_replace(unnest({_all_sql(_ATTRIBUTES)}), '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '', 'g') AS u FROM {_PAGES}),
f AS (SELECT discovery_id, CASE WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, 'http') THEN u ELSE {_JOINED} END AS u FROM a)
SELECT DISTINCT discovery_id, u AS file FROM f WHERE {_EXT} IN ({_KNOWN})
""")
def attribute_files(s, d):
    return _pages(s, d).select("discovery_id", F.explode(extract.attribute_files(F.col("page"), F.col("base"))).alias("file"))


@query(f"""
WITH p AS (SELECT discovery_id, page FROM {_PAGES}),
f AS (SELECT discovery_id, list_filter(list_transform(regexp_extract_all(page, 'class="[^"]*(?:subject|filetitle)[^"]*"[^>]*>([^<]+)<', 1), lambda x: trim(x)), lambda x: x <> '') AS subjects,
 len(regexp_extract_all(page, 'class="[^"]*(?:post|reply|postblock)[^"]*"')) AS posts, len(regexp_extract_all(page, '(?i)\\.jpg|\\.jpeg|\\.png|\\.gif')) // 2 AS images,
 list_distinct(list_filter(list_transform(regexp_extract_all(page, 'class="[^"]*(?:postername|name)[^"]*"[^>]*>([^<]+)<', 1), lambda x: trim(x)), lambda x: x NOT IN ('', 'Anonymous'))) AS names,
 regexp_extract_all(page, '(\\d{{2}}/\\d{{2}}/\\d{{2,4}}\\s*\\(\\w+\\)\\s*\\d{{2}}:\\d{{2}})', 1)[1:5] AS dates,
 list_transform(regexp_extract_all(page, '(?s)<blockquote>(.*?)</blockquote>', 1)[1:20], lambda x: regexp_replace(trim(regexp_replace(x, '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g')) AS replies FROM p)
SELECT discovery_id, array_to_string(subjects, '; ') AS subjects, CAST(posts AS INT) AS posts, CAST(images AS INT) AS images, array_to_string(names, '; ') AS names, array_to_string(dates, '; ') AS dates,
array_to_string(list_transform(list_filter(replies, lambda x: length(x) > 10), lambda x: substr(x, 1, 200)), '; ') AS replies FROM f
""")
def forum_fields(s, d):
    f = _pages(s, d).select("discovery_id", extract.forum_fields(F.col("page")).alias("f"))
    joined = lambda c: F.array_join(f"f.{c}", "; ").alias(c)
    return f.select("discovery_id", joined("subjects"), "f.posts", "f.images", joined("names"), joined("dates"), joined("replies"))


@query(f"""
SELECT discovery_id, coalesce(nullif(concat_ws(', ', CASE WHEN regexp_matches(page, 'FrontPage|vti_cnf|_vti_bin') THEN 'Microsoft FrontPage' END,
CASE WHEN contains(lower(page), 'generator') AND contains(lower(page), 'dreamweaver') THEN 'Macromedia Dreamweaver' END, CASE WHEN regexp_matches(page, 'wp-content|(?i:wordpress)') THEN 'WordPress' END,
CASE WHEN contains(page, 'phpBB') THEN 'phpBB Forum' END, CASE WHEN contains(page, 'vBulletin') THEN 'vBulletin Forum' END,
CASE WHEN regexp_matches(page, 'Powered by\\s+[A-Za-z0-9\\s]+') THEN substr(trim(regexp_extract(page, 'Powered by\\s+([A-Za-z0-9\\s]+)', 1)), 1, 30) END,
CASE WHEN contains(lower(page), '<meta name="generator"') THEN nullif(substr(trim(regexp_extract(page, '(?i)<meta\\s+name=["'']generator["'']\\s+content=["'']([^"'']+)', 1)), 1, 40), '') END), ''),
'Unknown (likely hand-coded HTML)') AS software FROM {_PAGES}
""")
def server_software(s, d):
    return _pages(s, d).select("discovery_id", classify.server_software(F.col("page")).alias("software"))


_HOSTS = (
    "b1.s3.us-east-1.amazonaws.com", "s3.eu-west-1.amazonaws.com/b", "acc1.blob.core.windows.net/c", "storage.googleapis.com/b", "b.storage.googleapis.com", "a1.r2.cloudflarestorage.com", "x.fra1.digitaloceanspaces.com",
    "x.cdn.digitaloceanspaces.com", "res.cloudinary.com/d", "x.imgix.net", "x.akamaized.net", "x.akamaihd.net", "x.fastly.net", "d1.cloudfront.net", "x.b-cdn.net", "cdn2.x.test", "static.x.test", "media.x.test",
    "assets1.x.test", "files.x.test", "dl.x.test", "download.x.test", "uploads.x.test", "content.x.test", "www.x.test",
)
_SUBJECT = f"(SELECT discovery_id, 'http://' || h || '/' || discovery_id || '.mp3' AS url FROM discoveries, (SELECT unnest([{', '.join(repr(h) for h in _HOSTS)}]) AS h))"
_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(url, '(?i)https?://{p}') THEN '{n}'" for n, p in extract.HOST_KINDS) + " ELSE 'other' END"


def _hosted(s, d):
    return table(s, d, "discoveries").select("discovery_id", F.explode(F.array(*[F.lit(h) for h in _HOSTS])).alias("h")).select(
        "discovery_id", F.concat(F.lit("http://"), "h", F.lit("/"), F.col("discovery_id").cast("string"), F.lit(".mp3")).alias("url")
    )


@query(f"SELECT discovery_id, url, {_KIND_SQL} AS kind FROM {_SUBJECT}")
def host_kinds(s, d):
    return _hosted(s, d).select("discovery_id", "url", extract.host_kind(F.col("url")).alias("kind"))


_FILES = extract._FILE_EXTENSIONS


@query(f"""
WITH u AS (SELECT DISTINCT discovery_id, url FROM (SELECT discovery_id, unnest(regexp_extract_all(page || ' ', '(?i)(https?://[^\\s"''<>]+?\\.(?:{_FILES}))[\\s"''<>?]', 1)) AS url FROM {_PAGES}))
SELECT discovery_id, url, {_KIND_SQL} AS kind FROM u WHERE ({_KIND_SQL}) <> 'other'
""")
def content_urls(s, d):
    return _pages(s, d).select("discovery_id", F.explode(extract.content_urls(F.col("page"))).alias("x")).select("discovery_id", "x.url", "x.kind")


@query(f"""
WITH p AS (SELECT discovery_id, page FROM {_PAGES}), f AS (SELECT discovery_id, unnest({_all_sql([
    f"(?i)[\"'](https?://[^\"'<>\\s]*?\\.(?:{_FILES})(?:\\?[^\"'<>\\s]*)?)[\"']", f"(?i)[\"'](/?[A-Za-z0-9_./~%-]*?\\.(?:{_FILES}))[\"']", '(?i)"(?:url|src|file|href|download|path|link)"\\s*:\\s*"([^"]+)"'])}) AS file FROM p)
SELECT DISTINCT discovery_id, file FROM f
""")
def text_file_urls(s, d):
    return _pages(s, d).select("discovery_id", F.explode(extract.file_urls(F.col("page"))).alias("file"))


# ---- parsed pages: what the parser must find stands in the columns of which the page is made
_SIMPLE = """'<ul><li><a href="' || url || '" rel="nofollow">' || coalesce(category, '') || '</a></li><li><img src="/i/' || discovery_id || '.png"></li></ul>'"""
_PLAIN_URL = "regexp_full_match(url, 'http://[a-z0-9./_-]+') AND category IS NOT NULL"


def _simple_pages(s, d):
    page = F.concat(F.lit('<ul><li><a href="'), "url", F.lit('" rel="nofollow">'), F.coalesce("category", F.lit("")), F.lit('</a></li><li><img src="/i/'), F.col("discovery_id").cast("string"), F.lit('.png"></li></ul>'))
    plain = F.col("url").rlike(r"^http://[a-z0-9./_-]+\z") & F.col("category").isNotNull()
    return table(s, d, "discoveries").filter(plain).select("discovery_id", page.alias("page"))


@query(f"SELECT discovery_id, url, category AS text, 'nofollow' AS rel FROM discoveries WHERE {_PLAIN_URL} UNION ALL SELECT discovery_id, '/i/' || discovery_id || '.png', '', '' FROM discoveries WHERE {_PLAIN_URL}")
def anchor_links_parsed(s, d):
    return _simple_pages(s, d).select("discovery_id", F.explode(extract.page_links_udf("page")).alias("l")).select("discovery_id", "l.url", "l.text", "l.rel")


_FILE_KNOWN = ", ".join(f"'{e}'" for e in sorted(e for e, c in extract._KNOWN.items() if c != "web"))


@query(f"SELECT discovery_id, url, 'a' AS found_via FROM discoveries WHERE {_PLAIN_URL} AND regexp_extract(url, '\\.([a-z0-9]{{1,6}})$', 1) IN ({_FILE_KNOWN})")
def file_links_parsed(s, d):
    found = _simple_pages(s, d).select("discovery_id", F.explode(extract.file_links_udf("page", F.lit("http://base.test/"))).alias("l"))
    return found.select("discovery_id", "l.url", "l.found_via").filter(F.col("found_via") == "a")


@query("""
SELECT discovery_id, 'http://base.test/d/?up' AS file FROM discoveries WHERE discovery_id % 2 = 0 UNION ALL SELECT discovery_id, 'http://base.test/d/f' || discovery_id || '.zip' FROM discoveries WHERE discovery_id % 2 = 0
""")
def directory_listing_files(s, d):
    """Every second page is a listing; the others are not, and have no files."""
    title = F.when(F.col("discovery_id") % 2 == 0, "Index of /d").otherwise("Our files")
    page = F.concat(F.lit("<title>"), title, F.lit('</title><a href="?up">Up</a><a href="f'), F.col("discovery_id").cast("string"), F.lit('.zip">f</a>'))
    pages = table(s, d, "discoveries").select("discovery_id", page.alias("page"))
    return pages.select("discovery_id", F.explode(extract.listing_files_udf("page", F.lit("http://base.test/d/"))).alias("file"))


# ---- urls and contents
@query(f"WITH x AS (SELECT id, coalesce(source_url, '') AS base, target_url AS u FROM link_graph) SELECT id, {_RESOLVED} AS resolved FROM x WHERE u IS NOT NULL")
def resolved_targets(s, d):
    links = table(s, d, "link_graph").filter("target_url is not null")
    return links.select("id", urls.resolve(F.col("target_url"), F.coalesce("source_url", F.lit(""))).alias("resolved"))


@query("""
SELECT id, 'http://base.test/a/' || id || '.x' AS beside, 'http://base.test/' || id || '.x' AS above, 'http://base.test/a/b?' || id AS asked, 'http://other.test/' || id AS host FROM records
""")
def joined_urls(s, d):
    i, base = F.col("id").cast("string"), F.lit("http://base.test/a/b?q=1#f")
    return table(s, d, "records").select(
        "id", urls.urljoin(base, F.concat(F.lit("./"), i, F.lit(".x"))).alias("beside"), urls.urljoin(base, F.concat(F.lit("../../"), i, F.lit(".x"))).alias("above"),
        urls.urljoin(base, F.concat(F.lit("?"), i)).alias("asked"), urls.urljoin(base, F.concat(F.lit("//other.test/"), i)).alias("host"),
    )


@query("SELECT id, strftime(created_at, '%Y%m%d%H%M%S') AS stamp FROM records WHERE created_at IS NOT NULL")
def arrival_stamps(s, d):
    return table(s, d, "records").filter("created_at is not null").select("id", cap.from_time(F.col("created_at")).alias("stamp"))


@query(r"""
SELECT discovery_id, lower(regexp_extract(url, '^(?i)(?:https?)', 0)) <> '' AND regexp_full_match(url, '(?is).*\.(?:mp3|wad|zip)(?:\?.*)?') AS file, category IN ('audio', 'games') AS kind FROM discoveries WHERE category IS NOT NULL AND url ILIKE 'http%'
""")
def extension_and_mime_regexes(s, d):
    rows = table(s, d, "discoveries").filter(F.col("category").isNotNull() & F.col("url").ilike("http%"))
    return rows.select("discovery_id", F.col("url").rlike("(?s)" + urls.extension_regex(["mp3", "wad", "zip"])).alias("file"), F.col("category").rlike("^" + urls.mime_regex(["audio", "games"]) + r"\z").alias("kind"))


@query("""
SELECT doc_id, strlen(text) >= 4 AND NOT (regexp_matches(lower(ltrim(substr(text, 1, 32), ' ')), '^(?:<!doctype|<html|<head|<\\?xml)') AND doc_id % 2 = 0) AS plausible,
mime_type ILIKE '%text/html%' AND strlen(text) < 2048 AND doc_id % 2 = 0 AS tiny FROM documents WHERE text IS NOT NULL AND regexp_full_match(substr(text, 1, 32), '(?s)[\\x00-\\x7f]*') AND mime_type IS NOT NULL
""")
def content_checks(s, d):
    """Texts as bodies of files, every second one under the extension of a page."""
    docs = table(s, d, "documents").filter(F.substring("text", 1, 32).rlike(r"(?s)^[\x00-\x7f]*\z") & F.col("mime_type").isNotNull())
    ext, body = F.when(F.col("doc_id") % 2 == 0, "zip").otherwise("html"), F.encode("text", "UTF-8")
    return docs.select("doc_id", cap.plausible_content(body, ext).alias("plausible"), cap.tiny_page(F.col("mime_type"), F.octet_length(body), ext).alias("tiny"))


@query("SELECT discovery_id, '{\"k\": ' || discovery_id || '}' AS inner FROM discoveries")
def fenced_code(s, d):
    text = F.concat(F.lit('Here it is:\n```json\n{"k": '), F.col("discovery_id").cast("string"), F.lit("}\n```\nDone."))
    return table(s, d, "discoveries").select("discovery_id", cap.code_fence_body(text).alias("inner"))


@query("SELECT hit_id, size FROM archive_hits WHERE NOT coalesce(mimetype IN ('audio/midi', 'text/html') AND contains(mimetype, 'html') AND size < 50000, FALSE)")
def small_pages_out(s, d):
    kept = index.no_small_page(["audio/midi", "text/html"], category=F.col("mimetype"), mime=F.col("mimetype"), size=F.col("size"))
    return table(s, d, "archive_hits").filter(kept).select("hit_id", "size")
