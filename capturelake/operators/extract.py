"""Links, media and fields out of page texts.

What a regular expression can say is a native expression; only extractors that need a tolerant HTML
parser run in Python, in Arrow batches. Filter on content type or domain and select the page
column before them: they are barriers to the optimizer.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.functions import urls

_FILE_EXTENSIONS = "|".join(sorted({e for name, exts in urls.CATEGORIES if name != "web" for e in exts.split()}))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


# ---- native extractors
def hrefs(page: Column) -> Column:
    """Double-quoted href values, as they stand, distinct and in order; entities are not decoded."""
    return distinct_in_order(_all(page, r'(?i)href="([^"]+)"'))


def links(page: Column, base: Column) -> Column:
    """Absolute forms of the href values; links that have none are left out; distinct, in order."""
    return distinct_in_order(F.filter(F.transform(hrefs(page), lambda u: urls.resolve(u, base)), lambda u: u.isNotNull()))


def file_urls(text: Column) -> Column:
    """Quoted urls and paths with the extension of a file, and file values of JSON keys; distinct, in this order."""
    absolute = _all(text, rf"(?i)[\"'](https?://[^\"'<>\s]*?\.(?:{_FILE_EXTENSIONS})(?:\?[^\"'<>\s]*)?)[\"']")
    relative = _all(text, rf"(?i)[\"'](/?[A-Za-z0-9_./~%-]*?\.(?:{_FILE_EXTENSIONS}))[\"']")
    keyed = _all(text, r'(?i)"(?:url|src|file|href|download|path|link)"\s*:\s*"([^"]+)"')
    return distinct_in_order(F.concat(absolute, relative, keyed))


# Places of media in a page, by bucket: the attribute and the extensions of its value, in order.
_IMAGE, _LAZY, _SOUND = "jpg|jpeg|png|gif|webp|bmp|tiff|svg", "jpg|jpeg|png|gif|webp", "mp3|wav|flac|ogg|aac|m4a|wma|mid|midi"
MEDIA_PLACES = {
    "images": [("src", _IMAGE), ("src='", _IMAGE), ("data-src", _LAZY), ("data-original", _LAZY), ("data-lazy", _LAZY), ("background-image", _LAZY), ("href", _LAZY + "|bmp")],
    "videos": [
        ("src", "mp4|avi|mkv|wmv|flv|mov|webm|m4v|mpg|mpeg"), ("href", "mp4|avi|mkv|wmv|flv|mov|webm|m4v"), ("data-src", "mp4|webm|m4v"), ("<source", "mp4|webm|ogg"),
    ],
    "audio": [("src", _SOUND), ("href", _SOUND)],
    "documents": [("href", "pdf|doc|docx|xls|xlsx|ppt|pptx|txt|csv|rtf")],
    "archives": [("href", "zip|rar|7z|tar|gz|bz2|tgz")],
    "other": [("src", "swf|dcr|dir"), ("data", "swf|dcr|dir"), ("value", "swf|dcr|dir")],
}


def _media_pattern(place: str, extensions: str) -> str:
    if place == "background-image":
        return rf"(?i)background-image:\s*url\([\"']?([^\"')\s]+\.(?:{extensions}))[\"']?\)"
    if place == "<source":
        return rf'(?i)<source[^>]*src="([^"]*\.(?:{extensions})[^"]*)"'
    quote, name = ("'", place[:-2]) if place.endswith("='") else ('"', place)
    return rf"(?i){name}={quote}([^{quote}]*\.(?:{extensions})[^{quote}]*){quote}"


def media_urls(page: Column, base: Column) -> Column:
    """Map from bucket (images, videos, audio, documents, archives, other) to its distinct urls, resolved, in order."""

    def bucket(places: list[tuple[str, str]]) -> Column:
        found = F.flatten(F.array(*[_all(page, _media_pattern(*p)) for p in places]))
        return distinct_in_order(F.filter(F.transform(found, lambda u: urls.resolve(u, base)), lambda u: u.isNotNull()))

    return F.create_map(*[x for k, places in MEDIA_PLACES.items() for x in (F.lit(k), bucket(places))])


def forum_fields(page: Column) -> Column:
    """Struct of a thread page: subjects, posts, images (each stands twice), names without Anonymous, first dates, replies.

    The five dates and twenty replies are what the report shows; the counts are of the whole page.
    """
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "<[^>]+>", " ")), r"\s+", " ")
    replies = F.transform(F.slice(_all(page, r"(?s)<blockquote>(.*?)</blockquote>"), 1, 20), bare)
    return F.struct(
        trimmed(_all(page, r'class="[^"]*(?:subject|filetitle)[^"]*"[^>]*>([^<]+)<')).alias("subjects"),
        F.regexp_count(page, F.lit(r'class="[^"]*(?:post|reply|postblock)[^"]*"')).alias("posts"),
        F.floor(F.regexp_count(page, F.lit(r"(?i)\.jpg|\.jpeg|\.png|\.gif")) / 2).cast("int").alias("images"),
        F.array_remove(distinct_in_order(trimmed(_all(page, r'class="[^"]*(?:postername|name)[^"]*"[^>]*>([^<]+)<'))), "Anonymous").alias("names"),
        F.slice(_all(page, r"(\d{2}/\d{2}/\d{2,4}\s*\(\w+\)\s*\d{2}:\d{2})"), 1, 5).alias("dates"),
        F.transform(F.filter(replies, lambda r: F.length(r) > 10), lambda r: F.substring(r, 1, 200)).alias("replies"),
    )


def asset_hosts(page: Column, main_domain: Column) -> Column:
    """Hosts named in src, href, data-src, poster and action attributes that do not hold the main domain; sorted."""
    hosts = F.transform(_all(page, r"(?i)\b(?:src|href|data-src|poster|action)=[\"'](?:https?:)?//([^/\"'?#\s]+)"), lambda h: F.lower(h))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: ~h.contains(main_domain))))


# Kinds of content hosts with the pattern of their addresses behind the scheme, in order; the first match wins.
HOST_KINDS = (
    ("aws_s3", r"[a-z0-9.-]+\.s3[.-](?:[a-z0-9-]+)?\.amazonaws\.com/."), ("aws_s3_path", r"s3[.-](?:[a-z0-9-]+)?\.amazonaws\.com/[a-z0-9.-]+/."), ("azure_blob", r"[a-z0-9]+\.blob\.core\.windows\.net/[^/]+/."),
    ("gcs", r"storage\.googleapis\.com/[^/]+/."), ("gcs_cname", r"[a-z0-9.-]+\.storage\.googleapis\.com/."), ("cloudflare_r2", r"[a-z0-9]+\.r2\.cloudflarestorage\.com/."),
    ("do_spaces", r"[a-z0-9.-]+\.digitaloceanspaces\.com/."), ("do_spaces_cdn", r"[a-z0-9.-]+\.cdn\.digitaloceanspaces\.com/."), ("cloudinary", r"res\.cloudinary\.com/[^/]+/."),
    ("imgix", r"[a-z0-9.-]+\.imgix\.net/."), ("akamai", r"[a-z0-9.-]+\.akamaized\.net/."), ("akamai_hd", r"[a-z0-9.-]+\.akamaihd\.net/."), ("fastly", r"[a-z0-9.-]+\.fastly\.net/."),
    ("cloudfront", r"[a-z0-9]+\.cloudfront\.net/."), ("bunnycdn", r"[a-z0-9.-]+\.b-cdn\.net/."),
    ("generic_cdn", r"cdn[0-9]*\.[a-z0-9.-]+/."), ("generic_static", r"static[0-9]*\.[a-z0-9.-]+/."), ("generic_media", r"media[0-9]*\.[a-z0-9.-]+/."), ("generic_assets", r"assets[0-9]*\.[a-z0-9.-]+/."),
    ("generic_files", r"files[0-9]*\.[a-z0-9.-]+/."), ("generic_dl", r"dl[0-9]*\.[a-z0-9.-]+/."), ("generic_download", r"download[0-9]*\.[a-z0-9.-]+/."), ("generic_upload", r"uploads?\.[a-z0-9.-]+/."),
    ("generic_content", r"content[0-9]*\.[a-z0-9.-]+/."),
)


def host_kind(url: Column) -> Column:
    return urls.ordered_class(url, [(name, f"(?i)https?://{pattern}") for name, pattern in HOST_KINDS], "other")


def content_urls(page: Column) -> Column:
    """Absolute file urls on hosts of a known kind, as (url, kind)."""
    found = distinct_in_order(_all(page, rf"(?i)(https?://[^\s\"'<>]+?\.(?:{_FILE_EXTENSIONS}))(?=[\s\"'<>?]|\z)"))
    return F.filter(F.transform(found, lambda u: F.struct(u.alias("url"), host_kind(u).alias("kind"))), lambda x: x["kind"] != "other")


# Places where scripts name the endpoints that they call; each pattern has one group.
API_PLACES = (
    r"[\"'](/api/v[0-9]+/[a-zA-Z/]+)[\"']", r"[\"'](/_api/[a-zA-Z/]+)[\"']", r"fetch\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", r"axios\.[a-z]+\s*\(\s*[\"'`]([^\"'`]+)[\"'`]",
    r"\.get\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", r"\.post\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", r"baseURL\s*[:=]\s*[\"'`]([^\"'`]+)[\"'`]", r"apiUrl\s*[:=]\s*[\"'`]([^\"'`]+)[\"'`]",
    r"endpoint\s*[:=]\s*[\"'`]([^\"'`]+)[\"'`]", r"API_URL\s*[:=]\s*[\"'`]([^\"'`]+)[\"'`]", r"UPLOAD_URL\s*[:=]\s*[\"'`]([^\"'`]+)[\"'`]",
)


def api_mentions(page: Column, base: Column) -> Column:
    """Endpoints that a page's scripts name, distinct: absolute ones, and paths from the root behind the base's host."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    found = F.flatten(F.array(*[_all(page, p) for p in API_PLACES]))
    full = F.transform(found, lambda u: F.when(u.startswith("/"), F.concat(root, u)).when(u.startswith("http"), u))
    return distinct_in_order(F.filter(full, lambda u: u.isNotNull()))


# Attributes that may name a file.
FILE_ATTRIBUTES = ("href", "src", "data-src", "data-url", "data-file", "data-download", "data-media", "poster", "content", "action")


def attribute_files(page: Column, base: Column) -> Column:
    """Resolved values of ten attributes that name a file of a known extension, distinct; ``//`` becomes ``https://``."""
    found = F.flatten(F.array(*[_all(page, rf"(?i){a}\s*=\s*[\"']([^\"']+)[\"']") for a in FILE_ATTRIBUTES]))
    text = F.transform(found, lambda u: F.regexp_replace(u, r"(?U)^\s+|\s+\z", ""))
    full = F.transform(text, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("http"), u).otherwise(urls.urljoin(base, u)))
    return distinct_in_order(F.filter(full, lambda u: is_file(u)))


def is_file(url: Column) -> Column:
    """Does a url end in an extension that belongs to a category?"""
    return urls.extension_of_file(url).isin(*sorted({e for _, exts in urls.CATEGORIES for e in exts.split()}))


# Places where players, embeds and structured data name their media; each pattern has one group.
EMBED_PLACES = (
    r"jwplayer\s*\([^)]*\)\s*\.setup\s*\(\s*\{[^}]*file\s*:\s*[\"']([^\"']+)[\"']", r"jwplayer\s*\([^)]*\)\s*\.setup\s*\(\s*\{[^}]*sources\s*:\s*\[([^\]]+)\]",
    r"videojs\s*\([^)]*\)\s*\.src\s*\(\s*[\"']([^\"']+)[\"']", r"data-setup\s*=\s*[\"'][^\"']*sources\s*:\s*\[([^\]]+)\][\"']", r"new\s+Plyr\s*\([^)]*\)\s*;\s*[^;]*source\s*[:=]\s*[\"']([^\"']+)[\"']",
    r"<(?:audio|video)[^>]*src\s*=\s*[\"']([^\"']+)[\"']", r"<source[^>]*src\s*=\s*[\"']([^\"']+)[\"']", r"<source[^>]*srcset\s*=\s*[\"']([^\"']+)[\"']", r"poster\s*=\s*[\"']([^\"']+)[\"']",
    r"<(?:object|embed)[^>]*(?:data|src)\s*=\s*[\"']([^\"']+)[\"']", r"<param[^>]*name\s*=\s*[\"'](?:movie|src|flashvars|file)[\"'][^>]*value\s*=\s*[\"']([^\"']+)[\"']", r"<iframe[^>]*src\s*=\s*[\"']([^\"']+)[\"']",
    r"background(?:-image)?\s*:\s*[^;]*url\s*\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)", r"<meta[^>]*property\s*=\s*[\"']og:(?:image|video|audio)[\"'][^>]*content\s*=\s*[\"']([^\"']+)[\"']",
    r"<meta[^>]*content\s*=\s*[\"']([^\"']+)[\"'][^>]*property\s*=\s*[\"']og:(?:image|video|audio)[\"']", r"<meta[^>]*name\s*=\s*[\"']twitter:(?:image|player:stream)[\"'][^>]*content\s*=\s*[\"']([^\"']+)[\"']",
    r'"contentUrl"\s*:\s*"([^"]+)"', r'"embedUrl"\s*:\s*"([^"]+)"', r'"downloadUrl"\s*:\s*"([^"]+)"', r"data-(?:src|file|url|audio|video|download|media|image|poster)\s*=\s*[\"']([^\"']+)[\"']",
)


def embeds(page: Column, base: Column) -> Column:
    """Media urls in players, embeds and structured data, resolved, without fragment, of a known extension; distinct, in order.

    In each place absolute urls are sought first, then whatever begins with a slash, wherever it stands.
    """
    groups = F.flatten(F.array(*[_all(page, "(?is)" + p) for p in EMBED_PLACES]))
    rooted = lambda g: F.transform(_all(g, r"(/[^\s\"']+)"), lambda u: urls.urljoin(base, u))
    full = F.flatten(F.transform(groups, lambda g: F.concat(_all(g, r"(https?://[^\s\"']+)"), rooted(g))))
    bare = F.transform(full, lambda u: F.substring_index(u, "#", 1))
    return distinct_in_order(F.filter(bare, lambda u: u.startswith("http") & is_file(u)))


def is_directory_listing(page: Column) -> Column:
    """Does a page look like a listing that a server made of a folder?"""
    return F.coalesce(
        page.rlike(r"(?i)<title>\s*index of|>\s*parent directory\s*<|\?C=[NMSD](?:;|&amp;)O=[AD]|directory listing for|\[to parent directory\]"), F.lit(False)
    )


def sitemap_locations(xml: Column) -> Column:
    """Array of (url, nested) of the loc elements of a sitemap; nested ones are sitemaps themselves."""
    found = F.transform(_all(xml, r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.transform(found, lambda u: F.struct(u.alias("url"), (u.endswith(".xml") | F.lower(u).contains("sitemap")).alias("nested")))


def robots_sitemaps(text: Column) -> Column:
    return _all(text, r"(?im)^\s*sitemap:\s*(\S+)")


def feed_links(xml: Column) -> Column:
    """Array of (url, confidence) of a feed: enclosures, then item links."""
    enclosures = F.transform(_all(xml, r"(?i)<enclosure[^>]+url=[\"']([^\"']+)[\"']"), lambda u: F.struct(u.alias("url"), F.lit(0.8).alias("confidence")))
    items = F.transform(_all(xml, r"(?is)<link>\s*([^<]+?)\s*</link>"), lambda u: F.struct(u.alias("url"), F.lit(0.75).alias("confidence")))
    return F.concat(enclosures, items)


# ---- extractors that need a parser
class _Walker(HTMLParser):
    """Calls back on tags and texts of a page, however broken it is."""

    def __init__(self, on_tag, on_end=None, on_text=None):
        super().__init__(convert_charrefs=True)
        self.on_tag, self.on_end, self.on_text = on_tag, on_end, on_text

    def handle_starttag(self, tag, attrs):
        self.on_tag(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        if self.on_end:
            self.on_end(tag)

    def handle_data(self, data):
        if self.on_text:
            self.on_text(data)


def _walk(page: str, **calls) -> None:
    walker = _Walker(**calls)
    try:
        walker.feed(page)
        walker.close()
    except (AssertionError, ValueError):
        pass  # what was read so far counts


def page_links(page: str | None) -> list[dict]:
    """Links of a page: anchors, and the sources of img, script, link, source, video and audio; with the text that follows.

    Urls are not resolved. The text is the first that is not blank after the link, up to 200 characters.
    """
    out: list[dict] = []

    def tag(name, attrs):
        url = attrs.get("href") if name == "a" else attrs.get("src") if name in ("img", "script", "link", "source", "video", "audio") else None
        if url:
            out.append({"url": url, "text": "", "rel": attrs.get("rel", "")})

    def text(data):
        if out and not out[-1]["text"] and data.strip():
            out[-1]["text"] = data.strip()[:200]

    if page:
        _walk(page, on_tag=tag, on_text=text)
    return out


_DOWNLOAD_WORDS = ("download", "mirror", "get it", "save")
_URL_TAGS = {"audio": ("src",), "video": ("src",), "source": ("src",), "embed": ("src",), "object": ("data",), "iframe": ("src",)}


def _ext(url: str) -> str:
    m = re.search(r"\.([^.]*)\Z", re.sub(r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*).*", r"\1", url, flags=re.I | re.S).lower())
    return m[1] if m and len(m[1]) <= 6 else ""


_KNOWN: dict[str, str] = {}
for _name, _exts in urls.CATEGORIES:
    for _e in _exts.split():
        _KNOWN.setdefault(_e, _name)


def file_links(page: str | None, base: str | None) -> list[dict]:
    """Links to files, resolved: anchors, media tags and ``data-*`` attributes with a known extension.

    An anchor without one, whose text has a word of downloading, comes out as ``potential_download``.
    """
    out: list[dict] = []
    anchor: list = []

    def add(url, via):
        try:
            full = urljoin(base or "", url.strip())
        except ValueError:
            return None
        ext = _ext(full)
        if ext in _KNOWN and _KNOWN[ext] != "web":
            out.append({"url": full, "extension": ext, "category": _KNOWN[ext], "found_via": via})
            return None
        return full

    def tag(name, attrs):
        if name == "a" and attrs.get("href"):
            anchor[:] = [add(attrs["href"], "a"), ""]
        for key in _URL_TAGS.get(name, ()):
            if attrs.get(key):
                add(attrs[key], name)
        for key, value in attrs.items():
            if key.startswith("data-") and value and re.match(r"(?:https?:)?/", value):
                add(value, key)

    def text(data):
        if anchor:
            anchor[1] += data

    def end(name):
        if name == "a" and anchor:
            url, words = anchor
            anchor.clear()
            if url and any(w in words.lower() for w in _DOWNLOAD_WORDS):
                out.append({"url": url, "extension": "", "category": "potential_download", "found_via": "a"})

    if page:
        _walk(page, on_tag=tag, on_text=text, on_end=end)
    return out


def listing_files(page: str | None, base: str | None) -> list[str]:
    """Resolved links of a page that is a directory listing; none for any other page."""
    out: list[str] = []
    marks = [False]

    def tag(name, attrs):
        href = attrs.get("href", "")
        if name != "a" or not href:
            return
        if re.match(r"\?[CN]=", href):
            marks[0] = True
            return
        try:
            out.append(urljoin(base or "", href))
        except ValueError:
            pass

    def text(data):
        if "Index of" in data or "Parent Directory" in data:
            marks[0] = True

    if page:
        _walk(page, on_tag=tag, on_text=text)
    return out if marks[0] else []


# types are objects, not texts: a worker process that imports this module has no session to parse them
def _rows(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


@F.pandas_udf(_rows("url", "text", "rel"))
def page_links_udf(page: pd.Series) -> pd.Series:
    return page.map(page_links)


@F.pandas_udf(_rows("url", "extension", "category", "found_via"))
def file_links_udf(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([file_links(p, b) for p, b in zip(page, base)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def listing_files_udf(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([listing_files(p, b) for p, b in zip(page, base)], dtype=object)
