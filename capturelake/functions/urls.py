"""Url functions as Column expressions: parts, keys, extensions, file names, joins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to category, in order of precedence; an extension belongs to the first category that lists it.
CATEGORIES = (
    ("audio", "mp3 wav ogg flac mid midi wma m4a aac aiff mod xm it s3m"),
    ("video", "mp4 avi mkv mov wmv flv mpg mpeg webm rm rmvb 3gp asf"),
    ("image", "jpg jpeg png gif bmp webp svg tiff ico psd"),
    ("flash", "swf fla dcr"),
    ("archive", "zip rar 7z tar gz bz2 tgz lzh iso"),
    ("document", "pdf doc docx xls xlsx ppt pptx txt rtf odt"),
    ("software", "exe msi dmg apk jar deb rpm bin"),
    ("game", "rom nes smc gba wad pak"),
    ("font", "ttf otf woff woff2 eot"),
    ("data", "csv json xml sql db sqlite"),
    ("web", "html htm php asp aspx jsp cgi css js"),
)

#: Path of a url, of its text after scheme and authority.
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def domain(url: Column) -> Column:
    """Authority in lower case, with port and user; of a text without ``://`` what stands before the first slash."""
    return F.lower(
        F.when(url.contains("://"), F.regexp_extract(url, r"://([^/?#]*)", 1)).otherwise(F.substring_index(url, "/", 1))
    )


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def _bare_host(url: Column) -> Column:
    """What stands after the last ``//`` and before the next slash or question mark."""
    return F.substring_index(F.substring_index(F.element_at(F.split(url, "//"), -1), "/", 1), "?", 1)


def surt(url: Column) -> Column:
    """Reversed host labels, ``com,example)``; every ``www.`` is removed."""
    host = F.replace(_bare_host(url), F.lit("www."), F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"))


def urlkey(url: Column) -> Column:
    """Key of an index line: reversed domain and path; the path keeps its case, ``www.`` stays."""
    return F.concat(F.array_join(F.reverse(F.split(domain(url), r"\.")), ","), F.lit(")"), path(url))


def extension_anywhere(url: Column, longest: int = 6) -> Column:
    """What follows the last dot anywhere in the path, in lower case; '' if that is longer than ``longest``."""
    ext = F.regexp_extract(F.lower(path(url)), r"\.([^.]*)\z", 1)
    return F.when(F.length(ext) <= longest, ext).otherwise("")


def extension_of_file(url: Column, longest: int = 6) -> Column:
    """What follows the last dot of the last path segment, in lower case; '' if there is none or it is longer."""
    ext = F.regexp_extract(F.lower(path(url)), r"\.([^./]*)\z", 1)
    return F.when(F.length(ext) <= longest, ext).otherwise("")


def extension_of_text(url: Column) -> Column:
    """What follows the last dot of the url text, in lower case and without a query; fragments stay.

    The dot is sought before the query is cut, so ``a.php?x=b.mp3`` gives ``mp3``. '' if the last
    segment has no dot.
    """
    last = F.substring_index(url, "/", -1)
    ext = F.substring_index(F.lower(F.substring_index(url, ".", -1)), "?", 1)
    return F.when(last.contains("."), ext).otherwise("")


def category(ext: Column) -> Column:
    """Category of an extension by the first list that has it; ``other`` if none has."""
    seen: dict[str, str] = {}
    for name, exts in CATEGORIES:
        for e in exts.split():
            seen.setdefault(e, name)
    lookup = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])
    return F.coalesce(F.element_at(lookup, F.lower(ext)), F.lit("other"))


def resolve(url: Column, base: Column) -> Column:
    """Absolute form of a link: NULL for '', ``data:`` and ``javascript:`` links, and for relative ones without a base.

    ``//x`` becomes ``http://x`` and absolute links stay; a path from the root is put behind the base's host as it stands.
    """
    return (
        F.when(url.isNull() | (url == "") | url.startswith("data:") | url.startswith("javascript:"), None)
        .when(url.startswith("//"), F.concat(F.lit("http:"), url))
        .when(url.startswith("http"), url)
        .when(base.isNull() | (base == ""), None)
        .when(url.startswith("/"), F.concat(F.regexp_extract(base, _ROOT, 1), url))
        .otherwise(urljoin(base, url))
    )


_ROOT = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def _steps(path: Column, empty: bool) -> Column:
    """A path from the root without '.' and '..' segments, and without empty ones unless ``empty``; a slash at its end stays."""
    names = F.filter(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda x: x != "." if empty else ~x.isin("", "."))
    step = lambda kept, x: F.when(x != "..", F.array_append(kept, x)).otherwise(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    kept = F.when(path.contains(".."), F.aggregate(names, F.array().cast("array<string>"), step)).otherwise(names)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"/\.{1,2}\z" if empty else r"/\.{0,2}\z") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def urljoin(base: Column, url: Column) -> Column:
    """RFC 3986 resolution against a hierarchical base, with dot segments, in native expressions; NULL if either is NULL.

    An empty link gives the base; one with another scheme, or against a base without a host, stays as it is. White space and
    control characters before a link, and tabs and line ends in it, do not count. Empty queries and fragments
    are dropped, as are empty segments of a relative path.
    """
    root, scheme = F.regexp_extract(base, _ROOT, 1), F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    link = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    own, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_replace(F.regexp_extract(link, r"(?s)^[^?#]*(.*)\z", 1), r"^\?(?=#|\z)|#\z", "")
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    named = F.lower(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(url.isNotNull(), F.when(base.isNotNull(), (
        F.when(url == "", base)
        .when((root == "") | (named != "") & (named != scheme), url)
        .when(link == "", F.substring_index(base, "#", 1))
        .when(named != "", F.concat(scheme, F.regexp_replace(link, r"^[^:]*", "")))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), tail))
        .when(link.startswith("?"), F.concat(root, base_path, tail))
        .when(own.startswith("/"), F.concat(root, _steps(own, True), tail))
        .otherwise(F.concat(root, _steps(F.concat(F.when(folder == "", "/").otherwise(folder), own), False), tail))
    )))


def merge_key(url: Column) -> Column:
    """Key under which hits of different sources are merged: no slash at the end, lower case."""
    return F.lower(F.rtrim(url, F.lit("/")))


def strip_scheme(url: Column) -> Column:
    """Url text without scheme and ``www.``."""
    text = url
    for part in ("http://", "https://", "www."):
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _percent_decoded(text: Column) -> Column:
    """Percent decoding that keeps plus signs, and a text that can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def sanitise(name: Column, longest: int = 200) -> Column:
    """A file name without reserved characters; a longer one keeps 196 characters of its stem and its extension."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+\z", "")
    ext = F.regexp_extract(clean, r"(\.[^.]*)\z", 1)
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 4), ext)).otherwise(clean)


def filename(url: Column, ext: Column) -> Column:
    """File name of a url: decoded last path segment, else ``file_`` and eight digits of its md5; with its extension."""
    last = _percent_decoded(F.substring_index(F.substring_index(url, "?", 1), "/", -1))
    named = F.when(last == "", F.concat(F.lit("file_"), F.substring(F.md5(url), 1, 8))).otherwise(last)
    full = F.when((ext == "") | F.lower(named).endswith(F.concat(F.lit("."), ext)), named).otherwise(
        F.concat(named, F.lit("."), ext)
    )
    return F.substring(F.regexp_replace(full, r'[<>:"/\\|?*]', "_"), 1, 200)


def snapshot_url(base: str, timestamp: Column, url: Column, raw: bool = True) -> Column:
    """Address of a snapshot in an archive: base, timestamp (with ``id_`` for the raw form), url."""
    return F.concat(F.lit(base.rstrip("/") + "/"), timestamp, F.lit("id_/" if raw else "/"), url)


def years_in(url: Column) -> Column:
    """Struct (first, last) of the years 1900-2099 in a url text; NULL if it has none."""
    years = F.transform(F.regexp_extract_all(url, F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(F.size(years) > 0, F.struct(F.array_min(years).alias("first"), F.array_max(years).alias("last")))


def year_neighbours(url: Column) -> Column:
    """The url with its first year replaced by the years two and one before and after; an empty array without a year."""
    year = F.regexp_extract(url, r"((?:19|20)\d{2})", 1)
    shifted = lambda k: F.replace(url, year, (year.cast("int") + k).cast("string"))
    none = F.array().cast("array<string>")
    return F.when(year == "", none).otherwise(F.array(*[shifted(k) for k in (-2, -1, 1, 2)]))


def ordered_class(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first rule whose regular expression is found in the text; ``default`` if none is.

    Rules are (name, Java regular expression), in order. NULL texts give ``default``.
    """
    out = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: Parameters that make a link a signed one.
_SIGNED = r"(?i)[?&](?:x-amz-signature|signature|sig|token|sv|se|sp|spr)="


def is_signed(url: Column) -> Column:
    """Does a url carry a signature or access token? For audits; use ``redacted`` to pass such a url on."""
    return url.rlike(_SIGNED)


def redacted(url: Column) -> Column:
    """A signed url without its query; any other url as it is."""
    return F.when(is_signed(url), F.substring_index(url, "?", 1)).otherwise(url)


def extension_regex(extensions: list[str]) -> str:
    """Regular expression of urls that end in one of the extensions, before a query."""
    return r"(?i).*\.(?:" + "|".join(re.escape(e) for e in extensions) + r")(?:\?.*)?\z"


def mime_regex(types: list[str]) -> str:
    """Regular expression of the given media types."""
    return "(?:" + "|".join(re.escape(t) for t in types) + ")"
