"""Functions of capture fields: 14-digit timestamps, sizes, digests, content types, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.session import let


# 14-digit timestamps are texts that sort in time order; none of these functions casts them on the compare path.
def compact(iso: Column) -> Column:
    """14 digits of an ISO time: ``-``, ``:``, ``T`` and ``Z`` taken out, cut to 14 characters."""
    return F.substring(F.translate(iso, "-:TZ", ""), 1, 14)


def year(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 4)


def month(timestamp: Column) -> Column:
    return F.substring(timestamp, 5, 2)


def label(timestamp: Column) -> Column:
    """``YYYY-MM-DD`` of a 14-digit timestamp."""
    return F.concat_ws("-", F.substring(timestamp, 1, 4), F.substring(timestamp, 5, 2), F.substring(timestamp, 7, 2))


def from_time(time: Column) -> Column:
    """14 digits of a timestamp column, in the session's time zone."""
    return F.date_format(time, "yyyyMMddHHmmss")


def to_time(timestamp: Column) -> Column:
    """Timestamp of a full 14-digit text; NULL for any other."""
    return F.when(timestamp.rlike(r"^[0-9]{14}\z"), F.try_to_timestamp(timestamp, F.lit("yyyyMMddHHmmss")))


def falsy_coalesce(*columns: Column) -> Column:
    """The first column that is neither NULL nor '' nor, for numbers, 0; the last column if all are."""
    out = columns[-1]
    for c in reversed(columns[:-1]):
        text = c.cast("string")
        out = F.when(text.isNotNull() & ~text.isin("", "0"), c).otherwise(out)
    return out


def human_bytes(n: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB`` with one decimal, or ``GB`` with two; halves go to the even digit."""
    shown = lambda unit, power, digits: F.format_string(f"%.{digits}f {unit}", F.bround(n / 1024.0**power, digits))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, shown("KB", 1, 1))
        .when(n < 1024**3, shown("MB", 2, 1))
        .otherwise(shown("GB", 3, 2))
    )


def content_hash(body: Column) -> Column:
    """SHA-256 of a body, in hex."""
    return F.sha2(body, 256)


def url_digest(url: Column) -> Column:
    return F.md5(url)


# First bytes of file formats, in hex, in order of precedence.
MAGIC = (
    ("mp3", "FFFB"), ("mp3", "FFF3"), ("mp3", "FFF2"), ("mp3", "494433"), ("flac", "664C6143"), ("wav/avi", "52494646"), ("ogg", "4F676753"),
    ("mp4", "00000018667479706D7034"), ("mp4", "0000001C667479706D7034"), ("mp4", "00000020667479706D7034"), ("mkv/webm", "1A45DFA3"), ("zip/epub/docx/apk", "504B0304"), ("rar", "526172211A07"),
    ("7z", "377ABCAF271C"), ("gzip", "1F8B"), ("pdf", "25504446"), ("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"), ("exe/dll", "4D5A"), ("doc/xls/ppt (OLE)", "D0CF11E0"),
)
#: More formats that old pages link to.
OLD_MEDIA = (("midi", "4D546864"), ("swf", "465753"), ("swf", "435753"), ("bmp", "424D"))


def magic_type(body: Column, formats: tuple[tuple[str, str], ...] = MAGIC) -> Column:
    """Format by the first bytes, first match wins; ``unknown`` if none matches, NULL for NULL."""
    out = F.lit("unknown")
    for name, prefix in reversed(formats):
        n = len(prefix) // 2
        out = F.when(F.hex(F.substring(body, 1, n)) == prefix, F.lit(name)).otherwise(out)
    return F.when(body.isNotNull(), out)


def plausible_content(body: Column, ext: Column) -> Column:
    """False for fewer than four bytes, and for an HTML page under an extension that is not one of a page; else true."""
    head = F.lower(F.trim(F.decode(F.substring(body, 1, 32), "ISO-8859-1")))
    page = head.rlike(r"^(?:<!doctype|<html|<head|<\?xml)")
    return F.coalesce((F.octet_length(body) >= 4) & (~page | F.lower(ext).isin("html", "htm", "php", "asp", "aspx", "xml", "svg")), F.lit(False))


def tiny_page(mime: Column, size: Column, ext: Column, least: int = 2048) -> Column:
    """A page that stands where a file should be: HTML, small, under an extension that is none of a page."""
    return F.coalesce(F.lower(mime).contains("text/html"), F.lit(False)) & (size < least) & ~F.lower(ext).isin("html", "htm", "php", "asp", "")


# texts
def stripped(page: Column) -> Column:
    """Page text: each tag one blank, runs of white space one blank (Unicode white space too)."""
    return F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"(?U)\s+", " ")


def first_snippet(page: Column, keyword: Column, around: int = 100, longest: int = 200) -> Column:
    """Text around the first place of a keyword in the raw page, letter case ignored; NULL if it isn't there."""
    at = F.instr(F.lower(page), F.lower(keyword))

    def cut(k: Column) -> Column:
        start = F.greatest(k - around, F.lit(1))
        raw = F.substr(page, start, k - start + F.length(keyword) + around)
        flat = F.regexp_replace(F.replace(raw, F.lit("\n"), F.lit(" ")), "<[^>]+>", "")
        return F.when(k > 0, F.substring(F.trim(flat), 1, longest))

    return let(at, cut)


def keyword_hits(page: Column, keyword: Column, context: int = 120) -> Column:
    """Array of (position, context) of every place of a keyword in the stripped text, letter case ignored.

    Places do not overlap; positions count from 0; the context is trimmed. NULL pages and empty keywords have none.
    """

    def hits(text: Column) -> Column:
        parts = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.lower(keyword), F.lit("\\E")))
        lengths = F.transform(parts, lambda p: F.length(p))
        # the k-th place starts after the first k parts and the k - 1 keywords between them
        before = lambda k: F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * F.length(keyword)
        at = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), before)
        one = lambda p: F.struct(
            p.alias("position"),
            F.trim(F.substr(text, F.greatest(p - context, F.lit(0)) + 1, p - F.greatest(p - context, F.lit(0)) + F.length(keyword) + context)).alias("context"),
        )
        return F.when(F.size(parts) > 1, F.transform(at, one)).otherwise(F.array().cast("array<struct<position:int,context:string>>"))

    return F.when((keyword != "") & page.isNotNull(), let(stripped(page), hits))


def code_fence_body(text: Column) -> Column:
    """What stands inside a fenced block, else the trimmed text."""
    inner = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(text.contains("```"), inner).otherwise(text), r"^\s+|\s+\z", "")
