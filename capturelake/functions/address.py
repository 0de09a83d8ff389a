"""The address that a url text names, apart from its spelling."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.session import let

#: White space, control and invisible characters that may stand anywhere in a url text.
BLANKS = r"[\s\x00-\x1f\x7f\x85 ­ ᠎ -‏ -  -⁤　﻿]+"

#: Percent escapes which are decoded: unreserved characters, white space and bytes of non-ASCII letters.
_PLAIN_ESCAPE = r"%(?:2[de]|3[0-9]|4[1-9a-f]|5[0-9af]|6[1-9a-f]|7[0-9ae]|0[9a-d]|20|[89a-f][0-9a-f])"

#: Marks of the surrounding text, and signs of an empty query, field or fragment, at the end of a url.
_TAIL_MARKS = r"[\"'`<>()\[\]{}|,;:.!?#&*‘-‟«»…、。）]+\z"

_CLEAN_PATH = (
    r"^https?://[a-z0-9-]++(?:\.[a-z0-9-]++)*+(?!:(?:80|443)(?![0-9]))(?::[1-9][0-9]{0,4}+)?"
    r"(?:/[a-z0-9_~-]++(?:\.[a-z0-9_~-]++)*+)*+/*"
)
#: A text that is its own address, but for slashes at its end.
_CLEAN = _CLEAN_PATH + r"\z"
#: The same with query fields, which are still to be sorted.
_CLEAN_QUERY = _CLEAN_PATH + r"\?(?:[a-z0-9_~-][a-z0-9_~.=&-]*)?[a-z0-9_~-]\z"

_PARTS = r"^(https?):/+([^/?#]*)([^?#]*)\??([^#]*)#?(.*)\z"


def _named_entities() -> Column:
    """Map of all named character references of HTML that are one character, as a literal that is folded once."""
    known = {n.rstrip(";"): c for n, c in html.entities.html5.items() if n.endswith(";") and len(c) == 1}
    return F.from_json(F.lit(json.dumps(known)), "map<string,string>")


def _entities(text: Column) -> Column:
    """Character entities decoded, escaped any number of times; unknown names are left alone."""
    text = F.regexp_replace(text, r"(?i)&(?:amp;|#0*38;|#x0*26;)(?:(?:amp|#0*38|#x0*26);)*", "&")
    for name, plain in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("shy", "")):
        text = F.regexp_replace(text, f"(?i)&{name};", plain)

    def named(parts: Column) -> Column:
        def one(part: Column, k: Column) -> Column:
            name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]{1,31});", 1)
            char = F.when(name != "", F.element_at(_named_entities(), name))
            return F.when(k == 0, part).when(char.isNotNull(), F.concat(char, F.regexp_replace(part, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), part))

        return F.concat_ws("", F.transform(parts, one))

    def numeric(parts: Column) -> Column:
        def one(part: Column, k: Column) -> Column:
            code = F.regexp_extract(part, r"^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
            number = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).cast("int")
            known = (number > 0) & (number < 0xD800) | (number > 0xDFFF) & (number < 0x110000)
            char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
            return (
                F.when(k == 0, part)
                .when(known, F.concat(char, F.regexp_replace(part, r"^[^;]*;", "")))
                .otherwise(F.concat(F.lit("&#"), part))
            )

        return F.concat_ws("", F.transform(parts, one))

    text = F.when(text.contains("&#"), numeric(F.split(text, "&#"))).otherwise(text)
    return F.when(text.rlike("&[A-Za-z][A-Za-z0-9]{1,31};"), named(F.split(text, "&"))).otherwise(text)


def _decoded(text: Column) -> Column:
    """Needless percent escapes decoded; the others keep their lower-case form."""
    guarded = F.replace(F.regexp_replace(text, f"%(?!{_PLAIN_ESCAPE[1:]})", "%25"), F.lit("+"), F.lit("%2b"))
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(guarded), text)).otherwise(text)


def _climbed(path: Column) -> Column:
    """Path with its '..' segments resolved, however many; those above the root are dropped."""
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    step = lambda kept, x: F.when(x != "..", F.array_append(kept, x)).otherwise(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    kept = F.aggregate(names, F.array().cast("array<string>"), step)
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("/"), x)), "")


def _path(path: Column) -> Column:
    """Path without needless slashes and dot segments."""
    path = F.regexp_replace(path, r"/(?:\.?/)+", "/")  # "//" and "/./"
    path = F.regexp_replace(path, r"/\.\z", "/")
    path = F.when(path.contains("/.."), _climbed(path)).otherwise(path)
    return F.regexp_replace(path, r"/+\z", "")


def _query(query: Column) -> Column:
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: ~f.isin("", "=")))
    return F.when(query == "", "").otherwise(
        F.when(F.size(fields) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(fields, "&")))
    )


def address(url: Column) -> Column:
    """Canonical address of a url text; NULL for a text that is no http or https url.

    Equal for texts that differ only in white space (raw or escaped, anywhere), letter case, order
    of the query fields, surrounding marks, needless escapes, implied port, empty query, field or
    fragment, and needless slashes and dots. NULL and '' give NULL. Texts of any length are
    processed whole, in native expressions.
    """
    path, query = F.substring_index(url, "?", 1), F.substring_index(url, "?", -1)
    return (
        F.when(url.rlike(_CLEAN), F.rtrim(url, F.lit("/")))
        .when(url.rlike(_CLEAN_QUERY), F.concat(F.rtrim(path, F.lit("/")), _query(query)))
        .otherwise(_respelled(url))
    )


def _respelled(url: Column) -> Column:
    """The address of a text that may be spelled in any way."""
    text = F.when(url.rlike(BLANKS), F.regexp_replace(url, BLANKS, "")).otherwise(url)
    text = F.when(text.rlike("&#?[A-Za-z0-9]{1,32};"), F.regexp_replace(_entities(text), BLANKS, "")).otherwise(text)
    return let(F.lower(text), _from_plain)


def _from_plain(text: Column) -> Column:
    """The address of a lower-case text without raw blanks and character entities."""
    text = F.when(text.contains("%"), F.regexp_replace(F.lower(_decoded(text)), BLANKS, "")).otherwise(text)

    def whole(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, _PARTS, k)
        query_plus = F.replace(part(4), F.lit("+"), F.lit(""))  # "+" is an escaped blank there
        host = F.regexp_replace(part(2), r"\.*(?::0*)?\z|\.+(?=:[0-9]+\z)", "")
        host = F.when(~host.contains(":"), host).otherwise(
            F.when(t.startswith("http:"), F.regexp_replace(host, r":0*80\z", "")).otherwise(
                F.regexp_replace(host, r":0*443\z", "")
            )
        )
        tail = F.when(part(5) == "", "").otherwise(F.concat(F.lit("#"), part(5)))
        return F.when(
            part(2).rlike(r"[^.:@]"), F.concat(part(1), F.lit("://"), host, _path(part(3)), _query(query_plus), tail)
        )

    bare = F.regexp_replace(text, r"^[^a-z0-9]+", "")
    # a slash among the marks is one at the end of the path, unless there is a query
    slashes = _TAIL_MARKS.replace("[", "[/", 1)
    stripped = F.when(bare.contains("?"), F.regexp_replace(bare, _TAIL_MARKS, "")).otherwise(F.regexp_replace(bare, slashes, ""))
    return let(stripped, lambda t: F.when(t.rlike(r"^https?:/"), whole(t)))


def id128(*texts: Column) -> list[Column]:
    """Two 64-bit integers that identify a value; together they collide for 10^11 values with a chance below 1e-16."""
    return [F.xxhash64(*texts), F.xxhash64(F.lit(7919), *texts)]
