"""Capture index: lookups, filters, collapsing, limits, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import urls
from capturelake.functions.captures import falsy_coalesce
from capturelake.operators.numbering import running_max


# ---- predicates
def matches(url: str, match_type: str = "exact", *, column: str = "url", domain_column: str = "domain", strict: bool = False) -> Column:
    """Predicate of a lookup.

    ``exact`` (and any unknown type): equal urls. ``domain`` and ``host``: equal authority. ``subdomains``:
    that, or a host below it. ``prefix``: urls that begin with the text, ASCII letter case ignored and with
    ``_`` and ``%`` as wildcards, unless ``strict``, whose plain prefix reaches the files' statistics.
    """
    name = url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()
    if match_type in ("domain", "host"):
        return F.col(domain_column) == name
    if match_type == "subdomains":
        return (F.col(domain_column) == name) | F.col(domain_column).endswith("." + name)
    if match_type == "prefix":
        return F.col(column).startswith(url) if strict else F.col(column).ilike(url + "%")
    return F.col(column) == url


def filter_expression(text: str, aliases: dict[str, str] | None = None) -> Column:
    """Predicate of a filter text: ``[!]field:regex``, or ``=field:value`` and ``!=field:value`` for whole values.

    A regular expression must match the whole value. Field names go through ``aliases``.
    """
    aliases = {"statuscode": "status_code", "mimetype": "mime_type", "original": "url", "length": "content_length"} | (aliases or {})
    equal, negated = False, False
    if text.startswith("!="):
        equal, negated, text = True, True, text[2:]
    elif text.startswith("="):
        equal, text = True, text[1:]
    elif text.startswith("!"):
        negated, text = True, text[1:]
    field, colon, value = text.partition(":")
    if not colon or not field:
        raise ValueError(f"a filter is [!]field:regex, not {text!r}")
    column = F.coalesce(F.col(aliases.get(field, field)).cast("string"), F.lit(""))
    test = column == value if equal else column.rlike(f"^(?:{value})\\z")
    return ~test if negated else test


def between_years(first: int | None, last: int | None, column: str = "timestamp") -> Column:
    """Timestamps from the first moment of ``first`` to the last of ``last``, by text comparison; it is pushed to the scan."""
    test = F.lit(True)
    if first is not None:
        test = test & (F.col(column) >= str(first))
    if last is not None:
        test = test & (F.col(column) < str(last + 1))
    return test


def has_extension(extensions: list[str], column: str = "url") -> Column:
    """Urls that end in ``.ext`` or hold ``.ext?``, letter case ignored."""
    low = F.lower(F.col(column))
    test = F.lit(False)
    for e in extensions:
        test = test | low.endswith(f".{e.lower()}") | low.contains(f".{e.lower()}?")
    return test


def no_junk_host(junk: list[str], column: str = "domain") -> Column:
    """Hosts that hold none of the given texts."""
    test = F.lit(True)
    for j in junk:
        test = test & ~F.col(column).contains(j)
    return test


def no_page_as_file(mime: str = "mime_type", url: str = "url") -> Column:
    """Rows that are no HTML page under the extension of a file."""
    page = F.coalesce(F.col(mime), F.lit("")).contains("text/html")
    return ~page | urls.extension_anywhere(F.col(url)).isin("html", "htm", "php", "asp")


def at_least_size(minimum: dict[str, int], default: int = 0, *, ext: Column, size: Column) -> Column:
    """Rows of at least the size that their extension asks for."""
    lookup = F.create_map(*[F.lit(x) for kv in (minimum or {"": default}).items() for x in kv])
    return size >= F.coalesce(F.element_at(lookup, ext), F.lit(default))


def no_small_page(categories: list[str], *, category: Column, mime: Column, size: Column, least: int = 50000) -> Column:
    """Rows that are no small HTML page in one of the media categories; what is unknown rules nothing out."""
    return ~F.coalesce(category.isin(categories) & mime.contains("html") & (size < least), F.lit(False))


# Extensions of pages.
PAGE_EXTENSIONS = ("html", "htm", "php", "asp", "aspx", "jsp", "cgi", "shtml", "pl", "")


def is_page(url: Column, ext: Column) -> Column:
    """A page rather than a file: a page's extension, none, or a slash at the end."""
    return ext.isin(*PAGE_EXTENSIONS) | url.endswith("/")


def likely_file(ext: Column, confidence: Column, least: float = 0.3) -> Column:
    """Targets with a known extension and enough confidence."""
    return (F.coalesce(ext, F.lit("")) != "") & F.coalesce(confidence >= least, F.lit(False))


def wanted_target(ext: Column, category: Column, wanted: list[str], known: list[str]) -> Column:
    """Targets of a wanted extension, and those whose link only promises a download and whose extension is unknown."""
    ext, category = F.coalesce(ext, F.lit("")), F.coalesce(category, F.lit(""))
    return ext.isin(wanted) | (category == "potential_download") & ~ext.isin(known)


def status_among(status: Column, words: list[str]) -> Column:
    """Rows whose status text holds one of the words, letter case ignored."""
    low = F.lower(F.coalesce(status, F.lit("")))
    test = F.lit(False)
    for w in words:
        test = test | low.contains(w.lower())
    return test


def by_size(size: Column) -> list[Column]:
    """Order of the captures of a file: the largest first, unknown sizes last."""
    return [size.desc_nulls_last()]


def by_confidence_and_category(confidence: Column, category: Column) -> list[Column]:
    """Order of targets: the surest first, then by category."""
    return [confidence.desc_nulls_last(), category.asc_nulls_first()]


def by_confidence_and_size(confidence: Column, size: Column) -> list[Column]:
    """Order of lookups: the surest first, then the largest."""
    return [confidence.desc_nulls_last(), size.desc_nulls_last()]


# ---- tiers
def tiered(df: DataFrame, tests: list[Column]) -> DataFrame:
    """Rows of the strictest test that any row passes, with its ``tier``; later tests are the looser ones.

    One pass tags each row with its tier; the smallest tier is a single number joined back.
    """
    tier = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)])
    tagged = df.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = tagged.agg(F.min("tier").alias("_best"))
    return tagged.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best")


# ---- collapsing
def first_per(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row of each key by a total order; combined map-side, so a hot key is one row per task."""
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*df.columns)
    rank = F.struct(*order)
    best = df.select(*[k.alias(n) for k, n in zip(keys, names)], row.alias("_row"), rank.alias("_rank")).groupBy(*names).agg(F.min_by("_row", "_rank").alias("_row"))
    return best.select("_row.*")


def collapse_digest(df: DataFrame, order: list[Column], digest: str = "digest") -> DataFrame:
    """One capture per digest, the first by ``order``; captures without one (NULL or '') all stay."""
    known = F.coalesce(F.col(digest), F.lit("")) != ""
    return first_per(df.filter(known), [F.col(digest)], order).unionByName(df.filter(~known))


def limit_then_collapse(df: DataFrame, limit: int, *, time: str = "timestamp", row_id: str = "id", digest: str = "digest") -> DataFrame:
    """The latest ``limit`` captures, and of those one per digest, the latest; a limit of a lookup, applied before collapsing."""
    latest = df.orderBy(F.col(time).desc_nulls_last(), F.col(row_id)).limit(limit)
    known = F.coalesce(F.col(digest), F.lit("")) != ""
    w = Window.partitionBy(F.when(known, F.col(digest)), ~known, F.when(~known, F.col(row_id))).orderBy(F.col(time).desc_nulls_last(), F.col(row_id))
    return latest.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def collapse_adjacent_digest(df: DataFrame, *, url: str = "url", time: str = "timestamp", row_id: str = "id", digest: str = "digest") -> DataFrame:
    """Captures whose digest differs from that of the capture of the same url before; a hot url is spread over several tasks."""
    rows = running_max(df, [url], [time, row_id], F.struct(time, row_id, digest), "_prev")
    return rows.filter(F.col(digest).isNull() | ~F.col(digest).eqNullSafe(F.col("_prev")[digest])).drop("_prev")


def first_by_digest_or_url(df: DataFrame, order: list[Column], *, digest: str = "digest", url: str = "url") -> DataFrame:
    """First row of each digest, or of each url where the digest is NULL; an empty digest is one key, however many rows have it."""
    key = F.coalesce(F.concat(F.lit("d "), F.col(digest)), F.concat(F.lit("u "), F.col(url)))
    return first_per(df, [key], order)


def first_by_file_name(df: DataFrame, order: list[Column], *, url: str = "url", keep_case: bool = False) -> DataFrame:
    """First row of each file name, without the query; letter case is ignored unless ``keep_case``."""
    name = F.substring_index(F.substring_index(F.col(url), "?", 1), "/", -1)
    return first_per(df, [name if keep_case else F.lower(name)], order)


def collapse_timestamp(df: DataFrame, digits: int, *, keys: list[str], time: str = "timestamp", row_id: str = "id") -> DataFrame:
    """First capture of each key and prefix of the timestamp."""
    return first_per(df, [*[F.col(k) for k in keys], F.substring(F.col(time), 1, digits)], [F.col(time), F.col(row_id)])


# ---- lookups
def search(
    captures: DataFrame, url: str, match_type: str = "exact", *, limit: int | None = 200, status: int | None = None,
    collapse: str | None = None, filters: list[str] | None = None, first_year: int | None = None, last_year: int | None = None, strict: bool = False,
) -> DataFrame:
    """Captures of a url, domain or prefix, latest first: filters, then the limit, then collapsing of what is left.

    ``status`` 0 or None is no filter; ``limit`` None is none. ``collapse`` is ``digest`` or ``urlkey``.
    """
    df = captures.filter(matches(url, match_type, strict=strict))
    if status:
        df = df.filter(F.col("status_code") == status)
    for f in filters or []:
        df = df.filter(filter_expression(f))
    df = df.filter(between_years(first_year, last_year))
    if collapse == "urlkey":
        df = first_per(df, [F.col("url")], [F.col("timestamp"), F.col("id")])
    if collapse == "digest" and limit is not None:
        return limit_then_collapse(df, limit)
    if collapse == "digest":
        return collapse_digest(df, [F.struct(F.col("timestamp")), F.col("id")])
    return df if limit is None else df.orderBy(F.col("timestamp").desc_nulls_last(), "id").limit(limit)


def best_timestamps(captures: DataFrame, url: str, limit: int = 10) -> DataFrame:
    """The largest good captures of a url: (timestamp, length), unknown lengths last, shown as 0."""
    good = captures.filter((F.col("url") == url) & (F.col("status_code") == 200))
    top = good.orderBy(F.col("content_length").desc_nulls_last(), "timestamp", "id").limit(limit)
    return top.select("timestamp", F.coalesce("content_length", F.lit(0)).alias("length"))


def has_domain(captures: DataFrame, domain: str) -> DataFrame:
    """One row: is there any capture of the domain? The scan stops at the first."""
    return captures.filter(F.col("domain") == domain).limit(1).agg((F.count(F.lit(1)) > 0).alias("known"))


def nearest(queries: DataFrame, captures: DataFrame, *, url: str = "url", at: str = "at", time: str = "timestamp") -> DataFrame:
    """For each (url, at) the latest capture not after it, as ``found``; NULL if there is none.

    An as-of join in one sort: captures and queries are put in one line, and each query takes the last capture
    before it. A url with very many captures or queries is spread over several tasks.
    """
    points = captures.select(F.col(url).alias("_u"), F.col(time).alias("_t"), F.col(time).alias("_c"), F.lit(0).alias("_q"))
    asks = queries.select(F.col(url).alias("_u"), F.col(at).alias("_t"), F.lit(None).cast("string").alias("_c"), F.lit(1).alias("_q"))
    line = running_max(points.unionByName(asks), ["_u"], ["_t", "_q"], F.col("_c"), "found", including=True)
    return line.filter("_q = 1").select(F.col("_u").alias(url), F.col("_t").alias(at), "found")


# ---- ingestion
def normalise_records(df: DataFrame, *, query_url: str | None = None, source: str = "wayback") -> DataFrame:
    """Index rows out of records with any of the usual field names.

    url or original (else the query's), timestamp, statuscode or status_code (else 200), mimetype, mime_type,
    mime or mime-detected, length or content_length (else 0), digest, filename, offset. A value that is
    NULL, '' or 0 gives way to the next name. The domain is the query's, if there is one.
    """
    known = set(df.columns)

    def pick(default: Column, *names: str) -> Column:
        return falsy_coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in known], default.cast("string"))

    url = pick(F.lit(query_url or ""), "url", "original")
    rows = df.select(
        url.alias("url"), pick(F.lit(""), "timestamp").alias("timestamp"),
        F.coalesce(pick(F.lit(200), "statuscode", "status_code", "status").try_cast("int"), F.lit(200)).alias("status_code"),
        pick(F.lit(""), "mimetype", "mime_type", "mime", "mime-detected").alias("mime_type"),
        F.coalesce(pick(F.lit(0), "length", "content_length").try_cast("bigint"), F.lit(0)).alias("content_length"),
        pick(F.lit(""), "digest").alias("digest"), F.lit(source).alias("source"),
        pick(F.lit(None), "filename", "warc_file").alias("warc_file"), pick(F.lit(None), "offset", "warc_offset").try_cast("bigint").alias("warc_offset"),
    )
    domain = urls.domain(F.lit(query_url)) if query_url else urls.domain(F.col("url"))
    return rows.withColumn("domain", domain)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Incoming rows whose key is not stored, one per key; NULL keys count as different, as in a unique index."""
    keys = keys or ["url", "timestamp", "source"]
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    fresh = incoming.filter(complete).dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*incoming.columns)
    return fresh.unionByName(incoming.filter(~complete))


def unseen(df: DataFrame, seen: DataFrame, key: Column, seen_key: str) -> DataFrame:
    """Rows whose key is not among those seen: downloads, stored blobs, known urls."""
    return df.withColumn("_key", key).join(seen.select(F.col(seen_key).alias("_key")), "_key", "left_anti").drop("_key")
