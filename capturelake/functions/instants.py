"""UTC instants from timestamp texts of many forms: one regular expression, integer day arithmetic."""

from __future__ import annotations

import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.session import let

# Zone abbreviations of e-mail and log dates, in hours from UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3,
    "JST": 9, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY_NAME = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?"
_ZONE = r"(?:[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}|[a-z]{1,5}|[a-z]+/[a-z0-9_+-]+(?:/[a-z0-9_+-]+)?)"
_FRACTION = r"(?:[.,][0-9]{1,9})?"

#: The forms of a time, each with the names of its groups; a name stands for one component.
_FORMS = (
    # 20040229235959, with fraction digits or a T between date and time
    "{y}{mo2}{d2}t?{h2}{mi}{s}(?:[.,]?[0-9]{{1,9}})?(?: ?{z})?",
    # 2004-02-29 23:59:59.123+01:00
    "{y}[-/.]{mo}[-/.]{d}(?:t|[ _]+){h}:{mi}:{s}" + _FRACTION.replace("{", "{{").replace("}", "}}") + "(?: ?\\(?{z}\\)?)?",
    # 29/Feb/2004:23:59:59 +0100
    "\\[?{d}/{name}/{y}:{h2}:{mi}:{s}(?: {z})?\\]?",
    # Sun, 29 Feb 2004 23:59:59 GMT
    "(?:{week},? +)?{d}[ -]{name}[ -]{y},? +{h}:{mi}:{s}(?: \\(?{z}\\)?)?",
    # Feb 29, 2004 11:59:59 PM
    "(?:{week},? +)?{name}\\.? +{d},? +{y},? +{h}:{mi}:{s}(?: ?{half})?(?: \\(?{z}\\)?)?",
    # Sun Feb 29 23:59:59 GMT 2004
    "{week} +{name} +{d} +{h}:{mi}:{s}(?: {z})? +{y}",
)
#: Dates without a time; they name no instant, but are dates.
_DATES = ("{y}-?{mo2}-?{d2}", "{y}/{mo2}/{d2}", "(?:{week},? +)?{d}[ -]{name}[ -]{y}", "(?:{week},? +)?{name}\\.? +{d},? +{y}")
_EPOCHS = ("{sec}", "{ms}")

_GROUPS = {
    "y": r"[0-9]{4}", "mo": r"[0-9]{1,2}", "mo2": r"[0-9]{2}", "d": r"[0-9]{1,2}", "d2": r"[0-9]{2}", "h": r"[0-9]{1,2}", "h2": r"[0-9]{2}",
    "mi": r"[0-9]{2}", "s": r"[0-9]{2}", "z": _ZONE, "name": _MONTH, "half": r"[ap]\.?m\.?", "sec": r"[0-9]{9,10}", "ms": r"[0-9]{11,13}",
}
#: Components in the order in which they are written out, each with the groups that may hold it.
_COMPONENTS = (("y",), ("mo", "mo2"), ("d", "d2"), ("h", "h2"), ("mi",), ("s",), ("name",), ("half",), ("z",), ("sec",), ("ms",))
_SEP = "\x01"


@lru_cache
def alternation() -> tuple[str, str]:
    """All forms as one alternation with named groups, and the replacement that writes out the components.

    A name is used once in a Java expression, so each form numbers its own groups; of the groups
    of a component at most one took part in a match, and the others are empty.
    """
    used: dict[str, list[str]] = {k: [] for k in _GROUPS}
    forms = []
    for n, form in enumerate((*_FORMS, *_DATES, *_EPOCHS)):
        names = {}
        for k, pattern in _GROUPS.items():
            if "{" + k + "}" in form:
                used[k].append(f"{k}{'abcdefghijklmnop'[n]}")
                names[k] = f"(?<{used[k][-1]}>{pattern})"
        forms.append(form.format(week=_DAY_NAME, **names))
    fields = ["".join(f"${{{g}}}" for k in part for g in used[k]) for part in _COMPONENTS]
    return r"(?i)^\s*(?:" + "|".join(forms) + r")\s*\z", _SEP + _SEP.join(fields)


@lru_cache
def _zones_of(_: int) -> tuple[str, ...]:
    spark = SparkSession.getActiveSession()
    known = set(zoneinfo.available_timezones())
    if spark is not None and getattr(spark, "_jvm", None) is not None:
        known &= set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return tuple(sorted(z for z in known if "/" in z or z == "UTC"))


def known_zones() -> tuple[str, ...]:
    """IANA zone names that both Python and the JVM know."""
    return _zones_of(id(SparkSession.getActiveSession()))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, by integer arithmetic."""
    from_march = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(from_march / 400)
    year_of_era = from_march - era * 400
    day_of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    day_of_era = year_of_era * 365 + F.floor(year_of_era / 4) - F.floor(year_of_era / 100) + day_of_year
    return (era * 146097 + day_of_era - 719468).cast("long")


def components(text: Column) -> Column:
    """Struct (kind, local, zone) of a timestamp text; NULL if it has no known form or an impossible value.

    kind is ``time``, ``date`` or ``epoch``; local is the clock time as seconds since 1970 as if
    it were UTC (of an epoch text: the instant); zone is the zone text or ''. Fractions are dropped.
    """
    pattern, order = alternation()

    def read(parts: Column) -> Column:
        text_of = lambda k: F.element_at(parts, k + 2)
        number = lambda k: F.nullif(text_of(k), F.lit("")).cast("int")
        named = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(text_of(6), 1, 3))) + 2) / 3).cast("int")
        month = F.when(text_of(6) != "", named).otherwise(number(1))
        year, day, hour = number(0), number(2), number(3)
        half = F.lower(F.substring(text_of(7), 1, 1))
        clock = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        good_date = (year >= 1) & month.between(1, 12) & day.between(1, last)
        good_time = (
            F.when(half == "", hour <= 23).otherwise(hour.between(1, 12)) & (number(4) <= 59) & (number(5) <= 59)
        )
        midnight = _days(year, month, day) * 86400
        # all branches have nullable fields, so that their types are equal without a cast
        nullable = lambda x: F.when(parts.isNotNull(), x)
        struct = lambda kind, local, zone: F.struct(nullable(F.lit(kind)).alias("kind"), nullable(local.cast("long")).alias("local"), nullable(zone).alias("zone"))
        return (
            F.when(text_of(9) != "", struct("epoch", text_of(9), F.lit("UTC")))
            .when(text_of(10) != "", struct("epoch", F.floor(text_of(10).cast("long") / 1000), F.lit("UTC")))
            .when(good_date & (text_of(3) == ""), struct("date", midnight, F.lit("")))
            .when(good_date & good_time, struct("time", midnight + clock * 3600 + number(4) * 60 + number(5), text_of(8)))
        )

    parts = F.split(F.regexp_replace(text, pattern, order), _SEP)
    return let(parts, lambda p: F.when(F.size(p) == len(_COMPONENTS) + 1, read(p)))


def _at_zone(local: Column, zone: Column) -> Column:
    """UTC second of a clock time in a zone: the first, if it occurs twice; NULL if the clocks skip it."""
    clock = F.timestamp_seconds(local)
    utc = F.to_utc_timestamp(clock, zone)
    return let(utc, lambda u: F.when(F.from_utc_timestamp(u, zone) == clock, F.unix_seconds(u)))


def _civil_seconds(text: Column) -> Column:
    """Clock time of a 14-digit text, as seconds since 1970 as if it were UTC; NULL if there is no such time."""
    year, month, day, hour, minute, second = (F.substring(text, a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (year >= 1) & month.between(1, 12) & day.between(1, last) & (hour <= 23) & (minute <= 59) & (second <= 59)
    return F.when(good, _days(year, month, day) * 86400 + hour * 3600 + minute * 60 + second)


def instant_of(c: Column, default_zone: Column) -> Column:
    """UTC second of what ``components`` read; NULL for a date, and for a clock time that the zone skips or whose zone is unknown."""
    zone = F.when(c["zone"] == "", default_zone).otherwise(c["zone"])

    def placed(z: Column) -> Column:
        digits = F.regexp_replace(z, ":", "")
        hours, minutes = F.substring(digits, 2, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")), F.lit("0")).cast("int")
        shift = F.when(z.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60)
        offset = F.when(F.length(z) <= 5, F.element_at(_abbreviations(), F.upper(z)))
        return (
            F.when(z.rlike("^[+-]"), F.when((hours <= 18) & (minutes <= 59), c["local"] - shift))
            .when(offset.isNotNull(), c["local"] - offset * 3600)
            .when(z.isin(*known_zones()), _at_zone(c["local"], z))
        )

    return F.when(c["kind"] == "epoch", c["local"]).when(c["kind"] == "time", let(zone, placed))


def utc_seconds(text: Column, default_zone: Column) -> Column:
    """UTC second that a timestamp text names; NULL if it names none.

    A text without a zone is clock time in ``default_zone`` (an IANA name; NULL or an unknown name:
    no instant). NULL, '', dates without a time, impossible or skipped clock times and unknown
    zones give NULL. A 14-digit text needs no expression match.
    """
    digits = _civil_seconds(text)
    plain = F.when(default_zone == "UTC", digits).otherwise(_at_zone(digits, default_zone))
    return F.when(text.rlike(r"^[0-9]{14}\z") & default_zone.isin(*known_zones()), plain).otherwise(let(components(text), lambda c: instant_of(c, default_zone)))


def _abbreviations() -> Column:
    return F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])


def utc_text(seconds: Column) -> Column:
    """14-digit UTC text of a UTC second, whatever the session's time zone."""

    def civil(sec: Column) -> Column:
        days, rest = F.floor(sec / 86400).cast("long"), F.pmod(sec, F.lit(86400))
        date = F.date_from_unix_date(days.cast("int"))
        two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
        return F.concat(
            F.lpad(F.year(date).cast("string"), 4, "0"), two(F.month(date)), two(F.dayofmonth(date)),
            two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60),
        )

    return let(seconds.cast("long"), civil)


#: Largest number of sources; it bounds the literal table of their zones.
MAX_SOURCES = 5000


def zone_of(source: Column, sources: DataFrame) -> Column:
    """Zone of a source's name; NULL for an unknown source.

    Letter case and outer blanks of the name do not count. ``sources`` is a fixed table of a few sources
    (archive_sources, 11 rows); it becomes a literal map, and more than ``MAX_SOURCES`` rows are an error.
    """
    rows = sources.select("source", "zone").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    zones: dict[str, str] = {}
    for name, zone in sorted((r["source"].strip().lower(), r["zone"]) for r in rows if r["source"] is not None and r["zone"] is not None):
        zones.setdefault(name, zone)
    key = F.lower(F.regexp_replace(source, r"^[\s\u00a0]+|[\s\u00a0]+\z", ""))
    if not zones:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in zones.items() for x in kv]), key)
