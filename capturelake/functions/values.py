"""Typed values out of loosely written texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions.instants import components, instant_of
from capturelake.session import let

# Texts which stand for a missing value.
NO_VALUE = ("", "n/a", "null", "none", "unknown", "-", "?")
# Texts of a boolean.
TRUE_TEXTS = ("true", "yes", "on", "t", "y", "1")
FALSE_TEXTS = ("false", "no", "off", "f", "n", "0")

#: White space, control and invisible characters that do not count around a value.
_EDGE = "".join(map(chr, (*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: A number; whole numbers may be grouped by commas.
_NUMBER = r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.0*)?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,4})?)\z"


def clean_value(text: Column) -> Column:
    """Text without outer white space and one pair of double quotes; NULL for a text that stands for no value."""
    outer = F.btrim(text, F.lit(_EDGE))
    quoted = outer.startswith('"') & outer.endswith('"') & (F.length(outer) > 1)
    inner = F.when(quoted, F.btrim(F.substr(outer, F.lit(2), F.length(outer) - 2), F.lit(_EDGE))).otherwise(outer)
    return F.when(~F.lower(inner).isin(*NO_VALUE), inner)


def key_name(text: Column) -> Column:
    """Letters and digits of a key, in lower case: equal for all spellings of an attribute."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def to_double(clean: Column) -> Column:
    """A finite number, or NULL."""
    number = F.when(clean.rlike(_NUMBER), F.replace(clean, F.lit(","), F.lit("")).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def to_bigint(clean: Column) -> Column:
    """A whole number in any notation that fits 64 bits, or NULL."""
    plain = F.replace(F.replace(clean, F.lit(","), F.lit("")), F.lit("+"), F.lit(""))
    digits = F.regexp_extract(plain, r"^(-?[0-9]+)(?:\.0*)?\z", 1)
    rounded = to_double(clean)
    whole = (F.abs(rounded) < 9.2e18) & (rounded == F.floor(rounded))
    exact = F.when(whole, plain.try_cast("decimal(38,15)"))
    return F.when(
        clean.rlike(_NUMBER),
        F.when(digits != "", digits.try_cast("bigint")).otherwise(F.when(exact == F.floor(exact), F.floor(exact)).try_cast("bigint")),
    )


def to_boolean(clean: Column) -> Column:
    low = F.lower(clean)
    return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)


def to_timestamp(clean: Column) -> Column:
    """A date, or a date with a time, that exists; without a zone it is UTC. Bare counts of seconds are no dates."""
    read = lambda c: F.when(c["kind"] == "date", c["local"]).otherwise(instant_of(c, F.lit("UTC")))
    return F.when(~clean.rlike(r"^[0-9]{9,13}\z"), F.timestamp_seconds(let(components(clean), read)))
