"""Mixed timestamp formats: rows whose timestamp names an instant, in one unambiguous form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.instants import utc_seconds, utc_text, zone_of
from capturelake.session import once


def normalise_timestamps(
    df: DataFrame, sources: DataFrame, *, text: str = "timestamp", source: str = "source", into: str = "utc_time"
) -> DataFrame:
    """``df`` with ``into``: the 14-digit UTC text of each row's timestamp, NULL where it names no instant.

    A text without a zone is clock time in the zone of the row's source. Rows are kept as they are,
    repeated rows too; a column called like ``into`` is replaced; an empty table gives an empty one.
    The plan is one projection over the scan, without join or exchange.
    """
    return df.withColumn(into, utc_text(utc_seconds(F.col(text), zone_of(F.col(source), sources))))


def to_be_normalised(
    df: DataFrame, sources: DataFrame, *, text: str = "timestamp", source: str = "source", into: str = "utc_time"
) -> DataFrame:
    """The rows whose timestamp names an instant and is not yet its 14-digit UTC text, with that text in ``into``."""
    utc = utc_text(utc_seconds(F.col(text), zone_of(F.col(source), sources)))
    return once(df, utc, into).filter(F.col(into) != F.col(text))
