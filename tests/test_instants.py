import pytest
from pyspark.sql import functions as F

from capturelake.functions.instants import utc_seconds, utc_text
from capturelake.operators.timestamps import normalise_timestamps

CASES = [
    ("20091026193754", "wayback", "20091026193754"), ("20091026193754", "own_crawl", "20091026233754"), ("20091026193754123", "wayback", "20091026193754"),
    ("2009-10-26T19:37:54Z", "own_crawl", "20091026193754"), ("2009-10-26 19:37:54", "crawl", "20091026183754"), ("2009-10-26T19:37:54.999+05:30", "wayback", "20091026140754"),
    ("2009-10-26 19:37:54-0700", "wayback", "20091027023754"), ("26/Oct/2009:19:37:54 +0100", "wayback", "20091026183754"), ("Mon, 26 Oct 2009 19:37:54 GMT", "crawl", "20091026193754"),
    ("Oct 26, 2009 7:37:54 PM", "wayback", "20091026193754"), ("Oct 26, 2009 12:00:01 AM EDT", "wayback", "20091026040001"), ("2009-10-26 19:37:54 Asia/Tokyo", "wayback", "20091026103754"),
    ("1256585874", "own_crawl", "20091026193754"), ("1256585874999", None, "20091026193754"), (" 20091026193754 ", " WayBack ", "20091026193754"),
    # twice, skipped, impossible, not exact
    ("2009-11-01 01:30:00", "own_crawl", "20091101053000"), ("2009-03-08 02:30:00", "own_crawl", None), ("2009-03-29 02:30:00", "crawl", None), ("20010229120000", "wayback", None), ("20000229120000", "wayback", "20000229120000"),
    ("19000229120000", "wayback", None), ("20091331250000", "wayback", None), ("00000000000000", "wayback", None), ("2009-10-26T24:00:00Z", "wayback", None), ("2009-10-26T23:59:60Z", "wayback", None),
    ("Oct 26, 2009 13:00:00 PM", "wayback", None), ("2009-10-26", "wayback", None), ("200910", "wayback", None), ("2009", "wayback", None), ("20091026", "wayback", None), ("-", "wayback", None), ("", "wayback", None),
    (None, "wayback", None), ("pending", "wayback", None), ("20091026193754", "nobody", None), ("20091026193754", None, None), ("2009-10-26 19:37:54 Mars/Base", "wayback", None), ("2009-10-26T19:37:54+99:99", "wayback", None), ("x" * 100_000, "wayback", None),
    ("20091026193754\n", "wayback", "20091026193754"),
]


def test_cases(spark, sources):
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "i int, timestamp string, source string")
    got = {r["i"]: r["utc_time"] for r in normalise_timestamps(rows, sources).collect()}
    assert [(CASES[i], g) for i, g in sorted(got.items()) if g != CASES[i][2]] == []


def test_keeps_rows_and_clashing_columns(spark, sources):
    rows = spark.createDataFrame([("20000101000000", "wayback", "a", "b", "c")] * 2, "timestamp string, source string, zone string, _source string, utc_time string")
    out = normalise_timestamps(rows, sources)
    assert out.count() == 2 and sorted(out.columns) == sorted(rows.columns)
    assert out.first()["utc_time"] == "20000101000000" and out.first()["zone"] == "a"
    assert normalise_timestamps(rows.limit(0), sources).count() == 0
    assert normalise_timestamps(rows, sources.limit(0)).first()["utc_time"] is None


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "UTC"])
def test_any_session_zone(spark, sources, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([("2009-10-26 19:37:54",)], "t string")
        assert rows.select(utc_text(utc_seconds(F.col("t"), F.lit("Europe/Berlin"))).alias("x")).first()["x"] == "20091026183754"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
