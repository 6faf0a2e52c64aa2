import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vialworks.operators.timestamps import DAY_US, estimate_zones, normalise_timestamps, read_timestamp

ZONES = [("kr", "Asia/Seoul", "YMD"), ("de", "Europe/Berlin", "DMY"), ("us", "America/Chicago", "MDY")]


def us(*a):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "order", "want"),
    [
        ("2024-07-27", "YMD", (us(2024, 7, 27), None)), ("24.05.13", "YMD", (us(2024, 5, 13), None)), ("24.05.13", "DMY", (us(2013, 5, 24), None)),
        ("03/04/2021", "MDY", (us(2021, 3, 4), None)), ("03/04/2021", "DMY", (us(2021, 4, 3), None)), ("25/06/2019", "MDY", (us(2019, 6, 25), None)),
        ("31/11/2022", "DMY", None), ("2021.13.05", "YMD", None), ("2023-02-30", "YMD", None), ("0000-00-00", "YMD", None), ("2022", "YMD", None), ("2024-05", "YMD", None), ("2019년", "YMD", None),
        ("43584", "YMD", (us(2019, 4, 29), None)), ("41837.25", "YMD", (us(2014, 7, 17, 6), None)), ("1549721472", "YMD", (1549721472000000, "UTC")), ("1416725658353", "YMD", (1416725658353000, "UTC")),
        ("20190505022824", "YMD", (us(2019, 5, 5, 2, 28, 24), None)), ("20140126T211800Z", "YMD", (us(2014, 1, 26, 21, 18), "UTC")), ("제8판 (2022.03.16)", "YMD", (us(2022, 3, 16), None)),
        ("Rev. 3 - 01.02.2016", "DMY", (us(2016, 2, 1), None)), ("최종개정일자:2017.08.30", "YMD", (us(2017, 8, 30), None)), ("2022년 3월 22일 오후 6시 51분", "YMD", (us(2022, 3, 22, 18, 51), None)),
        ("2017년 6월 5일 오전 12시 49분", "YMD", (us(2017, 6, 5, 0, 49), None)), ("February 15, 2015 8:55 a.m.", "MDY", (us(2015, 2, 15, 8, 55), None)), ("2/26/17 4:49 PM", "MDY", (us(2017, 2, 26, 16, 49), None)),
        ("2019-03-06T18:22:22+09:00", "YMD", (us(2019, 3, 6, 9, 22, 22), "UTC")), ("2015-12-06 16:51 Asia/Seoul", "YMD", (us(2015, 12, 6, 16, 51), "Asia/Seoul")), ("Sun, 30 Mar 2014 00:17:17 +0100", "DMY", (us(2014, 3, 29, 23, 17, 17), "UTC")),
        ("2022-05-12 05:30:03.943309808Z", "YMD", (us(2022, 5, 12, 5, 30, 3) + 943309, "UTC")), ("２０１５-０１-２５", "YMD", (us(2015, 1, 25), None)), ("07.03.2017 18:58 CET", "DMY", (us(2017, 3, 7, 17, 58), "UTC")),
        (None, None, None), ("", "YMD", None), ("  ", "YMD", None), ("x" * 10000, "YMD", None), ("#VALUE!", "YMD", None),
    ],
)
def test_formats(text, order, want):
    assert read_timestamp(text, order) == want


@given(st.dates(dt.date(1990, 1, 1), dt.date(2079, 12, 31)), st.sampled_from(["%Y-%m-%d", "%Y.%m.%d", "%Y%m%d", "%d %B %Y", "%d/%b/%Y", "%B %d, %Y"]))
def test_round_trip(day, form):
    assert read_timestamp(day.strftime(form), "YMD") == ((day.toordinal() - dt.date(1970, 1, 1).toordinal()) * DAY_US, None)


@given(st.text(max_size=40))
def test_never_fails(text):
    read_timestamp(text, "DMY")


def test_daylight_saving_and_edges(spark):
    rows = [
        (1, "de", "2021-10-31 02:30:00", "a"), (2, "de", "2021-03-28 02:30:00", "b"), (3, "us", "07/04/2021", None), (4, None, "2021-01-01", None), (5, "kr", None, None), (5, "kr", "nonsense", None), (6, "other", "2021-01-01", "z"),
    ]
    df = spark.createDataFrame(rows, "k int, dataSource string, v string, zone_id string")
    zones = spark.createDataFrame(ZONES, "dataSource string, zone_id string, date_order string")
    out = normalise_timestamps(df, "v", "dataSource", zones)
    assert out.columns == [*df.columns, "utc_us"]
    got = sorted((r.k, r.utc_us) for r in out.collect() if r.utc_us is not None)
    assert got == [(1, us(2021, 10, 31, 0, 30)), (2, us(2021, 3, 28, 1, 30)), (3, us(2021, 7, 4, 5)), (4, us(2021, 1, 1)), (6, us(2021, 1, 1))]
    assert normalise_timestamps(df.limit(0), "v", "dataSource", zones).count() == 0


def test_unknown_zone_is_estimated(spark):
    # local times in Seoul, ingested a minute later: in UTC or west of it they'd lie after their ingestion
    rows = [("a", f"2021-05-0{i} 10:00:00", dt.datetime(2021, 5, i, 1, 1)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "dataSource string, v string, at timestamp")
    zones = spark.createDataFrame([("a", None, "YMD")], "dataSource string, zone_id string, date_order string")
    out = normalise_timestamps(df, "v", "dataSource", zones, "at").collect()
    assert {r.utc_us for r in out} == {us(2021, 5, i, 1) for i in range(1, 8)}
    empty = spark.createDataFrame([], "s string, l long, i long")
    assert estimate_zones(empty, "s", "l", "i", ["UTC"]).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-03-05 10:00 Asia/Seol", (us(2024, 3, 5, 10), None)), ("2024-03-05 10:00 asia/seoul", (us(2024, 3, 5, 10), "Asia/Seoul")), ("2024-03-05 10:00 IST", (us(2024, 3, 5, 10), None)),
        ("2024-03-05 10:00 +19:00", (us(2024, 3, 5, 10), None)), ("2024-03-05 10:00 UTC+9", (us(2024, 3, 5, 1), "UTC")), ("2024-03-05T10", (us(2024, 3, 5, 10), None)), ("2024년 3월 5일 오후 2시", (us(2024, 3, 5, 14), None)),
        ("2024-03-05 12:10 America/Chicago", (us(2024, 3, 5, 12, 10), "America/Chicago")), ("10:30 2024-03-05", (us(2024, 3, 5, 10, 30), None)), ("오후 3:05, 2024.03.05", (us(2024, 3, 5, 15, 5), None)), ("10:30 +09:00 2024-03-05", (us(2024, 3, 5, 1, 30), "UTC")), ("March 5, 2024 10 PM", (us(2024, 3, 5, 22), None)),
        ("1709600000000000", (1709600000000000, "UTC")), ("1709600000000000123", (1709600000000000, "UTC")),
    ],
)
def test_zones_nobody_knows_and_other_forms(text, want):
    assert read_timestamp(text, "YMD") == want


def test_bad_zones_end_no_job(spark):
    rows = [("kr", "2024-03-05 10:00 Asia/Seol"), ("kr", "2024-03-05 10:00 Moon/Base"), ("bad", "2024-03-05 10:00")]
    df = spark.createDataFrame(rows, "dataSource string, v string")
    zones = spark.createDataFrame([*ZONES, ("bad", "Asia/Seol", "YMD")], "dataSource string, zone_id string, date_order string")
    got = [r.utc_us for r in normalise_timestamps(df, "v", "dataSource", zones).orderBy("dataSource").collect()]
    assert got == [us(2024, 3, 5, 10), us(2024, 3, 5, 1), us(2024, 3, 5, 1)]


def test_offset_histories_are_told_apart_by_arrival(spark):
    # a reading every nine hours over three years, ingested within four minutes: winter and summer time both count
    at = [dt.datetime(2019, 1, 1) + dt.timedelta(hours=9 * i) for i in range(2900)]
    from zoneinfo import ZoneInfo

    rows = []
    for s, z in (("b", "Europe/Berlin"), ("c", "America/Chicago"), ("k", "Asia/Seoul")):
        for i, t in enumerate(at):
            local = t.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(z)).replace(tzinfo=None)
            rows.append((s, us(*local.timetuple()[:6]), us(*t.timetuple()[:6]) + (i % 5) * 60_000_000))
    df = spark.createDataFrame(rows, "s string, l long, i long")
    got = {r.s: (r.zone_id, r.violations, r.evidence > 0) for r in estimate_zones(df, "s", "l", "i").collect()}
    assert got == {"b": ("Europe/Berlin", 0, True), "c": ("America/Chicago", 0, True), "k": ("Asia/Seoul", 0, True)}


def test_offset_histories_are_told_apart_by_sequence(spark):
    # no arrival times: readings of an unknown source between those of a known one, ten minutes apart
    at = [dt.datetime(2019, 1, 1) + dt.timedelta(hours=7 * i) for i in range(1200)]
    from zoneinfo import ZoneInfo

    rows = []
    for i, t in enumerate(at):
        local = t.replace(tzinfo=dt.UTC).astimezone(ZoneInfo("Europe/Berlin")).replace(tzinfo=None)
        rows += [("known", None, us(*t.timetuple()[:6]) - 600_000_000, 3 * i), ("open", us(*local.timetuple()[:6]), None, 3 * i + 1), ("known", None, us(*t.timetuple()[:6]) + 600_000_000, 3 * i + 2)]
    df = spark.createDataFrame(rows, "s string, l long, k long, n long").selectExpr("*", "'g' as g")
    got = {r.s: (r.zone_id, r.violations) for r in estimate_zones(df, "s", "l", None, None, "k", (["g"], ["n"])).collect()}
    assert got["open"] == ("Europe/Berlin", 0)
    assert estimate_zones(df.where("s = 'known'"), "s", "l", None, ["UTC"], "k", (["g"], ["n"])).collect()[0].evidence == 0


def test_previous_is_lag(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from vialworks.operators.ordered import previous

    df = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) as g", "pmod(hash(id), 500) as o", "id", "if(id % 7 = 0, null, id) as v")
    w = Window.partitionBy("g").orderBy("o", "id")
    want = {(r.id, r.p) for r in df.withColumn("p", F.lag("v").over(w)).collect()}
    assert {(r.id, r.prev.v if r.prev else None) for r in previous(df, ["g"], ["o", "id"], ["v"]).collect()} == want
    assert previous(df.limit(0), ["g"], ["o"], ["v"]).count() == 0
