from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from shoebox.operators.timestamps import extend_dictionary, normalise_times, parse_instant
from shoebox.plans.tables import table

FILES = "id long, origin_id int, taken_time string, created_time string, modified_time string"
ORIGINS = "origin_id int, tz string, date_order string"


def us(*at, zone="UTC"):
    local = datetime(*at)
    return (local - local.replace(tzinfo=ZoneInfo(zone), fold=0).utcoffset() - datetime(1970, 1, 1)) // timedelta(microseconds=1)


CASES = [
    ("2020-01-02T03:04:05Z", "Europe/Berlin", "dmy", us(2020, 1, 2, 3, 4, 5)),
    ("2020-01-02t03:04:05z", "UTC", "dmy", us(2020, 1, 2, 3, 4, 5)),
    ("2020:06:02 03:04:05", "Europe/Berlin", "dmy", us(2020, 6, 2, 1, 4, 5)),
    ("2020:06:02 03:04:05.73", "UTC", "dmy", us(2020, 6, 2, 3, 4, 5, 730000)),
    ("2020-06-02 03:04:05,176", "UTC", "dmy", us(2020, 6, 2, 3, 4, 5, 176000)),
    ("2020-06-02T03:04:05.1234569Z", "UTC", "dmy", us(2020, 6, 2, 3, 4, 5, 123456)),
    ("2020-06-02T03:04:05+05:45[Asia/Kathmandu]", "UTC", "dmy", us(2020, 6, 1, 21, 19, 5)),
    ("2020-06-02 03:04:05 America/New_York", "UTC", "dmy", us(2020, 6, 2, 7, 4, 5)),
    ("2020-06-02 03:04:05 EDT", "UTC", "dmy", us(2020, 6, 2, 7, 4, 5)),
    ("2020-06-02 03:04 ", "UTC", "dmy", us(2020, 6, 2, 3, 4)),
    ("20200602T030405Z", "UTC", "dmy", us(2020, 6, 2, 3, 4, 5)),
    ("20200602_030405", "Asia/Tokyo", "dmy", us(2020, 6, 1, 18, 4, 5)),
    ("03/04/2020 05:06:07", "UTC", "dmy", us(2020, 4, 3, 5, 6, 7)),
    ("03/04/2020 05:06:07 PM", "UTC", "mdy", us(2020, 3, 4, 17, 6, 7)),
    ("03.04.2020 05:06:07", "UTC", "mdy", us(2020, 4, 3, 5, 6, 7)),
    ("Oct 29, 2023, 12:52:32 AM", "UTC", "dmy", us(2023, 10, 29, 0, 52, 32)),
    ("Sun, 27 Mar 2022 02:12:55 +0200", "UTC", "dmy", us(2022, 3, 27, 0, 12, 55)),
    ("1583020800", "Asia/Tokyo", "dmy", 1583020800_000000),
    ("1583020800123", "UTC", "dmy", 1583020800_123000),
    ("1583020800123456", "UTC", "dmy", 1583020800_123456),
    # Clock set back: the earlier instant. Set forward: the offset before.
    ("2022-10-30T02:30:00", "Europe/Berlin", "dmy", us(2022, 10, 30, 0, 30)),
    ("2022-03-27T02:30:00", "Europe/Berlin", "dmy", us(2022, 3, 27, 1, 30)),
    *[(bad, "UTC", "dmy", None) for bad in ("", " ", "unknown", "-1", "2016-05-19", "2013-06", "0000:00:00 00:00:00", "    :  :     :  :  ", "2023-02-29T01:00:00", "2023-01-01T25:00:00", "13/13/2020 01:00:00", "2020-06-02 03:04:05 XYZ", "2020-06-02 03:04:05 Moon/Sea", "12345", None)],
]


def test_forms(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, raw string, zone string, date_order string")
    got = {r["i"]: r["utc_us"] for r in parse_instant(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def test_rows_nulls_repeats_and_clashing_columns(spark, rows):
    origins = spark.createDataFrame([(1, "Europe/Berlin", "dmy"), (1, "Europe/Berlin", "dmy"), (None, "Asia/Tokyo", "mdy")], ORIGINS)
    files = spark.createDataFrame([(1, 1, "2020-06-02 03:00:00", None, "x", "z"), (1, 1, "2020-06-02 03:00:00", None, "x", "z"), (2, None, "2020-06-02 03:00:00", "", "01/02/2020 00:00:00", "z"), (3, 99, "2020-06-02 03:00:00", None, None, "z")], FILES + ", zone string")
    assert rows(normalise_times(files, origins)) == sorted([(1, "taken_time", us(2020, 6, 2, 1)), (1, "taken_time", us(2020, 6, 2, 1)), (2, "taken_time", us(2020, 6, 2, 3)), (2, "modified_time", us(2020, 2, 1)), (3, "taken_time", us(2020, 6, 2, 3))], key=repr)
    assert rows(normalise_times(files.limit(0), origins.limit(0))) == []


def test_dictionary_is_extended_once(spark, tmp_path):
    path = f"file://{tmp_path}/times"
    a = spark.createDataFrame([("2020-01-01T00:00:00Z", "UTC", "dmy"), ("2020-01-01T00:00:00Z", "UTC", "dmy")], "raw string, zone string, date_order string")
    b = spark.createDataFrame([("2020-01-01T00:00:00Z", "UTC", "dmy"), ("1583020800", "UTC", "dmy")], a.schema)
    assert extend_dictionary(spark, path, a).count() == 1
    assert extend_dictionary(spark, path, b).count() == 2
    assert extend_dictionary(spark, path, b).count() == 2


def test_against_a_second_reading_of_the_table(spark, data):
    """The frequent forms of the test table, read by Python's own parser."""
    got = {(r[0], r[1]): r[2] for r in normalise_times(table(spark, data, "files"), table(spark, data, "origins")).collect()}
    forms = ["%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M:%SZ"]
    seen = 0
    for r in table(spark, data, "files").select("id", "created_time").collect():
        for form in forms:
            try:
                at = datetime.strptime(r["created_time"] or "", form)
            except ValueError:
                continue
            seen += 1
            assert got[r["id"], "created_time"] == (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert seen > 20


@pytest.mark.parametrize("zone", ["America/Chicago", "Australia/Adelaide", "Europe/London"])
def test_every_quarter_hour_around_both_changes(spark, zone):
    at = [datetime(2021, m, d) + timedelta(minutes=15 * i) for m, d in ((3, 14), (3, 28), (4, 4), (10, 3), (10, 31), (11, 7)) for i in range(96)]
    df = spark.createDataFrame([(a.strftime("%Y-%m-%d %H:%M:%S"), zone, "dmy") for a in at], "raw string, zone string, date_order string")
    got = {r["raw"]: r["utc_us"] for r in parse_instant(df).collect()}
    assert all(got[a.strftime("%Y-%m-%d %H:%M:%S")] == us(*a.timetuple()[:6], zone=zone) for a in at)
