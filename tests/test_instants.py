from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions.instants import with_instant


def us(*parts, zone="UTC", micro=0):
    t = datetime(*parts, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + micro


def parsed(spark, rows):
    df = spark.createDataFrame(rows, "k int, value string, zone string, us boolean")
    out = with_instant(df, "value", "at", F.col("zone"), F.col("us"))
    return {r.k: r["at"] for r in out.collect()}


CASES = [
    ("2022-08-28T12:35:10Z", None, False, us(2022, 8, 28, 12, 35, 10)),
    (" \t2022-08-28t12:35:10z\n", None, False, us(2022, 8, 28, 12, 35, 10)),
    ("2022-07-03T11:55:04.994173934Z", None, False, us(2022, 7, 3, 11, 55, 4, micro=994173)),
    ("2023-01-27T05:31:32.6+09:00", None, False, us(2023, 1, 26, 20, 31, 32, micro=600000)),
    ("2022-01-24T10:34:28.649+1245", None, False, us(2022, 1, 23, 21, 49, 28, micro=649000)),
    ("2023-01-18T03:58:12-00:00", None, False, us(2023, 1, 18, 3, 58, 12)),
    ("2022-11-06 16:43:05 GMT+1", None, False, us(2022, 11, 6, 15, 43, 5)),
    ("2023-01-17 16:16:13 GMT+5:30", None, False, us(2023, 1, 17, 10, 46, 13)),
    ("2022-09-21 03:26:13 EDT", None, False, us(2022, 9, 21, 7, 26, 13)),
    ("20240607T014327Z", None, False, us(2024, 6, 7, 1, 43, 27)),
    ("Thu, 16 Jun 2022 18:55:10 +0530", None, False, us(2022, 6, 16, 13, 25, 10)),
    ("Wed, 3 Aug 2022 23:57:45 GMT", None, False, us(2022, 8, 3, 23, 57, 45)),
    ("1644038435", None, False, 1644038435000000),
    ("1650263609.584", None, False, 1650263609584000),
    ("1666220241087", None, False, 1666220241087000),
    ("1649998230214991", None, False, 1649998230214991),
    ("2022-10-24T00:40:26[America/New_York]", None, False, us(2022, 10, 24, 0, 40, 26, zone="America/New_York")),
    ("2022-12-19T03:56:46-05:00[America/New_York]", "Asia/Tokyo", False, us(2022, 12, 19, 8, 56, 46)),
    ("2022-05-02 20:29:48", "Europe/Paris", False, us(2022, 5, 2, 20, 29, 48, zone="Europe/Paris")),
    ("2022-05-02 20:29:48", None, False, None),
    ("2022-04", "Asia/Tokyo", False, us(2022, 4, 1, zone="Asia/Tokyo")),
    ("2022", "Asia/Tokyo", False, us(2022, 1, 1, zone="Asia/Tokyo")),
    ("2022-01-09", "America/Chicago", False, us(2022, 1, 9, zone="America/Chicago")),
    ("21/12/2021 17:55:46", "UTC", False, us(2021, 12, 21, 17, 55, 46)),
    ("21/12/2021 17:55:46", "UTC", True, None),
    ("4/5/2022 8:14:39 PM", "UTC", True, us(2022, 4, 5, 20, 14, 39)),
    ("4/5/2022 8:14:39 PM", "UTC", False, us(2022, 5, 4, 20, 14, 39)),
    ("4/5/2022 8:14:39 PM", "UTC", None, us(2022, 5, 4, 20, 14, 39)),
    ("09.04.2023 11:19:31 Uhr", "UTC", False, us(2023, 4, 9, 11, 19, 31)),
    ("February 12, 2022 12:04:21 AM", "UTC", True, us(2022, 2, 12, 0, 4, 21)),
    ("May 20, 2022 12:33:37 PM", "UTC", True, us(2022, 5, 20, 12, 33, 37)),
    ("2024年5月24日 下午4:51:53", "Asia/Shanghai", False, us(2024, 5, 24, 16, 51, 53, zone="Asia/Shanghai")),
    ("2026年4月1日 午後0:49:15", "Asia/Tokyo", False, us(2026, 4, 1, 12, 49, 15, zone="Asia/Tokyo")),
    ("2023年12月26日 11:17:08", "Asia/Tokyo", False, us(2023, 12, 26, 11, 17, 8, zone="Asia/Tokyo")),
    ("2024-02-29", "UTC", False, us(2024, 2, 29)),
    ("2023-02-29 07:15:00+01:00", "UTC", False, None),
    ("2024-06-31", "UTC", False, None),
    ("2025-04-09T25:61:00Z", "UTC", False, None),
    ("0000-00-00 00:00:00", "UTC", False, None),
    ("3. März 2024 14:05", "Europe/Berlin", False, us(2024, 3, 3, 14, 5, zone="Europe/Berlin")),
    ("3. MÄRZ 2024 um 14:05 Uhr", "Europe/Berlin", False, us(2024, 3, 3, 14, 5, zone="Europe/Berlin")),
    ("dimanche 1er février 2026 à 08:30", "Europe/Paris", False, us(2026, 2, 1, 8, 30, zone="Europe/Paris")),
    ("3 de mayo de 2024 10:00", "Europe/Madrid", False, us(2024, 5, 3, 10, zone="Europe/Madrid")),
    ("12 juil. 2024", "UTC", False, us(2024, 7, 12)),
    ("12 juin 2024", "UTC", False, us(2024, 6, 12)),
    ("2024-03-05 3pm", "UTC", False, us(2024, 3, 5, 15)),
    ("2024-03-05 12 a.m.", "UTC", False, us(2024, 3, 5)),
    ("2024-03-05 3", "UTC", False, None),
    ("Tue Mar  5 14:05:06 2024", "UTC", False, us(2024, 3, 5, 14, 5, 6)),
    ("Tue Mar 5 14:05:06 UTC 2024", None, False, us(2024, 3, 5, 14, 5, 6)),
    ("2024-03-05 14:05:06 Europe/Berlin", "UTC", False, us(2024, 3, 5, 14, 5, 6, zone="Europe/Berlin")),
    ("2024-03-31 02:30:00 Europe/Berlin", "UTC", False, None),
    ("2024-W10-2", "UTC", False, us(2024, 3, 5)),
    ("2020-W53-7T10:00Z", None, False, us(2021, 1, 3, 10)),
    ("2021-W53-1", "UTC", False, None),
    ("2021-W00-1", "UTC", False, None),
    ("2024年3月5日 14時05分06秒", "Asia/Tokyo", False, us(2024, 3, 5, 14, 5, 6, zone="Asia/Tokyo")),
    ("3. Foobar 2024 14:05", "UTC", False, None),
    ("31 février 2024", "UTC", False, None),
    ("2022-05-05 13:00:00 PM", "UTC", False, None),
    ("2024-10-27 02:28:11", "Europe/Zurich", False, None),  # twice
    ("2024-03-31 02:28:11", "Europe/Zurich", False, None),  # never
    ("2024-10-27 03:00:00", "Europe/Zurich", False, us(2024, 10, 27, 3, zone="Europe/Zurich")),
    ("2024-04-07 01:45:00", "Australia/Lord_Howe", False, None),  # twice, by half an hour
    ("2022-05-02 20:29:48", "No/Where", False, None),
    ("2022-05-02 20:29:48 XYZ", "UTC", False, None),
    ("next Tuesday", "UTC", False, None),
    ("", "UTC", False, None),
    ("12345", "UTC", False, None),
    ("x" * 100_000, "UTC", False, None),
    (None, "UTC", False, None),
]


def test_spellings(spark):
    rows = [(k, v, z, m) for k, (v, z, m, _) in enumerate(CASES)]
    got = parsed(spark, rows)
    wrong = [(CASES[k][0], CASES[k][1], got[k], CASES[k][3]) for k in got if got[k] != CASES[k][3]]
    assert not wrong


def test_wall_clocks_agree_with_the_zone_rules(spark):
    zones = ["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Sydney", "America/Bogota"]
    rows, want, k = [], {}, 0
    for zone in zones:
        t = datetime(2023, 1, 1, 0, 30)
        while t < datetime(2024, 1, 1):
            a, b = (t.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(timezone.utc) for f in (0, 1))
            exists = a.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t
            rows.append((k, t.strftime("%Y-%m-%d %H:%M:%S"), zone, False))
            want[k] = int(a.timestamp()) * 1_000_000 if a == b and exists else None
            k += 1
            t += timedelta(hours=7)
    assert parsed(spark, rows) == want


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "value string, at_ string, zone string")
    assert with_instant(df, "value", "at", F.col("zone")).count() == 0
    df = spark.createDataFrame([("2022", "keep"), ("2022", "keep")], "value string, wall string")
    rows = with_instant(df, "value", "at", "UTC").collect()
    assert len(rows) == 2 and rows[0].wall == "keep" and rows[0]["at"] == us(2022, 1, 1)


@pytest.mark.parametrize("zone", [None, "UTC"])
def test_stated_zone_as_text(spark, zone):
    df = spark.createDataFrame([("2022-05-02 20:29:48",)], "value string")
    got = with_instant(df, "value", "at", zone).first()["at"]
    assert got == (us(2022, 5, 2, 20, 29, 48) if zone else None)


def test_the_result_may_replace_a_column(spark):
    df = spark.createDataFrame([("2022", "x")], "value string, out string")
    assert with_instant(df, "value", "out", "UTC").first().asDict() == {"value": "2022", "out": us(2022, 1, 1)}
    assert with_instant(df, "value", "value", "UTC").first().asDict() == {"value": us(2022, 1, 1), "out": "x"}
