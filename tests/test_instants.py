"""p6 against a plain parser, and its edges."""

import datetime as dt
from zoneinfo import ZoneInfo

from tests.conftest import EVIDENCE, MESSAGE, SOURCE_INDEX

from strandline.operators import instants

UTC = dt.timezone.utc
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def us(y, m, d, h=0, mi=0, s=0, micro=0, zone="UTC", fold=0):
    t = dt.datetime(y, m, d, h, mi, s, micro, tzinfo=ZoneInfo(zone), fold=fold)
    return int((t - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("2019-03-15T18:33:44.373153805Z", "x", None, us(2019, 3, 15, 18, 33, 44, 373153)),
    (" 20190101T050615Z ", "x", None, us(2019, 1, 1, 5, 6, 15)),
    ("2019-01-02t09:22:48z", "x", None, us(2019, 1, 2, 9, 22, 48)),
    ("2019-03-16 05:38:38+1100", "x", None, us(2019, 3, 15, 18, 38, 38)),
    ("2019-01-02T05:30:53,960+01:00", "x", None, us(2019, 1, 2, 4, 30, 53, 960000)),
    ("2019-03-31 03:04:56 CEST", "x", None, us(2019, 3, 31, 1, 4, 56)),
    ("2021-01-01 12:00:00 PST", "x", None, us(2021, 1, 1, 20)),
    ("Mon, 06 Jul 2020 01:28:10 -0400", "x", None, us(2020, 7, 6, 5, 28, 10)),
    ("Wed Oct 10 20:19:24 +0000 2012", "x", None, us(2012, 10, 10, 20, 19, 24)),
    ("21 de diciembre de 2019, 18:25", "x", "Europe/Madrid", us(2019, 12, 21, 17, 25)),
    ("Jul 6, 2020 1:24 AM", "x", "America/New_York", us(2020, 7, 6, 5, 24)),
    ("8/3/20, 10:57 PM", "en-US", "America/Los_Angeles", us(2020, 8, 4, 5, 57)),
    ("8/3/20, 10:57 p. m.", "es-PE", "America/Lima", us(2020, 3, 9, 3, 57)),
    ("03.08.2020 23:09:13", "en-US", "America/Los_Angeles", us(2020, 8, 4, 6, 9, 13)),
    ("[27/10/24, 03:13:07]", "es-ES", "Europe/Madrid", us(2024, 10, 27, 2, 13, 7)),
    ("2019/03/31 09:15", "x", None, us(2019, 3, 31, 9, 15)),
    ("1/1/21, 12:05 AM", "en-US", "UTC", us(2021, 1, 1, 0, 5)),
    ("1640783331671", "x", "America/Lima", 1640783331671000),
    ("1547477594", "x", None, 1547477594000000),
    ("1547055545464531", "x", None, 1547055545464531),
    # A local time that occurs twice is the first one; one that is skipped is read with the offset before the jump.
    ("2019-10-27T02:30:00", "x", "Europe/Madrid", us(2019, 10, 27, 0, 30)),
    ("2020-03-08T02:30:00", "x", "America/New_York", us(2020, 3, 8, 7, 30)),
    ("2021-05-06T10:00:00", "x", "No/Such_Zone", us(2021, 5, 6, 10)),
    *[(bad, "x", None, None) for bad in ("31/02/2022, 10:00", "2023-13-45T10:00:00", "0000-00-00T00:00:00", "ayer 10:15", "n/a", "", "2022-02-30", "13:45", "2021-01-01T25:00:00", "2021-01-01T10:61:00", "1/1/21, 13:05 PM")],
]


def run(make, cases, kind="jsonl"):
    m = make(MESSAGE, *[{"seq": i, "source_file": f"f{i}", "timestamp": c[0], "source_type": kind} for i, c in enumerate(cases)])
    s = make(SOURCE_INDEX, *[{"filename": f"f{i}", "time_zone": c[2], "locale": c[1], "imported_at": dt.datetime(2025, 1, 1)} for i, c in enumerate(cases)])
    e = make(EVIDENCE)
    return {r["row_id"]: r["utc_us"] for r in instants.found(m, e, s).collect()}


def test_cases(make):
    got = run(make, CASES)
    for i, c in enumerate(CASES):
        assert got.get(i) == c[3], c


def test_zones_as_in_zoneinfo(make):
    cases = []
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Lima"):
        for day in (dt.date(2021, 3, 14), dt.date(2021, 3, 28), dt.date(2021, 4, 4), dt.date(2021, 10, 3), dt.date(2021, 10, 31), dt.date(2021, 11, 7)):
            for minute in range(0, 300, 30):
                t = dt.datetime(day.year, day.month, day.day) + dt.timedelta(minutes=minute)
                cases.append((t.isoformat(), "x", zone, us(t.year, t.month, t.day, t.hour, t.minute, zone=zone, fold=0)))
    got = run(make, cases)
    assert [got.get(i) for i in range(len(cases))] == [c[3] for c in cases]


def test_imessage_counts_from_2001(make):
    assert run(make, [("733538228967936000", "x", None, None)], "imessage")[0] == (733538228967936000 // 1000) + 978307200 * 10**6


def test_newest_index_row_and_repeats(make):
    m = make(MESSAGE, *[{"seq": 1, "source_file": "f", "timestamp": "2021-06-01T10:00:00"}] * 3)
    s = make(SOURCE_INDEX, {"filename": "f", "time_zone": "America/Lima", "imported_at": dt.datetime(2024, 1, 1)}, {"filename": "f", "time_zone": "Asia/Kolkata", "imported_at": dt.datetime(2025, 1, 1)}, {"filename": None})
    e = make(EVIDENCE, *[{"evidence_no": 7, "source_file": "g", "timestamp": "2021-06-01T10:00:00"}] * 2, {"evidence_no": 8}, {"timestamp": "2021"})
    rows = sorted((r["tbl"], r["row_id"], r["utc_us"]) for r in instants.found(m, e, s).collect())
    assert rows == [("evidence", 7, us(2021, 6, 1, 10)), ("message", 1, us(2021, 6, 1, 4, 30))]


def test_hot_stamp_and_dictionary(make, tmp_path, spark):
    rows = [{"seq": i, "source_file": "f", "timestamp": "2021-06-01T10:00:00" if i % 3 else f"2021-06-0{i % 9 + 1}T10:00:{i % 60:02d}"} for i in range(4000)]
    m, e, s = make(MESSAGE, *rows), make(EVIDENCE), make(SOURCE_INDEX)
    path = f"file://{tmp_path}/dictionary"
    plain = {r["row_id"]: r["utc_us"] for r in instants.found(m, e, s).collect()}
    kept = {r["row_id"]: r["utc_us"] for r in instants.found(m, e, s, path).collect()}
    n = spark.read.parquet(path).count()
    assert plain == kept and len(plain) == 4000
    assert {r["row_id"]: r["utc_us"] for r in instants.found(m, e, s, path).collect()} == plain
    assert spark.read.parquet(path).count() == n


def test_extra_columns_and_long_stamps(make):
    m = make(MESSAGE + ", stamp string, zone string, row_id long, utc_us long, tbl string", {"seq": 1, "source_file": "f", "timestamp": "2021-06-01T10:00:00Z", "stamp": "no"}, {"seq": 2, "source_file": None, "timestamp": "9" * 100_000})
    rows = instants.found(m, make(EVIDENCE), make(SOURCE_INDEX)).collect()
    assert [(r["row_id"], r["utc_us"]) for r in rows] == [(1, us(2021, 6, 1, 10))]


def test_spanish_months(make):
    got = run(make, [(f"3 de {m} de 2021, 04:05", "x", None, None) for m in MONTHS])
    assert [got[i] for i in range(12)] == [us(2021, i + 1, 3, 4, 5) for i in range(12)]
