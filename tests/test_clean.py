"""Cleaning on literal edge cases."""

import pytest
from pyspark.sql import functions as F

from geohotspots.functions import text, timestamps
from geohotspots.operators import clean
from geohotspots.sources.readers import scan_csv


def one_column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, c string").repartition(2)
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, []), ("NaN", []), ("", []), ("bad", []), ("[]", []), ('["x"]', ["x"]),
        ("42", []), ("{}", []), ('["a"] trailing', []), ("['a']", []), ('["a"', []),
        ("[1] [2]", []), ('["a"]] x]', []), ('["a"]} ]', []), ("[1,]", []), ("[01]", []),
        ("  [\"a\"]\t", ["a"]), ('["a]b"]', ["a]b"]), ('["x", ["y"]]', ["x", '["y"]']),
        ('["a\\"b"]', ['a"b']), ('"x"', []),
    ],
)
def test_json_arrays(spark, raw, expected):
    assert one_column(spark, [raw], text.json_string_array) == [expected]


def test_violation_tokens(spark):
    values = ['[" wrong parking ", "Wrong Parking", "", null, "na", 5]', "bad", '[" x "]']
    assert one_column(spark, values, text.violation_tokens) == [
        ["WRONG PARKING", "WRONG PARKING", "5"], [], ["X"],
    ]


def test_offence_codes(spark):
    values = [
        '["101","abc","102",null]',
        '["101","2.0",2.0,1.5,true,null,7,"abc"," 8 ",1e3,"1_0","+5",-3]',
        "bad",
    ]
    assert one_column(spark, values, text.offence_codes) == [
        [101, 102], [101, 2, 7, 8, 1000, 10, 5, -3], [],
    ]


def test_timestamps(spark):
    values = [
        "2024-01-15 09:00:00", "2024-01-15 03:30:00+00:00", "2024-01-15T03:30:00Z",
        "2024-01-15 03:30:00+00", "2024-01-15 09:00:00.5+0530", "2024-01-15", "garbage",
        "", "NULL", None, "09:00", "2024-13-01 00:00:00", " 2024-1-5 9:05:01 ",
    ]
    wall = one_column(
        spark,
        values,
        lambda c: timestamps.wall_clock(timestamps.parse_instant(c)).cast("string"),
    )
    nine = "2024-01-15 09:00:00"
    assert wall == [
        nine, nine, nine, nine, nine + ".5", "2024-01-15 00:00:00", None, None, None, None,
        None, None, "2024-01-05 09:05:01",
    ]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        micros = one_column(
            spark,
            ["2024-01-15 09:00:00", "2024-01-15 03:30:00Z"],
            lambda c: F.unix_micros(timestamps.parse_instant(c)),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert micros == [1705289400000000] * 2


def test_categoricals(spark):
    values = [" CAR ", "None", None, "a\t b   c", "nat"]
    assert one_column(spark, values, clean.vehicle_type) == ["car", "", "", "a\t b   c", ""]
    assert one_column(spark, values, clean.station_name) == ["CAR", "", "", "a b c", ""]


def test_bounding_box(spark):
    points = [
        ("12.7", "77.3", True), ("13.2", "77.9", True), ("12.699", "77.5", False),
        ("13.201", "77.5", False), ("13", "77.299", False), ("13", "77.901", False),
        (None, "77.5", False), ("NaN", "77.5", False), ("x", "77.5", False),
        (" 13.0 ", "77.5", True), ("0", "0", False),
    ]
    df = spark.createDataFrame(points, "latitude string, longitude string, keep boolean")
    kept = clean.validate_geo(df).collect()
    assert len(kept) == 3 and all(r.keep for r in kept)


RAW = "id string, latitude string, longitude string, created_datetime string, read_order long"


def test_first_valid_row_of_an_id_wins_and_report_adds_up(spark):
    good, time = ("13.0", "77.5"), "2024-01-15 09:00:00"
    rows = [
        ("a", "0", "0", time, 0), ("a", *good, time, 1), ("a", *good, "2024-01-16", 2),
        (None, *good, time, 3), (None, *good, time, 4), ("b", *good, "bad", 5),
        ("b", *good, time, 6), ("c", *good, time, 7),
    ]
    for parts in (1, 7):
        raw = spark.createDataFrame(rows, RAW).repartition(parts)
        kept = clean.clean_events(raw).select("id", "read_order").collect()
        assert sorted(r.read_order for r in kept) == [1, 3, 6, 7]
        report = {r.metric: r.n for r in clean.ingestion_report(raw).collect()}
        assert report == {
            "total_rows_read": 8, "rows_retained": 4, "total_dropped": 4,
            "invalid_geo": 1, "unparseable_created_at": 1, "duplicate_id": 2,
        }
        cleaned = clean.clean_events(raw)
        assert report == {
            r.metric: r.n for r in clean.ingestion_report(raw, cleaned=cleaned).collect()
        }


def test_report_lists_geography_even_without_drops(spark):
    raw = spark.createDataFrame([("a", "13", "77.5", "2024-01-15", 0)], RAW)
    report = {r.metric: r.n for r in clean.ingestion_report(raw).collect()}
    assert report == {
        "total_rows_read": 1, "rows_retained": 1, "total_dropped": 0, "invalid_geo": 0,
    }


def test_missing_columns_and_files_are_refused(spark):
    with pytest.raises(ValueError):
        clean.clean_events(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(ValueError):
        scan_csv(spark, "/nonexistent/events.csv")


def test_scan_csv_keeps_read_order_and_nulls_missing_texts(spark, tmp_path):
    path = tmp_path / "events.csv"
    lines = ["id,latitude,longitude,created_datetime,violation_type"]
    lines += [f'{i},13.0,77.5,NULL,"[""A"",""B""]"' for i in range(50)]
    path.write_text("\n".join(lines) + "\n")
    rows = scan_csv(spark, str(path)).repartition(5).orderBy("read_order").collect()
    assert [r.id for r in rows] == [str(i) for i in range(50)]
    assert rows[0].created_datetime is None and rows[0].violation_type == '["A","B"]'


def test_hot_id_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("concat('x', id % 2) AS id", "id AS read_order")
    plan = clean.dedupe_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


HEADER = "id,latitude,longitude,created_datetime,note"
GOOD = '1,12.95,77.6,2024-01-15 09:00:00,"a, b"'


def _report(spark, path, **options):
    return {r["metric"]: r["n"] for r in clean.ingestion_report(scan_csv(spark, str(path), **options)).collect()}


@pytest.mark.parametrize(
    ("bad", "read", "malformed"),
    [
        ("2,12.95,77.6,2024-01-15 09:00:00,x,extra", 2, 1),
        ("2,12.95,77.6,2024-01-15 09:00:00", 2, 0),
        ('2,12.95,77.6,2024-01-15 09:00:00,"two\nlines"', 3, 1),
        ('2,12.95,77.6,2024-01-15 09:00:00,"say ""hi"", all"', 2, 0),
    ],
)
def test_rows_that_do_not_fit_the_header(spark, tmp_path, bad, read, malformed):
    (tmp_path / "e.csv").write_text("\n".join([HEADER, GOOD, bad]) + "\n")
    got = _report(spark, tmp_path / "e.csv")
    assert got["total_rows_read"] == read and got.get("malformed_row", 0) == malformed
    dropped = sum(got.get(k, 0) for k in ("malformed_row", "unparseable_created_at", "invalid_geo", "duplicate_id"))
    assert read == got["rows_retained"] + dropped
    assert _report(spark, tmp_path / "e.csv", multi_line=True)["total_rows_read"] == 2


def test_files_of_other_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{GOOD}\n")
    (tmp_path / "b.csv").write_text("id,longitude,latitude,created_datetime,note\n2,77.6,12.95,2024-01-15,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    ("text", "local"),
    [
        ("2024/01/15 09:00:00", "2024-01-15 09:00:00"),
        ("15-01-2024 09:00", "2024-01-15 09:00:00"),
        ("Jan 15 2024 09:00", "2024-01-15 09:00:00"),
        ("20240115 090000", "2024-01-15 09:00:00"),
        ("01/15/2024 09:00", "2024-01-15 09:00:00"),
        ("2024-01-15 03:30:00 UTC", "2024-01-15 09:00:00"),
        ("2024-01-15 09:00:00 Asia/Kolkata", "2024-01-15 09:00:00"),
        ("15/15/2024 09:00", None),
        ("20241315", None),
    ],
)
def test_further_timestamp_layouts(spark, text, local):
    from geohotspots.functions.timestamps import parse_instant, wall_clock

    row = spark.createDataFrame([(text,)], "t string").select(wall_clock(parse_instant(F.col("t"))).cast("string"))
    assert row.first()[0] == local


def test_bare_nan_keeps_the_rest_of_an_array(spark):
    from geohotspots.functions.text import json_string_array, offence_codes

    rows = spark.createDataFrame([("[NaN, 7]",), ("[-Infinity,8, Infinity ]",), ('["a, NaN, b"]',)], "t string")
    assert [r[0] for r in rows.select(offence_codes(F.col("t"))).collect()][:2] == [[7], [8]]
    assert rows.select(json_string_array(F.col("t"))).collect()[2][0] == ["a, NaN, b"]
