"""Written artifacts and the whole run."""

import csv
import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.tables import clean_rows, raw_rows
from geohotspots.operators import clean
from geohotspots.plans import zones as plan
from geohotspots.sources import published, readers, writers

SF = "/root/testdata/sf0.001"
PRIVATE = ("vehicle_number", "updated_vehicle_number")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("run")
    source = str(out / "events.csv")
    raw_rows(spark, SF).drop("read_order").coalesce(1).write.csv(
        source, header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return plan.run(spark, source, str(out / "artifacts"), with_risk=True, single_file=True)


def text_of(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_report(done):
    got = json.loads(text_of(done.paths["report"]))
    assert got["total_rows_read"] == 1019 and got["rows_retained"] == 941
    assert got["total_dropped"] == 78
    assert got["dropped_by_reason"] == {
        "unparseable_created_at": 23, "invalid_geo": 37, "duplicate_id": 18,
    }


def test_zone_csv(done):
    rows = list(csv.DictReader(text_of(done.paths["csv"]).splitlines()))
    assert list(rows[0]) == [*writers.ZONE_COLUMNS, *writers.RISK_COLUMNS]
    assert [int(r["global_rank"]) for r in rows] == list(range(1, len(rows) + 1))


def test_geojson(spark, done):
    document = json.loads(text_of(done.paths["geojson"]))
    assert document["type"] == "FeatureCollection"
    features = document["features"]
    assert len(features) == done.tables.scored.count()
    for f in features:
        lon, lat = f["geometry"]["coordinates"]
        assert 77.3 <= lon <= 77.9 and 12.7 <= lat <= 13.2
        assert {"police_station", "risk_tier", "anomaly_score", "h3_cell"} <= set(f["properties"])
    lines = [json.loads(x) for x in text_of(done.paths["features"]).splitlines()]
    key = lambda f: f["properties"]["hotspot_id"]
    assert sorted(lines, key=key) == sorted(features, key=key)
    flat = readers.flatten_geojson(spark, done.paths["geojson"])
    assert flat.count() == len(features)


def test_no_private_field_leaves(done):
    for path in done.paths.values():
        text = text_of(path)
        assert not any(p in text for p in PRIVATE) and '"id"' not in text


def test_peak_windows(spark, done):
    flat = readers.flatten_peak_windows(spark, done.paths["peak_windows"], multi_line=True)
    assert flat.count() == done.tables.windows.count()


def test_peak_windows_document_over_several_lines(spark, tmp_path):
    window = {"day_of_week": 6, "start_hour": 8, "end_hour": 11, "expected_intensity": 1.0}
    (tmp_path / "w.json").write_text(json.dumps({"a": [window], "b": []}, indent=2))
    rows = readers.flatten_peak_windows(spark, str(tmp_path / "w.json"), multi_line=True).collect()
    assert [(r.hotspot_id, r.day_label, r.end_hour) for r in rows] == [("a", "Sun", 11)]


def test_empty_artifacts(spark, done, tmp_path):
    none = done.tables.zones.filter("false")
    path = writers.write_priority_csv(none, str(tmp_path / "zones.csv"), single_file=True)
    assert text_of(path).strip().split(",")[0] == "hotspot_id"
    path = writers.write_geojson_document(done.tables.scored.filter("false"), str(tmp_path / "h.geojson"))
    assert json.loads(text_of(path)) == {"type": "FeatureCollection", "features": []}


@pytest.mark.parametrize("single_file", [True, False])
def test_bytes_do_not_depend_on_partitioning(spark, tmp_path, single_file):
    def texts(parts):
        events = clean_rows(spark, SF).repartition(parts)
        tables = plan.zone_tables(events, order_by="id", with_risk=False)
        report = clean.ingestion_report(raw_rows(spark, SF).repartition(parts))
        paths = plan.export_all(tables, report, str(tmp_path / f"{parts}"), single_file=single_file)
        return {name: text_of(path) for name, path in paths.items()}

    assert texts(1) == texts(7)


def test_run_keeps_the_callers_cells_and_order(spark, tmp_path):
    rows = raw_rows(spark, SF).drop("read_order")
    rows = rows.withColumn("h3_cell", F.concat(F.lit("mine"), F.col("police_station"))).withColumn("nr", F.col("id"))
    rows.coalesce(1).write.csv(str(tmp_path / "in"), header=True, quote='"', escape='"')
    found = plan.run(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), order_by="nr", min_samples=500, with_risk=False
    )
    cells = {r["h3_cell"] for r in found.tables.scored.collect()}
    assert cells and all(c.startswith("mine") for c in cells)


def test_a_failed_writer_leaves_the_old_set(spark, done, tmp_path):
    out = str(tmp_path / "live")
    tables, report = done.tables, clean.ingestion_report(raw_rows(spark, SF))
    with pytest.raises(FileNotFoundError):
        published.resolve(spark, out)
    first = plan.export_all(tables, report, out)
    zones = tables.zones
    held = published.read_published(spark, out)

    def broken(folder):
        raise RuntimeError("disk full")

    half = {"csv": lambda to: writers.write_priority_csv(zones.limit(1), f"{to}/priority_zones.csv"), "report": broken}
    with pytest.raises(RuntimeError, match="disk full"):
        published.publish(spark, out, half)
    assert published.resolve(spark, out) == first
    again = published.read_published(spark, out)
    assert again.zones.count() == zones.count() and again.hotspots.count() == tables.scored.count()
    assert again.peak_windows.count() == tables.windows.count()
    totals = {r.metric: r.n for r in again.report.collect()}
    assert totals["rows_retained"] == 941 and totals["invalid_geo"] == 37

    fewer = replace(tables, zones=zones.filter("global_rank <= 3"))
    second = plan.export_all(fewer, report, out)
    assert published.resolve(spark, out) == second and second != first
    assert published.read_published(spark, out).zones.count() == 3
    # Who resolved the first set before still reads it whole.
    assert held.zones.count() == zones.count()


def test_two_publishers_at_once_agree_on_one_set(spark, tmp_path):
    out = str(tmp_path / "both")
    write = lambda to: f"{to}/x"
    published.publish(spark, out, {"x": write})
    line = spark.read.schema(published.MANIFEST).json(f"{out}/manifest").first()
    rival = [(line["sequence"], "0" * 32, {"x": "versions/rival/x"})]
    spark.createDataFrame(rival, published.MANIFEST).write.mode("append").json(f"{out}/manifest")
    assert published.resolve(spark, out)["x"].split("/")[-2] == line["version"]
