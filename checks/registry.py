"""Every registered query: the Spark form and, where SQL can say it, the oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as S
from checks.sql import fixed, query
from checks.tables import clean_rows, events_table, raw_rows
from geohotspots.config import TimeWindow
from geohotspots.functions import text
from geohotspots.functions.timestamps import parse_instant, wall_clock
from geohotspots.operators import (
    activity,
    clean,
    dbscan,
    evaluate,
    forecast,
    impact,
    panel,
    peaks,
    priority,
    reports,
    risk,
    serving,
    spatial,
)
from geohotspots.plans import activity_state, forecasting, ingest
from geohotspots.plans import zones as zones_plan
from geohotspots.session import cut_lineage, shared_dir
from geohotspots.sources import published, readers, writers

Query = Callable[[SparkSession, str], DataFrame]

CLUSTERING = {"eps_m": S.EPS_M, "min_samples": S.MIN_SAMPLES, "bbox": S.BOX}
MIN_CELL_TOTAL, TEST_DAYS = 20, 7


class Tables:
    """Tables of one data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return raw_rows(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_rows(self.spark, self.sf_dir)

    @cached_property
    def cells(self) -> DataFrame:
        return spatial.by_cell(spatial.assign_cells(self.clean, 9))

    @cached_property
    def activity(self) -> DataFrame:
        return cut_lineage(activity.hotspot_activity(self.cells))

    @cached_property
    def hotspots(self) -> DataFrame:
        return spatial.summarise(self.activity, S.BOX)

    @cached_property
    def scored(self) -> DataFrame:
        return cut_lineage(impact.score_impact(self.hotspots, self.activity))

    @cached_property
    def profiles(self) -> DataFrame:
        return cut_lineage(peaks.peak_profiles(self.activity, self.hotspots))

    @cached_property
    def windows(self) -> DataFrame:
        return cut_lineage(peaks.top_peaks(self.profiles))

    @cached_property
    def zones(self) -> DataFrame:
        return cut_lineage(priority.rank_zones(self.scored, self.activity))

    @cached_property
    def tiers(self) -> DataFrame:
        return cut_lineage(risk.quantile_tiers(risk.risk_features(self.scored)))

    @cached_property
    def zones_tiers(self) -> DataFrame:
        return self.zones.join(self.tiers, "hotspot_id")

    @cached_property
    def labelled(self) -> DataFrame:
        return dbscan.cluster_dbscan(self.clean, **CLUSTERING)

    @cached_property
    def cells8(self) -> DataFrame:
        return spatial.assign_cells(self.clean, 8)

    @cached_property
    def daily(self) -> DataFrame:
        return cut_lineage(
            panel.busy_cells(panel.daily_counts(self.cells8), MIN_CELL_TOTAL)
        )

    @cached_property
    def panel(self) -> DataFrame:
        return cut_lineage(
            panel.build_daily_panel(self.cells8, min_cell_total=MIN_CELL_TOTAL)
        )

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        return panel.time_split(panel.training_rows(self.panel), TEST_DAYS)

    @cached_property
    def naive_test(self) -> DataFrame:
        """Hold-out scored by the weekly lag, with labels."""
        train, test = self.split
        return cut_lineage(
            evaluate.hotspot_day_label(forecast.predict_counts(test), train)
        )

    @cached_property
    def cell_dim(self) -> DataFrame:
        return forecast.cell_dim(self.cells8, panel.cell_codes(self.panel))

    @cached_property
    def naive_forecast(self) -> DataFrame:
        return forecast.forecast_days(
            forecast.tail_history(self.panel),
            self.cell_dim,
            self.panel.agg(F.max("date")).scalar(),
            forecast.predict_counts,
        )

    @cached_property
    def model(self):
        return forecast.fit_demand(self.split[0])

    @cached_property
    def poisson_tree(self):
        return forecast.fit_demand(self.split[0], "trees", TREE)


_tables: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of a folder, shared by the queries of one session as stored artifacts are."""
    key = (spark.sparkContext.applicationId, sf_dir)
    return _tables.setdefault(key, Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, needs: str | None = None, final: str | None = None):
    """Register a function of :class:`Tables`; ``needs`` and ``final`` make the oracle."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(tables(spark, sf_dir))
        if final is not None:
            ORACLES[name] = query(needs or "", final)
        return build

    return add


def six(c: Column | str) -> Column:
    """Spark twin of ``checks.sql.fixed``."""
    column = F.col(c) if isinstance(c, str) else c
    return F.floor(column * 1000000 + 0.318309886) / 1000000


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six(n) for n in names})


def dated(df: DataFrame, name: str = "date") -> DataFrame:
    """Dates as text: engines hand them over as different types."""
    return df.withColumn(name, F.col(name).cast("string"))


DATE = "CAST(date AS VARCHAR) AS date"


def _list_text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), "|")


def _scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/artifacts-{uuid.uuid4().hex}/{name}"


HS = "hotspot_id, member_count, police_station, h3_cell, cluster_label"
HS_SQL = f"{HS}, {fixed('centroid_lat', 'centroid_lat')}, {fixed('centroid_lon', 'centroid_lon')}"
ZONE_SQL = ", ".join(
    ["hotspot_id", "police_station", "global_rank", "station_rank"]
    + [fixed(c, c) for c in ("impact", "frequency", "persistence", "recency", "priority_score")]
)


def _zone_rows(zones: DataFrame) -> DataFrame:
    factors = ("impact", "frequency", "persistence", "recency", "priority_score")
    return rounded(
        zones.select("hotspot_id", "police_station", "global_rank", "station_rank", *factors),
        *factors,
    )


# --- sources and sinks ------------------------------------------------------------


def _raw_csv(t: Tables) -> str:
    path = _scratch(t, "events.csv")
    t.raw.drop("read_order").write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return path


@register("scan_csv", "raw", """
SELECT id, latitude, longitude, nullif(created_datetime, 'NULL') AS created_datetime, closed_datetime,
 violation_type, offence_code, nullif(vehicle_type, '') AS vehicle_type,
 nullif(police_station, 'NULL') AS police_station, junction_name, vehicle_number FROM raw""")
def _(t):
    return readers.scan_csv(t.spark, _raw_csv(t)).drop("read_order", clean.MALFORMED_FLAG)


@register("scan_csv_layouts", "raw", """
SELECT CAST(count(*) * 3 AS BIGINT) AS total_rows_read, CAST(count(*) AS BIGINT) AS malformed_row FROM events""")
def _(t):
    # One row as it should be, one with a field too many, one with a field too few, per event.
    events = events_table(t.spark, t.sf_dir)
    fields = F.concat_ws(",", F.col("event_id").cast("string"), F.lit("12.95"), F.lit("77.6"))
    time = F.lit("2024-01-15 09:00:00")
    body = events.select(
        F.explode(
            F.array(
                F.concat(fields, F.lit(","), time, F.lit(",x")),
                F.concat(fields, F.lit("b,"), time, F.lit(",x,extra")),
                F.concat(fields, F.lit(","), time),
            )
        ).alias("value")
    )
    path = _scratch(t, "layouts.csv")
    # Every file has the header; lines hold no tab, so they are written as they are.
    lines = body.withColumnRenamed("value", "id,latitude,longitude,created_datetime,note")
    lines.write.csv(path, header=True, sep="\t", quote="")
    report = clean.ingestion_report(readers.scan_csv(t.spark, path))
    picked = [F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in ("total_rows_read", "malformed_row")]
    return report.agg(*picked)


LAYOUTS = (
    "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm", "MMM d yyyy HH:mm", "yyyyMMdd HHmmss",
    "yyyy-MM-dd HH:mm:ss 'UTC'", "dd/MM/yyyy HH:mm:ss",
)


@register("parse_timestamp_layouts", "raw", """
SELECT event_id, strftime(CASE event_id % 6 WHEN 4 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE
 WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END,
 '%Y-%m-%d %H:%M:%S') AS local_time FROM events""")
def _(t):
    text = F.coalesce(
        *[
            F.when(F.pmod("event_id", F.lit(len(LAYOUTS))) == i, F.date_format("ts", layout))
            for i, layout in enumerate(LAYOUTS)
        ]
    )
    texts = events_table(t.spark, t.sf_dir).select("event_id", text.alias("text"))
    local = wall_clock(parse_instant(F.col("text")))
    return texts.select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@register("sink_priority_csv", "zt_cell", f"SELECT {ZONE_SQL}, risk_tier FROM zt_cell")
def _(t):
    path = writers.write_priority_csv(t.zones_tiers, _scratch(t, "priority_zones.csv"))
    header = t.spark.read.csv(path, header=True, inferSchema=False)
    typed = header.withColumns(
        {c: F.col(c).cast("double") for c in ("impact", "frequency", "persistence", "recency", "priority_score")}
        | {c: F.col(c).cast("int") for c in ("global_rank", "station_rank")}
    )
    return _zone_rows(typed).join(header.select("hotspot_id", "risk_tier"), "hotspot_id")


@register("read_zones", "zones_cell", f"SELECT {ZONE_SQL} FROM zones_cell")
def _(t):
    path = writers.write_priority_csv(t.zones, _scratch(t, "zones.csv"), single_file=False)
    return _zone_rows(readers.read_zones(t.spark, path, with_risk=False))


GEO_SQL = f"""SELECT hotspot_id, member_count, police_station, h3_cell, cluster_label,
 {fixed('impact_score', 'Congestion_Impact_Score')}, {fixed('severity_component', 'severity_component')},
 {fixed('proximity_component', 'proximity_component')}, {fixed('concentration_component', 'concentration_component')},
 {fixed('centroid_lon', 'longitude')}, {fixed('centroid_lat', 'latitude')} FROM scored_cell"""
GEO_VALUES = (
    "Congestion_Impact_Score", "severity_component", "proximity_component",
    "concentration_component", "longitude", "latitude",
)


@register("flatten_geojson", "scored_cell", GEO_SQL)
def _(t):
    path = writers.write_geojson_document(t.scored, _scratch(t, "hotspots.geojson"))
    flat = readers.flatten_geojson(t.spark, path).drop("risk_tier", "anomaly_score")
    return rounded(flat, *GEO_VALUES)


@register("sink_geojson", "scored_cell", GEO_SQL)
def _(t):
    path = writers.write_geojson(t.scored, _scratch(t, "hotspots.geojsonl"))
    flat = readers.read_features(t.spark, path).drop("risk_tier", "anomaly_score")
    return rounded(flat, *GEO_VALUES)


DAY_SQL = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][day_of_week + 1] AS day_label"


@register("flatten_peak_windows", "top_cell", f"""
SELECT hotspot_id, day_of_week, {DAY_SQL}, start_hour, end_hour,
 {fixed('expected_intensity', 'expected_intensity')} FROM top_cell""")
def _(t):
    path = writers.write_peak_windows(t.windows, _scratch(t, "peak_windows.json"))
    return rounded(readers.flatten_peak_windows(t.spark, path), "expected_intensity")


@register("export_all", "zones_cell scored_cell top_cell", """
SELECT z.hotspot_id, z.global_rank, s.member_count, count(w.hotspot_id) AS n_windows
FROM zones_cell z JOIN scored_cell s USING (hotspot_id) LEFT JOIN top_cell w USING (hotspot_id)
GROUP BY z.hotspot_id, z.global_rank, s.member_count""")
def _(t):
    done = zones_plan.ZoneTables(t.cells, t.activity, t.scored, t.profiles, t.windows, t.zones, False)
    report = clean.ingestion_report(t.raw)
    paths = zones_plan.export_all(done, report, _scratch(t, "all"), single_file=True)
    ranks = readers.read_zones(t.spark, paths["csv"], with_risk=False).select("hotspot_id", "global_rank")
    members = readers.flatten_geojson(t.spark, paths["geojson"]).select("hotspot_id", "member_count")
    windows = readers.flatten_peak_windows(t.spark, paths["peak_windows"], multi_line=True)
    counts = windows.groupBy("hotspot_id").agg(F.count(F.lit(1)).alias("n_windows"))
    joined = ranks.join(members, "hotspot_id").join(counts, "hotspot_id", "left")
    return joined.fillna({"n_windows": 0})


@register("read_published", "zones_cell scored_cell top_cell", f"""
SELECT z.hotspot_id, z.global_rank, {fixed('s.impact_score', 'impact_score')}, count(w.hotspot_id) AS n_windows
FROM zones_cell z JOIN scored_cell s USING (hotspot_id) LEFT JOIN top_cell w USING (hotspot_id)
GROUP BY z.hotspot_id, z.global_rank, s.impact_score""")
def _(t):
    # The newest of two published sets, read back in one call.
    done = zones_plan.ZoneTables(t.cells, t.activity, t.scored, t.profiles, t.windows, t.zones, False)
    report, out = clean.ingestion_report(t.raw), _scratch(t, "published")
    zones_plan.export_all(replace(done, zones=t.zones.limit(1)), report, out)
    zones_plan.export_all(done, report, out)
    newest = published.read_published(t.spark, out, with_risk=False)
    counts = newest.peak_windows.groupBy("hotspot_id").agg(F.count(F.lit(1)).alias("n_windows"))
    impacts = newest.hotspots.select("hotspot_id", F.col("Congestion_Impact_Score").alias("impact_score"))
    joined = newest.zones.select("hotspot_id", "global_rank").join(impacts, "hotspot_id").join(counts, "hotspot_id", "left")
    return rounded(joined.fillna({"n_windows": 0}), "impact_score")


def _increments(t: Tables) -> str:
    """State folder of three increments of the raw rows, in their order."""
    state = _scratch(t, "state")
    ends = t.raw.agg(F.max("read_order")).first()[0]
    for no in range(3):
        third = F.floor(F.col("read_order") * 3 / (ends + 1)) == no
        ingest.ingest_increment(t.raw.filter(third), state, f"increment-{no}")
    return state


@register("ingest_increments", "ranked", r"""
SELECT id, lat AS latitude, lon AS longitude,
 CASE WHEN police_station = 'NULL' THEN '' ELSE regexp_replace(trim(police_station), '\s+', ' ', 'g') END AS police_station
FROM ranked WHERE rn = 1""")
def _(t):
    events = ingest.accepted_events(t.spark, _increments(t))
    return events.select("id", "latitude", "longitude", "police_station")


@register("ingest_increments_report", "tagged ranked", """
SELECT (SELECT count(*) FROM tagged) AS total_rows_read, (SELECT count(*) FROM ranked WHERE rn = 1) AS rows_retained,
 (SELECT count(*) FROM tagged WHERE reject_reason = 'invalid_geo') AS invalid_geo""")
def _(t):
    report = ingest.accepted_report(t.spark, _increments(t))
    names = ("total_rows_read", "rows_retained", "invalid_geo")
    return report.agg(*[F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in names])


def _activity_state(t: Tables) -> str:
    """State folder of three increments of the clean events, the first two compacted."""
    state = _scratch(t, "activity")
    for no in range(3):
        part = t.clean.filter(F.col("read_order") % 3 == no)
        activity_state.add_activity(activity_state.cell_hotspots(part), state, f"part-{no}", buckets=8)
        if no == 1:
            activity_state.compact(t.spark, state)
    return state


@register("activity_state", "ev_cell weights", f"""
SELECT hotspot_id, police_station, CAST(CAST(created_local AS DATE) AS VARCHAR) AS local_date,
 CAST(hour(created_local) AS INTEGER) AS hour, count(*) AS n,
 CAST(sum(round(latitude * 100000)) AS BIGINT) AS sum_lat, CAST(sum(round(longitude * 100000)) AS BIGINT) AS sum_lon,
 max(coalesce((SELECT max(weight) FROM weights WHERE list_contains(violation_type, token)), 0))::DOUBLE AS severity,
 CAST(sum(CASE WHEN (junction_name IS NOT NULL AND trim(junction_name) <> '')
  OR list_has_any(violation_type, ['PARKING NEAR ROAD CROSSING', 'PARKING NEAR JUNCTION',
   'NO STOPPING ON ROAD', 'WRONG PARKING ON CARRIAGEWAY']) THEN 1 ELSE 0 END) AS BIGINT) AS near,
 epoch_us(max(created_at)) AS last_us
FROM ev_cell GROUP BY hotspot_id, police_station, CAST(created_local AS DATE), hour(created_local)""")
def _(t):
    merged = activity_state.merged_activity(t.spark, _activity_state(t))
    return dated(merged, "local_date").select(
        "hotspot_id", "police_station", "local_date", "hour", "n",
        *[(F.col(c) / 1000).cast("bigint").alias(c) for c in ("sum_lat", "sum_lon")],
        "severity", "near", F.unix_micros("last_at").alias("last_us"),
    )


@register("zones_from_state", "zones_cell", f"SELECT {ZONE_SQL} FROM zones_cell")
def _(t):
    derived = activity_state.zones_from_state(t.spark, _activity_state(t), with_risk=False)
    return _zone_rows(derived.zones)


@register("drop_private", "clean", "SELECT latitude, longitude, police_station FROM clean")
def _(t):
    return writers.drop_private(
        t.clean.select("id", "latitude", "longitude", "police_station", "vehicle_number")
    )


@register("ingestion_report_json", "tagged ranked", """
SELECT (SELECT count(*) FROM tagged) AS total_rows_read, (SELECT count(*) FROM ranked WHERE rn = 1) AS rows_retained,
 (SELECT count(*) FROM tagged WHERE reject_reason = 'invalid_geo') AS invalid_geo""")
def _(t):
    path = writers.write_ingestion_report(clean.ingestion_report(t.raw), _scratch(t, "report.json"))
    read = t.spark.read.schema(
        "total_rows_read bigint, rows_retained bigint, dropped_by_reason map<string, bigint>"
    ).json(path)
    return read.select(
        "total_rows_read", "rows_retained", F.col("dropped_by_reason")["invalid_geo"].alias("invalid_geo")
    )


# --- cleaning -----------------------------------------------------------------------


@register("null_tokens", "raw", """
SELECT read_order, CASE WHEN lower(trim(police_station)) NOT IN ('', 'null', 'nan', 'none', 'nat', 'na') THEN trim(police_station) END AS station,
 CASE WHEN lower(trim(vehicle_type)) NOT IN ('', 'null', 'nan', 'none', 'nat', 'na') THEN trim(vehicle_type) END AS vehicle
FROM raw""")
def _(t):
    return t.raw.select(
        "read_order",
        text.null_if_token(F.col("police_station")).alias("station"),
        text.null_if_token(F.col("vehicle_type")).alias("vehicle"),
    )


@register("parse_json_array", "raw", """
SELECT read_order, CASE WHEN violation_type LIKE '[%' THEN array_to_string(CAST(json(violation_type) AS VARCHAR[]), '|') ELSE '' END AS elements,
 CASE WHEN violation_type LIKE '[%' THEN CAST(json_array_length(violation_type) AS INTEGER) ELSE 0 END AS n FROM raw""")
def _(t):
    elements = text.json_string_array(F.col("violation_type"))
    return t.raw.select("read_order", elements.alias("e")).select(
        "read_order", _list_text(F.col("e")).alias("elements"), F.size("e").alias("n")
    )


@register("violation_tokens", "raw", """
SELECT read_order, CASE WHEN violation_type LIKE '[%' THEN array_to_string(list_transform(CAST(json(violation_type) AS VARCHAR[]), lambda x: upper(trim(x))), '|') ELSE '' END AS tokens FROM raw""")
def _(t):
    return t.raw.select(
        "read_order", _list_text(text.violation_tokens(F.col("violation_type"))).alias("tokens")
    )


@register("offence_codes", "raw", """
SELECT read_order, concat(CAST(CAST(json_extract_string(offence_code, '$[0]') AS INTEGER) AS VARCHAR), '|',
 CAST((CAST(id AS BIGINT) % 300) AS VARCHAR), '|2') AS codes FROM raw""")
def _(t):
    return t.raw.select(
        "read_order", _list_text(text.offence_codes(F.col("offence_code"))).alias("codes")
    )


@register("parse_timestamps", "typed", """
SELECT read_order, created_at, closed_at, created_at + INTERVAL 330 MINUTE AS created_local FROM typed""")
def _(t):
    parsed = clean.parse_timestamps(t.raw)
    return parsed.select(
        "read_order",
        wall_clock(F.col("created_at"), "UTC").alias("created_at"),
        wall_clock(F.col("closed_at"), "UTC").alias("closed_at"),
        "created_local",
    )


@register("require_created_at", "typed", "SELECT id, read_order FROM typed WHERE created_at IS NOT NULL")
def _(t):
    return clean.require_created_at(clean.parse_timestamps(t.raw)).select("id", "read_order")


@register("canonical_names", "typed", """
SELECT count(created_at) AS n_created_at, count(closed_at) AS n_closed_at, count(*) AS n FROM typed""")
def _(t):
    renamed = clean.parse_timestamps(t.raw)
    return renamed.agg(
        F.count("created_at").alias("n_created_at"),
        F.count("closed_at").alias("n_closed_at"),
        F.count(F.lit(1)).alias("n"),
    )


@register("validate_geo", "typed", f"""
SELECT read_order, lat AS latitude, lon AS longitude FROM typed
WHERE lat BETWEEN {S.d(12.7)} AND {S.d(13.2)} AND lon BETWEEN {S.d(77.3)} AND {S.d(77.9)}""")
def _(t):
    return clean.validate_geo(t.raw, S.BOX).select("read_order", "latitude", "longitude")


@register("norm_vehicle_type", "raw", "SELECT read_order, coalesce(lower(trim(vehicle_type)), '') AS vehicle_type FROM raw")
def _(t):
    return clean.normalise_categoricals(t.raw).select("read_order", "vehicle_type")


@register("norm_station", "raw", r"""
SELECT read_order, CASE WHEN police_station = 'NULL' THEN '' ELSE regexp_replace(trim(police_station), '\s+', ' ', 'g') END AS police_station FROM raw""")
def _(t):
    return clean.normalise_categoricals(t.raw).select("read_order", "police_station")


@register("dedupe_first", "raw", """
SELECT id, read_order FROM (SELECT id, read_order, row_number() OVER (PARTITION BY id ORDER BY read_order) AS rn FROM raw) r WHERE rn = 1""")
def _(t):
    return clean.dedupe_first(t.raw.select("id", "read_order"))


@register("ingestion_report", "tagged ranked", """
SELECT 'total_rows_read' AS metric, count(*) AS n FROM tagged
UNION ALL SELECT 'rows_retained', count(*) FROM ranked WHERE rn = 1
UNION ALL SELECT 'total_dropped', (SELECT count(*) FROM tagged) - (SELECT count(*) FROM ranked WHERE rn = 1)
UNION ALL SELECT reject_reason, count(*) FROM tagged WHERE reject_reason IS NOT NULL GROUP BY reject_reason
UNION ALL SELECT 'duplicate_id', count(*) FROM ranked WHERE rn > 1""")
def _(t):
    return clean.ingestion_report(t.raw)


@register("clean_events", "ranked", r"""
SELECT id, lat AS latitude, lon AS longitude, created_at, created_at + INTERVAL 330 MINUTE AS created_local,
 CASE WHEN violation_type LIKE '[%' THEN array_to_string(list_transform(CAST(json(violation_type) AS VARCHAR[]), lambda x: upper(trim(x))), '|') ELSE '' END AS violation_type,
 coalesce(lower(trim(vehicle_type)), '') AS vehicle_type,
 CASE WHEN police_station = 'NULL' THEN '' ELSE regexp_replace(trim(police_station), '\s+', ' ', 'g') END AS police_station
FROM ranked WHERE rn = 1""")
def _(t):
    return clean.clean_events(t.raw).select(
        "id",
        "latitude",
        "longitude",
        wall_clock(F.col("created_at"), "UTC").alias("created_at"),
        "created_local",
        _list_text(F.col("violation_type")).alias("violation_type"),
        "vehicle_type",
        "police_station",
    )


# --- space --------------------------------------------------------------------------


@register("hex_bin", "hex9", "SELECT id, h3_cell FROM hex9")
def _(t):
    return spatial.assign_cells(t.clean, 9).select("id", "h3_cell")


@register("hex_bin_res8", "hex8", "SELECT h3_cell, count(*) AS n FROM hex8 GROUP BY h3_cell")
def _(t):
    return t.cells8.groupBy("h3_cell").agg(F.count(F.lit(1)).alias("n"))


_OFFSETS = ", ".join(f"({dx}, {dy})" for dx, dy in S.GRID.offsets)


@register("sparse_neighbour_counts", "clean", f"""
, pts AS (SELECT latitude, longitude, count(*) AS w,
  CAST(floor((longitude - {S.d(S.GRID.lon0)}) / {S.d(S.GRID.step_lon)}) AS BIGINT) AS cx,
  CAST(floor((latitude - {S.d(S.GRID.lat0)}) / {S.d(S.GRID.step_lat)}) AS BIGINT) AS cy FROM clean GROUP BY latitude, longitude),
cells AS (SELECT cx, cy, sum(w) AS events FROM pts GROUP BY cx, cy),
around AS (SELECT c.cx, c.cy, c.events, sum(n.events) AS total FROM cells c, (VALUES {_OFFSETS}) o(dx, dy), cells n
  WHERE n.cx = c.cx + o.dx AND n.cy = c.cy + o.dy GROUP BY c.cx, c.cy, c.events)
SELECT a.latitude, a.longitude, CAST(sum(b.w) AS BIGINT) AS neighbours
FROM pts a JOIN around r ON a.cx = r.cx AND a.cy = r.cy AND r.events < {S.MIN_SAMPLES} AND r.total >= {S.MIN_SAMPLES}
JOIN pts b ON b.latitude BETWEEN a.latitude - 0.001 AND a.latitude + 0.001
 AND b.longitude BETWEEN a.longitude - 0.001 AND a.longitude + 0.001
WHERE {S._DIST} <= {S.d(S.EPS_M)} GROUP BY a.latitude, a.longitude""")
def _(t):
    sized, cells = dbscan.density(t.clean, S.GRID, S.MIN_SAMPLES, "read_order")
    hits = dbscan.sparse_neighbour_counts(sized, cells, S.GRID)
    return hits.groupBy(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).agg(
        F.sum("hits").alias("neighbours")
    )


@register("core_points", "cores clean", """
SELECT latitude, longitude, count(*) AS weight FROM clean WHERE read_order IN (SELECT p FROM cores) GROUP BY latitude, longitude""")
def _(t):
    cores = dbscan.core_points(t.clean, **CLUSTERING)
    return cores.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})


@register("cluster_dbscan", "labelled", "SELECT id, cluster_label FROM labelled")
def _(t):
    return t.labelled.select("id", "cluster_label")


@register("hotspots_from_clusters", "hs_cluster", f"SELECT {HS_SQL} FROM hs_cluster")
def _(t):
    labelled = spatial.assign_cells(t.labelled, 9)
    return rounded(
        spatial.hotspots_from_clusters(labelled, S.BOX), "centroid_lat", "centroid_lon"
    )


@register("hotspots_from_cells", "hs_cell", f"SELECT {HS_SQL} FROM hs_cell")
def _(t):
    celled = spatial.assign_cells(t.clean, 9)
    return rounded(spatial.hotspots_from_cells(celled, S.BOX), "centroid_lat", "centroid_lon")


@register("build_hotspots", "hs_cluster", f"SELECT {HS_SQL} FROM hs_cluster")
def _(t):
    built = spatial.build_hotspots(t.clean, resolution=9, **CLUSTERING)
    return rounded(built, "centroid_lat", "centroid_lon")


@register("build_hotspots_fallback", "hs_cell", f"SELECT {HS_SQL} FROM hs_cell")
def _(t):
    parameters = CLUSTERING | {"min_samples": 5_000_000}
    built = spatial.build_hotspots(t.clean, resolution=9, **parameters)
    return rounded(built, "centroid_lat", "centroid_lon")


@register("modal_value", "station_cell", "SELECT hotspot_id, police_station FROM station_cell")
def _(t):
    return spatial.modal_value(t.cells, ["hotspot_id"], "police_station")


@register("membership", "ev_cluster", "SELECT id, hotspot_id FROM ev_cluster")
def _(t):
    return spatial.membership(spatial.by_cluster(t.labelled))


# --- impact ---------------------------------------------------------------------------


@register("severity", "sev_cell", "SELECT hotspot_id, severity_component FROM sev_cell")
def _(t):
    return impact.severity(t.activity)


@register("proximity", "prox_cell", f"SELECT hotspot_id, {fixed('proximity_component', 'proximity_component')} FROM prox_cell")
def _(t):
    return rounded(impact.proximity(t.activity), "proximity_component")


@register("temporal_concentration", "conc_cell", f"SELECT hotspot_id, {fixed('concentration_component', 'concentration_component')} FROM conc_cell")
def _(t):
    return rounded(impact.concentration(t.activity), "concentration_component")


@register("impact_raw", "rawscore_cell", f"SELECT hotspot_id, {fixed('impact_raw', 'impact_raw')} FROM rawscore_cell")
def _(t):
    raw = impact.impact_raw(t.hotspots, impact.impact_components(t.activity))
    return rounded(raw.select("hotspot_id", "impact_raw"), "impact_raw")


@register("live_signal_boost", "rawscore_cell", f"""
, boosted AS (SELECT hotspot_id, CASE WHEN member_count % 3 = 0 THEN
  impact_raw + (1 - impact_raw) * least(1.0, greatest(0.0, (member_count % 17) / 10.0)) ELSE impact_raw END AS impact_raw FROM rawscore_cell)
SELECT hotspot_id, {fixed('impact_raw', 'impact_raw')},
 {fixed('least(100.0, impact_raw * (100.0 / (SELECT max(impact_raw) FROM boosted)))', 'impact_score')} FROM boosted""")
def _(t):
    signal = t.hotspots.filter("member_count % 3 = 0").select(
        "hotspot_id", ((F.col("member_count") % 17) / 10.0).alias("signal")
    )
    scored = impact.score_impact(t.hotspots, t.activity, signal=signal)
    return rounded(
        scored.select("hotspot_id", "impact_raw", "impact_score"), "impact_raw", "impact_score"
    )


@register("impact_score", "scored_cell", f"SELECT hotspot_id, {fixed('impact_score', 'impact_score')} FROM scored_cell")
def _(t):
    scored = impact.score_impact(t.hotspots, t.activity)
    return rounded(scored.select("hotspot_id", "impact_score"), "impact_score")


@register("impact_breakdown", "scored_cell", f"""
SELECT hotspot_id, {fixed('severity_component', 'severity')}, {fixed('proximity_component', 'proximity')},
 {fixed('concentration_component', 'concentration')} FROM scored_cell""")
def _(t):
    parts = ("severity", "proximity", "concentration")
    wide = t.scored.select("hotspot_id", *[F.col("breakdown")[p].alias(p) for p in parts])
    return rounded(wide, *parts)


# --- peaks ----------------------------------------------------------------------------


@register("peak_profile", "profile_cell", f"""
SELECT hotspot_id, day_of_week, hour, total_events, {fixed('intensity', 'intensity')} FROM profile_cell""")
def _(t):
    profiles = peaks.peak_profiles(t.activity, t.hotspots)
    return rounded(peaks.profile_rows(profiles), "intensity")


@register("peak_cells", "peakcells_cell", f"""
SELECT hotspot_id, day_of_week, hour, {fixed('intensity', 'intensity')} FROM peakcells_cell""")
def _(t):
    return rounded(peaks.peak_cells(t.profiles).drop("total_events"), "intensity")


WINDOW_SQL = f"hotspot_id, day_of_week, start_hour, end_hour, {fixed('expected_intensity', 'expected_intensity')}"


@register("coalesce_peaks", "windows_cell", f"SELECT {WINDOW_SQL} FROM windows_cell")
def _(t):
    windows = peaks.coalesce_peaks(peaks.peak_cells(t.profiles))
    return rounded(windows, "expected_intensity")


@register("top_peaks", "top_cell", f"SELECT {WINDOW_SQL}, peak_rank FROM top_cell")
def _(t):
    return rounded(peaks.top_peaks(t.profiles, top_k=3), "expected_intensity")


@register("zone_peaks", "zones_cell top_cell", f"""
SELECT z.hotspot_id, z.global_rank, t.day_of_week, t.start_hour, t.end_hour, {fixed('t.expected_intensity', 'expected_intensity')}
FROM zones_cell z LEFT JOIN top_cell t USING (hotspot_id)""")
def _(t):
    attached = peaks.attach_peaks(t.zones, t.windows)
    rows = attached.select("hotspot_id", "global_rank", F.explode_outer("peak_windows").alias("w"))
    return rounded(rows.select("hotspot_id", "global_rank", "w.*"), "expected_intensity")


@register("overall_matrix", "clean", """
SELECT CAST(isodow(created_local) - 1 AS INTEGER) AS day_of_week, CAST(hour(created_local) AS INTEGER) AS hour, count(*) AS n FROM clean GROUP BY ALL""")
def _(t):
    return peaks.overall_matrix(t.clean)


@register("top_zone_profile", "profile_cell zones_cell", f"""
SELECT hotspot_id, day_of_week, hour, {fixed('intensity', 'intensity')} FROM profile_cell
WHERE hotspot_id = (SELECT hotspot_id FROM zones_cell WHERE global_rank = 1)""")
def _(t):
    rows = peaks.top_zone_profile(t.profiles, t.zones).drop("total_events")
    return rounded(rows, "intensity")


# --- priority ----------------------------------------------------------------------------


@register("frequency", "hs_cell", "SELECT hotspot_id, member_count FROM hs_cell")
def _(t):
    return spatial.summarise(t.activity, S.BOX).select("hotspot_id", "member_count")


@register("persistence", "factors_cell", "SELECT hotspot_id, active_days FROM factors_cell")
def _(t):
    return priority.raw_factors(t.activity).select("hotspot_id", "active_days")


@register("recency", "factors_cell", f"SELECT hotspot_id, {fixed('recency', 'recency')} FROM factors_cell")
def _(t):
    return rounded(priority.recency(t.activity), "recency")


@register("default_as_of", "clean", "SELECT max(created_at) AS as_of FROM clean")
def _(t):
    as_of = priority.default_as_of(t.clean)
    return t.spark.range(1).select(wall_clock(as_of, "UTC").alias("as_of"))


@register("minmax", "factors_cell", f"SELECT hotspot_id, {fixed('frequency', 'frequency')}, {fixed('persistence', 'persistence')} FROM factors_cell")
def _(t):
    factors = priority.priority_factors(t.scored, t.activity)
    columns = ("frequency", "persistence")
    return rounded(factors.select("hotspot_id", *columns), *columns)


@register("priority_score", "prio_cell", f"SELECT hotspot_id, {fixed('priority_score', 'priority_score')} FROM prio_cell")
def _(t):
    factors = priority.priority_factors(t.scored, t.activity)
    return rounded(factors.select("hotspot_id", "priority_score"), "priority_score")


@register("global_rank", "zones_cell", "SELECT hotspot_id, global_rank FROM zones_cell")
def _(t):
    factors = priority.priority_factors(t.scored, t.activity)
    return priority.rank_global(factors).select("hotspot_id", "global_rank")


@register("station_rank", "zones_cell", "SELECT hotspot_id, police_station, station_rank FROM zones_cell")
def _(t):
    factors = priority.priority_factors(t.scored, t.activity)
    return priority.rank_in_station(factors).select(
        "hotspot_id", "police_station", "station_rank"
    )


@register("rank_zones", "zones_cell", f"SELECT {ZONE_SQL} FROM zones_cell")
def _(t):
    return _zone_rows(priority.rank_zones(t.scored, t.activity))


def cluster_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: clean events to ranked cluster zones."""
    events = clean_rows(spark, sf_dir)
    assigned = spatial.assign_hotspots(events, resolution=9, **CLUSTERING).events
    act = cut_lineage(activity.hotspot_activity(assigned))
    scored = cut_lineage(impact.score_impact(spatial.summarise(act, S.BOX), act))
    return _zone_rows(priority.rank_zones(scored, act))


QUERIES["rank_cluster_zones"] = cluster_zones
ORACLES["rank_cluster_zones"] = query("zones_cluster", f"SELECT {ZONE_SQL} FROM zones_cluster")


@register("cluster_peaks", "top_cluster", f"SELECT {WINDOW_SQL}, peak_rank FROM top_cluster")
def _(t):
    act = activity.hotspot_activity(spatial.by_cluster(t.labelled))
    return rounded(peaks.top_peaks(peaks.peak_profiles(act)), "expected_intensity")


# --- risk --------------------------------------------------------------------------------


@register("risk_features", "scored_cell", f"""
SELECT hotspot_id, {fixed('impact_score', 'impact_score')}, {fixed('severity_component', 'severity_component')},
 {fixed('proximity_component', 'proximity_component')}, {fixed('concentration_component', 'concentration_component')},
 {fixed('ln(1 + member_count)', 'log_member_count')} FROM scored_cell""")
def _(t):
    return rounded(risk.risk_features(t.scored), *risk.FEATURES)


@register("standardize", "scored_cell", """
, f AS (SELECT hotspot_id, impact_score, severity_component, proximity_component, concentration_component, ln(1 + member_count) AS log_member_count FROM scored_cell),
s AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in risk.FEATURES) + """ FROM f)
SELECT hotspot_id, """ + ", ".join(
    fixed(f"CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END", c) for c in risk.FEATURES
) + " FROM f, s")
def _(t):
    return rounded(risk.standardise(risk.risk_features(t.scored)), *risk.FEATURES)


_Z_SQL = """
, f AS (SELECT hotspot_id, impact_score, severity_component, proximity_component, concentration_component, ln(1 + member_count) AS log_member_count FROM scored_cell),
s AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in risk.FEATURES) + """ FROM f),
z AS MATERIALIZED (SELECT hotspot_id, impact_score, [""" + ", ".join(
    f"CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END" for c in risk.FEATURES
) + f"""] AS x, ('0x' || substr(md5('{risk.SEED}:' || hotspot_id), 1, 8))::BIGINT % {risk.PRIME} AS a,
 ('0x' || substr(md5('{risk.SEED}:' || hotspot_id), 9, 8))::BIGINT % {risk.PRIME} AS b FROM f, s)"""


def _forest_sql() -> str:
    """Growing and walking the forest, a join for each level."""
    def mean_path(n: str) -> str:
        return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n} END"

    def draw(first: int) -> str:
        return f"('0x' || substr(md5('{risk.SEED}:' || tree || ':' || node), {first}, 8))::BIGINT % {risk.PRIME}"

    sides = ", ".join(f"min(x[{i}])" for i in range(1, 6)), ", ".join(f"max(x[{i}])" for i in range(1, 6))
    parts = [_Z_SQL.replace("z AS MATERIALIZED (", "z AS MATERIALIZED (SELECT * REPLACE (list_transform(x, lambda v: round(v * 1000000)) AS x) FROM (") + ")", f"""c AS MATERIALIZED (SELECT least(count(*), {risk.TREE_ROWS}) AS size FROM z),
l0 AS MATERIALIZED (SELECT tree, x, 1::BIGINT AS node FROM (SELECT t AS tree, x, row_number() OVER (PARTITION BY t ORDER BY (a + t * b) % {risk.PRIME}, hotspot_id) AS rn
 FROM z, range({risk.TREES}) r(t)) q, c WHERE rn <= size),
w0 AS MATERIALIZED (SELECT hotspot_id, x, t AS tree, 1::BIGINT AS node FROM z, range({risk.TREES}) r(t))"""]
    for level in range(8):
        parts.append(f"""p{level} AS MATERIALIZED (SELECT tree, node, f, lo[f + 1] + (hi[f + 1] - lo[f + 1]) * (({draw(9)}) / {risk.PRIME}::DOUBLE) AS cut
 FROM (SELECT *, o[({draw(1)}) % len(o) + 1] AS f FROM (SELECT *, list_filter([0, 1, 2, 3, 4], lambda i: lo[i + 1] < hi[i + 1]) AS o
  FROM (SELECT tree, node, [{sides[0]}] AS lo, [{sides[1]}] AS hi FROM l{level} GROUP BY tree, node) m) n, c WHERE len(o) > 0 AND {level} < ceil(log2(size))) d)""")
        for t, own in (("l", "tree, x"), ("w", "hotspot_id, x, tree")):
            parts.append(f"""{t}{level + 1} AS MATERIALIZED (SELECT {own}, CASE WHEN f IS NULL THEN node ELSE 2 * node + CASE WHEN x[f + 1] > cut THEN 1 ELSE 0 END END AS node
 FROM {t}{level} LEFT JOIN p{level} USING (tree, node))""")
    parts.append(f"""e AS (SELECT tree, node, floor(log2(node)) + {mean_path('n')} AS path FROM (SELECT tree, node, count(*) AS n FROM l8 GROUP BY ALL) g),
r AS MATERIALIZED (SELECT hotspot_id, pow(2.0, -(sum(path) / {risk.TREES}) / (SELECT {mean_path('size')} FROM c)) AS raw FROM w8 JOIN e USING (tree, node) GROUP BY hotspot_id)
SELECT hotspot_id, CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 0.0 ELSE round_even((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 4) END::DOUBLE AS anomaly_score FROM r""")
    return ",\n".join(parts)


def _kmeans_sql() -> str:
    """Seeds by exponential races, then rounds of moving centres in one recursion."""
    def distance(centre: str) -> str:
        return " + ".join(f"(x[{i}] - {centre}[{i}]) * (x[{i}] - {centre}[{i}])" for i in range(1, 6))

    def moved(k: int) -> str:
        sums = ", ".join(f"(sum(x[{i}]) FILTER (g = {k}))::DOUBLE / count(*) FILTER (g = {k})" for i in range(1, 6))
        return f"CASE WHEN count(*) FILTER (g = {k}) > 0 THEN [{sums}] ELSE any_value(c{k}) END AS c{k}"

    draw = f"(a + (3 * start + {{no}}) * b) % {risk.PRIME}"
    wait = f"-ln(({draw} + 1) / {float(risk.PRIME + 1)}::DOUBLE) / d"
    parts = [_Z_SQL, f"""pt AS MATERIALIZED (SELECT hotspot_id, impact_score, a, b, list_transform(x, lambda v: round(v * 1000000)::BIGINT) AS x FROM z),
i0 AS MATERIALIZED (SELECT start, min({{'w': ({draw.format(no=0)})::DOUBLE, 'id': hotspot_id, 'x': x}}).x::DOUBLE[] AS c0 FROM pt, range({risk.RESTARTS}) q(start) GROUP BY start),
i1 AS MATERIALIZED (SELECT start, any_value(c0) AS c0, min({{'w': {wait.format(no=1)}, 'id': hotspot_id, 'x': x}}).x::DOUBLE[] AS c1
 FROM (SELECT *, {distance('c0')} AS d FROM pt, i0) q WHERE d > 0 GROUP BY start),
i2 AS MATERIALIZED (SELECT start, any_value(c0) AS c0, any_value(c1) AS c1, min({{'w': {wait.format(no=2)}, 'id': hotspot_id, 'x': x}}).x::DOUBLE[] AS c2
 FROM (SELECT *, least({distance('c0')}, {distance('c1')}) AS d FROM pt, i1) q WHERE d > 0 GROUP BY start),
km AS (SELECT 0 AS i, start, c0, c1, c2 FROM i2 UNION ALL
 SELECT i + 1, start, {moved(0)}, {moved(1)}, {moved(2)}
 FROM (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS g FROM (
  SELECT km.*, x, {distance('c0')} AS d0, {distance('c1')} AS d1, {distance('c2')} AS d2 FROM km, pt WHERE i < {risk.ROUNDS}) m) v GROUP BY i, start),
o AS MATERIALIZED (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS g, least(d0, d1, d2) AS d FROM (
 SELECT start, hotspot_id, impact_score, {distance('c0')} AS d0, {distance('c1')} AS d1, {distance('c2')} AS d2 FROM km, pt WHERE i = {risk.ROUNDS}) m),
best AS (SELECT start FROM o GROUP BY start ORDER BY sum(round(d / 1000000)::BIGINT), start LIMIT 1),
named AS (SELECT g, row_number() OVER (ORDER BY avg(impact_score) DESC, g) AS rank FROM o WHERE start = (SELECT start FROM best) GROUP BY g)
SELECT hotspot_id, ['HIGH', 'MEDIUM', 'LOW'][rank] AS risk_tier FROM o JOIN named USING (g) WHERE start = (SELECT start FROM best)"""]
    return ",\n".join(parts)


@register("anomaly_score", "scored_cell", _forest_sql())
def _(t):
    return risk.anomaly_scores(risk.standardise(risk.risk_features(t.scored)))


@register("risk_tier", "scored_cell", _kmeans_sql())
def _(t):
    features = cut_lineage(risk.risk_features(t.scored))
    return risk.risk_tiers(features, risk.standardise(features))


@register("quantile_tiers", "tiers_cell", "SELECT hotspot_id, risk_tier FROM tiers_cell")
def _(t):
    return risk.quantile_tiers(risk.risk_features(t.scored))


@register("attach_risk", "scored_cell tiers_cell", """
SELECT hotspot_id, coalesce(risk_tier, 'UNKNOWN') AS risk_tier, CASE WHEN risk_tier IS NULL THEN 0.5 ELSE 0.25 END::DOUBLE AS anomaly_score
FROM scored_cell LEFT JOIN (SELECT * FROM tiers_cell WHERE risk_tier <> 'LOW') t USING (hotspot_id)""")
def _(t):
    known = t.tiers.filter("risk_tier <> 'LOW'").withColumn("anomaly_score", F.lit(0.25))
    return risk.attach_risk(t.scored, known).select("hotspot_id", "risk_tier", "anomaly_score")


# --- demand panel and forecast --------------------------------------------------------------

ROLLS = ("roll_7_mean", "roll_14_mean", "expanding_mean")
ROLL_SQL = ", ".join(fixed(c, c) for c in ROLLS)
CALENDAR = "dow, is_weekend, month, day, day_of_year"


@register("daily_counts", "daily", f"SELECT h3_cell, {DATE}, count FROM daily")
def _(t):
    return dated(panel.daily_counts(t.cells8))


@register("min_cell_total", "busy", f"SELECT h3_cell, {DATE}, count FROM busy")
def _(t):
    return dated(t.daily)


@register("zero_fill", "filled", f"SELECT h3_cell, {DATE}, count FROM filled")
def _(t):
    return dated(panel.zero_fill(t.daily))


@register("lags", "panel", f"SELECT h3_cell, {DATE}, lag_1, lag_7 FROM panel")
def _(t):
    return dated(panel.add_lags(panel.zero_fill(t.daily)).drop("count"))


@register("rolling", "panel", f"SELECT h3_cell, {DATE}, {ROLL_SQL} FROM panel")
def _(t):
    return dated(rounded(panel.add_rolling(panel.zero_fill(t.daily)).drop("count"), *ROLLS))


@register("calendar", "panel", f"SELECT h3_cell, {DATE}, {CALENDAR} FROM panel")
def _(t):
    return dated(panel.add_calendar(panel.zero_fill(t.daily)).drop("count"))


@register("cell_code", "panel", "SELECT DISTINCT h3_cell, cell_code FROM panel")
def _(t):
    return panel.cell_codes(t.daily)


@register("daily_panel", "panel", f"""
SELECT h3_cell, {DATE}, count, lag_1, lag_7, {CALENDAR}, cell_code, {ROLL_SQL} FROM panel""")
def _(t):
    built = panel.build_daily_panel(t.cells8, min_cell_total=MIN_CELL_TOTAL)
    return dated(rounded(built, *ROLLS))


@register("training_rows", "training", f"SELECT h3_cell, {DATE}, count FROM training")
def _(t):
    return dated(panel.training_rows(t.panel).select("h3_cell", "date", "count"))


@register("cell_dim", "celldim", f"""
SELECT h3_cell, cell_code, police_station, {fixed('centroid_lat', 'centroid_lat')}, {fixed('centroid_lon', 'centroid_lon')} FROM celldim""")
def _(t):
    return rounded(t.cell_dim, "centroid_lat", "centroid_lon")


@register("tail_history", "filled", f"SELECT h3_cell, {DATE}, count FROM filled WHERE date > (SELECT max(date) FROM filled) - 21")
def _(t):
    return dated(forecast.tail_history(t.panel))


@register("forecast_days", "naive", f"SELECT h3_cell, {DATE}, predicted_count, police_station FROM naive")
def _(t):
    rows = t.naive_forecast.select("h3_cell", "date", "predicted_count", "police_station")
    return dated(rows)


@register("forecast_hotspots", "ranked_forecast", """
SELECT forecast_rank, h3_cell, police_station, total_predicted, CAST(peak_date AS VARCHAR) AS peak_date FROM ranked_forecast""")
def _(t):
    ranked = forecast.forecast_hotspots(t.naive_forecast)
    return dated(ranked.drop("centroid_lat", "centroid_lon"), "peak_date")


@register("time_split", "training train", f"""
SELECT h3_cell, {DATE}, CASE WHEN date <= (SELECT max(date) FROM training) - 7 THEN 'train' ELSE 'test' END AS part FROM training""")
def _(t):
    train, test = t.split
    parts = train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )
    return dated(parts.select("h3_cell", "date", "part"))


@register("fit_demand")
def _(t):
    rows = forecast.predict_counts(t.split[1], t.model)
    return rows.select("h3_cell", "date", "count", "prediction")


@register("forecast_model")
def _(t):
    fitted = forecast.DemandForecaster(min_cell_total=MIN_CELL_TOTAL).fit(t.cells8)
    return fitted.predict_hotspots()


@register("grid_sweep")
def _(t):
    train, test = (cut_lineage(part) for part in t.split)
    tried = evaluate.grid_sweep(train, test).tried
    return t.spark.createDataFrame(
        [(p["regParam"], mae) for p, mae in tried], "reg_param double, mae double"
    )


SWEPT = ("lag_7", "roll_7_mean", "roll_14_mean", "expanding_mean")
SWEPT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS predictor, avg(abs(count - {c})) AS e FROM test" for c in SWEPT
)


@register("sweep_errors", "test", f"""
SELECT predictor, {fixed('e', 'mae')}, e = min(e) OVER () AS best FROM ({SWEPT_SQL}) x""")
def _(t):
    predictors = [
        lambda rows, c=c: rows.withColumn("prediction", F.col(c).cast("double")) for c in SWEPT
    ]
    errors = evaluate.sweep_errors(t.naive_test.drop("prediction"), predictors)
    rows = [(c, e, e == min(errors)) for c, e in zip(SWEPT, errors)]
    return rounded(t.spark.createDataFrame(rows, "predictor string, mae double, best boolean"), "mae")


@register("fit_demand_totals", "train", """
SELECT dow, CAST(sum(count) AS DOUBLE) AS total FROM train GROUP BY dow""")
def _(t):
    # Without a ridge the Poisson model gives back the training sums of each day of the week.
    train = t.split[0]
    fitted = forecast.fit_demand(train, "glm", {"regParam": 0.0, "maxIter": 200, "tol": 1e-9})
    sums = forecast.predict_counts(train, fitted).groupBy("dow").agg(F.sum("prediction").alias("s"))
    return sums.select("dow", F.round("s", 2).alias("total"))


@register("evaluate_forecaster")
def _(t):
    done = forecasting.evaluate_forecaster(
        t.cells8, test_days=TEST_DAYS, min_cell_total=MIN_CELL_TOTAL
    )
    return done.metrics.join(done.baseline.select("baseline_mae", "improvement_pct"))


@register("regression_metrics", "test", f"""
SELECT {fixed('avg(abs(count - prediction))', 'mae')}, {fixed('sqrt(avg(pow(count - prediction, 2)))', 'rmse')},
 {fixed('1 - avg(pow(count - prediction, 2)) / var_pop(count)', 'r2')} FROM test""")
def _(t):
    metrics = evaluate.regression_metrics(t.naive_test).drop("poisson_deviance")
    return rounded(metrics, "mae", "rmse", "r2")


@register("regression_metrics_deviance", "test", f"""
SELECT {fixed('avg(abs(count - p))', 'mae')},
 {fixed('2 * avg(CASE WHEN count > 0 THEN count * ln(count / p) ELSE 0 END - count + p)', 'poisson_deviance')}
FROM (SELECT count, roll_7_mean + 1 AS p FROM test) x""")
def _(t):
    positive = t.naive_test.withColumn("prediction", F.col("roll_7_mean") + 1)
    metrics = evaluate.regression_metrics(positive).select("mae", "poisson_deviance")
    return rounded(metrics, "mae", "poisson_deviance")


@register("naive_baseline", "test", f"""
SELECT {fixed('b', 'baseline_mae')}, {fixed('m', 'mae')}, {fixed('(b - m) / b * 100', 'improvement_pct')}
FROM (SELECT avg(abs(count - lag_7)) AS b, avg(abs(count - roll_7_mean)) AS m FROM test) x""")
def _(t):
    result = evaluate.naive_baseline(t.naive_test, prediction="roll_7_mean")
    return rounded(result, "baseline_mae", "mae", "improvement_pct")


@register("hotspot_day_label", "test", f"SELECT h3_cell, {DATE}, label FROM test")
def _(t):
    train, test = t.split
    labelled = evaluate.hotspot_day_label(test, train)
    return dated(labelled.select("h3_cell", "date", "label"))


@register("roc_auc", "test", f"""
SELECT {fixed('(sum(CASE WHEN label = 1 THEN r ELSE 0 END) - p * (p + 1) / 2.0) / (p * n)', 'auc')}
FROM (SELECT label, rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS r,
 count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label = 0) OVER () AS n FROM test) x GROUP BY p, n""")
def _(t):
    return rounded(evaluate.roc_auc(t.naive_test), "auc")


@register("f1_threshold", "f1s", f"SELECT threshold_no, {fixed('threshold', 'threshold')}, {fixed('f1', 'f1')} FROM f1s")
def _(t):
    return rounded(evaluate.f1_by_threshold(t.naive_test), "threshold", "f1")


@register("best_threshold", "best_f1", f"SELECT {fixed('threshold', 'threshold')}, {fixed('f1', 'f1')} FROM best_f1")
def _(t):
    best = evaluate.best_threshold(evaluate.f1_by_threshold(t.naive_test))
    return rounded(best, "threshold", "f1")


@register("confusion", "test best_f1", f"""
, c AS (SELECT count(*) FILTER (label = 0 AND NOT f) AS tn, count(*) FILTER (label = 0 AND f) AS fp,
 count(*) FILTER (label = 1 AND NOT f) AS fn, count(*) FILTER (label = 1 AND f) AS tp
 FROM (SELECT label, prediction >= (SELECT threshold FROM best_f1) AS f FROM test) x)
SELECT tn, fp, fn, tp, {fixed('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)', 'precision')},
 {fixed('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)', 'recall')},
 {fixed('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)', 'f1')} FROM c""")
def _(t):
    best = evaluate.best_threshold(evaluate.f1_by_threshold(t.naive_test))
    threshold = best.select("threshold").scalar()
    return rounded(evaluate.confusion(t.naive_test, threshold), "precision", "recall", "f1")


def _trees_sql(depth: int) -> str:
    """CTEs of one Poisson tree on the training rows: bins, then for each level the sums of
    all nodes, the gains of all cuts and sets, and the best split of each node."""
    sets = [panel.FEATURES.index(c) for c in panel.CATEGORIES]
    cuts = ", ".join(
        f"list_sort(list_distinct(list_transform(range(1, 64), lambda i: v{i}[(i * n) // 64 + 1]) || [v{i}[n]]))[:-2] AS c{i}"
        for i in range(len(panel.FEATURES)) if i not in sets
    )
    lists = ", ".join(
        f"list_sort(list({c}::DOUBLE)) AS v{i}" for i, c in enumerate(panel.FEATURES) if i not in sets
    )
    def bins(source: str) -> str:
        return "[" + ", ".join(
            f"{c}::BIGINT" if i in sets else f"len(list_filter(c{i}, lambda x: x < {source}.{c}))::BIGINT"
            for i, c in enumerate(panel.FEATURES)
        ) + "]"

    def gain(y: str, q: str) -> str:
        step = f"ln(({y} + s) / (({q}) / 1000000.0::DOUBLE + s))"
        return f"(({y}) * {step} - ({q}) / 1000000.0::DOUBLE * (exp({step}) - 1))"

    parts = [f""", lists AS MATERIALIZED (SELECT count(*) AS n, ln((sum(count) + 0.5::DOUBLE) / count(*)) AS base, {lists} FROM train),
cuts AS MATERIALIZED (SELECT base, {cuts} FROM (SELECT * FROM lists) x),
node0 AS MATERIALIZED (SELECT count AS y, round(exp(base) * 1000000)::BIGINT AS p, {bins('train')} AS b, 0 AS node, 0.0::DOUBLE AS step FROM train, cuts)"""]
    for level in range(depth):
        parts.append(f"""h{level} AS MATERIALIZED (SELECT node, f, bin, sum(y)::BIGINT AS y, sum(p)::BIGINT AS p, count(*) AS n
 FROM (SELECT node, y, p, unnest(range({len(panel.FEATURES)})) AS f, unnest(b) AS bin FROM node{level}) u GROUP BY ALL),
a{level} AS MATERIALIZED (SELECT node, sum(y)::BIGINT AS ya, sum(p)::BIGINT AS pa, count(*) AS na FROM node{level} GROUP BY node),
e{level} AS (SELECT *, CASE WHEN f IN ({', '.join(map(str, sets))}) THEN e * y / (p / 1000000.0::DOUBLE + 10) ELSE bin END AS key
 FROM (SELECT *, unnest(CASE WHEN f IN ({', '.join(map(str, sets))}) THEN [1, -1] ELSE [1] END) AS e FROM h{level}) x),
r{level} AS MATERIALIZED (SELECT *, f IN ({', '.join(map(str, sets))}) AS is_set, CASE WHEN f IN ({', '.join(map(str, sets))}) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS s,
 row_number() OVER w AS place, sum(y) OVER w AS yl, sum(p) OVER w AS pl, sum(n) OVER w AS nl, list(bin) OVER w AS levels
 FROM e{level} WINDOW w AS (PARTITION BY node, f, e ORDER BY key, bin ROWS UNBOUNDED PRECEDING)),
s{level} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, place, e DESC) AS choice
 FROM (SELECT *, round({gain('yl', 'pl')} + {gain('(ya - yl)', '(pa - pl)')} - {gain('ya', 'pa')}, 6) AS gain
  FROM r{level} JOIN a{level} USING (node) WHERE nl >= 50 AND na - nl >= 50 AND (NOT is_set OR place <= 32)) g WHERE gain > 0) c WHERE choice = 1),
node{level + 1} AS MATERIALIZED (SELECT n.y, n.p, n.b, CASE WHEN s.node IS NULL THEN -1 ELSE 2 * n.node + CASE WHEN l THEN 1 ELSE 2 END END AS node,
 CASE WHEN s.node IS NULL THEN n.step WHEN l THEN ln((yl + s) / (pl / 1000000.0::DOUBLE + s)) ELSE ln((ya - yl + s) / ((pa - pl) / 1000000.0::DOUBLE + s)) END AS step
 FROM (SELECT n.*, s.node AS sn, CASE WHEN s.is_set THEN list_contains(s.levels, n.b[s.f + 1]) ELSE n.b[s.f + 1] <= s.bin END AS l
  FROM node{level} n LEFT JOIN s{level} s USING (node)) n LEFT JOIN s{level} s ON s.node = n.sn)""")
    # Hold-out rows go down the same splits.
    parts.append(f"""t0 AS MATERIALIZED (SELECT h3_cell, date, base, {bins('test')} AS b, 0 AS node, 0.0::DOUBLE AS step FROM test, cuts)""")
    for level in range(depth):
        parts.append(f"""t{level + 1} AS MATERIALIZED (SELECT h3_cell, date, base, t.b, CASE WHEN s.node IS NULL THEN -1 ELSE 2 * t.tn + CASE WHEN l THEN 1 ELSE 2 END END AS node,
 CASE WHEN s.node IS NULL THEN t.step WHEN l THEN ln((yl + s) / (pl / 1000000.0::DOUBLE + s)) ELSE ln((ya - yl + s) / ((pa - pl) / 1000000.0::DOUBLE + s)) END AS step
 FROM (SELECT t.*, t.node AS tn, s.node AS sn, CASE WHEN s.is_set THEN list_contains(s.levels, t.b[s.f + 1]) ELSE t.b[s.f + 1] <= s.bin END AS l
  FROM t{level} t LEFT JOIN s{level} s USING (node)) t LEFT JOIN s{level} s ON s.node = t.sn)""")
    return ",\n".join(parts)


TREE = {"trees": 1, "depth": 2, "learning_rate": 1.0, "feature_share": 1.0}


@register("fit_demand_trees", "train test", _trees_sql(2) + f"""
SELECT h3_cell, {DATE}, {fixed('exp(base + step)', 'prediction')} FROM t2""")
def _(t):
    rows = forecast.predict_counts(t.split[1], t.poisson_tree)
    return dated(rounded(rows.select("h3_cell", "date", "prediction"), "prediction"))


@register("feature_importance_trees", "train test", _trees_sql(2) + f"""
SELECT feature, {fixed('coalesce(g, 0) / sum(g) OVER ()', 'importance')} FROM (
 SELECT unnest({list(panel.FEATURES)}) AS feature, unnest(range({len(panel.FEATURES)})) AS f) n
LEFT JOIN (SELECT f, sum(gain) AS g FROM (SELECT f, gain FROM s0 UNION ALL SELECT f, gain FROM s1) u GROUP BY f) x USING (f)""")
def _(t):
    return rounded(forecast.feature_importance(t.poisson_tree, t.split[0]), "importance")


@register("grid_sweep_trees")
def _(t):
    train, test = (cut_lineage(part) for part in t.split)
    grid = [{"trees": 4, "depth": 2}, {"trees": 4, "depth": 3, "min_rows": 30}]
    tried = evaluate.grid_sweep(train, test, "trees", grid).tried
    return t.spark.createDataFrame([(p["depth"], mae) for p, mae in tried], "depth int, mae double")


@register("feature_importance")
def _(t):
    return forecast.feature_importance(t.model, t.split[0])


@register("save_load_model")
def _(t):
    fitted = forecast.DemandForecaster(min_cell_total=MIN_CELL_TOTAL).fit(t.cells8)
    path = fitted.save(_scratch(t, "forecaster"))
    return forecast.DemandForecaster.load(t.spark, path).predict_next_days(3)


def _reloaded(t: Tables) -> forecast.DemandForecaster:
    fitted = forecast.DemandForecaster(min_cell_total=MIN_CELL_TOTAL).fit(t.cells8)
    return forecast.DemandForecaster.load(t.spark, fitted.save(_scratch(t, "forecaster")))


@register("saved_cells", "celldim", f"""
SELECT h3_cell, cell_code, police_station, {fixed('centroid_lat', 'centroid_lat')}, {fixed('centroid_lon', 'centroid_lon')} FROM celldim""")
def _(t):
    return rounded(_reloaded(t).cells, "centroid_lat", "centroid_lon")


@register("saved_history", "filled", f"SELECT h3_cell, {DATE}, count FROM filled WHERE date > (SELECT max(date) FROM filled) - 21")
def _(t):
    return dated(_reloaded(t).history)


# --- serving ---------------------------------------------------------------------------------

AT = TimeWindow(day_of_week=5, hour=10)
ACTIVE = "SELECT DISTINCT hotspot_id FROM top_cell WHERE day_of_week = 5 AND 10 BETWEEN start_hour AND end_hour"


@register("active_hotspots", "top_cell", ACTIVE)
def _(t):
    return serving.active_hotspots(t.windows, AT)


@register("active_hotspots_hour", "top_cell", "SELECT DISTINCT hotspot_id FROM top_cell WHERE 8 BETWEEN start_hour AND end_hour")
def _(t):
    return serving.active_hotspots(t.windows, TimeWindow(hour=8))


@register("filter_by_ids", "zones_cell top_cell", f"SELECT hotspot_id, global_rank FROM zones_cell WHERE hotspot_id IN ({ACTIVE})")
def _(t):
    ids = serving.active_hotspots(t.windows, AT)
    return serving.filter_by_ids(t.zones, ids).select("hotspot_id", "global_rank")


@register("top_zones", "zones_cell", f"SELECT {ZONE_SQL} FROM zones_cell WHERE global_rank <= 20")
def _(t):
    return _zone_rows(serving.top_zones(t.zones, 20))


@register("station_drilldown", "zt_cell", f"""
SELECT station_rank, hotspot_id, risk_tier, {fixed('priority_score', 'priority_score')} FROM zt_cell WHERE police_station = 'Station 3'""")
def _(t):
    rows = serving.station_zones(t.zones_tiers, "Station 3")
    return rounded(
        rows.select("station_rank", "hotspot_id", "risk_tier", "priority_score"), "priority_score"
    )


@register("station_kpis", "zt_cell", f"""
SELECT police_station, count(*) AS n_zones, count(*) FILTER (risk_tier = 'HIGH') AS n_high, {fixed('max(priority_score)', 'top_score')} FROM zt_cell GROUP BY police_station""")
def _(t):
    return rounded(serving.station_kpis(t.zones_tiers), "top_score")


KPI_SQL = f"""count(*) AS n_zones, count(*) FILTER (risk_tier = 'HIGH') AS n_high, count(DISTINCT police_station) AS n_stations,
 {fixed('avg(priority_score)', 'avg_score')}, (SELECT count(*) FROM zt_cell) AS total_zones,
 {fixed("count(*) FILTER (risk_tier = 'HIGH') * 100.0 / count(*)", 'pct_high')}"""


@register("kpis", "zt_cell top_cell", f"SELECT {KPI_SQL} FROM zt_cell WHERE hotspot_id IN ({ACTIVE})")
def _(t):
    chosen = serving.filtered_zones(t.zones_tiers, t.windows, AT)
    return rounded(serving.kpis(chosen, t.zones_tiers), "avg_score", "pct_high")


@register("tier_counts", "zt_cell", """
SELECT r.risk_tier, count(z.hotspot_id) AS n_zones FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) r(risk_tier)
LEFT JOIN zt_cell z USING (risk_tier) GROUP BY r.risk_tier""")
def _(t):
    return serving.tier_counts(t.zones_tiers)


@register("high_risk_top", "zt_cell", f"""
SELECT hotspot_id, police_station, {fixed('priority_score', 'priority_score')} FROM zt_cell WHERE risk_tier = 'HIGH'
ORDER BY zt_cell.priority_score DESC, hotspot_id LIMIT 12""")
def _(t):
    return rounded(serving.high_risk_top(t.zones_tiers), "priority_score")


@register("anomaly_top_given", "zt_cell", f"""
SELECT hotspot_id, police_station, CAST(global_rank % 97 AS DOUBLE) AS anomaly_score, risk_tier, {fixed('priority_score', 'priority_score')}
FROM zt_cell ORDER BY global_rank % 97 DESC, hotspot_id LIMIT 12""")
def _(t):
    given = t.zones_tiers.withColumn("anomaly_score", (F.col("global_rank") % 97).cast("double"))
    return rounded(serving.anomaly_top(given), "priority_score")


@register("anomaly_top")
def _(t):
    scores = risk.anomaly_scores(risk.standardise(risk.risk_features(t.scored)))
    return serving.anomaly_top(t.zones_tiers.join(scores, "hotspot_id"))


@register("intensity_by_day", "top_cell", f"""
SELECT CAST(d AS INTEGER) AS day_of_week, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d + 1] AS day_label,
 {fixed('avg(expected_intensity)', 'avg_intensity')} FROM range(7) r(d) LEFT JOIN top_cell ON day_of_week = d GROUP BY d""")
def _(t):
    return rounded(serving.intensity_by_day(t.windows), "avg_intensity")


@register("top_windows", "top_cell", f"""
SELECT hotspot_id, {DAY_SQL}, format('{{:02d}}:00–{{:02d}}:00', start_hour, end_hour) AS "window",
 {fixed('expected_intensity', 'expected_intensity')} FROM top_cell
ORDER BY top_cell.expected_intensity DESC, hotspot_id, day_of_week, start_hour LIMIT 15""")
def _(t):
    return rounded(serving.top_windows(t.windows), "expected_intensity")


@register("map_style", "hs_cell", """
SELECT hotspot_id, CAST(trunc(s * 420 + 80) AS INTEGER) AS radius, CAST(trunc(s * 220 + 20) AS INTEGER) AS r,
 CAST(trunc((1 - s) * 80 + 20) AS INTEGER) AS g, CAST(trunc(150 - s * 120) AS INTEGER) AS b
FROM (SELECT hotspot_id, member_count::DOUBLE / max(member_count) OVER () AS s FROM hs_cell) x""")
def _(t):
    return serving.map_style(t.hotspots).select("hotspot_id", "radius", "r", "g", "b")


@register("forecast_style", "ranked_forecast", f"""
SELECT forecast_rank, CAST(round_even(total_predicted, 0) AS BIGINT) AS total_rounded,
 {fixed('total_predicted / greatest(max(total_predicted) OVER (), 1) * 400 + 80', 'radius')} FROM ranked_forecast""")
def _(t):
    styled = serving.forecast_style(forecast.forecast_hotspots(t.naive_forecast))
    return rounded(styled.select("forecast_rank", "total_rounded", "radius"), "radius")


@register("is_fallback", "hs_cell", "SELECT bool_and(hotspot_id LIKE 'h3-%') AS is_fallback FROM hs_cell")
def _(t):
    return serving.is_fallback(t.hotspots)


@register("filtered_zones", "zt_cell top_cell", f"""
SELECT hotspot_id, global_rank, risk_tier FROM zt_cell WHERE risk_tier = 'MEDIUM' AND police_station = 'Station 1'
AND hotspot_id IN (SELECT hotspot_id FROM top_cell WHERE 10 BETWEEN start_hour AND end_hour)""")
def _(t):
    rows = serving.filtered_zones(
        t.zones_tiers, t.windows, TimeWindow(hour=10), risk_tier="MEDIUM", station="Station 1"
    )
    return rows.select("hotspot_id", "global_rank", "risk_tier")


@register("station_list", "hs_cell", "SELECT DISTINCT police_station FROM hs_cell WHERE police_station IS NOT NULL")
def _(t):
    return serving.station_list(t.hotspots)


@register("sample_violations", "clean", """
SELECT police_station, sample_no, created_local, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY police_station
 ORDER BY created_at DESC, id)::INTEGER AS sample_no FROM clean) r WHERE sample_no <= 10""")
def _(t):
    return serving.sample_violations(t.clean).select(
        "police_station", "sample_no", "created_local", "latitude", "longitude"
    )


# --- reports ----------------------------------------------------------------------------------


def _hist_sql(table: str, column: str, bins: int) -> str:
    return f"""
SELECT CAST(b AS INTEGER) AS bin, count(v) AS n, {fixed('lo + w * b', 'bin_start')} FROM range({bins}) r(b)
CROSS JOIN (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column})) / {float(bins)}::DOUBLE AS w FROM {table}) s
LEFT JOIN (SELECT {column} AS v FROM {table}) t ON least(floor((v - lo) / w), {bins - 1}) = b GROUP BY b, lo, w"""


def _hist(df: DataFrame, column: str, bins: int) -> DataFrame:
    rows = reports.histogram(df, column, bins).select("bin", "n", "bin_start")
    return rounded(rows, "bin_start")


@register("impact_hist", "scored_cell", _hist_sql("scored_cell", "impact_score", 40))
def _(t):
    return _hist(t.scored, "impact_score", 40)


@register("priority_hist", "zones_cell", _hist_sql("zones_cell", "priority_score", 40))
def _(t):
    return _hist(t.zones, "priority_score", 40)


@register("size_hist", "hs_cell", _hist_sql("hs_cell", "member_count", 50))
def _(t):
    return _hist(t.hotspots, "member_count", 50)


@register("zones_per_station", "zones_cell", """
SELECT coalesce(nullif(police_station, ''), '(unknown)') AS station, count(*) AS n_zones FROM zones_cell GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return reports.zones_per_station(t.zones)


@register("top20_labels", "zones_cell", f"""
SELECT global_rank, '#' || global_rank || ' ' || substr(coalesce(nullif(police_station, ''), '?'), 1, 18) AS label,
 {fixed('priority_score', 'priority_score')} FROM zones_cell WHERE global_rank <= 20""")
def _(t):
    return rounded(reports.top_labels(t.zones), "priority_score")


@register("impact_geo", "scored_cell", f"""
SELECT hotspot_id, {fixed('centroid_lon', 'longitude')}, {fixed('centroid_lat', 'latitude')}, {fixed('impact_score', 'impact_score')} FROM scored_cell""")
def _(t):
    return rounded(reports.impact_geo(t.scored), "longitude", "latitude", "impact_score")


@register("run_summary", "scored_cell zones_cell", f"""
SELECT (SELECT count(*) FROM scored_cell) AS hotspots, (SELECT {fixed('avg(impact_score)')} FROM scored_cell) AS impact_mean,
 (SELECT {fixed('max(impact_score)')} FROM scored_cell) AS impact_max, (SELECT max(member_count) FROM scored_cell) AS largest_hotspot,
 count(*) AS zones, {fixed('avg(priority_score)', 'priority_mean')}, {fixed('max(priority_score)', 'priority_max')},
 count(DISTINCT coalesce(nullif(police_station, ''), '(unknown)')) AS stations FROM zones_cell""")
def _(t):
    names = ("impact_mean", "impact_max", "priority_mean", "priority_max")
    return rounded(reports.run_summary(t.scored, t.zones), *names)


@register("run_summary_report", "tagged ranked zones_cell", """
SELECT (SELECT count(*) FROM tagged) AS rows_read, (SELECT count(*) FROM ranked WHERE rn = 1) AS rows_retained,
 (SELECT count(*) FROM tagged) - (SELECT count(*) FROM ranked WHERE rn = 1) AS rows_dropped,
 count(*) AS zones, 'cells' AS method FROM zones_cell""")
def _(t):
    summary = reports.run_summary(t.scored, t.zones, clean.ingestion_report(t.raw), False)
    return summary.select("rows_read", "rows_retained", "rows_dropped", "zones", "method")


@register("top5_with_peak", "zones_cell top_cell", f"""
SELECT global_rank, coalesce(nullif(police_station, ''), '?') AS station, {fixed('priority_score', 'priority_score')},
 coalesce(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][day_of_week + 1] || format(' {{:02d}}-{{:02d}}h', start_hour, end_hour), 'n/a') AS peak
FROM zones_cell z LEFT JOIN (SELECT * FROM top_cell WHERE peak_rank = 1) t USING (hotspot_id) WHERE global_rank <= 5""")
def _(t):
    return rounded(reports.top_zones_with_peak(t.zones, t.windows), "priority_score")
