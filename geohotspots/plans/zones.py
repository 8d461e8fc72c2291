"""Batch run: raw events to ranked zones and published artifacts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from geohotspots.config import LOCAL_TZ, SEED, BoundingBox, ImpactWeights, PriorityConfig
from geohotspots.operators import clean, peaks
from geohotspots.operators.activity import hotspot_activity
from geohotspots.operators.impact import score_impact
from geohotspots.operators.priority import rank_zones
from geohotspots.operators.risk import attach_risk, compute_risk
from geohotspots.operators.spatial import assign_hotspots, summarise
from geohotspots.session import cut_lineage, store
from geohotspots.sources import writers
from geohotspots.sources.published import publish
from geohotspots.sources.readers import scan_csv


# What a run reads of an event, besides a cell id of the caller's and the order column;
# everything else is dropped before rows are stored.
EVENT_COLUMNS = (
    "id", "read_order", "latitude", "longitude", "police_station", "junction_name",
    "violation_type", "created_at", "created_local",
)


@dataclass(frozen=True)
class ZoneTables:
    """Tables of a run, all but ``assigned`` of hotspot size. Zones that come from stored
    activity have no assigned events."""

    assigned: DataFrame | None
    activity: DataFrame
    scored: DataFrame
    profiles: DataFrame
    windows: DataFrame
    zones: DataFrame
    used_dbscan: bool


@dataclass(frozen=True)
class RunResult:
    tables: ZoneTables
    report: DataFrame
    paths: dict[str, str]


def zone_tables(
    events: DataFrame,
    *,
    resolution: int = 9,
    eps_m: float = 75.0,
    min_samples: int = 15,
    order_by: str = "read_order",
    bbox: BoundingBox = BoundingBox(),
    weights: ImpactWeights = ImpactWeights(),
    config: PriorityConfig = PriorityConfig(),
    top_k_peaks: int = 3,
    signal: DataFrame | None = None,
    with_risk: bool = True,
    seed: int = SEED,
) -> ZoneTables:
    """Clean events to zones.

    The events are read twice: once for their coordinates (clustering) and once for the
    activity table. Everything after that works on tables of hotspot size, stored so
    that later stages do not go back to the events.
    """
    weights.validate()
    config.validate()
    assigned = assign_hotspots(
        events,
        resolution=resolution,
        eps_m=eps_m,
        min_samples=min_samples,
        order_by=order_by,
        bbox=bbox,
    )
    tables = derive_tables(
        cut_lineage(hotspot_activity(assigned.events)),
        bbox=bbox,
        weights=weights,
        config=config,
        top_k_peaks=top_k_peaks,
        signal=signal,
        with_risk=with_risk,
        seed=seed,
    )
    return replace(tables, assigned=assigned.events, used_dbscan=assigned.used_dbscan)


def derive_tables(
    activity: DataFrame,
    *,
    bbox: BoundingBox = BoundingBox(),
    weights: ImpactWeights = ImpactWeights(),
    config: PriorityConfig = PriorityConfig(),
    top_k_peaks: int = 3,
    signal: DataFrame | None = None,
    with_risk: bool = True,
    seed: int = SEED,
) -> ZoneTables:
    """Everything a run derives from a stored activity table; no event is read."""
    weights.validate()
    config.validate()
    scored = cut_lineage(
        score_impact(summarise(activity, bbox), activity, weights, signal=signal)
    )
    profiles = cut_lineage(peaks.peak_profiles(activity, scored))
    windows = cut_lineage(peaks.top_peaks(profiles, top_k=top_k_peaks))
    zones = rank_zones(scored, activity, config)
    if with_risk:
        risk = cut_lineage(compute_risk(scored, seed=seed))
        scored, zones = attach_risk(scored, risk), attach_risk(zones, risk)
    zones = cut_lineage(peaks.attach_peaks(zones, windows))
    return ZoneTables(None, activity, scored, profiles, windows, zones, False)


def export_all(
    tables: ZoneTables, report: DataFrame, out_dir: str, *, single_file: bool = False
) -> dict[str, str]:
    """Publish every artifact below ``out_dir`` as one set (:mod:`sources.published`): readers
    see all of it or what was there before.

    All parts are written in parallel, hotspots as line-delimited GeoJSON. ``single_file``
    writes one file per artifact and adds the GeoJSON document.
    """
    artifacts = {
        "csv": lambda to: writers.write_priority_csv(
            tables.zones, f"{to}/priority_zones.csv", single_file=single_file
        ),
        "features": lambda to: writers.write_geojson(tables.scored, f"{to}/hotspots.geojsonl"),
        "peak_windows": lambda to: writers.write_peak_windows(
            tables.windows, f"{to}/peak_windows.json", single_file=single_file
        ),
        "report": lambda to: writers.write_ingestion_report(report, f"{to}/ingestion_report.json"),
    }
    if single_file:
        artifacts["geojson"] = lambda to: writers.write_geojson_document(tables.scored, f"{to}/hotspots.geojson")
    return publish(report.sparkSession, out_dir, artifacts)


def run(
    spark: SparkSession,
    csv_path: str,
    out_dir: str,
    *,
    multi_line: bool = False,
    single_file: bool = False,
    tz: str = LOCAL_TZ,
    bbox: BoundingBox = BoundingBox(),
    **parameters,
) -> RunResult:
    """CSV to artifacts. ``parameters`` go to :func:`zone_tables`."""
    raw = scan_csv(spark, csv_path, multi_line=multi_line)
    # The raw file is parsed once: tagged rows are stored with the columns a run reads.
    order = parameters.get("order_by", "read_order")
    tagged = clean.tag_rejects(raw, tz=tz, bbox=bbox)
    wanted = {*EVENT_COLUMNS, "h3_cell", order, "reject_reason"}
    tagged = store(tagged.select(*[c for c in tagged.columns if c in wanted]))
    events = store(clean.accept(tagged, order_by=order).drop("reject_reason"))
    report = cut_lineage(clean.ingestion_report(tagged, cleaned=events))
    tables = zone_tables(events, bbox=bbox, **parameters)
    paths = export_all(tables, report, out_dir, single_file=single_file)
    return RunResult(tables, report, paths)
