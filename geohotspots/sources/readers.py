"""Readers: raw event files and the published artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from geohotspots.config import DAY_LABELS
from geohotspots.functions.text import null_if_csv_na
from geohotspots.operators.clean import MALFORMED_FLAG, require_columns

ZONE_DDL = (
    "hotspot_id string, centroid_lat double, centroid_lon double, police_station string, "
    "impact double, frequency double, persistence double, recency double, "
    "priority_score double, global_rank int, station_rank int"
)
RISK_DDL = "risk_tier string, anomaly_score double"
FEATURE_DDL = (
    "type string, geometry struct<type: string, coordinates: array<double>>, "
    "properties struct<hotspot_id: string, member_count: bigint, police_station: string, "
    "Congestion_Impact_Score: double, severity_component: double, "
    "proximity_component: double, concentration_component: double, h3_cell: string, "
    "cluster_label: int, risk_tier: string, anomaly_score: double>"
)
WINDOW_DDL = (
    "array<struct<day_of_week: int, start_hour: int, end_hour: int, "
    "expected_intensity: double>>"
)


_BROKEN = "_broken_record"


def _malformed(record: Column, fields: int) -> Column:
    """Whether a record that does not fit the header has too many fields or an open quote.

    The reader hands over the text of records with too many or too few fields.
    """
    bare = F.regexp_replace(record, r'"([^"]|"")*"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return F.coalesce((commas >= fields) | F.contains(bare, F.lit('"')), F.lit(False))


def scan_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Event CSV with header, every column as text, plus a sortable ``read_order``.

    ``multi_line`` is only for files whose cells contain line breaks: it makes a file
    unsplittable. Without it what follows the line break is marked as malformed, as are rows
    with more fields than the header; missing fields at the end of a row are null. A file
    whose header differs from the first one's makes the read fail, as its columns would be
    swapped.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    try:
        header = spark.read.options(**options).csv(path)
    except AnalysisException as error:
        raise ValueError(f"cannot read CSV at {path!r}: {error}") from error
    require_columns(header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header.columns, _BROKEN]])
    rows = (
        spark.read.schema(schema)
        .options(**options, enforceSchema=False, columnNameOfCorruptRecord=_BROKEN, columnPruning=False)
        .csv(path)
    )
    return rows.select(
        *[null_if_csv_na(F.col(f"`{c}`")).alias(c) for c in header.columns],
        _malformed(F.col(_BROKEN), len(header.columns)).alias(MALFORMED_FLAG),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("read_order"),
    )


def read_zones(spark: SparkSession, path: str, *, with_risk: bool = True) -> DataFrame:
    """Priority-zone CSV with its fixed schema."""
    ddl = f"{ZONE_DDL}, {RISK_DDL}" if with_risk else ZONE_DDL
    return spark.read.schema(ddl).csv(path, header=True)


def _flatten(features: DataFrame) -> DataFrame:
    return features.select(
        "properties.*",
        F.col("geometry.coordinates")[0].alias("longitude"),
        F.col("geometry.coordinates")[1].alias("latitude"),
    )


def flatten_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a FeatureCollection document: properties, longitude, latitude."""
    schema = f"features array<struct<{FEATURE_DDL}>>"
    document = spark.read.schema(schema).json(path, multiLine=True)
    return _flatten(document.select(F.inline("features")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of newline-delimited GeoJSON features, the splittable form."""
    return _flatten(spark.read.schema(FEATURE_DDL).json(path))


def _window_rows(windows: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(d) for d in DAY_LABELS])
    return windows.select(
        "hotspot_id",
        "day_of_week",
        F.get(labels, F.col("day_of_week")).alias("day_label"),
        "start_hour",
        "end_hour",
        "expected_intensity",
    )


def flatten_peak_windows(
    spark: SparkSession, path: str, *, multi_line: bool = False
) -> DataFrame:
    """Rows of ``{hotspot_id: [window, ...]}`` objects.

    One object per line, or, with ``multi_line``, one object per file.
    """
    text = spark.read.text(path, wholetext=multi_line).filter(F.col("value") != "")
    parsed = text.select(
        F.explode(F.from_json("value", f"map<string, {WINDOW_DDL}>")).alias(
            "hotspot_id", "windows"
        )
    )
    return _window_rows(parsed.select("hotspot_id", F.inline("windows")))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``metric, n`` of an ingestion report: the totals and the drops by reason."""
    totals = ("total_rows_read", "rows_retained", "total_dropped")
    schema = ", ".join(f"{c} long" for c in totals) + ", dropped_by_reason map<string,long>"
    document = spark.read.schema(schema).json(path)
    sums = F.map_from_arrays(F.array(*map(F.lit, totals)), F.array(*totals))
    reasons = F.coalesce("dropped_by_reason", F.create_map().cast("map<string,bigint>"))
    return document.select(F.explode(F.map_concat(sums, reasons)).alias("metric", "n"))
