"""Cleaning: typed columns, reject reasons, first-wins de-duplication, drop report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geohotspots.config import LOCAL_TZ, REQUIRED_COLUMNS, BoundingBox
from geohotspots.functions.text import (
    collapse_ws,
    is_null_like,
    normalise_tokens,
    null_if_token,
    offence_codes,
    trim_ws,
    violation_tokens,
)
from geohotspots.functions.timestamps import (
    TIMESTAMP_FORMATS,
    instant_of_wall_clock,
    parse_trimmed_instant,
    wall_clock,
)

MALFORMED = "malformed_row"
UNPARSEABLE = "unparseable_created_at"
INVALID_GEO = "invalid_geo"
DUPLICATE = "duplicate_id"

#: Column in which a reader marks rows that do not fit their header.
MALFORMED_FLAG = "_malformed"

_RENAMES = {"created_datetime": "created_at", "closed_datetime": "closed_at"}


def require_columns(df: DataFrame, columns: tuple[str, ...] = REQUIRED_COLUMNS) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def vehicle_type(c: Column) -> Column:
    return F.when(is_null_like(c), F.lit("")).otherwise(F.lower(trim_ws(c)))


def station_name(c: Column) -> Column:
    return F.when(is_null_like(c), F.lit("")).otherwise(collapse_ws(c))


def number(c: Column) -> Column:
    return trim_ws(c.cast("string")).try_cast("double")


def inside(lat: Column, lon: Column, bbox: BoundingBox) -> Column:
    """True inside the closed box; false (never null) for null and NaN coordinates."""
    return F.coalesce(
        lat.between(bbox.lat_min, bbox.lat_max) & lon.between(bbox.lon_min, bbox.lon_max),
        F.lit(False),
    )


def parse_timestamps(
    df: DataFrame, tz: str = LOCAL_TZ, formats: Sequence[str] = TIMESTAMP_FORMATS
) -> DataFrame:
    """Type the ``*_datetime`` columns, rename them, add ``created_local``.

    ``formats`` are tried in order on texts in no ISO form. Columns that are timestamps already are taken as they are; those without zone are
    wall-clock time in ``tz``.
    """
    present = [c for c in _RENAMES if c in df.columns]
    kinds = {c: df.schema[c].dataType for c in present}
    texts = [c for c in present if isinstance(kinds[c], T.StringType)]
    walls = [c for c in present if isinstance(kinds[c], T.TimestampNTZType)]
    # Trimmed in a step of its own: the parser refers to the text several times.
    df = df.withColumns({c: null_if_token(F.col(c)) for c in texts})
    df = df.withColumns(
        {c: parse_trimmed_instant(F.col(c), tz, formats) for c in texts}
        | {c: instant_of_wall_clock(F.col(c), tz) for c in walls}
    )
    df = df.withColumnsRenamed({c: _RENAMES[c] for c in present})
    if "created_at" in df.columns:
        df = df.withColumn("created_local", wall_clock(F.col("created_at"), tz))
    return df


def parse_arrays(df: DataFrame) -> DataFrame:
    """JSON-array cells to arrays; columns that are arrays already are only normalised."""
    columns = {}
    if "violation_type" in df.columns:
        is_array = isinstance(df.schema["violation_type"].dataType, T.ArrayType)
        parse = normalise_tokens if is_array else violation_tokens
        columns["violation_type"] = parse(F.col("violation_type"))
    if "offence_code" in df.columns and isinstance(
        df.schema["offence_code"].dataType, T.StringType
    ):
        columns["offence_code"] = offence_codes(F.col("offence_code"))
    return df.withColumns(columns)


def normalise_categoricals(df: DataFrame) -> DataFrame:
    rules = {"vehicle_type": vehicle_type, "police_station": station_name}
    return df.withColumns({c: f(F.col(c)) for c, f in rules.items() if c in df.columns})


def validate_geo(df: DataFrame, bbox: BoundingBox = BoundingBox()) -> DataFrame:
    """Numeric coordinates inside the box; all other rows are dropped."""
    typed = df.withColumns({c: number(F.col(c)) for c in ("latitude", "longitude")})
    return typed.filter(inside(F.col("latitude"), F.col("longitude"), bbox))


def require_created_at(df: DataFrame) -> DataFrame:
    return df.filter(F.col("created_at").isNotNull())


def tag_rejects(
    raw: DataFrame,
    *,
    tz: str = LOCAL_TZ,
    bbox: BoundingBox = BoundingBox(),
    formats: Sequence[str] = TIMESTAMP_FORMATS,
) -> DataFrame:
    """Add ``reject_reason``: the first failing check of a row, or null."""
    require_columns(raw)
    df = parse_timestamps(raw, tz, formats)
    broken = F.col(MALFORMED_FLAG) if MALFORMED_FLAG in df.columns else F.lit(False)
    df = df.withColumns({c: number(F.col(c)) for c in ("latitude", "longitude")})
    return df.withColumn(
        "reject_reason",
        F.when(broken, MALFORMED)
        .when(F.col("created_at").isNull(), UNPARSEABLE)
        .when(~inside(F.col("latitude"), F.col("longitude"), bbox), INVALID_GEO),
    ).drop(MALFORMED_FLAG)


def dedupe_first(
    df: DataFrame, *, key: str = "id", order_by: str | list[str] = "read_order"
) -> DataFrame:
    """One row per key, the first in ``order_by``; null keys count as equal.

    The rank filter is applied on the map side as well, so a key that holds a large
    share of the rows sends at most one row per map task through the shuffle.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    window = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(window))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def clean_events(
    raw: DataFrame,
    *,
    order_by: str | list[str] = "read_order",
    tz: str = LOCAL_TZ,
    bbox: BoundingBox = BoundingBox(),
    formats: Sequence[str] = TIMESTAMP_FORMATS,
) -> DataFrame:
    """Raw text rows to typed, valid, de-duplicated events."""
    return accept(tag_rejects(raw, tz=tz, bbox=bbox, formats=formats), order_by=order_by)


def accept(tagged: DataFrame, *, order_by: str | list[str] = "read_order") -> DataFrame:
    """Tagged rows (see :func:`tag_rejects`) to valid, de-duplicated events."""
    valid = tagged.filter(F.col("reject_reason").isNull())
    unique = dedupe_first(valid.drop("reject_reason"), order_by=order_by)
    return normalise_categoricals(parse_arrays(unique))


def ingestion_report(
    raw: DataFrame,
    *,
    cleaned: DataFrame | None = None,
    tz: str = LOCAL_TZ,
    bbox: BoundingBox = BoundingBox(),
    formats: Sequence[str] = TIMESTAMP_FORMATS,
) -> DataFrame:
    """Rows ``(metric, n)``: rows read, rows retained, total dropped, drops by reason.

    ``invalid_geo`` is always present, the other reasons only when they occur. Duplicates
    are the valid rows beyond the retained ones. With the ``cleaned`` events at hand,
    their number says how many were retained and nothing is shuffled by id; otherwise
    valid rows are counted per id. Rows that have been tagged already, with a
    ``reject_reason``, are not parsed again.
    """
    tagged = raw
    if "reject_reason" not in raw.columns:
        tagged = tag_rejects(raw, tz=tz, bbox=bbox, formats=formats)
    valid = F.col("reject_reason").isNull()
    keys = ["reject_reason"]
    if cleaned is None:
        tagged = tagged.withColumn("key", F.when(valid, F.col("id")))
        keys.append("key")
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    retained = total(valid, F.lit(1))
    if cleaned is not None:
        retained = cleaned.agg(F.count(F.lit(1))).scalar()
    totals = counts.agg(
        total(F.lit(True), F.col("n")).alias("total_rows_read"),
        total(valid, F.col("n")).alias("valid"),
        total(F.col("reject_reason") == MALFORMED, F.col("n")).alias(MALFORMED),
        total(F.col("reject_reason") == UNPARSEABLE, F.col("n")).alias(UNPARSEABLE),
        total(F.col("reject_reason") == INVALID_GEO, F.col("n")).alias(INVALID_GEO),
        retained.alias("rows_retained"),
    ).withColumns(
        {
            DUPLICATE: F.col("valid") - F.col("rows_retained"),
            "total_dropped": F.col("total_rows_read") - F.col("rows_retained"),
        }
    )
    metrics = (
        "total_rows_read", "rows_retained", "total_dropped",
        MALFORMED, UNPARSEABLE, INVALID_GEO, DUPLICATE,
    )
    rows = F.inline(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in metrics])
    )
    optional = F.col("metric").isin(MALFORMED, UNPARSEABLE, DUPLICATE)
    return totals.select(rows).filter(~optional | (F.col("n") > 0))
