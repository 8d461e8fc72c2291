"""Density clustering on great-circle distance, without all-pairs work.

The plane is cut into square sub-cells whose diagonal is at most ``eps``: points of one
sub-cell are all neighbours. That gives three reductions.

* Equal coordinates become one weighted point before any shuffle.
* A sub-cell with at least ``min_samples`` events ("dense") holds core points only. Just
  the points of the other sub-cells are counted, and those hold fewer than
  ``min_samples`` events each, so the probes against any sub-cell are bounded. The
  probed points of a crowded sub-cell are split over salts.
* Core points of one sub-cell form one graph node, so the graph is bounded by the area
  over eps squared, whatever the number of events. Whether two nodes touch is decided
  from their extreme points, and where that is not enough by splitting both into
  quarters of quarters, until the pairs left are few enough to compare exactly.

Labels are defined by the data alone: clusters are numbered by their earliest core event
in read order, and a border point joins the smallest label next to it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.config import NOISE_LABEL, BoundingBox, require_int
from geohotspots.functions.geo import (
    SubcellGrid,
    chord_limit,
    haversine_limit,
    unit_vector,
)
from geohotspots.operators.components import connected_components
from geohotspots.operators.ordering import global_position
from geohotspots.session import cut_lineage, store

EPS_MAX_M = 5_000.0
# Points of one sub-cell that share a salt; sub-cells with more points than the second
# figure are salted at all.
SALT_POINTS = 4_096
CROWDED_POINTS = 256
# Pairs of points compared exactly for one pair of (quartered) sub-cells.
EXACT_PAIRS = 4_096

_POINT = ("lat", "lon")
_VECTOR = ("ux", "uy", "uz")
_SPARSE = "active and not dense"


def check_parameters(eps_m: float, min_samples: int) -> None:
    if isinstance(eps_m, bool) or not isinstance(eps_m, (int, float)):
        raise ValueError(f"eps_m must be a number, got {eps_m!r}")
    if not 0 < eps_m <= EPS_MAX_M:
        raise ValueError(f"eps_m must be > 0 and <= {EPS_MAX_M}, got {eps_m!r}")
    require_int("min_samples", min_samples, 1)


def grid_for(events: DataFrame, eps_m: float, bbox: BoundingBox | None) -> SubcellGrid | None:
    """Grid over ``bbox``, or over the extent of the data; None for no data."""
    if bbox is None:
        low = events.agg(
            F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")
        ).first()
        if low[0] is None:
            return None
        bbox = BoundingBox(*low)
    return SubcellGrid.covering(
        float(eps_m), bbox.lat_min, bbox.lat_max, bbox.lon_min, bbox.lon_max
    )


def weighted_points(events: DataFrame, grid: SubcellGrid, order_by: str) -> DataFrame:
    """One row per distinct coordinate: weight, earliest event, sub-cell."""
    return (
        events.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
        .agg(F.count(F.lit(1)).alias("weight"), F.min(order_by).alias("first_order"))
        .withColumns({"cx": grid.column(F.col("lon")), "cy": grid.row(F.col("lat"))})
    )


def _offset_rows(offsets: Iterable[tuple[int, int]]) -> Column:
    """Generator of the sub-cells ``(tx, ty)`` around ``(cx, cy)``."""
    rows = ", ".join(f"struct(cx + {dx} AS tx, cy + {dy} AS ty)" for dx, dy in offsets)
    return F.expr(f"inline(array({rows}))")


def _tile_bits(reach: int) -> int:
    """Tiles have ``2 ** bits`` sub-cells a side: 16, or twice the reach if that is more."""
    return max(4, (2 * reach - 1).bit_length())


def _in_tile(df: DataFrame, grid: SubcellGrid) -> DataFrame:
    """Add the tile ``(qx, qy)`` that the sub-cell ``(cx, cy)`` lies in."""
    return df.withColumns(
        {
            "qx": F.shiftright("cx", _tile_bits(grid.reach_x)),
            "qy": F.shiftright("cy", _tile_bits(grid.reach_y)),
        }
    )


def _in_reach(df: DataFrame, grid: SubcellGrid) -> DataFrame:
    """One row for every tile ``(qx, qy)`` that the sub-cell ``(tx, ty)`` can be reached from."""

    def tiles(name: str, reach: int) -> Column:
        first, last = (F.shiftright(F.col(name) + r, _tile_bits(reach)) for r in (-reach, reach))
        return F.explode(F.sequence(first, last))

    return df.select("*", tiles("tx", grid.reach_x).alias("qx")).select(
        "*", tiles("ty", grid.reach_y).alias("qy")
    )


def _beside(own: DataFrame, near: DataFrame, grid: SubcellGrid) -> DataFrame:
    """Rows of :func:`_in_tile` with those of :func:`_in_reach` whose sub-cell is in reach.

    Both sides are shuffled by tile, not once for each sub-cell in reach.
    """
    close = F.expr(f"abs(tx - cx) <= {grid.reach_x} and abs(ty - cy) <= {grid.reach_y}")
    return own.join(near, ["qx", "qy"]).filter(close)


def subcells(points: DataFrame, grid: SubcellGrid, min_samples: int) -> DataFrame:
    """Per sub-cell: events, distinct points, ``dense``, ``active`` and ``reached``.

    A sub-cell is active when it and the sub-cells in reach hold ``min_samples`` events
    together; points of other sub-cells are noise without looking further. It is reached when
    points of a sparse active sub-cell have to be compared with its own.
    """
    cells = points.filter("cx is not null and cy is not null").groupBy("cx", "cy").agg(
        F.sum("weight").alias("events"), F.count(F.lit(1)).alias("points")
    )
    in_offsets = F.expr("(tx - cx) * 256 + ty - cy").isin([dx * 256 + dy for dx, dy in grid.offsets])

    def neighbours(table: DataFrame, value: Column) -> DataFrame:
        own = _in_tile(table, grid)
        other = table.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), value.alias("value"))
        pairs = _beside(own, _in_reach(other, grid), grid).filter(in_offsets)
        return pairs.groupBy("qx", "qy", *table.columns)

    flagged = (
        neighbours(cells, F.col("events"))
        .agg(F.sum("value").alias("around"))
        .select(
            "cx",
            "cy",
            "events",
            "points",
            (F.col("events") >= min_samples).alias("dense"),
            (F.col("around") >= min_samples).alias("active"),
        )
    )
    return (
        neighbours(flagged, F.expr(_SPARSE))
        .agg(F.max("value").alias("reached"))
        .drop("qx", "qy")
    )


def _chord(a: str, b: str) -> str:
    """Squared chord between the unit vectors in columns ``{a}ux..`` and ``{b}ux..``."""
    return " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in _VECTOR)


def _within(grid: SubcellGrid) -> Column:
    return F.expr(f"{_chord('', 't_')} <= {chord_limit(grid.eps_m)!r}D")


def _salts(points_in_cell: Column) -> Column:
    return F.ceil(points_in_cell / F.lit(SALT_POINTS)).cast("int")


def _probe(
    probes: DataFrame, targets: DataFrame, cells: DataFrame, value: str, best: Column, grid: SubcellGrid
) -> DataFrame:
    """``probes`` that have a target point within eps, with ``found``, the aggregate ``best`` of
    the targets' ``value``.

    ``probes`` come from sparse sub-cells, so at most ``min_samples - 1`` per sub-cell, and
    ``cells`` has all sub-cells. Points are shuffled by tiles of sub-cells: probes once, targets
    to the tiles that can reach them, so that a tile holds a bounded number of points. Targets in
    crowded sub-cells are dealt over salts instead.
    """
    kept = [c for c in probes.columns if c not in ("cx", "cy", *_POINT)]
    vector = unit_vector(F.col("lat"), F.col("lon"))
    target_vector = [v.alias(f"t_{c}") for c, v in zip(_VECTOR, vector)]
    probe = F.struct(*_POINT, *[v.alias(c) for c, v in zip(_VECTOR, vector)], *kept)
    place = [F.col("cx").alias("tx"), F.col("cy").alias("ty")]

    def found(pairs: DataFrame, *by: str) -> DataFrame:
        same = [F.max(c).alias(c) for c in kept]
        return pairs.filter(_within(grid)).groupBy(*by, "cx", "cy", *_POINT).agg(best.alias("found"), *same)

    own = (
        _in_tile(probes, grid)
        .repartition("qx", "qy")
        .groupBy("qx", "qy", "cx", "cy")
        .agg(F.collect_list(probe).alias("probes"))
    )
    # Few targets in a sub-cell travel as one row.
    near = (
        _in_reach(targets.filter(F.col("points") <= CROWDED_POINTS).select(*place, *_POINT, value), grid)
        .repartition("qx", "qy")
        .groupBy("qx", "qy", "tx", "ty")
        .agg(F.collect_list(F.struct(*target_vector, value)).alias("targets"))
    )
    pairs = _beside(own, near, grid).select("qx", "qy", "cx", "cy", "targets", F.inline("probes"))
    pairs = pairs.select(*[c for c in pairs.columns if c != "targets"], F.inline("targets"))
    # A probe is in one tile, so its targets are summed up where they are compared.
    counts = found(pairs, "qx", "qy").drop("qx", "qy")
    crowded = cells.filter(F.col("points") > CROWDED_POINTS)
    if crowded.isEmpty():
        return counts
    links = (
        cells.filter(_SPARSE)
        .select("cx", "cy", _offset_rows(grid.offsets))
        .join(crowded.select(*place, "points"), ["tx", "ty"])
    )
    salted = targets.filter(F.col("points") > CROWDED_POINTS).select(
        *place,
        F.pmod(F.xxhash64("lat", "lon"), _salts(F.col("points"))).cast("int").alias("salt"),
        *target_vector,
        value,
    )
    spread = probes.join(links, ["cx", "cy"]).select(
        *[c for c in probes.columns],
        *[v.alias(c) for c, v in zip(_VECTOR, vector)],
        "tx",
        "ty",
        F.explode(F.sequence(F.lit(0), _salts(F.col("points")) - 1)).alias("salt"),
    )
    both = counts.unionByName(found(spread.join(salted, ["tx", "ty", "salt"])))
    return both.withColumnRenamed("found", value).groupBy("cx", "cy", *_POINT).agg(
        best.alias("found"), *[F.max(c).alias(c) for c in kept]
    )


def sized_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points with the size and flags of their sub-cell, so that later steps only filter."""
    return points.join(cells.select("cx", "cy", "points", "dense", "active", "reached"), ["cx", "cy"])


def density(
    events: DataFrame, grid: SubcellGrid, min_samples: int, order_by: str
) -> tuple[DataFrame, DataFrame]:
    """Stored :func:`sized_points` and :func:`subcells` of the events."""
    points = store(weighted_points(events, grid, order_by))
    cells = store(subcells(points, grid, min_samples))
    return store(sized_points(points, cells)), cells


def sparse_neighbour_counts(sized: DataFrame, cells: DataFrame, grid: SubcellGrid) -> DataFrame:
    """Points of active sparse sub-cells with ``hits``, the events within eps (their own too)."""
    probes = sized.filter(_SPARSE).select("cx", "cy", *_POINT, F.col("weight").alias("own_weight"), "first_order")
    counted = _probe(probes, sized.filter("reached"), cells, "weight", F.sum("weight"), grid)
    return counted.withColumnsRenamed({"found": "hits", "own_weight": "weight"})


def _extremes() -> list[Column]:
    """Northern-, southern-, eastern- and westernmost point, with fixed-width buffers."""
    lat, lon = F.col("lat"), F.col("lon")
    return [
        F.max(lat).alias("n_lat"),
        F.max_by(lon, lat).alias("n_lon"),
        F.min(lat).alias("s_lat"),
        F.min_by(lon, lat).alias("s_lon"),
        F.max(lon).alias("e_lon"),
        F.max_by(lat, lon).alias("e_lat"),
        F.min(lon).alias("w_lon"),
        F.min_by(lat, lon).alias("w_lat"),
        F.count(F.lit(1)).alias("points"),
    ]


def _with_vectors(summary: DataFrame) -> DataFrame:
    """Add the unit vectors of the four extreme points."""
    parts = {"ux": "cos({lat}) * cos({lon})", "uy": "cos({lat}) * sin({lon})", "uz": "sin({lat})"}
    vectors = [
        f"{text.format(lat=f'radians({p}_lat)', lon=f'radians({p}_lon)')} AS {p}_{c}"
        for p in "nsew"
        for c, text in parts.items()
    ]
    return summary.selectExpr("*", *vectors)


_SUMMARY = (
    "points", "n_lat", "s_lat", "e_lon", "w_lon",
    *(f"{p}_{c}" for p in "nsew" for c in _VECTOR),
)


def _side(prefix: str) -> list[Column]:
    return [F.expr(f"{c} AS {prefix}_{c}") for c in _SUMMARY]


def _touching(grid: SubcellGrid) -> Column:
    """True when two of the extreme points are within eps."""
    chords = ", ".join(_chord(f"a_{p}_", f"b_{q}_") for p in "nsew" for q in "nsew")
    return F.expr(f"least({chords}) <= {chord_limit(grid.eps_m)!r}D")


def _apart(grid: SubcellGrid) -> Column:
    """True only when the two bounding boxes are further apart than eps."""
    gap_lat = "greatest(0D, b_s_lat - a_n_lat, a_s_lat - b_n_lat)"
    gap_lon = "greatest(0D, b_w_lon - a_e_lon, a_w_lon - b_e_lon)"
    poleward = "greatest(abs(a_n_lat), abs(a_s_lat), abs(b_n_lat), abs(b_s_lat))"
    term = (
        f"pow(sin(radians({gap_lat}) / 2), 2)"
        f" + pow(cos(radians({poleward})) * sin(radians({gap_lon}) / 2), 2)"
    )
    return F.expr(f"({term}) * {1.0 - 1e-9!r}D > {haversine_limit(grid.eps_m)!r}D")


def _verdicts(pairs: DataFrame, grid: SubcellGrid) -> DataFrame:
    """Drop pairs that are apart; mark the rest ``touching`` or, by size, ``exact``."""
    return pairs.filter(~_apart(grid)).select(
        *("u", "v", "ax", "ay", "bx", "by"),
        _touching(grid).alias("touching"),
        (F.col("a_points") * F.col("b_points") <= EXACT_PAIRS).alias("exact"),
    )


def _exact_edges(
    pairs: DataFrame, cores: DataFrame, grid: SubcellGrid, level: int
) -> DataFrame:
    """Edges among small undecided pairs, comparing their points."""
    asked = (
        pairs.select(F.col("ax").alias("x"), F.col("ay").alias("y"))
        .union(pairs.select("bx", "by"))
        .distinct()
    )
    vector = unit_vector(F.col("lat"), F.col("lon"))
    fine = cores.select(
        *[v.alias(c) for c, v in zip(_VECTOR, vector)],
        grid.column(F.col("lon"), level).alias("x"),
        grid.row(F.col("lat"), level).alias("y"),
    ).join(asked, ["x", "y"], "left_semi")
    left = fine.select(F.col("x").alias("ax"), F.col("y").alias("ay"), *_VECTOR)
    right = fine.select(
        F.col("x").alias("bx"),
        F.col("y").alias("by"),
        *[F.col(c).alias(f"t_{c}") for c in _VECTOR],
    )
    return (
        pairs.select("u", "v", "ax", "ay", "bx", "by")
        .join(left, ["ax", "ay"])
        .join(right, ["bx", "by"])
        .filter(_within(grid))
        .select("u", "v")
        .distinct()
    )


def _node_id(x: Column, y: Column) -> Column:
    return F.shiftleft(x.cast("bigint"), 31).bitwiseOR(y.cast("bigint"))


def core_edges(cores: DataFrame, nodes: DataFrame, grid: SubcellGrid) -> DataFrame:
    """``(u, v)`` for every two sub-cells that hold core points within eps of each other."""
    here = _in_tile(nodes.select("cx", "cy", *_side("a")), grid)
    there = _in_reach(nodes.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), *_side("b")), grid)
    forward = F.expr("tx > cx or (tx = cx and ty > cy)")
    pairs = _beside(here, there, grid).filter(forward).withColumns(
        {
            "u": _node_id(F.col("cx"), F.col("cy")),
            "v": _node_id(F.col("tx"), F.col("ty")),
        }
    ).withColumnsRenamed({"cx": "ax", "cy": "ay", "tx": "bx", "ty": "by"})
    frontier = store(_verdicts(pairs, grid))
    edges = frontier.filter("touching").select("u", "v")
    level = 0
    while True:
        undecided = frontier.filter("not touching")
        edges = edges.union(
            _exact_edges(undecided.filter("exact"), cores, grid, level)
        )
        large = undecided.filter("not exact").select("u", "v", "ax", "ay", "bx", "by")
        if large.isEmpty():
            return edges.distinct()
        level += 2
        crowded = large.select("u").union(large.select("v")).distinct()
        inside = cores.withColumn("u", _node_id(F.col("cx"), F.col("cy"))).join(
            crowded, "u", "left_semi"
        )
        children = _with_vectors(
            inside.groupBy(
                grid.column(F.col("lon"), level).alias("x"),
                grid.row(F.col("lat"), level).alias("y"),
            ).agg(*_extremes())
        ).withColumns({"px": F.shiftright("x", 2), "py": F.shiftright("y", 2)})
        left = children.select(
            F.col("px").alias("ax"),
            F.col("py").alias("ay"),
            F.col("x").alias("ax2"),
            F.col("y").alias("ay2"),
            *_side("a"),
        )
        right = children.select(
            F.col("px").alias("bx"),
            F.col("py").alias("by"),
            F.col("x").alias("bx2"),
            F.col("y").alias("by2"),
            *_side("b"),
        )
        split = (
            large.join(left, ["ax", "ay"])
            .join(right, ["bx", "by"])
            .drop("ax", "ay", "bx", "by")
            .withColumnsRenamed({"ax2": "ax", "ay2": "ay", "bx2": "bx", "by2": "by"})
        )
        judged = store(_verdicts(split, grid))
        found = judged.filter("touching").select("u", "v").distinct()
        edges = edges.union(found)
        frontier = judged.join(found, ["u", "v"], "left_anti")


def core_points(
    events: DataFrame,
    *,
    eps_m: float = 75.0,
    min_samples: int = 15,
    order_by: str = "read_order",
    bbox: BoundingBox | None = None,
) -> DataFrame:
    """Distinct core coordinates ``(lat, lon, weight)``."""
    check_parameters(eps_m, min_samples)
    grid = grid_for(events, eps_m, bbox)
    if grid is None:
        return events.select(
            F.col("latitude").alias("lat"),
            F.col("longitude").alias("lon"),
            F.lit(1).cast("bigint").alias("weight"),
        )
    sized, cells = density(events, grid, min_samples, order_by)
    hits = sparse_neighbour_counts(sized, cells, grid)
    return _cores(sized, hits, min_samples).select(*_POINT, "weight")


def _cores(sized: DataFrame, hits: DataFrame, min_samples: int) -> DataFrame:
    columns = ("cx", "cy", *_POINT, "weight", "first_order")
    dense = sized.filter("dense").select(*columns, F.lit(True).alias("dense"))
    sparse = hits.filter(F.col("hits") >= min_samples).select(*columns, F.lit(False).alias("dense"))
    return dense.unionByName(sparse)


def _label_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cx, cy, label)``: components numbered by their earliest core event."""
    components = connected_components(edges)
    rooted = nodes.select(
        "cx", "cy", "first_order", _node_id(F.col("cx"), F.col("cy")).alias("node")
    ).join(components, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    clusters = rooted.groupBy("root").agg(F.min("first_order").alias("first_order"))
    numbered = global_position(clusters, [F.col("first_order").asc()], "position")
    return rooted.join(
        numbered.select("root", (F.col("position") - 1).alias("label")), "root"
    ).select("cx", "cy", "label")


def cluster_lookup(
    events: DataFrame, grid: SubcellGrid, min_samples: int, order_by: str
) -> DataFrame:
    """Labels by sub-cell: ``(cx, cy, dense_label, members)``.

    A dense sub-cell has one label for all its points. A sparse one lists its labelled
    coordinates, fewer than ``min_samples`` of them.
    """
    sized, cells = density(events, grid, min_samples, order_by)
    hits = store(sparse_neighbour_counts(sized, cells, grid))
    cores = _cores(sized, hits, min_samples)
    nodes = store(
        _with_vectors(
            cores.groupBy("cx", "cy").agg(F.min("first_order").alias("first_order"), *_extremes())
        )
    )
    labels = store(_label_nodes(nodes, core_edges(cores, nodes, grid)))

    sparse_cores = cores.filter("not dense")
    others = hits.filter(F.col("hits") < min_samples).select("cx", "cy", *_POINT)
    # Labelled sub-cells in reach of a point that is no core point, with their size.
    asked = (
        _beside(
            _in_tile(labels.join(cells.select("cx", "cy", "points"), ["cx", "cy"]), grid),
            _in_reach(others.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")).distinct(), grid),
            grid,
        )
        .select("cx", "cy", "label", "points")
        .distinct()
    )
    next_to = cores.select("cx", "cy", *_POINT).join(asked, ["cx", "cy"])
    borders = _probe(others, next_to, cells, "label", F.min("label"), grid).withColumnRenamed("found", "label")
    core_labels = sparse_cores.join(labels, ["cx", "cy"])
    members = (
        core_labels.select("cx", "cy", *_POINT, "label")
        .union(borders.select("cx", "cy", *_POINT, "label"))
        .groupBy("cx", "cy")
        .agg(F.collect_list(F.struct("lat", "lon", "label")).alias("members"))
    )
    dense_labels = labels.join(cells.filter("dense").select("cx", "cy"), ["cx", "cy"])
    empty = F.lit(None).cast("array<struct<lat: double, lon: double, label: int>>")
    return dense_labels.select(
        "cx", "cy", F.col("label").alias("dense_label"), empty.alias("members")
    ).unionByName(
        members.select("cx", "cy", F.lit(None).cast("int").alias("dense_label"), "members")
    )


def label_events(events: DataFrame, lookup: DataFrame, grid: SubcellGrid) -> DataFrame:
    """Add ``cluster_label`` from the lookup: one left join on the sub-cell.

    The join turns into a broadcast when the lookup is small at run time; otherwise
    skewed sub-cells are split by adaptive execution.
    """
    placed = events.withColumns(
        {"cx": grid.column(F.col("longitude")), "cy": grid.row(F.col("latitude"))}
    )
    here = F.filter(
        "members",
        lambda m: (m["lat"] == F.col("latitude")) & (m["lon"] == F.col("longitude")),
    )
    label = F.coalesce(
        F.col("dense_label"), F.get(here, F.lit(0))["label"], F.lit(NOISE_LABEL)
    )
    return (
        placed.join(lookup, ["cx", "cy"], "left")
        .withColumn("cluster_label", label)
        .drop("cx", "cy", "dense_label", "members")
    )


def find_clusters(
    events: DataFrame,
    *,
    eps_m: float = 75.0,
    min_samples: int = 15,
    order_by: str = "read_order",
    bbox: BoundingBox | None = None,
) -> tuple[DataFrame, SubcellGrid] | None:
    """Stored label lookup and its grid; None when there are no events.

    ``bbox`` is a box the coordinates are known to lie in; without it one scan finds
    their extent.
    """
    check_parameters(eps_m, min_samples)
    grid = grid_for(events, eps_m, bbox)
    if grid is None:
        return None
    needed = events.select("latitude", "longitude", order_by)
    return cut_lineage(cluster_lookup(needed, grid, min_samples, order_by)), grid


def cluster_dbscan(
    events: DataFrame,
    *,
    eps_m: float = 75.0,
    min_samples: int = 15,
    order_by: str = "read_order",
    bbox: BoundingBox | None = None,
) -> DataFrame:
    """Add ``cluster_label`` to events; noise is -1."""
    found = find_clusters(
        events, eps_m=eps_m, min_samples=min_samples, order_by=order_by, bbox=bbox
    )
    if found is None:
        return events.withColumn("cluster_label", F.lit(NOISE_LABEL))
    return label_events(events, *found)
