"""Building blocks of the oracle queries, written for DuckDB.

They state the rules directly on the given tables and share nothing with the operators
but the parameters.
"""

from __future__ import annotations

from checks.tables import DUCK_CLEAN, DUCK_GEO, DUCK_RAW
from geohotspots.config import BoundingBox
from geohotspots.functions.geo import SubcellGrid

EPS_M, MIN_SAMPLES = 75.0, 15
BOX = BoundingBox()
GRID = SubcellGrid.covering(EPS_M, BOX.lat_min, BOX.lat_max, BOX.lon_min, BOX.lon_max)


def fixed(expression: str, name: str | None = None) -> str:
    """Six decimals without ties: sums in another order must not flip a digit."""
    text = f"floor(({expression}) * 1000000 + 0.318309886) / 1000000"
    return f"{text} AS {name}" if name else text


def d(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _hex(resolution: int, source: str) -> str:
    third = d(3.0)
    return f"""
SELECT * EXCLUDE (q, r, rq, rr, rp), 'hex{resolution}_' || CAST(CAST(
   CASE WHEN abs(rq-q) > abs(rr-r) AND abs(rq-q) > abs(rp-(-q-r)) THEN -rp-rr ELSE rq END AS BIGINT) AS VARCHAR)
   || '_' || CAST(CAST(
   CASE WHEN abs(rq-q) > abs(rr-r) AND abs(rq-q) > abs(rp-(-q-r)) THEN rr
        WHEN abs(rr-r) > abs(rp-(-q-r)) THEN -rq-rp ELSE rr END AS BIGINT) AS VARCHAR) AS h3_cell
FROM (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q-r + 0.5) AS rp
 FROM (SELECT *,
  (x * (sqrt({third})/{third}) - y/{third}) / e AS q, (y * {d(2.0)} / {third}) / e AS r
  FROM (SELECT *, (longitude - {d(77.6)}) * ky * cos(radians({d(12.95)})) AS x,
    (latitude - {d(12.95)}) * ky AS y
    FROM (SELECT *, radians({d(1.0)}) * {d(6371000.0)} AS ky,
      {d(200.786)} * pow(sqrt({d(7.0)}), {9 - resolution}) AS e FROM {source}) s0) s1) s2) s3
"""


_SLIM = "SELECT * EXCLUDE (ky, e, x, y) FROM ({inner}) slim"

_WEIGHTS = """
SELECT * FROM (VALUES ('PARKING NEAR ROAD CROSSING', 1.0), ('WRONG PARKING ON CARRIAGEWAY', 0.9),
 ('NO STOPPING ON ROAD', 0.85), ('OBSTRUCTION ON ROAD', 0.8), ('PARKING ON FOOTPATH', 0.7),
 ('WRONG PARKING', 0.6), ('NO PARKING ZONE', 0.5), ('PARKING WITHOUT PERMIT', 0.4),
 ('WRONG SIDE PARKING', 0.45), ('PARKING NEAR JUNCTION', 0.75), ('PARKING NEAR BUS STOP', 0.55),
 ('PARKING NEAR SCHOOL', 0.5), ('PARKING NEAR HOSPITAL', 0.5), ('DOUBLE PARKING', 0.7)) w(token, weight)
"""

_DIST = """2 * CAST('6371000' AS DOUBLE) * asin(sqrt(
   pow(sin(radians(b.latitude - a.latitude)/2), 2)
   + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude)/2), 2)))"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, text: str) -> None:
    CTES[name] = (tuple(needs.split()), text)


cte("geo", "", DUCK_GEO)
cte("raw", "", DUCK_RAW)
cte("clean", "", DUCK_CLEAN)
cte("hex9", "clean", _SLIM.format(inner=_hex(9, "clean")))
cte("hex8", "clean", _SLIM.format(inner=_hex(8, "clean")))
cte("weights", "", _WEIGHTS)

# --- cleaning of the raw rows ---
cte("typed", "raw", f"""
SELECT *, TRY_CAST(trim(latitude) AS DOUBLE) AS lat, TRY_CAST(trim(longitude) AS DOUBLE) AS lon,
 CASE WHEN created_datetime LIKE '%+00' THEN TRY_CAST(replace(created_datetime, '+00', '') AS TIMESTAMP)
      ELSE TRY_CAST(created_datetime AS TIMESTAMP) - INTERVAL 330 MINUTE END AS created_at,
 TRY_CAST(closed_datetime AS TIMESTAMP) - INTERVAL 330 MINUTE AS closed_at
FROM raw""")
cte("tagged", "typed", f"""
SELECT *, CASE WHEN created_at IS NULL THEN 'unparseable_created_at'
  WHEN lat IS NULL OR lon IS NULL OR NOT (lat BETWEEN {d(12.7)} AND {d(13.2)} AND lon BETWEEN {d(77.3)} AND {d(77.9)})
  THEN 'invalid_geo' END AS reject_reason FROM typed""")
cte("ranked", "tagged", """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY read_order) AS rn FROM tagged WHERE reject_reason IS NULL""")

# --- clustering by brute force ---
cte("pairs", "clean", f"""
SELECT a.read_order AS a, b.read_order AS b FROM clean a JOIN clean b
 ON b.latitude BETWEEN a.latitude - 0.001 AND a.latitude + 0.001
AND b.longitude BETWEEN a.longitude - 0.001 AND a.longitude + 0.001
WHERE {_DIST} <= {d(EPS_M)}""")
cte("cores", "pairs", f"SELECT a AS p FROM pairs GROUP BY a HAVING count(*) >= {MIN_SAMPLES}")
cte("core_pairs", "pairs cores", """
SELECT a, b FROM pairs WHERE a IN (SELECT p FROM cores) AND b IN (SELECT p FROM cores)""")
cte("reach", "core_pairs", """
SELECT a AS p, b AS q FROM core_pairs UNION SELECT r.p, c.b FROM reach r JOIN core_pairs c ON r.q = c.a""")
cte("core_labels", "reach", """
SELECT p, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS label
FROM (SELECT p, min(q) AS root FROM reach GROUP BY p) r""")
cte("labels", "pairs core_labels", """
SELECT p, label FROM core_labels UNION ALL
SELECT a, min(label) FROM pairs JOIN core_labels ON b = core_labels.p
WHERE a NOT IN (SELECT p FROM core_labels) GROUP BY a""")
cte("labelled", "hex9 labels", """
SELECT h.*, coalesce(l.label, -1) AS cluster_label FROM hex9 h LEFT JOIN labels l ON h.read_order = l.p""")

# --- hotspots: by cell and by cluster ---
cte("ev_cell", "hex9", "SELECT *, 'h3-' || h3_cell AS hotspot_id, CAST(NULL AS INTEGER) AS cluster_label FROM hex9")
cte("ev_cluster", "labelled", """
SELECT *, 'dbscan-' || CAST(cluster_label AS VARCHAR) AS hotspot_id FROM labelled WHERE cluster_label >= 0""")


def _hotspot_chain(kind: str) -> None:
    """Tables hs_, comp_, scored_, zones_ ... over ev_cell or ev_cluster."""
    ev = f"ev_{kind}"

    def mode(column: str) -> str:
        return f"""SELECT hotspot_id, {column} FROM (SELECT hotspot_id, {column},
 row_number() OVER (PARTITION BY hotspot_id ORDER BY n DESC, {column}) AS rn
 FROM (SELECT hotspot_id, {column}, count(*) AS n FROM {ev}
  WHERE {column} IS NOT NULL AND lower(trim({column})) NOT IN ('', 'null', 'nan', 'none', 'na')
  GROUP BY ALL) c) r WHERE rn = 1"""

    cte(f"station_{kind}", ev, mode("police_station"))
    cte(f"modecell_{kind}", ev, mode("h3_cell"))
    cte(f"hs_{kind}", f"{ev} station_{kind} modecell_{kind}", f"""
SELECT g.*, c.h3_cell, s.police_station FROM (
 SELECT hotspot_id, cluster_label, count(*) AS member_count,
  greatest({d(12.7)}, least({d(13.2)}, avg(latitude))) AS centroid_lat,
  greatest({d(77.3)}, least({d(77.9)}, avg(longitude))) AS centroid_lon
 FROM {ev} GROUP BY hotspot_id, cluster_label) g
 LEFT JOIN station_{kind} s USING (hotspot_id) LEFT JOIN modecell_{kind} c USING (hotspot_id)""")
    cte(f"sev_{kind}", f"{ev} weights", f"""
SELECT e.hotspot_id, coalesce(nullif(max(w.weight), 0), 0.3)::DOUBLE AS severity_component
FROM (SELECT hotspot_id, unnest(CASE WHEN len(violation_type) = 0 THEN ['-'] ELSE violation_type END) AS token
 FROM {ev}) e LEFT JOIN weights w ON e.token = w.token GROUP BY e.hotspot_id""")
    cte(f"prox_{kind}", ev, f"""
SELECT hotspot_id, avg(CASE WHEN (junction_name IS NOT NULL AND trim(junction_name) <> '')
  OR list_has_any(violation_type, ['PARKING NEAR ROAD CROSSING', 'PARKING NEAR JUNCTION',
   'NO STOPPING ON ROAD', 'WRONG PARKING ON CARRIAGEWAY']) THEN 1.0 ELSE 0.0 END)::DOUBLE AS proximity_component
FROM {ev} GROUP BY hotspot_id""")
    cte(f"conc_{kind}", ev, f"""
SELECT hotspot_id, greatest(0.0, least(1.0, 1 + sum(p * log2(p)) / log2(24))) AS concentration_component
FROM (SELECT hotspot_id, n / sum(n) OVER (PARTITION BY hotspot_id) AS p FROM (
 SELECT hotspot_id, hour(created_local) AS h, count(*)::DOUBLE AS n FROM {ev} GROUP BY ALL) c) x GROUP BY hotspot_id""")
    cte(f"rawscore_{kind}", f"hs_{kind} sev_{kind} prox_{kind} conc_{kind}", f"""
SELECT *, {d(0.45)} * severity_component + {d(0.35)} * proximity_component
 + {d(0.2)} * concentration_component AS impact_raw
FROM hs_{kind} JOIN sev_{kind} USING (hotspot_id) JOIN prox_{kind} USING (hotspot_id) JOIN conc_{kind} USING (hotspot_id)""")
    cte(f"scored_{kind}", f"rawscore_{kind}", f"""
SELECT *, least(100.0, impact_raw * (100.0 / (SELECT max(impact_raw) FROM rawscore_{kind}))) AS impact_score
FROM rawscore_{kind}""")
    cte(f"factors_{kind}", f"{ev} scored_{kind}", f"""
SELECT s.*, f.active_days, f.last_at, impact_score / 100.0 AS impact,
 CASE WHEN max(member_count) OVER () = min(member_count) OVER () THEN 1.0 ELSE
  (member_count - min(member_count) OVER ())::DOUBLE / (max(member_count) OVER () - min(member_count) OVER ()) END AS frequency,
 CASE WHEN max(active_days) OVER () = min(active_days) OVER () THEN 1.0 ELSE
  (active_days - min(active_days) OVER ())::DOUBLE / (max(active_days) OVER () - min(active_days) OVER ()) END AS persistence,
 greatest(1e-12, least(1.0, pow(2.0, -((epoch_us(max(last_at) OVER ()) - epoch_us(last_at)) / 86400000000.0) / 21.0))) AS recency
FROM scored_{kind} s JOIN (SELECT hotspot_id, count(DISTINCT CAST(created_local AS DATE)) AS active_days,
 max(created_at) AS last_at FROM {ev} GROUP BY hotspot_id) f USING (hotspot_id)""")
    cte(f"prio_{kind}", f"factors_{kind}", f"""
SELECT *, CASE WHEN impact = 0 OR frequency = 0 OR persistence = 0 OR recency = 0 THEN 0.0
 ELSE least(100.0, 100 * exp(0.4 * ln(impact) + 0.25 * ln(frequency) + 0.2 * ln(persistence) + 0.15 * ln(recency)))
 END AS priority_score FROM factors_{kind}""")
    cte(f"zones_{kind}", f"prio_{kind}", f"""
SELECT *, row_number() OVER (ORDER BY priority_score DESC, hotspot_id)::INTEGER AS global_rank,
 row_number() OVER (PARTITION BY police_station ORDER BY priority_score DESC, hotspot_id)::INTEGER AS station_rank
FROM prio_{kind}""")
    cte(f"profile_{kind}", f"{ev} hs_{kind}", f"""
SELECT hotspot_id, day_of_week, hour, (n + 0.5) / max(n + 0.5) OVER (PARTITION BY hotspot_id) AS intensity,
 sum(n) OVER (PARTITION BY hotspot_id)::BIGINT AS total_events
FROM (SELECT g.hotspot_id, g.day_of_week, g.hour, coalesce(c.n, 0)::DOUBLE AS n FROM (
  SELECT hotspot_id, CAST(dw AS INTEGER) AS day_of_week, CAST(hr AS INTEGER) AS hour
  FROM hs_{kind}, range(7) a(dw), range(24) b(hr)) g
 LEFT JOIN (SELECT hotspot_id, CAST(isodow(created_local) - 1 AS INTEGER) AS day_of_week,
  CAST(hour(created_local) AS INTEGER) AS hour, count(*) AS n FROM {ev} GROUP BY ALL) c
 USING (hotspot_id, day_of_week, hour)) x""")
    cte(f"peakcells_{kind}", f"profile_{kind}", f"SELECT * FROM profile_{kind} WHERE intensity >= 0.5")
    cte(f"windows_{kind}", f"peakcells_{kind}", f"""
SELECT hotspot_id, day_of_week, min(hour) AS start_hour, max(hour) AS end_hour, max(intensity) AS expected_intensity
FROM (SELECT *, hour - row_number() OVER (PARTITION BY hotspot_id, day_of_week ORDER BY hour) AS run FROM peakcells_{kind}) r
GROUP BY hotspot_id, day_of_week, run""")
    cte(f"top_{kind}", f"windows_{kind}", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hotspot_id
 ORDER BY expected_intensity DESC, day_of_week, start_hour)::INTEGER AS peak_rank FROM windows_{kind}) r
WHERE peak_rank <= 3""")
    cte(f"tiers_{kind}", f"scored_{kind}", f"""
SELECT hotspot_id, CASE WHEN impact_score >= (SELECT quantile_cont(impact_score, {d(2 / 3)}) FROM scored_{kind}) THEN 'HIGH'
 WHEN impact_score >= (SELECT quantile_cont(impact_score, {d(1 / 3)}) FROM scored_{kind}) THEN 'MEDIUM'
 ELSE 'LOW' END AS risk_tier FROM scored_{kind}""")
    cte(f"zt_{kind}", f"zones_{kind} tiers_{kind}", f"SELECT * FROM zones_{kind} JOIN tiers_{kind} USING (hotspot_id)")


_hotspot_chain("cell")
_hotspot_chain("cluster")

# --- daily panel: cells at resolution 8, at least 20 events ---
cte("daily", "hex8", """
SELECT h3_cell, CAST(created_local AS DATE) AS date, count(*) AS count FROM hex8 GROUP BY ALL""")
cte("busy", "daily", """
SELECT * FROM daily WHERE h3_cell IN (SELECT h3_cell FROM daily GROUP BY h3_cell HAVING sum(count) >= 20)""")
cte("filled", "busy", """
SELECT g.h3_cell, g.date, coalesce(b.count, 0) AS count FROM (
 SELECT h3_cell, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
 FROM (SELECT DISTINCT h3_cell FROM busy) c, (SELECT CAST(min(date) AS TIMESTAMP) AS lo, CAST(max(date) AS TIMESTAMP) AS hi FROM busy) s) g
LEFT JOIN busy b ON b.h3_cell = g.h3_cell AND b.date = g.date""")
cte("panel", "filled", """
SELECT *, lag(count, 1) OVER w AS lag_1, lag(count, 7) OVER w AS lag_7,
 avg(count) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll_7_mean,
 avg(count) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS roll_14_mean,
 avg(count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expanding_mean,
 CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
 CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
 CAST(dayofyear(date) AS INTEGER) AS day_of_year,
 CAST(dense_rank() OVER (ORDER BY h3_cell) - 1 AS INTEGER) AS cell_code
FROM filled WINDOW w AS (PARTITION BY h3_cell ORDER BY date)""")
cte("training", "panel", "SELECT * FROM panel WHERE lag_7 IS NOT NULL AND roll_7_mean IS NOT NULL AND expanding_mean IS NOT NULL")
cte("train", "training", "SELECT * FROM training WHERE date <= (SELECT max(date) FROM training) - 7")
cte("test", "training train", """
SELECT *, CAST(lag_7 AS DOUBLE) AS prediction,
 CAST(count >= (SELECT quantile_cont(count, 0.75) FROM train) AS INTEGER) AS label
FROM training WHERE date > (SELECT max(date) FROM training) - 7""")
cte("thresholds", "test", """
SELECT CAST(i AS INTEGER) AS threshold_no, c AS threshold FROM (
 SELECT unnest(range(19)) AS i, unnest(quantile_cont(prediction, [0.5, 0.525, 0.55, 0.575, 0.6, 0.625, 0.65, 0.675,
  0.7, 0.725, 0.75, 0.775, 0.8, 0.825, 0.85, 0.875, 0.9, 0.925, 0.95])) AS c FROM test) u""")
cte("f1s", "thresholds test", """
SELECT threshold_no, threshold, CASE WHEN pos + flagged = 0 THEN 0.0 ELSE 2.0 * tp / (pos + flagged) END AS f1
FROM (SELECT threshold_no, threshold, count(*) FILTER (label = 1) AS pos,
 count(*) FILTER (prediction >= threshold) AS flagged,
 count(*) FILTER (prediction >= threshold AND label = 1) AS tp
 FROM thresholds, test GROUP BY ALL) c""")
cte("best_f1", "f1s", "SELECT threshold, f1 FROM f1s ORDER BY f1 DESC, threshold_no LIMIT 1")
cte("celldim", "hex8 panel", """
SELECT p.h3_cell, p.cell_code, m.centroid_lat, m.centroid_lon, s.police_station
FROM (SELECT DISTINCT h3_cell, cell_code FROM panel) p
JOIN (SELECT h3_cell, avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon FROM hex8 GROUP BY h3_cell) m USING (h3_cell)
JOIN (SELECT h3_cell, police_station, row_number() OVER (PARTITION BY h3_cell ORDER BY count(*) DESC, police_station) AS rn
 FROM hex8 GROUP BY h3_cell, police_station) s ON s.h3_cell = p.h3_cell AND s.rn = 1""")
# The weekly lag as predictor repeats the last seven days.
cte("naive", "filled celldim", """
SELECT f.h3_cell, CAST(f.date + 7 AS DATE) AS date, CAST(f.count AS DOUBLE) AS predicted_count,
 c.centroid_lat, c.centroid_lon, c.police_station
FROM filled f JOIN celldim c USING (h3_cell) WHERE f.date > (SELECT max(date) FROM filled) - 7""")
cte("ranked_forecast", "naive", """
SELECT row_number() OVER (ORDER BY total_predicted DESC, h3_cell)::INTEGER AS forecast_rank, * FROM (
 SELECT h3_cell, centroid_lat, centroid_lon, police_station, sum(predicted_count) AS total_predicted,
 arg_max(date, predicted_count * 1000 - (date - DATE '2024-01-01')) AS peak_date FROM naive GROUP BY ALL) t
ORDER BY forecast_rank LIMIT 20""")


def query(needs: str, final: str) -> str:
    """WITH clause over everything ``final`` needs, in order of dependence."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = ",\n".join(
        f"{n} AS {'' if n == 'reach' else 'MATERIALIZED'} ({CTES[n][1]})" for n in order
    )
    recursive = "RECURSIVE " if "reach" in order or "UNION ALL\n SELECT i + 1" in final else ""
    return f"WITH {recursive}{parts}\n{final}"
