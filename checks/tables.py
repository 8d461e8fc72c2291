"""Event records derived from the given ``events`` table.

The given table has no coordinates, so they are computed from its keys. The texts below
run on both engines; only spellings that differ are passed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GEO_SQL = """
SELECT *,
 CAST(CASE WHEN event_id % 17 = 0 THEN 1270000 + ((event_id*104729) % 4999)*10
      ELSE 1272000 + ((user_id*7919) % 4600)*10 + ((event_id*31) % 101 - 50) END AS DOUBLE)/100000 AS latitude,
 CAST(CASE WHEN event_id % 17 = 0 THEN 7730000 + ((event_id*15485863) % 5987)*10
      ELSE 7732000 + ((user_id*6007) % 5600)*10 + ((event_id*37) % 103 - 51) END AS DOUBLE)/100000 AS longitude
FROM {events}
"""

_RAW_SQL = """
SELECT CAST(event_id AS VARCHAR(20)) AS id, event_id*2 + k AS read_order,
 CASE WHEN event_id % 83 = 0 THEN 'bad' WHEN event_id % 79 = 0 THEN '0.0'
      WHEN event_id % 73 = 0 THEN NULL ELSE CAST(latitude AS VARCHAR(30)) END AS latitude,
 CAST(longitude AS VARCHAR(30)) AS longitude,
 CASE WHEN event_id % 97 = 0 THEN 'not-a-date' WHEN event_id % 89 = 0 THEN 'NULL'
      WHEN event_id % 3 = 0 THEN concat({fmt}, '+00') ELSE {fmt} END AS created_datetime,
 CASE WHEN event_id % 2 = 0 THEN NULL ELSE {fmt} END AS closed_datetime,
 CASE WHEN event_id % 71 = 0 THEN concat(chr(123), 'bad')
      WHEN event_type = 'signup' THEN '["WRONG PARKING"]'
      WHEN event_type = 'error' THEN '["parking near junction "," wrong parking"]'
      WHEN event_type = 'click' THEN '["No Parking Zone"]'
      WHEN event_type = 'view' THEN '[]'
      ELSE '["UNKNOWN TOKEN"]' END AS violation_type,
 concat('[', {k}, ',"x",null,"', CAST(event_id % 300 AS VARCHAR(20)), '",2.0,1.5,true]') AS offence_code,
 CASE event_id % 4 WHEN 0 THEN ' CAR ' WHEN 1 THEN 'Scooter' WHEN 2 THEN '' ELSE NULL END AS vehicle_type,
 CASE WHEN user_id % 7 = 6 THEN 'NULL'
      ELSE concat('  Station   ', CAST(user_id % 7 AS VARCHAR(20)), ' ') END AS police_station,
 CASE event_id % 5 WHEN 0 THEN concat('Junction ', CAST(user_id % 9 AS VARCHAR(20)))
      WHEN 1 THEN '  ' ELSE NULL END AS junction_name,
 concat('V', CAST(user_id AS VARCHAR(20))) AS vehicle_number
FROM (SELECT *, 0 AS k FROM ({geo}) a
      UNION ALL SELECT *, 1 AS k FROM ({geo}) b WHERE event_id % 53 = 0) g
"""

_CLEAN_SQL = """
SELECT CAST(event_id AS VARCHAR(20)) AS id, event_id AS read_order, latitude, longitude,
 CASE WHEN event_id % 71 = 0 THEN {empty}
      WHEN event_type = 'signup' THEN {arr}('WRONG PARKING')
      WHEN event_type = 'error' THEN {arr}('PARKING NEAR JUNCTION', 'WRONG PARKING')
      WHEN event_type = 'click' THEN {arr}('NO PARKING ZONE')
      WHEN event_type = 'view' THEN {empty}
      ELSE {arr}('UNKNOWN TOKEN') END AS violation_type,
 CASE event_id % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'scooter' ELSE '' END AS vehicle_type,
 CASE WHEN user_id % 7 = 6 THEN '' ELSE concat('Station ', CAST(user_id % 7 AS VARCHAR(20))) END AS police_station,
 CASE event_id % 5 WHEN 0 THEN concat('Junction ', CAST(user_id % 9 AS VARCHAR(20)))
      WHEN 1 THEN '  ' ELSE NULL END AS junction_name,
 {instant} AS created_at,
 {local} AS created_local,
 concat('V', CAST(user_id AS VARCHAR(20))) AS vehicle_number
FROM ({geo}) g
"""

_SPARK = {
    "fmt": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "k": "get_json_object(props, '$.k')",
    "arr": "array",
    "empty": "cast(array() AS array<string>)",
    "local": "ts + INTERVAL '330' MINUTE",
    "instant": "CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP)",
    "geo": GEO_SQL,
}
_DUCK = {
    "fmt": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "k": "json_extract_string(props, '$.k')",
    "arr": "list_value",
    "empty": "CAST([] AS VARCHAR[])",
    "local": "ts + INTERVAL 330 MINUTE",
    "instant": "ts",
    "geo": GEO_SQL.format(events="events"),
}

DUCK_GEO = _DUCK["geo"]
DUCK_RAW = _RAW_SQL.format(**_DUCK)
DUCK_CLEAN = _CLEAN_SQL.format(**_DUCK)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text rows with duplicates, bad coordinates and bad times."""
    return spark.sql(_RAW_SQL.format(**_SPARK), events=events_table(spark, sf_dir))


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean events, one per row of the given table."""
    return spark.sql(_CLEAN_SQL.format(**_SPARK), events=events_table(spark, sf_dir))
