"""Tables stored in buckets of a key, so that work by that key needs no exchange later.

Rows are shuffled by the key once, when they are written: one task writes one bucket as one
file. Groups and windows by the key (or by the key and more columns), and joins of two such
tables by it, then read the buckets as they lie. The bucket of a key follows from Spark's hash
and the number of buckets, so tables with the same number fit each other. A bucket is read by
one task: store what has no hot key, as accepted events by their id, or sums by hotspot.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: About 128 MB a bucket at a terabyte; give fewer for small tables.
BUCKETS = 8192


def _name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write Parquet below ``path`` in buckets of ``keys``. Null keys are one more value.

    No name stays in the catalog, so the folder can be published or moved as any other.
    """
    name = _name()
    spread = df.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(name)
    # A table with a path of its own: its files stay.
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_bucketed(
    spark: SparkSession, paths: Sequence[str], schema: str, keys: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Read folders of :func:`write_bucketed` as one table, with the keys and number of buckets
    they were written with. Bucket n of all folders is one partition.

    ``schema`` lists the columns as DDL does: a table without rows has no file that says them.
    The folders are partitions of one table and not a union: Spark 4.1 takes a union of bucketed
    scans for bucketed as well, but does not put their buckets together, so a grouping without
    exchange gives wrong groups. Keep such tables out of unions of your own for the same reason,
    or set ``spark.sql.unionOutputPartitioning`` to false. The table's name is known to this
    session's catalog alone and may be dropped without loss.
    """
    name, part = _name(), "_part"
    by = ", ".join(map(_quoted, keys))
    spark.sql(
        f"CREATE TABLE {name} ({schema}, {part} int) USING parquet PARTITIONED BY ({part}) "
        f"CLUSTERED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION {_text(paths[0])}"
    )
    for no, path in enumerate(paths):
        spark.sql(f"ALTER TABLE {name} ADD PARTITION ({part}={no}) LOCATION {_text(path)}")
    return spark.table(name).drop(part)
