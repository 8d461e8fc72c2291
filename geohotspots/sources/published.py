"""Published sets of artifacts: whole or not at all.

A set is written below a folder of its own version, and only then a line is added to the
manifest. Readers ask the manifest for the newest set, so a run that fails half-way leaves
nothing to read, and a running reader keeps the set it resolved. Lines are added as new
files, which a committer moves into place whole; two runs that finish together both stand,
and every reader prefers the same one. Old versions stay until they are removed by age.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geohotspots.sources import readers

MANIFEST = "sequence long, version string, paths map<string,string>"


def _manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{out_dir}/manifest")


def _newest(spark: SparkSession, out_dir: str):
    """The manifest line with the largest sequence and version; None without a manifest."""
    newest = F.max(F.struct("sequence", "version"))
    try:
        lines = _manifest(spark, out_dir)
        line = lines.join(lines.agg(newest.alias("at")).select("at.*"), ["sequence", "version"]).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return line


def publish(
    spark: SparkSession, out_dir: str, artifacts: Mapping[str, Callable[[str], str]]
) -> dict[str, str]:
    """Write each artifact with its function, which gets the folder of the new version and
    returns a path below it, then add the set to the manifest. Returns the paths by name."""
    version = uuid.uuid4().hex
    folder = f"{out_dir}/versions/{version}"
    paths = {name: write(folder) for name, write in artifacts.items()}
    below = {name: path.removeprefix(f"{out_dir}/") for name, path in paths.items()}
    last = _newest(spark, out_dir)
    line = [((last["sequence"] if last else 0) + 1, version, below)]
    spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").json(f"{out_dir}/manifest")
    return paths


def resolve(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """Paths of the newest published set. The folder may have been moved as a whole."""
    line = _newest(spark, out_dir)
    if line is None:
        raise FileNotFoundError(f"no published artifacts below {out_dir}")
    return {name: f"{out_dir}/{path}" for name, path in line["paths"].items()}


class Published(NamedTuple):
    """Tables of one published set, typed."""

    zones: DataFrame
    hotspots: DataFrame
    peak_windows: DataFrame
    report: DataFrame


def read_published(spark: SparkSession, out_dir: str, *, with_risk: bool = True) -> Published:
    """All tables of the newest set, from one look at the manifest: they fit each other."""
    paths = resolve(spark, out_dir)
    return Published(
        readers.read_zones(spark, paths["csv"], with_risk=with_risk),
        readers.read_features(spark, paths["features"]),
        readers.flatten_peak_windows(spark, paths["peak_windows"], multi_line=bool(paths.get("geojson"))),
        readers.read_report(spark, paths["report"]),
    )
