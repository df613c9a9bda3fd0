"""Models as versioned tables (K11): written whole, then named as the current one, and read by version."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import path_exists


class ModelStore:
    """Tables of named models under a folder that all executors reach.

    ``save`` writes a new version beside the others and then appends its number to the model's list of
    versions; a reader takes the largest number there, so it never sees a version that is half written,
    and an older version can be read as long as it is kept.  One writer a model at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first; none for an unknown model."""
        folder = f"{self.path}/{name}/versions"
        if not path_exists(self.spark, folder):
            return []
        return [r.version for r in self.spark.read.schema("version bigint").parquet(folder).distinct().orderBy("version").collect()]

    def save(self, name: str, tables: Mapping[str, DataFrame]) -> int:
        """Stores the tables of a trained model as the next version and returns its number."""
        version = max(self.versions(name), default=0) + 1
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}/{table}")
        row = self.spark.createDataFrame([(version,)], "version bigint")
        row.write.mode("append").parquet(f"{self.path}/{name}/versions")
        return version

    def load(self, name: str, *tables: str, version: int | None = None) -> tuple[DataFrame, ...]:
        """The named tables of a version (default: the last complete one)."""
        known = self.versions(name)
        if not known or version is not None and version not in known:
            raise ValueError(f"model {name} has no version {version or ''}".rstrip())
        version = version or known[-1]
        return tuple(self.spark.read.parquet(f"{self.path}/{name}/version={version}/{t}") for t in tables)

    def history(self, name: str) -> DataFrame:
        """(version, is_current) of the complete versions."""
        last = max(self.versions(name), default=0)
        rows = [(v, v == last) for v in self.versions(name)]
        return self.spark.createDataFrame(rows, "version bigint, is_current boolean").orderBy(F.col("version"))
