"""Named sources: a name -> table or path registry read with declared schemas.

A name stands for a table of Spark's catalog (bucketed tables keep their buckets this way) or for parquet files.

Reading with a declared schema keeps the scan lazy, lets Catalyst push the
``securityid`` / ``date`` predicates and column pruning into the parquet
reader, and gives a typed (possibly empty) relation even when no row matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaflow.sources import schemas

SOURCE_SCHEMAS = {
    "om_int_security_price": schemas.SECURITY_PRICE,
    "om_int_option_price": schemas.OPTION_PRICE,
}


@dataclass
class Catalog:
    """Maps source names to catalog tables, parquet paths or registered temp views.

    ``views`` lets tests and fixtures register DataFrames under a source name.
    """

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)
    views: dict[str, DataFrame] = field(default_factory=dict)
    persist: bool = False  # keep loaded sources in executor memory/disk for reuse

    def load(self, name: str) -> DataFrame:
        """The source ``name``; a second load returns the same DataFrame (and,
        with ``persist=True``, the same cached blocks)."""
        if name in self.views:
            return self.views[name]
        df = self._read(name)
        if self.persist:
            df = df.persist()
        self.views[name] = df
        return df

    def _read(self, name: str) -> DataFrame:
        if name not in SOURCE_SCHEMAS and name not in self.paths and name not in self.tables:
            raise ValueError(f"unknown source {name!r}")
        schema = SOURCE_SCHEMAS.get(name)
        if name in self.tables:
            if not self.spark.catalog.tableExists(self.tables[name]):
                raise FileNotFoundError(self.tables[name])
            df = self.spark.table(self.tables[name])
            return df.select(*schema.fieldNames()) if schema else df
        path = self.paths.get(name)
        if path is None:
            raise ValueError(f"no table or path registered for source {name!r}")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(path) from e
            raise

    def security_price(self) -> DataFrame:
        return self.load("om_int_security_price")

    def option_price(self) -> DataFrame:
        return self.load("om_int_option_price")

    def register(self, name: str, df: DataFrame) -> "Catalog":
        self.views[name] = df
        df.createOrReplaceTempView(name)
        return self


def file_states(spark: SparkSession, path: str) -> list[tuple]:
    """(name, bytes, time of change) of the files below a path, listed by Spark without being read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_micros("modificationTime"))
    return sorted(map(tuple, files.collect()))
