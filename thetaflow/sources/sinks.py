"""Sinks and the CSV source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Most rows of a file.
FILE_ROWS = 4_000_000


def write_dataset(df: DataFrame, path: str, date_col: str = "date", cluster_by=("securityid", "date"),
                  file_rows: int = FILE_ROWS) -> None:
    """The 1DTE dataset as parquet, in partitions by ``year`` of ``date_col``.

    Within a year, rows are range-partitioned and sorted by ``cluster_by``, so readers skip files and row
    groups by their least and largest underlying, and the number of files follows the number of rows
    (``file_rows`` to a file at most), not of underlyings.  Only years that ``df`` holds are replaced; the others stay
    as they are.
    """
    keys = [c for c in cluster_by if c in df.columns]
    out = df.withColumn("year", F.year(F.col(f"`{date_col}`")))
    out = out.repartitionByRange("year", *keys).sortWithinPartitions("year", *keys)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows)
     .partitionBy("year").parquet(path))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, by=("securityid", "date")) -> None:
    """A table of Spark's catalog in ``buckets`` files, one each, by a hash of ``by``.

    Tables with equal buckets join and group by ``by`` (and more columns) without moving a row.  The
    hash takes all of ``by``: an underlying with a third of all quotes is spread over all buckets.
    """
    (df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
     .format("parquet").option("path", path).saveAsTable(table))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row and no index column (one file per task)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_with_dates(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                        date_cols=("date",), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV source.

    With a schema it is applied as is, and a cell that does not fit raises.
    Without one Spark infers the types over all rows, so a column keeps all
    its values: as text if they have no type in common.  ``date_cols`` that come
    out as text are parsed with ``date_format``; a cell that is no date raises.
    """
    reader = spark.read.option("header", True).option("dateFormat", date_format).option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    for name in date_cols:
        if name in df.columns and not isinstance(df.schema[name].dataType, T.DateType):
            df = df.withColumn(name, F.to_date(F.col(f"`{name}`").cast("string"), date_format))
    return df


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType,
                     date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """S7 with a table of rejects: (rows that fit ``schema``, ``(file, line)`` of those that don't).

    A line is rejected as a whole if a cell does not fit its column or their number is wrong; none is lost.
    """
    whole = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    raw = (spark.read.schema(whole).option("header", True).option("dateFormat", date_format).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_line").csv(path))
    cells = [F.col(f"`{f.name}`") for f in schema.fields]
    # The parser checks the cells that are read: the condition, which always holds, reads all of them.
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file")).where(F.concat_ws("", *[x.cast("string") for x in cells]) >= "")
    return (rows.where(F.col("_line").isNull()).select(*cells),
            rows.where(F.col("_line").isNotNull()).select(F.col("_file").alias("file"), F.col("_line").alias("line")))
