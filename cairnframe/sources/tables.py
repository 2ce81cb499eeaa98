"""Scans and sinks: explicit schemas, bad rows kept apart, keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parquet_rows(spark: SparkSession, folder: str, name: str, columns: list[str], row: str) -> DataFrame:
    """Columns of a table and the place of each row: files by path, rows as they stand in them."""
    whole = parquet(spark, folder, name)
    paths = sorted(r[0] for r in whole.select("_metadata.file_path").distinct().collect())
    rows = whole.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    if len(paths) < 2:
        return rows.select(*columns, F.col("_index").alias(row))
    files = spark.createDataFrame(list(enumerate(paths)), "_file long, _path string")
    return rows.join(F.broadcast(files), "_path").select(*columns, (F.shiftleft("_file", 40) + F.col("_index")).alias(row))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "|", encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Rows of delimited text and, apart from them, the lines that do not fit the schema."""
    whole = not encoding.upper().startswith(("UTF-8", "US-ASCII", "ISO-8859"))  # lines of wide characters cannot be found by bytes
    rows = spark.read.csv(path, schema=f"{schema}, _corrupt string", sep=separator, encoding=encoding, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=whole)
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("_corrupt")


def records(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON records, one to a line or one array to a file; a record that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=not lines)


def last_predictions(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def list_columns(df: DataFrame) -> list[str]:
    """Text columns in which every value holds `[`; found in one pass."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not text:
        return []
    row = df.agg(*[F.min(F.coalesce(F.col(f"`{c}`").contains("["), F.lit(False)).cast("int")).alias(c) for c in text]).first()
    return [c for c in text if row[c] == 1]


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000) -> None:
    """Parquet in folders by column; hot values are spread over several files by the rebalancing of partitions."""
    df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
