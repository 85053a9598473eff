"""Strict readers: closed schemas, row numbers, unique ids, files checked by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    """Columns or ids are not what the reader was told to expect."""


def read_parquet(spark: SparkSession, path: str, columns: list[str], row_index: bool = False) -> DataFrame:
    """Columns must be exactly ``columns``, in order."""
    df = spark.read.parquet(path)
    if df.columns != columns:
        raise SchemaMismatch(f"expected {columns}, found {df.columns}")
    return df.select("*", F.col("_metadata.row_index").alias("row_index")) if row_index else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, id_column: str | None = None) -> DataFrame:
    """Every line must be an object of the schema; ids must be unique."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    if id_column:
        repeated = df.groupBy(id_column).count().where("count > 1").first()
        if repeated:
            raise SchemaMismatch(f"{id_column} {repeated[0]!r} repeats")
    return df


def read_tolerant_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that are no object of the schema."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad IS NULL").select("r.*").drop("_bad"), rows.where("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, sha256`` of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_canonical_jsonl(df: DataFrame, path: str, id_column: str) -> None:
    """Rows sorted by id, keys sorted by name, one file; an existing target is an error."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(id_column).select(line.alias("value")).coalesce(1).write.mode("errorifexists").text(path)
