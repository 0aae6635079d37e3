"""Tabular sources and sinks: CSV, TSV, JSON lines, whole bundles of tables, SQL."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .toon import read_toon


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All cells as text, by the header; quoted fields may hold separators, doubled quotes and line ends."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, quote='"', escape='"', multiLine=True)


def read_tsv(spark: SparkSession, path: str, null: str = r"\N") -> DataFrame:
    """Unquoted tab-separated text with a header, split by line, so large files are read in parallel."""
    return spark.read.csv(path, header=True, inferSchema=False, sep="\t", quote="", nullValue=null)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; without a schema all values as text."""
    reader = spark.read.schema(schema) if schema else spark.read.option("primitivesAsString", True)
    return reader.json(path)


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's extension: csv, tsv, json, jsonl, toon or parquet; others raise ValueError."""
    ext = PurePosixPath(path).suffix.lower()
    if ext == ".csv":
        return read_csv(spark, path)
    if ext == ".tsv":
        return read_tsv(spark, path)
    if ext in (".json", ".jsonl"):
        return read_json(spark, path)
    if ext == ".toon":
        return read_toon(spark, path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def read_bundle(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Several tables by name."""
    return {name: read_table_file(spark, path) for name, path in paths.items()}


def export_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines below ``folder``, and a manifest with the schemas; written by the executors."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    rows = [(name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "table string, table_schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")


def import_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of export_bundle(), with their schemas. The manifest has a row per table."""
    from pyspark.sql.types import StructType

    manifest = spark.read.schema("table string, table_schema string").json(f"{folder}/_manifest").collect()
    return {r["table"]: spark.read.schema(StructType.fromJson(json.loads(r["table_schema"]))).json(f"{folder}/{r['table']}") for r in manifest}


def bundle_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) of a bundle."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **params) -> DataFrame:
    """A SQL query with named parameters over the given tables."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params) if params else spark.sql(text)
