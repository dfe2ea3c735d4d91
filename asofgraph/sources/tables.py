"""Typed tables from CSV, JSON lines, JSON arrays and Parquet, and the sinks that mirror them."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofgraph.operators.contracts import TABLES


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By suffix: csv, jsonl or ndjson, json (an array), parquet. With a schema, CSV identifiers keep their zeros."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind in ("jsonl", "ndjson"):
        return reader.json(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported table format: {path}")


def read_contract_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a contract. Text formats are read as strings and cast, so a bad cell is null and countable."""
    contract = TABLES[table]
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raw = read_table(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in contract.types]))
    return contract.cast(raw)


def unfloat_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: one notion of missing at the border."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv_bundle(frames: dict[str, DataFrame], folder: str, required: tuple[str, ...] = ()) -> None:
    """One single-file CSV folder a diagnostic (each a small aggregate); a missing one is an error before anything is written."""
    if missing := set(required) - set(frames):
        raise ValueError(f"diagnostics missing: {sorted(missing)}")
    for name, frame in frames.items():
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_json(value: object, path: str) -> None:
    """Atomic on the driver: a temporary file, flushed, then renamed. NaN is refused."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, path)


def record_json(df: DataFrame) -> DataFrame:
    """One JSON string a row, nulls kept, timestamps in ISO form."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
