"""Results written as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts, each with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def csv_round_trip(df: DataFrame, name: str) -> DataFrame:
    """df written as CSV in the session's shared folder and read again, as strings."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write_csv(df, path)
    return df.sparkSession.read.option("header", True).csv(path, schema=", ".join(f"{c} string" for c in df.columns))
