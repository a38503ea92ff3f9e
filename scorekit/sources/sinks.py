"""CSV and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header per file. An existing path is an error unless ``mode`` says otherwise."""
    df.write.option("header", True).mode(mode).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A one-column string frame as text lines."""
    df.write.text(path)
