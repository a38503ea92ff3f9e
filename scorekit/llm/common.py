"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words: runs without ASCII white space, and runs of ASCII letters, digits and anything beyond ASCII.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# A side of at most so many bytes is sent to every executor; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text without other characters takes the engine's faster way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often, and inside whichever lambda, it is used."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id but not a text; rows alike in both get the same key."""
    return F.xxhash64(doc_id, F.isnull(doc_id), text)


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path, for loops that drop a round once the next is written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcasting if ``rows`` rows of ``row_bytes`` stay within :data:`BROADCAST_BYTES`."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
