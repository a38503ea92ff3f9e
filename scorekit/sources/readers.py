"""CSV and text sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import split_fields
from ..staging import materialize, new_path
from .contracts import SCORING_COLUMNS, TRAINING_COLUMNS, double_schema, keyed_schema, string_schema

_BAD_ROWS = ("null", "drop", "fail")

# The lattice of types that text is read as, narrowest first, by the bit that says a value fits. A column has the first
# type whose bit all its values have; what fits none, and a column without values, is a string.
TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|Inf(inity)?)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}"


def _bit(name: str) -> int:
    return 1 << TYPES.index(name)


def fitting_types(text: Column) -> Column:
    """The bits of the :data:`TYPES` that a text can be read as; null for a null. A whole number is a double, too."""
    whole, wide, number = _bit("int") | _bit("bigint") | _bit("double"), _bit("bigint") | _bit("double"), _bit("double")
    day = text.rlike(_DATE) & text.try_cast("date").isNotNull()
    time = text.rlike(_TIME) & text.try_cast("timestamp").isNotNull()
    # A cast that fails costs as much as hundreds of patterns, so only what looks right is cast.
    large = F.when(text.try_cast("int").isNotNull(), whole).when(text.try_cast("bigint").isNotNull(), wide).otherwise(number)
    mask = F.when(text.rlike(_WHOLE), F.when(F.length(text) < 10, whole).otherwise(large)).when(text.rlike(_NUMBER), number).when(day, _bit("date") | _bit("timestamp")).when(time, _bit("timestamp"))
    mask = mask.when(F.lower(text).isin("true", "false"), _bit("boolean")).otherwise(0)
    return F.when(text.isNotNull(), mask)


def inferred_types(text: DataFrame) -> DataFrame:
    """``column, type, count`` and, for each of :data:`TYPES`, ``n_<type>``: how many values of each column of text there are,
    how many fit each type, and the narrowest type that all fit. One pass, in which a column's values meet in the lattice by
    a bitwise AND."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(n).alias("column"), fitting_types(F.col(_quoted(n))).alias("bits")) for i, n in enumerate(text.columns)]
    met = text.select(F.inline(F.array(*cells))).groupBy("i", "column").agg(
        F.count("bits").alias("count"), F.bit_and("bits").alias("all"), *[F.count(F.when(F.col("bits").bitwiseAND(_bit(t)) != 0, 1)).alias(f"n_{t}") for t in TYPES])
    kind = F.lit("string")
    for t in reversed(TYPES):
        kind = F.when(F.col("all").bitwiseAND(_bit(t)) != 0, t).otherwise(kind)
    return met.select("i", "column", kind.alias("type"), "count", *[f"n_{t}" for t in TYPES]).orderBy("i").drop("i")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, column types inferred as in :func:`inferred_types`. The file is read once: its text is staged by
    columns, which both the inference and the result read."""
    text = materialize(spark.read.option("header", True).csv(path), "text")
    if not text.columns:
        return text
    types = {r["column"]: r["type"] for r in inferred_types(text).collect()}  # one row per column
    return text.select(*[F.col(_quoted(n)).cast(types.get(n, "string")).alias(n) for n in text.columns])


def _parsed(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """Every field in its type, converted once by the parser, and in ``_line`` the text of a row that has the wrong number
    of fields or one that does not fit. The parser leaves out fields that no one asks for and could not judge them, so
    callers must filter by :func:`_whole`."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_line")
    if header:
        reader = reader.option("enforceSchema", False)
    return reader.schema(T.StructType([*schema.fields, T.StructField("_line", T.StringType(), True)])).csv(path)


def _whole(schema: T.StructType) -> Column:
    """True, and asks for all fields."""
    return F.hash(*[F.col(_quoted(n)) for n in schema.names]) >= -(2**31)


def read_typed(spark: SparkSession, path: str, schema: T.StructType, on_bad: str = "fail", header: bool = True) -> DataFrame:
    """CSV under an explicit schema.

    ``on_bad`` decides about short, long and non-numeric rows: ``fail``, the default, raises, ``drop`` leaves the row
    out, ``null`` pads, cuts off or nulls the field. Rows are judged as a whole, whichever columns a query reads. With a
    header, its names must equal the schema's, in order.
    """
    if on_bad not in _BAD_ROWS:
        raise ValueError(f"on_bad must be one of {sorted(_BAD_ROWS)}")
    if on_bad == "null":
        reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
        return (reader.option("enforceSchema", False) if header else reader).schema(schema).csv(path)
    bad = F.col("_line").isNotNull()
    if on_bad == "fail":
        message = F.concat(F.lit(f"bad value or number of fields in {path}: "), F.substring("_line", 1, 200))
        bad = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    return _parsed(spark, path, schema, header).filter(_whole(schema) & ~bad).select(*[_quoted(n) for n in schema.names])


@dataclass(frozen=True)
class Quarantined:
    """The rows of a file that fit its schema, those that do not as ``file, line, reason``, and how many there are."""

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def read_quarantined(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> Quarantined:
    """Part a CSV's good rows from its bad ones in one pass over it.

    Both are staged by that pass, which also counts them; a field is converted once. Only the rejected lines are looked at
    again, to say what is wrong with each: the number of its fields, or the first field that does not fit its type.
    """
    rows = _parsed(spark, path, schema, header).filter(_whole(schema)).withColumn("_rejected", F.col("_line").isNotNull())
    counts = Observation()
    rows = rows.withColumn("_file", F.when(F.col("_rejected"), F.input_file_name()))
    staged = new_path(spark, "quarantine")
    rows.observe(counts, F.count("*").alias("rows"), F.count("_line").alias("rejected")).write.partitionBy("_rejected").parquet(staged)
    kinds = T.StructType([*rows.drop("_rejected").schema.fields, T.StructField("_rejected", T.BooleanType())])
    both = spark.read.schema(kinds).parquet(staged)
    good = both.where("NOT _rejected").select(*[_quoted(n) for n in schema.names])
    texts = ", ".join(f"{_quoted(n)} string" for n in [*schema.names, "_wrong"])
    fields = both.where("_rejected").select(
        F.col("_file").alias("file"), F.col("_line").alias("line"),
        F.from_csv("_line", texts, {"columnNameOfCorruptRecord": "_wrong"}).alias("f"))
    unfit = [F.when(F.col("f")[x.name].isNotNull() & F.col("f")[x.name].try_cast(x.dataType).isNull(),
                    F.concat(F.lit(f"{x.name} is no {x.dataType.simpleString()}: "), F.col("f")[x.name])) for x in schema.fields]
    reason = F.when(F.col("f._wrong").isNotNull(), F.lit(f"not {len(schema.fields)} fields")).otherwise(F.coalesce(*unfit, F.lit("does not fit")))
    seen = counts.get
    return Quarantined(good, fields.select("file", "line", reason.alias("reason")), seen["rows"] - seen["rejected"], seen["rejected"])


def read_training_text(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """The training file with every column as string."""
    return read_typed(spark, path, string_schema(TRAINING_COLUMNS), on_bad)


def read_scoring_text(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """The scoring file with every column as string."""
    return read_typed(spark, path, string_schema(SCORING_COLUMNS), on_bad)


def read_scoring(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """The scoring file with every column as double."""
    return read_typed(spark, path, double_schema(SCORING_COLUMNS), on_bad)


def read_scoring_keyed(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """The scoring file with a row id and a user id in front."""
    return read_typed(spark, path, keyed_schema(SCORING_COLUMNS), on_bad)


def drop_lines_containing(lines: DataFrame, token: str, column: str = "value") -> DataFrame:
    """Leave out every line that holds ``token`` anywhere, not just a header."""
    return lines.filter(~F.contains(F.col(column), F.lit(token)))


def bind_fields(df: DataFrame, fields: Column | str, schema: T.StructType) -> DataFrame:
    """Typed frame from rows held as arrays of text: field *i* becomes column *i* of ``schema``.

    A missing field is null; text that does not fit the type raises.
    """
    cells = F.col(fields) if isinstance(fields, str) else fields
    rows = df.select(cells.alias("_cells"))
    return rows.select(*[F.get("_cells", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def rows_to_frame(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of ``df`` under an explicit schema, bound by position and cast; the widths must match."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns do not fit a schema of {len(schema.fields)}")
    return df.toDF(*schema.names).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def rename_positional(df: DataFrame, *names: str) -> DataFrame:
    """Column names by position."""
    return df.toDF(*names)


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name, age`` as ``name string, age int``; the age is trimmed and must be a whole number."""
    fields = split_fields("value")
    return spark.read.text(path).select(
        fields[0].alias("name"), F.trim(F.get(fields, F.lit(1))).cast("int").alias("age")
    )
