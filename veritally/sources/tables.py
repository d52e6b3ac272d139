"""Reading tables: typed CSV and Parquet, schema checks, session views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. Without a schema every column is text, under its header name;
    with one, the header must agree with it. Types are never guessed (`007` stays `007`)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


CORRUPT = "corrupt_row"


def read_csv_rows(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, corrupt: str = CORRUPT, header: bool = True
) -> DataFrame:
    """CSV, every row of it: the columns of the schema and, in `corrupt`, the text
    of a row that is damaged (a value that does not fit its type, too few or too many values),
    NULL for a sound one. A damaged row keeps the values that could be read, so nothing becomes NULL
    unsaid. Quoted values may hold line breaks, so a file is read by one task: deliver large tables
    in several files.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if corrupt in schema.fieldNames():
        raise ValueError(f"column {corrupt} exists already")
    reader = spark.read.option("header", header).option("multiLine", True).option("mode", "PERMISSIVE").option("columnPruning", False)
    reader = reader.option("columnNameOfCorruptRecord", corrupt).option("quote", '"').option("escape", '"')
    rows = reader.schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).csv(path)
    # Values that nobody asks for are not converted, and then not found to be damaged. So the corrupt
    # column depends on all others, in a way that never changes it.
    every = F.concat_ws("", *[F.col(f"`{name}`").cast("string") for name in schema.fieldNames()])
    return rows.withColumn(corrupt, F.coalesce(F.col(corrupt), F.when(F.length(every) < 0, F.lit(""))))


def split_corrupt(rows: DataFrame, corrupt: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """The sound rows without the extra column, and the damaged ones."""
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), rows.where(F.col(corrupt).isNotNull())


#: Types that text may stand for, the narrowest first; each with the text that it would be written as.
_WRITTEN = (
    ("boolean", lambda x: x.try_cast("boolean").cast("string")),
    ("int", lambda x: x.try_cast("int").cast("string")),
    ("bigint", lambda x: x.try_cast("bigint").cast("string")),
    ("double", lambda x: x.try_cast("double").cast("string")),
    ("date", lambda x: F.try_to_date(x, "yyyy-MM-dd").cast("string")),
    ("timestamp", lambda x: F.date_format(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")),
)


def lossless_types(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`column`, `type`, `n_values` and `n_nulls` for text columns: the narrowest type of which every
    value of the whole table is the written form, so that a cast loses nothing (`007`, `1.50` and
    `True` stay text). A column without values is text. One pass, one row of counters; no value is
    looked at by the driver."""
    columns = list(columns or rows.columns)
    measures: list[Column] = []
    for k, name in enumerate(columns):
        text = F.col(f"`{name}`").cast("string")
        measures += [F.count(text).alias(f"n_{k}"), F.count_if(text.isNull()).alias(f"nulls_{k}")]
        measures += [F.count_if(written(text).eqNullSafe(text) & text.isNotNull()).alias(f"{kind}_{k}") for kind, written in _WRITTEN]
    counts = rows.agg(*measures)
    reports = []
    for k, name in enumerate(columns):
        fits = [F.when((F.col(f"n_{k}") > 0) & (F.col(f"{kind}_{k}") == F.col(f"n_{k}")), F.lit(kind)) for kind, _ in _WRITTEN]
        reports.append(F.struct(F.lit(name).alias("column"), F.coalesce(*fits, F.lit("string")).alias("type"), F.col(f"n_{k}").alias("n_values"), F.col(f"nulls_{k}").alias("n_nulls")))
    return counts.select(F.explode(F.array(*reports)).alias("r")).select("r.*")


def read_parquet(spark: SparkSession, path: str | list[str], expected: T.StructType | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return conform(df, expected) if expected is not None else df


def conform(df: DataFrame, expected: T.StructType) -> DataFrame:
    """The expected columns in the expected types. A missing column is an error, and so is a
    type that no cast reaches; a value that does not fit its type becomes NULL. Looks at the
    schema only and reads no row."""
    missing = [field.name for field in expected if field.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(
        *[
            F.col(field.name)
            if df.schema[field.name].dataType == field.dataType
            else F.col(field.name).try_cast(field.dataType).alias(field.name)
            for field in expected
        ]
    )


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same columns and types."""
    return df.limit(0)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Name tables in the session, for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
