"""Column expressions shared by the queries. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_flag(label: Column | str) -> Column:
    """Label text to boolean. Text that is no boolean becomes NULL, not an error."""
    column = F.col(label) if isinstance(label, str) else label
    return column.try_cast("boolean")


def count_true(flag: Column) -> Column:
    """Rows where the flag holds; NULL counts as not holding. NULL over no rows."""
    return F.sum(F.when(flag, 1).otherwise(0))


def rate_pct(part: Column, whole: Column) -> Column:
    """Percentage as a double, so that every engine gives the same value."""
    return (F.lit(100.0) * part).cast("double") / whole


#: Base64 text to bytes, as SQL over `{x}`: NULL for text that is NULL, empty or not base64.
PAYLOAD_BYTES_SQL = "nullif(try_to_binary(btrim({x}, ' \t\r\n'), 'base64'), X'')"


def payload_bytes(payload: str) -> Column:
    """Base64 text of a column to bytes, by PAYLOAD_BYTES_SQL: the one rule, in the plan."""
    return F.expr(PAYLOAD_BYTES_SQL.format(x=f"`{payload}`"))
