"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_START = "1900-01-01"
OPEN_END = "9999-12-31"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_hash(*cols: str | Column) -> Column:
    """SHA-256 over the columns' texts joined by a bar; a null counts as empty text and keeps its place."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in cols)), 256)


surrogate_key = row_hash


def typed(name: str, kind: str) -> Column:
    """The column as ``kind``; what can't be read as such becomes null."""
    return F.col(name).try_cast(kind).alias(name)


def first_given(canonical: str, *aliases: str) -> Column:
    return F.coalesce(*(F.col(c) for c in (canonical, *aliases))).alias(canonical)


def date_key(day: str | Column) -> Column:
    return F.date_format(col(day), "yyyyMMdd").cast("int")


def masked(name: str | Column, key: str) -> Column:
    """A stable token in place of a personal value; without the secret key small numbers can't be tried out."""
    inner = F.sha2(F.concat(F.lit(key), F.lit("|"), F.coalesce(col(name).cast("string"), F.lit(""))), 256)
    return F.sha2(F.concat(F.lit(key), F.lit("|"), inner), 256)


def net(amount: str, fee: str) -> Column:
    return F.col(amount) - F.coalesce(F.col(fee), F.lit(0))
