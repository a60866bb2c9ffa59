"""Column functions on attribute values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(c: Column) -> Column:
    """Without ASCII punctuation, in lower case; null becomes empty. White space stays."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\p{Punct}", ""))


def concat_key(*cols: Column) -> Column:
    """Values joined without a separator."""
    return F.concat(*cols)


def unpadded(key: Column) -> Column:
    """Equal for two keys exactly if they are equal once padded with zeros to a common length."""
    return F.rtrim(key, F.lit("0"))


def padded(key: Column, length: int | Column) -> Column:
    """Padded with zeros to a common length: the order of keys."""
    return F.rpad(key, length, "0") if isinstance(length, int) else F.call_function("rpad", key, length, F.lit("0"))


def headless(value: Column) -> Column:
    """The value without its first character, comparable to unpadded() keys."""
    return unpadded(F.substring(value, 2, 2**31 - 1))


def row_string(*cols: Column) -> Column:
    """A row as one string with '|' between values, which normalised values don't hold."""
    return F.concat_ws("|", *cols)


def row_values(row: Column) -> Column:
    return F.split(row, r"\|", -1)
