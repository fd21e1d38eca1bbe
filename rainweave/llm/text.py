"""Column expressions on texts, shared by the operators that stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_LETTERED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def spaced_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lettered_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; none for NULL."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_LETTERED + "+"), "")


def count_spaced_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(*columns: Column) -> Column:
    """64-bit key of a row by its content; equal for equal rows, never NULL."""
    return F.xxhash64(*columns)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a boolean column that filters use as it is.

    Tied to a row number, it is not replaced by its expressions further down: a filter on it would
    otherwise repeat all measures of a text within one condition.
    """
    return df.withColumn("_row_number", F.monotonically_increasing_id()).withColumn(name, value & (F.col("_row_number") >= 0)).drop("_row_number")
