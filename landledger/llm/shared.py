"""Small things that several operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import clear, materialise, new_path, shared_dir  # noqa: F401

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
WORD_BREAKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def nested(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns as one struct, so that added columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def numbered(df: DataFrame) -> DataFrame:
    """Columns named c0, c1, ...: Python functions over Arrow take them by place, whatever they are called (a dot in a name reads as a path)."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])
