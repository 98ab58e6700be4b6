"""Selections by kind of column, seed, settings path and canonical key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def scalar_fields(df: DataFrame) -> DataFrame:
    """df without nested columns; the scan then reads only the others."""
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))))


def sampled(seed: Column, first: int | None) -> Column:
    """Whether a shot's details are kept: those of the first so many seeds, or of all."""
    return F.lit(True) if first is None else seed < first


def first_shots(seed: Column, first: int, shots: int) -> Column:
    """The shots of a run that is cut to so many: by seed, so that any order of rows gives the same."""
    return (seed >= first) & (seed < first + shots)


def matches(path: Column, pattern: str) -> Column:
    """Whether a dotted settings path fits a pattern, whose `*` stands for any part of one name."""
    names = [".*".join(re.escape(x) for x in name.split("*")).replace(".*", "[^.]*") for name in pattern.split(".")]
    return path.rlike("^" + r"\.".join(names) + "$")


def assigned(path: Column, assignments: list[tuple[str, object]]) -> Column:
    """The value that a list of (pattern, value) gives a path; a later assignment wins."""
    out = F.lit(None)
    for pattern, value in assignments:
        out = F.when(matches(path, pattern), F.lit(value)).otherwise(out)
    return out


def canonical_order(identity: Column) -> Column:
    """What rows are sorted by so that order does not depend on any collation: the bytes of their identity."""
    return F.encode(identity, "UTF-8")
