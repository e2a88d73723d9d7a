"""Columns by position.

Operators read the columns they need by position, so that extra columns of any name, also of a
name that an operator uses itself, pass through. A wanted column is taken by its exact name, else
by its name in another case; if several match, the first one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_index(df: DataFrame, name: str) -> int:
    names = df.columns
    if name in names:
        return names.index(name)
    low = [c.lower() for c in names]
    if name.lower() in low:
        return low.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns named, under those names, whatever else the input holds."""
    at = [column_index(df, n) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(
        *[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)]
    )


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """The columns named as `k_<name>`, and the whole row, by position, as struct `_row`."""
    at = [column_index(df, n) for n in names]
    cells = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*cells).select(
        F.struct(*cells).alias("_row"), *[F.col(f"_c{i}").alias(f"k_{n}") for i, n in zip(at, names)]
    )


def unboxed(df: DataFrame, like: DataFrame, only: list[int] | None = None, **more: Column) -> DataFrame:
    """Rows of `boxed` with the columns of `like`, or those at the places `only`; `more` adds columns and replaces those of the same name."""
    taken = {m.lower() for m in more}
    names = like.columns
    keep = [i for i in (range(len(names)) if only is None else only) if names[i].lower() not in taken]
    return df.select(*[F.col(f"_row._c{i}") for i in keep], *more.values()).toDF(*[names[i] for i in keep], *more)


def only_boxed(df: DataFrame, places: list[int]) -> DataFrame:
    """Rows of `boxed` whose `_row` holds the columns at these places alone."""
    return df.withColumn("_row", F.struct(*[F.col("_row")[f"_c{i}"].alias(f"_c{i}") for i in places]))
