"""Columns made in steps that stay steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **new: Column) -> DataFrame:
    """The frame with these columns, added or in the place of those of the same name, out of a generator.

    The optimizer neither pushes later filters through a generator nor writes its columns' expressions into later ones. So expressions
    that use each other several times over stay small enough to be compiled.
    """
    made = F.inline(F.array(F.struct(*[c.alias(f"_made_{n}") for n, c in new.items()])))
    out = df.select("*", made)
    kept = [F.col(f"_made_{c}").alias(c) if c in new else F.col(c) for c in df.columns]
    return out.select(*kept, *[F.col(f"_made_{n}").alias(n) for n in new if n not in df.columns])
