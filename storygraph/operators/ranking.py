"""Row numbers over keys that may hold any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column], out: str) -> DataFrame:
    """Adds out: the number of a row, from 1, in the order (*chunk, *order) within its keys.

    Two levels, so that no task orders all rows of a key: rows are counted by chunk, the counts are added up, and only the rows of a
    chunk are ordered together.
    """
    names = [f"_chunk{i}" for i in range(len(chunk))]
    df = df.withColumns(dict(zip(names, chunk, strict=True)))
    sizes = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, *names)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, *names)]
    inner = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    joined = df.join(starts, same).withColumn(out, (F.col("_start") + inner).cast("int"))
    return joined.drop("_start", *names, *[f"_of_{c}" for c in (*keys, *names)])


def summed_before(df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before a row, in the order (*chunk, *order) within its keys. Two levels, as in `numbered`."""
    names = [f"_chunk{i}" for i in range(len(chunk))]
    df = df.withColumns(dict(zip(names, chunk, strict=True)))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, *names).agg(F.sum(value).alias("_sum"))
    bases = sums.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, *names)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, *names)]
    inner = F.sum(value).over(Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = df.join(bases, same).withColumn(out, F.col("_base") + F.coalesce(inner, F.lit(0)))
    return joined.drop("_base", *names, *[f"_of_{c}" for c in (*keys, *names)])
