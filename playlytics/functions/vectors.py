"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_distance(a: Column, b: Column) -> Column:
    """Length of the difference; the difference is taken in double precision."""
    return l2_norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def normalise_rows(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors; a zero vector has no direction, so its elements become NULL."""
    v = F.col(column)
    # array_repeat evaluates the norm once per row; inside the lambda it would run once per element
    norms = F.array_repeat(l2_norm(v), F.size(v))
    return df.withColumn(column, F.zip_with(v, norms, lambda x, n: F.try_divide(x.cast("double"), n)))


def normalise_columns(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Compatibility form: divide each element by the norm of its position over *all* rows.

    A position that is zero everywhere becomes NULL. Sums are combined per task, so a batch of any
    length shuffles ``width`` partial sums per task.
    """
    norms = (
        df.select(F.posexplode(column).alias("pos", "value"))
        .groupBy("pos")
        .agg(F.sqrt(F.sum(F.col("value").cast("double") * F.col("value").cast("double"))).alias("norm"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda s: s["norm"]).alias("norms"))
    )
    scaled = F.zip_with(column, "_norms", lambda x, n: F.try_divide(x.cast("double"), n))
    return df.withColumn("_norms", norms.scalar()).withColumn(column, scaled).drop("_norms")

