"""Statistics that roll up: kept per month, say, they are merged to years or the whole history without another look at the plays.

*Distinct counts* are exact. The ids of a group are bits of bitmaps of 32,768 ids each, of which a group holds those that it has ids
in; merging is a bitwise or. A bitmap takes 4 KB, so ids should be numbered densely, as song and session numbers are. A missing id counts as one.

*Medians* come from quantile sketches (KLL). Merged or not, the rank of a sketch's median is off by less than ``rank_bound(k)`` with 99 %
probability (about 2.3 / k^0.97, the sketch's documented error), whatever the number of values; up to about ``k`` values it is exact. A sketch holds a few
times ``k`` numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_SIZE = 1_000
RANK_BOUND = 0.01  # of a median at ``SKETCH_SIZE``: above three times ``rank_bound``, so it is as good as never passed


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], per: Sequence[str]) -> DataFrame:
    """(per, key, bucket, bits, has_null): the ids in each of the columns ``keys``, in one pass and one shuffle.

    Rows are combined before the shuffle, so a hot group sends one bitmap per task and bucket.
    """
    named = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("bigint").alias("id")) for k in keys])
    listed = df.select(*per, F.inline(named))
    return listed.groupBy(*per, "key", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"), F.bool_or(F.col("id").isNull()).alias("has_null")
    )


def merge_bitmaps(bitmaps: DataFrame, per: Sequence[str]) -> DataFrame:
    """The bitmaps of the coarser groups ``per``."""
    return bitmaps.groupBy(*per, "key", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.bool_or("has_null").alias("has_null"))


def count_distinct(bitmaps: DataFrame, keys: Sequence[str], per: Sequence[str]) -> DataFrame:
    """(per, n_<key>): the number of distinct ids of each group of the bitmaps; groups without one count 0."""
    own = lambda k: F.col("key") == k
    number = [
        F.coalesce(F.sum(F.when(own(k), F.bitmap_count("bits") + F.col("has_null").cast("int"))), F.lit(0)).alias(f"n_{k}")
        for k in keys
    ]
    return bitmaps.groupBy(*per).agg(*number)


def rank_bound(k: int) -> float:
    """The share of the values by which a quantile's rank is off at most, with 99 % probability."""
    return 2.296 / k**0.9723


def sketches(df: DataFrame, value: str, per: Sequence[str], k: int = SKETCH_SIZE) -> DataFrame:
    """(per, sketch, n) of a whole-numbered column; missing values take no part."""
    return df.groupBy(*per).agg(
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch"), F.count(value).alias("n")
    )


def merge_sketches(found: DataFrame, per: Sequence[str], k: int = SKETCH_SIZE) -> DataFrame:
    return found.groupBy(*per).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantile(share: float = 0.5, sketch: str = "sketch", n: str = "n") -> Column:
    """The quantile of a sketch, NULL for one without values."""
    return F.when(F.col(n) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(share))))


def rank_error(counts: DataFrame, found: DataFrame, value: str, guess: str, per: Sequence[str], share: float = 0.5) -> DataFrame:
    """(per, guess, error): how far the rank of ``guess`` lies from ``share`` among counted values (per, value, n)."""
    part = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0)) / F.sum("n")
    joined = counts.join(found.select(*per, guess), list(per)) if per else counts.withColumn(guess, found.select(guess).scalar())
    return (
        joined.groupBy(*per, guess)
        .agg(part(F.col(value) < F.col(guess)).alias("below"), part(F.col(value) <= F.col(guess)).alias("upto"))
        .select(*per, guess, F.greatest(F.lit(0.0), F.col("below") - share, share - F.col("upto")).alias("error"))
    )
