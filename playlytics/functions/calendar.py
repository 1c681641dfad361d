"""Local calendar columns. Instants stay in ``dt``; local time is used for calendar fields only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS, MICROS_PER_DAY, TIME_BIN_LABELS, Settings


def decimal_hour(local: Column) -> Column:
    """Hour of the day with minutes and whole seconds as its fraction."""
    return F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600


def time_bin_number(hours: Column, settings: Settings = DEFAULTS) -> Column:
    """0..3 for the four bins; each begins ``time_bin_shift`` hours after a multiple of the edges, left-closed."""
    shifted = F.pmod(hours - settings.time_bin_shift, F.lit(24))
    first, second, third = settings.time_bin_edges
    return F.when(shifted < first, 0).when(shifted < second, 1).when(shifted < third, 2).otherwise(3)


def time_bin_label(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIME_BIN_LABELS)), number + 1)


def month_start(year: str | Column = "year", month: str | Column = "month") -> Column:
    return F.make_date(year, month, F.lit(1))


def calendar_features(plays: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    local = F.from_utc_timestamp("dt", settings.time_zone)
    hours = decimal_hour(local)
    weekday = F.weekday(local)
    number = time_bin_number(hours, settings)
    return plays.withColumns(
        {
            "year": F.year(local),
            "month": F.month(local),
            "day": F.dayofmonth(local),
            "weekday": weekday,
            "time_us": F.pmod(F.unix_micros(local), F.lit(MICROS_PER_DAY)),
            "hour": F.hour(local),
            "is_weekend": weekday >= 5,
            "dectime": hours,
            "timebin_no": number,
            "timebin": time_bin_label(number),
        }
    )


def filter_month(df: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of one month, or all of them when no month is chosen."""
    if year is None:
        return df
    return df.where((F.col("year") == year) & (F.col("month") == month))


def month_dimension(months: DataFrame) -> DataFrame:
    """(year, month, date, label) of the months in ``months``."""
    date = month_start()
    return months.select("year", "month").distinct().withColumns({"date": date, "label": F.date_format(date, "MMMM yyyy")})


def filter_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of the months in a (filtered) dimension table.

    On a table that is partitioned by month only the partitions are read which the dimension turns out to hold when the query runs.
    """
    return df.join(months.select("year", "month"), ["year", "month"], "left_semi")


def month_list(sessions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every local month from the last session's end back to the first session's start."""
    bounds = sessions.agg(F.max("ses_end").alias("newest"), F.min("ses_start").alias("oldest"))
    month = lambda c: F.trunc(F.from_utc_timestamp(c, settings.time_zone), "MM").alias(c)
    months = bounds.select(month("newest"), month("oldest")).select(
        F.explode(F.expr("sequence(newest, oldest, interval -1 month)")).alias("date")
    )
    return months.select("date", F.date_format("date", "MMMM yyyy").alias("label"))
