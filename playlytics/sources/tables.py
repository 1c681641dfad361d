"""Table and query readers and the checks applied while reading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.config import BOOKKEEPING_PREFIX, TRAIT_COLUMNS


def quote_name(name: str) -> str:
    """Quote every part of a dotted table name; quotes inside it are dropped."""
    parts = name.replace('"', "").replace("`", "").split(".")
    return ".".join(f"`{part}`" for part in parts)


def drop_prefixed(df: DataFrame, prefix: str = BOOKKEEPING_PREFIX) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table or view without its bookkeeping columns."""
    df = spark.table(quote_name(name))
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return drop_prefixed(df)


def read_files(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return drop_prefixed(df.select(*columns) if columns else df)


def read_jdbc(
    spark: SparkSession,
    url: str,
    name: str,
    columns: Sequence[str] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table of an external database; projections and filters are pushed into its scan.

    For a large table pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``, so that
    it is read by many tasks.
    """
    table = ".".join(f'"{part}"' for part in name.replace('"', "").split("."))
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    return drop_prefixed(df.select(*columns) if columns else df)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores dealt to a task for each core, for work that costs more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def run_query(spark: SparkSession, query: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """A SQL query with named parameters (``:name``) over registered tables."""
    return spark.sql(query, args=dict(params or {}))


def drop_null_matches(matches: DataFrame, key: str = "g_id") -> DataFrame:
    return matches.dropna(subset=[key])


def vector_width(df: DataFrame, column: str = "embedding") -> int:
    """The one width of all vectors; vectors of several widths are an error."""
    width = F.when(F.col(column).isNotNull(), F.size(column))
    least, most = df.agg(F.min(width), F.max(width)).first()
    if least is None:
        raise ValueError(f"no vector in column {column}")
    if least != most:
        raise ValueError(f"vectors of {least} to {most} elements in column {column}: declare the width")
    return least


def fixed_width_vectors(df: DataFrame, width: int, element: str = "double", column: str = "embedding") -> DataFrame:
    """Cast the vectors to one element type; a NULL, a NULL element or a wrong width stops the job."""
    ok = (F.size(column) == width) & ~F.exists(column, lambda x: x.isNull())
    checked = F.when(ok, F.col(column).cast(f"array<{element}>")).otherwise(
        F.raise_error(F.lit(f"{column} is not a vector of {width} elements")).cast(f"array<{element}>")
    )
    return df.withColumn(column, checked)


def vector_check(df: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """Counts of usable vectors, wrong widths and missing vectors."""
    size = F.size(column)
    return df.agg(
        F.count(F.when(size == width, 1)).alias("n_ok"),
        F.count(F.when(F.col(column).isNotNull() & (size != width), 1)).alias("n_wrong_width"),
        F.count(F.when(F.col(column).isNull(), 1)).alias("n_missing"),
    )


def trait_outputs(df: DataFrame, columns: Sequence[str] = TRAIT_COLUMNS) -> DataFrame:
    """Pack the trait columns into one array in trait order."""
    return df.select("id", F.array(*[F.col(c).cast("double") for c in columns]).alias("outputs"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Match keys that occur more than once, each of which multiplies the plays joined to it."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def cluster_letter(cluster: Column) -> Column:
    """A to Z, then AA, AB and so on: up to seven letters name every integer."""
    rest, letters = cluster.cast("bigint"), []
    for _ in range(7):
        letters.insert(0, F.when(rest >= 0, F.char(rest % 26 + 65)).otherwise(""))
        rest = F.floor(rest / 26) - 1
    return F.when(cluster.isNotNull(), F.concat(*letters))


def cluster_labels(song_clusters: DataFrame) -> DataFrame:
    """Index and letter of every cluster that has songs."""
    found = song_clusters.where(F.col("cluster").isNotNull()).select(F.col("cluster").cast("int")).distinct()
    return found.withColumn("cluster_label", cluster_letter(F.col("cluster")))
