"""Written tables: shared scratch folder, partitioned outputs, saved models and graphs."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}  # of applications whose session does not name a folder
# the open scopes of this thread: application and paths
_scopes: ContextVar[tuple[tuple[str, list[str]], ...]] = ContextVar("scopes", default=())


def use_scratch_folder(spark: SparkSession, folder: str) -> None:
    """Name the shared folder for a session that was made without ``spark.checkpoint.dir``."""
    _roots[spark.sparkContext.applicationId] = folder


def has_scratch_folder(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.applicationId in _roots


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _roots.get(app)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{root.rstrip('/')}/playlytics-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    own = _own_scopes(spark)
    if own:
        own[-1].append(path)
    return path


def _own_scopes(spark: SparkSession) -> list[list[str]]:
    return [paths for app, paths in _scopes.get() if app == spark.sparkContext.applicationId]


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside when the block ends, with its results stored elsewhere."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), (spark.sparkContext.applicationId, paths)))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not stored can no longer be read."""
    delete(spark, scratch_root(spark))


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. With ``keep`` it outlives the present scope.

    This fixes results that depend on the physical partitioning, cuts lineage in a way that survives the
    loss of executors, and gives Catalyst the true size: a small table is then broadcast, a large one is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    own = _own_scopes(spark)
    if keep and own:
        own[-1].remove(path)
        if len(own) > 1:
            own[-2].append(path)
    return spark.read.schema(df.schema).parquet(path)


def write_by_month(df: DataFrame, path: str) -> None:
    """Write partitioned by month; the rebalance splits a hot month over several tasks and files."""
    df.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def replace_months(df: DataFrame, path: str) -> None:
    """Write partitioned by month, where only the months in ``df`` are replaced and all others stay as they are."""
    writer = df.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year", "month").parquet(path)


def delete_month(spark: SparkSession, path: str, year: int, month: int) -> None:
    delete(spark, f"{path}/year={year}/month={month}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, wherever Spark can reach it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    fs = spark._jvm.org.apache.hadoop.fs
    made, place = fs.Path(f"{path}.{uuid.uuid4().hex}"), fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    stream = place.getFileSystem(conf).create(made, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(fs, "Options$Rename")
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf).rename(made, place, options)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key``, one file a bucket, and open it: joins on ``key`` then need not move it.

    Choose at least as many buckets as shuffle partitions; a table with fewer is shuffled nevertheless. Its layout is
    stored beside it, so that any session can open it.
    """
    spark = df.sparkSession
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, F.col(key)).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    write_table(spark.createDataFrame([(columns, key, buckets)], "columns string, key string, buckets int"), f"{path}.layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``, in a session that may not know it yet."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        r = spark.read.parquet(f"{path}.layout").first()
        spark.sql(
            f"CREATE TABLE {name} ({r['columns']}) USING parquet CLUSTERED BY (`{r['key']}`) SORTED BY (`{r['key']}`) "
            f"INTO {r['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def save_clusterer(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_clusterer(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
