"""Clusters of songs by their lyric vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS
from playlytics.functions.vectors import l2_distance
from playlytics.sources.storage import materialise
from playlytics.sources.tables import cluster_letter


RESTARTS = 5


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def fit_clusterer(
    vectors: DataFrame, k: int = DEFAULTS.n_clusters, seed: int = DEFAULTS.seed, max_iter: int = 300, tol: float = 1e-4
) -> KMeansModel:
    """k-means over ``embedding``; the driver holds the k centers only."""
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol).fit(_features(vectors).select("features"))


def compare_sizes(vectors: DataFrame, sizes: Sequence[int], seed: int = DEFAULTS.seed, max_iter: int = 300) -> DataFrame:
    """(k, n_clusters, cost, silhouette) for several numbers of clusters, to choose one by.

    ``cost`` is the sum of squared distances to the own center. A fit may end in a worse local optimum than a smaller one did, so
    each starts anew until its cost is not above that of the last smaller k, ``RESTARTS`` times at most. The silhouette (-1 to 1, squared distances)
    is NULL where all songs are in one cluster. Each k reads the vectors anew; only centers and sums reach the driver.
    """
    features = materialise(vectors.select("embedding"), "features")
    features = _features(features).select("features")
    evaluator = ClusteringEvaluator(distanceMeasure="squaredEuclidean")
    rows: list[tuple] = []
    for k in sorted(set(sizes)):
        model = None
        for again in range(RESTARTS):
            found = KMeans(k=k, seed=seed + again, maxIter=max_iter).fit(features)
            if model is None or found.summary.trainingCost < model.summary.trainingCost:
                model = found
            if not rows or model.summary.trainingCost <= rows[-1][2]:
                break
        predicted = model.transform(features)
        used = predicted.select("prediction").distinct().count()
        silhouette = float(evaluator.evaluate(predicted)) if used > 1 else None
        rows.append((k, used, float(model.summary.trainingCost), silhouette))
    return vectors.sparkSession.createDataFrame(rows, "k int, n_clusters int, cost double, silhouette double")


def raw_assignment(vectors: DataFrame, model: KMeansModel) -> DataFrame:
    return model.transform(_features(vectors)).drop("features").withColumnRenamed("prediction", "model_cluster")


def cluster_order(vectors: DataFrame, model: KMeansModel) -> list[int]:
    """Canonical number of each model cluster: largest first, then by center."""
    counted = raw_assignment(vectors, model).groupBy("model_cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = {row["model_cluster"]: row["n"] for row in counted.collect()}  # at most k rows
    centers = [tuple(c) for c in model.clusterCenters()]
    ranked = sorted(range(len(centers)), key=lambda i: (-sizes.get(i, 0), centers[i]))
    return [ranked.index(i) for i in range(len(centers))]


def assign_clusters(vectors: DataFrame, model: KMeansModel, order: list[int]) -> DataFrame:
    """(g_id, embedding, cluster, cluster_label) for every song."""
    number = F.element_at(F.array(*map(F.lit, order)), F.col("model_cluster") + 1)
    return raw_assignment(vectors, model).select(
        F.col("id").alias("g_id"), "embedding", number.alias("cluster"), cluster_letter(number).alias("cluster_label")
    )


def model_centroids(vectors: DataFrame, model: KMeansModel, order: list[int]) -> DataFrame:
    """(cluster, cluster_label, centroid): one row per cluster."""
    rows = [(order[i], [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centers = vectors.sparkSession.createDataFrame(rows, "cluster int, centroid array<double>")
    return centers.select("cluster", cluster_letter(F.col("cluster")).alias("cluster_label"), "centroid")


def mean_centroids(vectors: DataFrame, song_clusters: DataFrame) -> DataFrame:
    """Centroids of a given assignment: element-wise means, summed on the JVM before the shuffle."""
    members = _features(vectors).join(song_clusters.withColumnRenamed("g_id", "id"), "id")
    means = members.groupBy("cluster").agg(Summarizer.mean(F.col("features")).alias("mean"))
    label = cluster_letter(F.col("cluster")).alias("cluster_label")
    return materialise(means.select("cluster", label, vector_to_array("mean").alias("centroid")), "centroids")


def centroid_distances(songs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Euclidean distance of each clustered song to its centroid."""
    joined = songs.drop("cluster_label").join(centroids, "cluster")
    return joined.select(
        "g_id", "cluster", "cluster_label", l2_distance(F.col("centroid"), F.col("embedding")).alias("centroid_dist")
    )
