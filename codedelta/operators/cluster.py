"""Snippet clustering with pyspark.ml: tokens -> hashed term frequencies ->
IDF -> k-means.  The analysed service delegated this to an external script
that is not part of it, so the algorithm here is our choice."""

from __future__ import annotations

from contextlib import ExitStack, contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a cached batch of the fit.  Spark writes and reads cached batches through an object stream that holds on to the last 100 of them: of
#: its default, 10,000 rows or 4 MB, these are 400 MB for every stream of every task.
FIT_BATCH_ROWS = 16
#: Outside the heap where executors have memory there (``spark.memory.offHeap``), else nowhere: each pass makes the rows anew.
OUTSIDE_HEAP = StorageLevel(useDisk=False, useMemory=True, useOffHeap=True, deserialized=False)


@contextmanager
def _small_cached_batches(spark: SparkSession):
    """Lowers the rows of a cached batch for what is first cached inside; a lower setting of the session stays."""
    key = "spark.sql.inMemoryColumnarStorage.batchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), FIT_BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cluster_snippets(df: DataFrame, text_col: str = "text", k: int = 4, seed: int = 42,
                     num_features: int = 1 << 14) -> DataFrame:
    """Adds ``cluster`` (int) to ``df``; fits on the whole input (distributed).

    Tokenising costs most, and IDF and every pass of k-means would do it anew: for the fit the term frequencies are kept on the executors'
    disks, in the partitions of ``df``, and dropped when the model stands.  K-means keeps vectors without a storage level as objects in the
    executors' heaps, which they fill as the input grows.  With one it keeps their norms only (8 bytes a row), and each pass weights the
    frequencies anew, a batch at a time."""
    prepare = PipelineModel([RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[A-Za-z_][A-Za-z0-9_]*", gaps=False),
                             HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)])
    with _small_cached_batches(df.sparkSession), ExitStack() as kept:
        counted = prepare.transform(df).select("_tf").persist(StorageLevel.DISK_ONLY)
        kept.callback(counted.unpersist)
        idf = IDF(inputCol="_tf", outputCol="_vec").fit(counted)
        vectors = idf.transform(counted).select("_vec").persist(OUTSIDE_HEAP)
        kept.callback(vectors.unpersist)
        model = KMeans(featuresCol="_vec", predictionCol="cluster", k=k, seed=seed).fit(vectors)
    return PipelineModel([prepare, idf, model]).transform(df).drop("_tok", "_tf", "_vec")


def fit_clusters(df: DataFrame, path: str, text_col: str = "text", ks=range(2, 7), seed: int = 42, num_features: int = 1 << 10) -> dict:
    """Fit k-means for each k, store the model of the best silhouette (a tie: the smaller k) at ``path``; returns {k: silhouette}.

    The texts are vectorised once, into a table beside the model; every fit and the silhouette (squared Euclidean, whose sums Spark takes in
    one pass) are distributed, and the driver holds only the centres.  A k with fewer distinct texts than clusters has no
    silhouette."""
    prepare = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[A-Za-z_][A-Za-z0-9_]*", gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features), IDF(inputCol="_tf", outputCol="_vec")]).fit(df)
    prepare.transform(df).select("_vec").write.parquet(f"{path}/vectors")
    vectors = df.sparkSession.read.parquet(f"{path}/vectors")
    score = ClusteringEvaluator(featuresCol="_vec", predictionCol="_k")
    fitted, silhouettes = {}, {}
    for k in ks:
        model = KMeans(featuresCol="_vec", predictionCol="_k", k=k, seed=seed).fit(vectors)
        if len(model.clusterCenters()) == k and sum(n > 0 for n in model.summary.clusterSizes) == k:
            fitted[k], silhouettes[k] = model, score.evaluate(model.transform(vectors))
    if not fitted:
        raise ValueError("fewer distinct texts than clusters")
    best = max(silhouettes, key=lambda k: (silhouettes[k], -k))
    PipelineModel(stages=[*prepare.stages, fitted[best]]).write().save(f"{path}/model")
    sizes = list(enumerate(fitted[best].summary.clusterSizes))
    order = sorted(sizes, key=lambda s: (-s[1], s[0]))
    df.sparkSession.createDataFrame([(i, rank, n) for rank, (i, n) in enumerate(order)], "center int, cluster int, n long").coalesce(1).write.parquet(f"{path}/labels")
    return silhouettes


def assign_clusters(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``cluster`` from the model stored at ``path``: 0 for the largest cluster of the fit, then by falling size."""
    labels = df.sparkSession.read.parquet(f"{path}/labels").collect()       # as many rows as clusters
    rank = F.create_map(*[F.lit(x) for r in labels for x in (r.center, r.cluster)])
    model = PipelineModel.load(f"{path}/model")
    if model.stages[0].getInputCol() != text_col:
        model.stages[0].setInputCol(text_col)
    return model.transform(df).withColumn("cluster", rank[F.col("_k")]).drop("_tok", "_tf", "_vec", "_k")


def with_cluster_labels(report: DataFrame, assigned: DataFrame, key: str = "pair_id") -> DataFrame:
    """The report with the cluster label of each row (null where it has none), as its last column."""
    return report.join(assigned.select(key, "cluster"), key, "left")
