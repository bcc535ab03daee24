"""Clusters of snippets: choice of k, stored model, labels by size."""
import tempfile
import threading

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from codedelta.operators import cluster as CL

TOPICS = ["class Alpha public void run", "def parse text return words", "import kafka producer consumer topic"]


def _texts(spark):
    rows = [(f"p{i}", TOPICS[t] + " " + " ".join(TOPICS[t].split()[:i % 3])) for t, n in enumerate((30, 20, 10)) for i in range(t * 100, t * 100 + n)]
    return spark.createDataFrame(rows + [("empty", "")], "pair_id string, text string")


def test_k_is_chosen_and_the_stored_model_assigns_like_its_centres(spark):
    df, path = _texts(spark), tempfile.mkdtemp(prefix="cd-km-") + "/m"
    silhouettes = CL.fit_clusters(df.filter("text <> ''"), path, ks=range(2, 5))
    assert max(silhouettes, key=silhouettes.get) == 3 and silhouettes[3] > 0.8
    got = {r.pair_id: r.cluster for r in CL.assign_clusters(df, path).collect()}
    assert [got["p0"], got["p100"], got["p200"]] == [0, 1, 2]       # by falling size
    model = PipelineModel.load(path + "/model")
    centres = np.array(model.stages[-1].clusterCenters())
    rank = {r.center: r.cluster for r in spark.read.parquet(path + "/labels").collect()}
    for r in model.transform(df).collect():
        assert got[r.pair_id] == rank[int(((centres - r["_vec"].toArray()) ** 2).sum(1).argmin())]


def test_labels_join_the_report(spark):
    report = spark.createDataFrame([("a", 1), ("b", 2)], "pair_id string, overall_score int")
    assigned = spark.createDataFrame([("a", 0)], "pair_id string, cluster int")
    rows = CL.with_cluster_labels(report, assigned).orderBy(F.col("pair_id")).collect()
    assert [tuple(r) for r in rows] == [("a", 1, 0), ("b", 2, None)]


def test_the_fit_tokenises_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(text):
        seen.add(1)
        return text
    texts = spark.createDataFrame([(i, f"alpha beta w{i % 3} w{i % 3} v{i % 5}") for i in range(30)], "id long, text string")
    df = texts.select("id", F.udf(note, useArrow=False)("text").alias("text"))
    out = CL.cluster_snippets(df, k=2, num_features=64)
    assert seen.value == 30
    assert out.count() == 30 and not spark.sparkContext._jsc.getPersistentRDDs()


def test_the_fit_holds_few_rows_in_the_heap(spark, monkeypatch):
    """Vectors stay out of the heap's block store, and a cached batch (Spark's streams hold on to 100) has few rows.

    Spark solves by rows here as on any input of more rows than features; on fewer it may keep blocks of them."""
    stored = lambda: {i.id(): i for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    old, most, batches, over = set(stored()), [0], [], threading.Event()
    fit = CL.KMeans.fit

    def watch():
        while not over.wait(0.005):
            most.append(sum(i.memSize() for k, i in stored().items() if k not in old))

    def noted(self, vectors):
        batches.extend(rdd.count() for k, rdd in spark.sparkContext._jsc.getPersistentRDDs().items() if k not in old)
        return fit(self, vectors)
    monkeypatch.setattr(CL.KMeans, "fit", noted)
    rows, size = 600, "spark.sql.inMemoryColumnarStorage.batchSize"
    before = spark.conf.get(size)
    df = spark.range(0, rows, 1, 2).select("id", F.expr("array_join(transform(sequence(0, 299), x -> concat('w', (x * (1 + id % 7)) % 997)), ' ')").alias("text"))
    poll = threading.Thread(target=watch)
    poll.start()
    try:
        out = CL.cluster_snippets(df, k=3, num_features=64)
    finally:
        over.set()
        poll.join()
    assert len(most) > 10 and max(most) < 100 * rows            # the vectors are over 500 bytes a row
    assert sum(batches) >= rows / 50
    assert spark.conf.get(size) == before and not set(stored()) - old
    assert out.count() == rows
