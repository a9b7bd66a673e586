"""Distributed training and scoring against local NumPy, Spark ML and SQL."""

import glob
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mixlode import Adamax, Component, GradientMixture, MixtureState, Nesterov
from mixlode.operators import scoring
from mixlode.operators.sampling import kmeans, kmeans_seed, take_batch, take_sample
from mixlode.operators.suffstats import fold, gather, suffstats
from mixlode.plans import oracles
from mixlode.plans import queries as catalogue
from mixlode.sources.features import local_points, params_from, read_points, with_features
from mixlode.streaming.online import OnlineMixture, ProgressLog, StateStore

SF = "/root/testdata/sf0.001"


def model(**settings):
    return GradientMixture.from_params([0.3, 0.7], [[0.0, 0.0], [2.0, 1.0]], [np.eye(2), [[2.0, 0.5], [0.5, 1.0]]], **settings)


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(42).normal(1, 2, (500, 2))


def test_statistics_agree(spark, points):
    m = model()
    df = local_points(spark, points).repartition(7)
    local, far = fold(points, m.weights, m.components), gather(df, m.weights, m.components)
    near = gather(df, m.weights, m.components, partitions=7)
    assert near.n == 500 and np.allclose(near.outer, local.outer) and near.loss == pytest.approx(local.loss)
    assert far.n == 500 and np.allclose(far.outer, local.outer) and far.loss == pytest.approx(local.loss)
    row = suffstats(df, m.weights, m.components).first()
    assert row["n"] == 500 and row["outer_2_12"] == pytest.approx(local.outer[1, 0, 1]) and row["wgrad_1"] == pytest.approx(local.weights_gradient(m.weights)[0])
    assert gather(df.limit(0), m.weights, m.components).n == 0


def test_partitioning_does_not_matter(spark, points):
    runs = [model(optimizer=Adamax(learning_rate=0.01), max_iter=3, tol=1e-300).step(local_points(spark, points).repartition(n)) for n in (1, 9)]
    for a, b in zip(runs[0].components, runs[1].components, strict=True):
        assert np.allclose(a.mu, b.mu, atol=1e-9) and np.allclose(a.sigma, b.sigma, atol=1e-9)


def test_distributed_equals_local(spark, points):
    far = model(max_iter=4, tol=1e-300).step(local_points(spark, points))
    near = model(max_iter=4, tol=1e-300).step_local(points, shrink=True)
    assert np.allclose(far.weights, near.weights) and far.loss == pytest.approx(near.loss)
    assert [r.iter for r in far.history_frame(spark).orderBy("iter").collect()] == [0, 1, 2, 3]


def test_scores_equal_spark_ml(spark, points):
    m = model()
    df = local_points(spark, points[:50]).withColumn("v", array_to_vector("features"))
    gmm = m.to_spark_gmm(spark).setFeaturesCol("v").setProbabilityCol("theirs").setPredictionCol("label")
    rows = m.predict(m.predict_soft(gmm.transform(df))).select("features", "probability", vector_to_array("theirs").alias("t"), "prediction", "label").collect()
    for r in rows:
        assert np.allclose(r.probability, r.t, atol=1e-9) and r.prediction == r.label == m.predict(np.array(r.features))


def test_edge_inputs(spark):
    empty = local_points(spark, [])
    m = model(max_iter=2)
    assert m.step(empty).history == [] and m.predict(empty).count() == 0
    assert model(max_iter=1).step(local_points(spark, [[1.0, 2.0]])).history[0][1] == 1
    for bad in ([[1.0]], [[1.0, float("nan")]]):
        with pytest.raises(Exception, match="point"):
            model(max_iter=1).step(local_points(spark, bad))
    with pytest.raises(ValueError, match="distinct"):
        GradientMixture.init(local_points(spark, [[1.0], [1.0]]), 2)
    one = GradientMixture.from_params([1.0], [[0.0]], [[[1.0]]], max_iter=2, batch_size=10**6).step(local_points(spark, [[1.0], [2.0]]))
    assert one.weights.tolist() == [1.0]


def test_fit_and_minibatch(spark):
    rng = np.random.default_rng(7)
    df = local_points(spark, np.vstack([rng.normal(-5, 1, (150, 2)), rng.normal(5, 1, (150, 2))])).repartition(3)
    m = GradientMixture.fit(df, 2, kmeans_tries=2, max_iter=10, batch_size=100)
    assert sorted(round(float(c.mu[0])) for c in m.components) == [-5, 5]
    counts = {r["prediction"]: r["count"] for r in m.predict(df).groupBy("prediction").count().collect()}
    assert sorted(counts.values()) == [150, 150]


def test_sources_and_params(spark, tmp_path):
    (tmp_path / "points.txt").write_text(" 1.5 2\n\n3 4 \n")
    assert sorted(r[0] for r in read_points(spark, str(tmp_path / "points.txt")).collect()) == [[1.5, 2.0], [3.0, 4.0]]
    for name, separator, lines in (("bar", "|", "1.5|2\n3 | 4\n"), ("tab", "\t", "1.5\t 2\n3\t4\n"), ("runs", " ", "  1.5   2\n\t\n3\t4"), ("dots", "..", "1.5..2\n3..4")):
        (tmp_path / name).write_text(lines)
        assert sorted(r[0] for r in read_points(spark, str(tmp_path / name), separator).collect()) == [[1.5, 2.0], [3.0, 4.0]], name
    (tmp_path / "words").write_text("1.5 two")
    with pytest.raises(Exception, match="CAST"):
        read_points(spark, str(tmp_path / "words")).collect()
    m = model()
    weights, comps = params_from(m.params(spark))
    assert np.allclose(weights, m.weights) and np.allclose(comps[1].sigma, m.components[1].sigma)
    m.save(spark, str(tmp_path / "model"))
    assert GradientMixture.load(spark, str(tmp_path / "model")).state.to_json() == m.state.to_json()
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert with_features(df, "a", "b").first()["features"] == [1.0, 2.0]
    assert with_features(df.select(array_to_vector(F.array("b")).alias("v")), "v").first()["features"] == [2.0]


def test_wide_points_score_by_arrow(spark):
    w, comps = catalogue.embedding_model()
    x = np.random.default_rng(2).normal(size=(20, 64))
    m = GradientMixture(MixtureState(w, tuple(comps)))
    got = m.predict_soft(local_points(spark, x)).select("features", "probability").collect()
    assert all(np.allclose(r.probability, m.predict_soft(np.array(r.features))) for r in got)


ODD = [[1.0, 2.0], None, [], [1.0], [1.0, 2.0, 3.0], [1.0, None], [float("nan"), 1.0], [1.0, float("-inf")], [-4.0, 0.5]]


@pytest.mark.parametrize("terms", [256, 0])
def test_odd_points_on_both_paths(spark, monkeypatch, terms):
    monkeypatch.setattr(scoring, "EXPRESSION_TERMS", terms)
    m, df = model(), spark.createDataFrame(list(enumerate(ODD)), "i int, features array<double>")
    got = {r.i: r for r in m.predict(m.predict_soft(df)).collect()}
    for i, p in enumerate(ODD):
        if i in (0, len(ODD) - 1):
            assert np.allclose(got[i].probability, m.predict_soft(np.array(p))) and got[i].prediction == m.predict(np.array(p))
        else:
            assert got[i].probability is None and got[i].prediction is None
    for i in range(1, len(ODD) - 1):
        with pytest.raises(Exception, match="every point must have 2 finite elements"):
            model(max_iter=1).step(df.where(f"i in (0, {i})"))
        with pytest.raises(Exception, match="every point must have 2 finite elements"):
            suffstats(df.where(f"i in (0, {i})"), m.weights, m.components).collect()


def test_stream_replays_change_nothing(spark, tmp_path, points):
    parts = [local_points(spark, points[i::3]) for i in range(3)]
    clean = OnlineMixture(model(max_iter=2), str(tmp_path / "clean"))
    for b in range(3):
        clean.train_batch(parts[b], b)
    done, step, write = clean.model.state.to_json(), GradientMixture.step, StateStore.write

    def run(name, path, patch):
        """Batch 1 fails once, by `patch`, and comes again; so does batch 2, without failure."""
        online = OnlineMixture(model(max_iter=2), path)
        online.train_batch(parts[0], 0)
        with pytest.MonkeyPatch.context() as m:
            patch(m)
            with pytest.raises(OSError):
                online.train_batch(parts[1], 1)
        for b in (1, 2, 2):
            online.train_batch(parts[b], b)
        assert online.model.state.to_json() == done, name
        assert [h[0] for h in online.model.history] == list(range(6))
        return online

    def half_way(self, df):
        self.max_iter = 1
        step(self, df)
        raise OSError("lost")

    def unwritten(self, batch_id, state):
        raise OSError("full")

    def written(self, batch_id, state):
        write(self, batch_id, state)
        raise OSError("lost after the write")

    run("step", str(tmp_path / "a"), lambda m: m.setattr(GradientMixture, "step", half_way))
    run("step, no store", None, lambda m: m.setattr(GradientMixture, "step", half_way))
    run("write", str(tmp_path / "b"), lambda m: m.setattr(StateStore, "write", unwritten))
    run("after", str(tmp_path / "c"), lambda m: m.setattr(StateStore, "write", written))
    again = OnlineMixture(model(max_iter=2), str(tmp_path / "c"))  # a new process, batch 2 comes again
    again.train_batch(parts[2], 2)
    assert again.model.state.to_json() == done
    plain = model(max_iter=2)
    for p in parts:
        plain.step(p)
    assert np.allclose(plain.weights, clean.model.weights)


def test_state_store_keeps_the_last(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"), keep=2)
    assert store.batches() == [] and store.before(5) is None
    for b in range(4):
        store.write(b, model().state)
    store.write(3, model().state)
    assert store.batches() == [2, 3] and store.before(3).to_json() == model().state.to_json()
    with pytest.raises(ValueError):
        StateStore(spark, str(tmp_path / "s"), keep=1)


def test_progress_is_logged(spark, tmp_path, caplog):
    listener = ProgressLog()
    spark.streams.addListener(listener)
    try:
        with caplog.at_level("INFO", logger="mixlode.stream"):
            spark.range(3).write.parquet(str(tmp_path / "in"))
            query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20000)
    finally:
        spark.streams.removeListener(listener)
    assert any("3 rows" in r.message for r in caplog.records)


def test_samples_by_hash_ignore_partitions(spark):
    df = spark.range(2000).selectExpr("id", "array(cast(id as double)) as features")
    batches = [sorted(r.id for r in take_batch(df.repartition(n), 0.1, 7, ("id",)).collect()) for n in (1, 6)]
    assert batches[0] == batches[1] and 130 < len(batches[0]) < 270
    samples = [take_sample(df.repartition(n), 20, 7, keys=("id",)) for n in (1, 6)]
    assert samples[0] == samples[1] and len(samples[0]) == 20
    assert batches[0] != sorted(r.id for r in take_batch(df, 0.1, 8, ("id",)).collect())


def test_fit_embeddings_equals_local_steps(spark):
    df = with_features(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    weights, comps = kmeans_seed(df, 3, iterations=5, keys=("vec_id",))
    x = np.array([r[0] for r in df.orderBy("vec_id").select("features").collect()])
    m = GradientMixture(MixtureState(weights, tuple(comps)), Nesterov(), max_iter=3).step_local(x, shrink=True)
    got = {r.prediction: r.n for r in catalogue.fit_embeddings(spark, SF).collect()}
    assert got == {j: n for j, n in enumerate(np.bincount(m.predict(x), minlength=3).tolist()) if n}


def test_seeding_is_as_good_as_spark_ml(spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(c, 1.0, (80, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 7, 0), (5, 5, 5))])
    theirs = KMeans(k=4, seed=1, featuresCol="v").fit(local_points(spark, x).withColumn("v", array_to_vector("features"))).summary.trainingCost
    assert min(kmeans(x, 4, seed=i)[1] for i in range(3)) <= 1.01 * theirs
    weights, comps = kmeans_seed(local_points(spark, x), 4, tries=3)
    assert weights.sum() == pytest.approx(1) and len(comps) == 4
    wide = local_points(spark, rng.normal(size=(150, 64)))
    began = time.time()
    kmeans_seed(wide, 3)
    assert time.time() - began < 10


def test_component_from_spark_objects():
    from pyspark.ml.linalg import DenseMatrix, DenseVector
    from pyspark.ml.stat import MultivariateGaussian

    c = Component.from_spark(MultivariateGaussian(DenseVector([1.0, 2.0]), DenseMatrix(2, 2, [2.0, 0.0, 0.0, 3.0])))
    assert c.mu.tolist() == [1.0, 2.0] and c.sigma.tolist() == [[2.0, 0.0], [0.0, 3.0]]


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = catalogue.queries()[name](spark, SF)
    cols = sorted(got.columns)
    key = lambda rows: sorted(tuple(r) for r in rows)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    assert key(got.select(*cols).collect()) == key(want)


def test_local_step_sees_every_row(spark, tmp_path):
    def run(name, balances):
        rows = [(i, float(b)) for i, b in enumerate(balances)]
        spark.createDataFrame(rows, "c_custkey long, c_acctbal double").repartition(3).write.parquet(str(tmp_path / name / "customer.parquet"))
        return [tuple(r) for r in catalogue.step_local(spark, str(tmp_path / name)).orderBy("component").collect()]

    balances = 8000 * np.random.default_rng(5).random(1003)
    balances[-1] = 9000.0
    got = run("all", balances)
    same_rate = catalogue.GradientAscent(shrinkage=1.0)
    far = GradientMixture.from_params([0.5, 0.5], [[2.0], [6.0]], [[[5.0]], [[5.0]]], optimizer=same_rate, max_iter=8).step(local_points(spark, balances[:, None] / 1000))
    assert np.allclose(got, [tuple(r) for r in catalogue.state_frame(spark, far.state).orderBy("component").collect()], atol=2e-6)
    balances[-1] = -9000.0  # the largest key counts
    assert not np.allclose(got, run("last", balances), atol=2e-6)


def test_contract(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
