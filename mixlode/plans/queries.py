"""The query catalogue: every operator on the sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlode.functions.gaussian import Component
from mixlode.functions.optimizers import Adam, Adamax, GradientAscent, Momentum, Nesterov, Optimizer
from mixlode.functions.regularizers import ConjugatePrior, LogBarrier, Regularizer
from mixlode.functions.transforms import RatioTransform
from mixlode.operators.sampling import group_stats, kmeans_seed
from mixlode.operators.scoring import concave_pdf, label_of, logpdf, with_prediction, with_probability
from mixlode.operators.suffstats import suffstats
from mixlode.plans.mixture import GradientMixture, MixtureState
from mixlode.sources.features import local_points, read_points, table, with_features
from mixlode.streaming.online import OnlineMixture

#: The fixed two-component model of (l_quantity, l_extendedprice / 1000).
WEIGHTS = (0.6, 0.4)
MEANS = ((15.0, 30.0), (35.0, 75.0))
COVS = (((120.0, 60.0), (60.0, 500.0)), ((120.0, 80.0), (80.0, 700.0)))
#: The same with s away from 1, for the training density.
SCALES = (0.8, 1.3)
#: The fixed one-dimensional model of events.value.
EVENT_WEIGHTS, EVENT_MEANS, EVENT_VARS = (0.5, 0.5), (20.0, 60.0), (300.0, 900.0)
#: Fixed centers for grouped covariances.
CENTERS = ((12.0, 25.0), (38.0, 80.0))

Query = Callable[[SparkSession, str], DataFrame]


def components(scales=(1.0, 1.0)) -> tuple[Component, ...]:
    return tuple(Component(m, c, s) for m, c, s in zip(MEANS, COVS, scales, strict=True))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return with_features(li, "l_quantity", F.col("l_extendedprice") / 1000)


#: What tells the rows of lineitem apart: samples by hash read it.
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")


def keyed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem_points with KEYS."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, "l_quantity", "l_extendedprice")
    return with_features(li, "l_quantity", F.col("l_extendedprice") / 1000)


def r6(c) -> F.Column:
    return F.round(c, 6)


def predict_soft_lineitem(spark, sf_dir):
    p = with_probability(lineitem_points(spark, sf_dir), WEIGHTS, components())
    return p.select("l_orderkey", "l_linenumber", r6(F.col("probability")[0]).alias("p1"), r6(F.col("probability")[1]).alias("p2"))


def predict_hard_lineitem(spark, sf_dir):
    return with_prediction(lineitem_points(spark, sf_dir), WEIGHTS, components()).select("l_orderkey", "l_linenumber", "prediction")


def label_histogram(spark, sf_dir):
    p = with_prediction(lineitem_points(spark, sf_dir), WEIGHTS, components())
    return p.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def logpdf_points(spark, sf_dir):
    df = lineitem_points(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", *[r6(logpdf(c)).alias(f"logpdf_{j + 1}") for j, c in enumerate(components())])


def gconcave_pdf_points(spark, sf_dir):
    df = lineitem_points(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", *[r6(concave_pdf(c) * 1000).alias(f"pdf_{j + 1}") for j, c in enumerate(components(SCALES))])


def suffstats_2d(spark, sf_dir):
    s = suffstats(lineitem_points(spark, sf_dir), WEIGHTS, components(SCALES))
    return s.select("n", *[r6(F.col(c) / F.col("n")).alias(c) for c in s.columns if c != "n"])


def outlier_uniform(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    far = with_features(df, F.col("l_quantity") + 1e6, F.col("l_extendedprice") - 1e9)
    p = with_probability(far, WEIGHTS, components())
    return p.select("l_orderkey", "l_linenumber", r6(F.col("probability")[0]).alias("p1"), r6(F.col("probability")[1]).alias("p2"), label_of().alias("prediction"))


def state_frame(spark: SparkSession, state: MixtureState) -> DataFrame:
    """One row per component: weight, s and the upper triangles of mean and covariance."""
    rows = []
    for j, (w, c) in enumerate(zip(state.weights, state.components, strict=True)):
        cells = [float(c.sigma[a, b]) for a in range(c.dim) for b in range(a, c.dim)]
        rows.append((j, *[round(float(v), 6) + 0.0 for v in (w, c.s, *c.mu, *cells)]))
    d = state.components[0].dim
    names = [f"mu_{a + 1}" for a in range(d)] + [f"sigma_{a + 1}{b + 1}" for a in range(d) for b in range(a, d)]
    return spark.createDataFrame(rows, ", ".join(["component int", "weight double", "s double", *[f"{n} double" for n in names]]))


def stepped(optimizer: Optimizer, iterations: int, regularizer: Regularizer | None = None, scales=(1.0, 1.0)) -> Query:
    def query(spark, sf_dir):
        model = GradientMixture(MixtureState(np.array(WEIGHTS), components(scales)), optimizer, regularizer, max_iter=iterations, tol=1e-300)
        return state_frame(spark, model.step(lineitem_points(spark, sf_dir)).state)

    return query


#: name -> (optimizer, iterations, regularizer, scales)
STEPS = {
    "step_ga_1": (GradientAscent(), 1, None, (1.0, 1.0)),
    "step_ga_3": (GradientAscent(), 3, None, (1.0, 1.0)),
    "step_ga_scaled_2": (GradientAscent(learning_rate=0.5), 2, None, (0.9, 1.1)),
    "step_momentum_3": (Momentum(), 3, None, (1.0, 1.0)),
    "step_nesterov_3": (Nesterov(), 3, None, (1.0, 1.0)),
    "step_adam_3": (Adam(learning_rate=0.01), 3, None, (1.0, 1.0)),
    "step_adamax_3": (Adamax(learning_rate=0.01), 3, None, (1.0, 1.0)),
    "step_logbarrier_1": (GradientAscent(), 1, LogBarrier(2.0), (1.0, 1.0)),
    "step_conjprior_1": (GradientAscent(), 1, ConjugatePrior(2, 2, mean=[25.0, 50.0], cov=[[100.0, 10.0], [10.0, 400.0]]), (1.0, 1.0)),
    "step_ratio_1": (GradientAscent(transform=RatioTransform()), 1, None, (1.0, 1.0)),
}


def reg_values(spark, sf_dir):
    w, prior, barrier = np.array(WEIGHTS), STEPS["step_conjprior_1"][2], LogBarrier(2.0)
    rows = [(j, float(barrier.component_value(c)), float(prior.component_value(c)), float(prior.weights_value(w))) for j, c in enumerate(components(SCALES))]
    out = spark.createDataFrame(rows, "component int, barrier double, prior double, prior_weights double")
    return out.select("component", *[r6(F.col(c)).alias(c) for c in ("barrier", "prior", "prior_weights")])


def init_stats_fixed_centers(spark, sf_dir):
    """Proportions and ridged covariances of the points nearest to fixed centers."""
    df = lineitem_points(spark, sf_dir)
    x = F.col("features")
    dist = [(x[0] - a) * (x[0] - a) + (x[1] - b) * (x[1] - b) for a, b in CENTERS]
    s = group_stats(df.withColumn("prediction", F.when(dist[0] <= dist[1], 0).otherwise(1)), CENTERS)
    ridge = F.greatest(F.lit(1e-4), F.col("c_11") + F.col("c_22")) / 2
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return s.join(F.broadcast(total)).select(
        F.col("prediction").alias("component"), r6(F.col("n") / F.col("total")).alias("weight"),
        r6(F.col("c_11") + ridge).alias("sigma_11"), r6(F.col("c_12")).alias("sigma_12"), r6(F.col("c_22") + ridge).alias("sigma_22"),
    )


def embedding_model(k: int = 3, d: int = 64) -> tuple[np.ndarray, list[Component]]:
    """A diagonal model by rule: component j has means 0.05 sin(i + j) and variances (1 + ((i + j) mod 3)) / d."""
    i = np.arange(d)
    return np.full(k, 1 / k), [Component(0.05 * np.sin(i + j), np.diag((1.0 + (i + j) % 3) / d)) for j in range(k)]


def predict_embeddings_diag(spark, sf_dir):
    df = with_features(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    p = with_probability(df, *embedding_model())
    return p.select("vec_id", *[r6(F.col("probability")[j]).alias(f"p{j + 1}") for j in range(3)], label_of().alias("prediction"))


def event_points(df: DataFrame) -> DataFrame:
    return with_features(df.select("event_id", "value"), "value")


def event_model(**settings) -> GradientMixture:
    comps = tuple(Component([m], [[v]]) for m, v in zip(EVENT_MEANS, EVENT_VARS, strict=True))
    return GradientMixture(MixtureState(np.array(EVENT_WEIGHTS), comps), **settings)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, or in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/mixlode-{name}-{uuid.uuid4().hex}"


def stream_train_events(spark, sf_dir):
    """Three micro-batches (event_id mod 3), one ascent iteration each, through a file stream."""
    base = shared_folder(spark, "events")
    events = event_points(table(spark, sf_dir, "events"))
    for b in range(3):  # written one after the other, and so read in this order
        events.where(F.col("event_id") % 3 == b).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    online = OnlineMixture(event_model(max_iter=1), f"{base}/state")
    query = online.train(stream, f"{base}/checkpoint")
    query.awaitTermination()
    return state_frame(spark, online.model.state)


def stream_predict_events(spark, sf_dir):
    """Micro-batches scored in foreachBatch, gathered in a table."""
    base = shared_folder(spark, "scored")
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    online = OnlineMixture(event_model())
    query = online.score(event_points(stream), lambda df, b: df.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint", soft=True)
    query.awaitTermination()
    p = spark.read.parquet(f"{base}/out")
    return p.select("event_id", r6(F.col("probability")[0]).alias("p1"), r6(F.col("probability")[1]).alias("p2"), label_of().alias("prediction"))


def stream_label_events(spark, sf_dir):
    """Micro-batches labelled in foreachBatch, gathered in a table."""
    base = shared_folder(spark, "labelled")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    query = OnlineMixture(event_model()).score(event_points(stream), lambda df, b: df.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "prediction")


def export_spark_gmm(spark, sf_dir):
    """Scores of the exported Spark ML model, next to our own."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = GradientMixture(MixtureState(np.array(WEIGHTS), components()))
    df = lineitem_points(spark, sf_dir).withColumn("vector", array_to_vector("features"))
    gmm = model.to_spark_gmm(spark).setFeaturesCol("vector").setProbabilityCol("theirs").setPredictionCol("their_label")
    both = model.predict_soft(gmm.transform(df))
    theirs = vector_to_array("theirs")
    return both.select("l_orderkey", "l_linenumber", r6(theirs[0]).alias("p1"), F.col("their_label").cast("int").alias("prediction"), (F.abs(theirs[0] - F.col("probability")[0]) < 1e-9).alias("agrees"))


def kmeans_init(spark, sf_dir):
    """Seeding from 300 rows, chosen by the hash of their keys."""
    weights, comps = kmeans_seed(keyed_points(spark, sf_dir), 3, 100, keys=KEYS)
    return state_frame(spark, MixtureState(weights, tuple(comps)))


def fit_lineitem(spark, sf_dir):
    """Seeding, then three iterations over all rows."""
    model = GradientMixture.fit(keyed_points(spark, sf_dir), 2, points_per_cluster=100, sample_keys=KEYS, max_iter=3, tol=1e-300)
    return state_frame(spark, model.state)


def fit_embeddings(spark, sf_dir):
    df = with_features(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").where(F.col("features").isNotNull())
    model = GradientMixture.fit(df, 3, kmeans_iter=5, optimizer=Nesterov(), max_iter=3, sample_keys=("vec_id",))
    p = model.predict(df)
    return p.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


#: Rows that a batch of step_minibatch has on average.
BATCH = 500


def step_minibatch(spark, sf_dir):
    """Five iterations, each over the rows whose hash falls into its batch."""
    model = GradientMixture(MixtureState(np.array(WEIGHTS), components()), Momentum(), batch_size=BATCH, max_iter=5, tol=1e-300, sample_keys=KEYS)
    return state_frame(spark, model.step(keyed_points(spark, sf_dir)).state)


#: The fixed one-dimensional model of customer balances in thousands.
BALANCE_WEIGHTS, BALANCE_MEANS, BALANCE_VARS = (0.5, 0.5), (2.0, 6.0), (5.0, 5.0)


def step_local(spark, sf_dir):
    """Local ascent on all customer balances in full batches, so every row is in every update.

    The driver holds 8 bytes a row; a column beyond spark.driver.maxResultSize raises an error, it is not cut.
    """
    df = with_features(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("b")), "b")
    points = df.select(F.col("features")[0].alias("b")).toArrow()["b"].to_numpy().reshape(-1, 1)
    model = GradientMixture.from_params(BALANCE_WEIGHTS, [[m] for m in BALANCE_MEANS], [[[v]] for v in BALANCE_VARS], max_iter=8, tol=1e-300)
    return state_frame(spark, model.step_local(points).state)


def step_local_batches(spark, sf_dir):
    """One epoch of local ascent in three batches, of all customers in the order of their keys; see step_local for the size."""
    df = with_features(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("b")), "b")
    points = df.orderBy("c_custkey").select(F.col("features")[0].alias("b")).toArrow()["b"].to_numpy().reshape(-1, 1)
    third = max(1, -(-len(points) // 3))
    model = GradientMixture.from_params(BALANCE_WEIGHTS, [[m] for m in BALANCE_MEANS], [[[v]] for v in BALANCE_VARS], batch_size=third, max_iter=3, tol=1e-300)
    return state_frame(spark, model.step_local(points).state)


def predict_odd_points(spark, sf_dir):
    """Points that are null, short, long, or hold a null, NaN or infinite element have null results."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    odd = [F.lit(None).cast("array<double>"), F.array(x), F.array(x, y, x), F.array(x, F.lit(None).cast("double")), F.array(F.lit(float("nan")), y), F.array(x, F.lit(float("inf")))]
    features = F.array(x, y)
    for i, point in enumerate(odd):
        features = F.when(F.col("l_linenumber") == i + 2, point).otherwise(features)
    p = with_probability(li.withColumn("features", features), WEIGHTS, components())
    return p.select("l_orderkey", "l_linenumber", r6(F.col("probability")[0]).alias("p1"), r6(F.col("probability")[1]).alias("p2"), label_of().alias("prediction"))


def text_points(spark, sf_dir):
    """All points written as lines of text and read back."""
    path = shared_folder(spark, "text")
    table(spark, sf_dir, "lineitem").select(F.concat_ws(" ; ", "l_quantity", "l_extendedprice")).write.text(path)
    p = read_points(spark, path, ";").select(F.col("features")[0].alias("x1"), F.col("features")[1].alias("x2"))
    return p.groupBy("x1").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x2"), 2).alias("x2"))


#: Points that are scored one by one on the driver, and as a local collection.
SINGLES = ((14.0, 30.0), (36.5, 71.0), (25.0, 52.0), (1.0, 90.0), (-1e6, 1e6))


def predict_singles(spark, sf_dir):
    """Single vectors on the driver, beside the same points as a table made from a local collection."""
    model = GradientMixture(MixtureState(np.array(WEIGHTS), components()))
    alone = [(*p, *[round(float(v), 6) for v in model.predict_soft(np.array(p))], model.predict(np.array(p))) for p in SINGLES]
    alone = spark.createDataFrame(alone, "x1 double, x2 double, p1 double, p2 double, prediction int")
    together = model.predict(local_points(spark, SINGLES)).select(F.col("features")[0].alias("x1"), F.col("features")[1].alias("x2"), F.col("prediction").alias("in_table"))
    return alone.join(together, ["x1", "x2"])


def component_scalars(spark, sf_dir):
    """Determinants of components made from Spark's own types, and shrinkages that halve a rate every so many iterations."""
    from pyspark.ml.linalg import DenseMatrix, DenseVector
    from pyspark.ml.stat import MultivariateGaussian

    rows = []
    for j, (m, c) in enumerate(zip(MEANS, COVS, strict=True)):
        own = Component.from_spark(MultivariateGaussian(DenseVector(m), DenseMatrix(2, 2, [v for row in c for v in row])))
        rate = GradientAscent().halve_every(HALVE[j])
        rows.append((j, round(own.det, 6), round(own.log_det, 6), round(rate.shrinkage, 6), round(rate.shrunk(0.5), 6)))
    return spark.createDataFrame(rows, "component int, det double, log_det double, shrinkage double, next_rate double")


#: Iterations in which a rate halves.
HALVE = (5, 40)


def rule_settings(spark, sf_dir):
    """The settings of every ascent rule and of the model, as they are by default and after they are set."""
    rows = []
    for rule in (GradientAscent(), Momentum(), Nesterov(), Adam(), Adamax()):
        rows += [(type(rule).__name__, f.name, round(float(getattr(rule, f.name)), 9)) for f in fields(rule) if isinstance(getattr(rule, f.name), float)]
    model = GradientMixture(MixtureState(np.array(WEIGHTS), components()))
    names = ("max_iter", "tol", "sampling_seed")
    rows += [("model", name, float(getattr(model, name))) for name in names]
    model.max_iter, model.tol, model.sampling_seed = 7, 0.25, 3
    rows += [("model, set", name, float(getattr(model, name))) for name in names]
    return spark.createDataFrame(rows, "rule string, setting string, value double")


def trajectory_ga_3(spark, sf_dir):
    """The parameters before each of three iterations."""
    model = GradientMixture(MixtureState(np.array(WEIGHTS), components()), max_iter=3, tol=1e-300, trace=True)
    t = model.step(lineitem_points(spark, sf_dir)).trajectory_frame(spark)
    return t.select("iter", "component", r6("weight").alias("weight"), r6("s").alias("s"), r6(F.col("mu")[0]).alias("mu_1"), r6(F.col("mu")[1]).alias("mu_2"), r6(F.col("sigma")[0][1]).alias("sigma_12"))


def queries() -> dict[str, Query]:
    plain = [
        predict_soft_lineitem, predict_hard_lineitem, label_histogram, logpdf_points, gconcave_pdf_points, suffstats_2d, outlier_uniform, reg_values,
        init_stats_fixed_centers, predict_embeddings_diag, stream_train_events, stream_predict_events, stream_label_events, export_spark_gmm, kmeans_init, fit_lineitem, fit_embeddings, step_minibatch, step_local, step_local_batches,
        predict_odd_points, text_points, predict_singles, component_scalars, rule_settings, trajectory_ga_3,
    ]
    return {q.__name__: q for q in plain} | {name: stepped(*how) for name, how in STEPS.items()}
