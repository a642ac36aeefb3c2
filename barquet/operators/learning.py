"""Learning jobs: calibrators, models by regime, anti-patterns, champion against challenger."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks
from ..functions.series import settled
from .statistics import calibration_report, walk_forward


def fit_platt(df: DataFrame, score: str = "score", y: str = "y"):
    """A logistic curve over one score."""
    data = VectorAssembler(inputCols=[score], outputCol="_x").transform(df.select(score, F.col(y).cast("double").alias(y)))
    return LogisticRegression(featuresCol="_x", labelCol=y, probabilityCol="_p").fit(data)


def apply_platt(model, df: DataFrame, score: str = "score", out: str = "p") -> DataFrame:
    """The fitted curve as a column expression: no model call for each row."""
    a, b = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, 1 / (1 + F.exp(-(F.col(score) * a + b))))


def fit_isotonic(df: DataFrame, score: str = "score", y: str = "y"):
    return IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="_p").fit(df.select(score, F.col(y).cast("double").alias(y)))


def apply_isotonic(model, df: DataFrame, score: str = "score", out: str = "p") -> DataFrame:
    return model.setFeaturesCol(score).setPredictionCol(out).transform(df)


def compare_calibrators(df: DataFrame) -> DataFrame:
    """Brier, log loss and ECE of raw, Platt and isotonic probabilities (score, y) on the last 30 % of each series, fitted on the rest."""
    split = settled(walk_forward(df, 0.7, 0.0).select("score", "y", "split"))  # read by each fit and each way
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    ways = {"raw": test.withColumn("p", F.col("score")), "platt": apply_platt(fit_platt(train), test), "isotonic": apply_isotonic(fit_isotonic(train), test)}
    out = None
    for name, scored in ways.items():
        part = scored.select(F.lit(name).alias("calibrator"), "p", "y")
        out = part if out is None else out.unionByName(part)
    return calibration_report(out, ["calibrator"])


def train_per_regime(df: DataFrame, features: list[str], least: int = 40, layers: tuple[int, ...] = (16,), seed: int = 7) -> dict:
    """A model of all rows (key None) and one of each regime (up, down, range) with enough rows; target y of 0 and 1."""
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("y", F.col("y").cast("double")))
    counts = {r["regime"]: r["count"] for r in df.groupBy("regime").count().collect()}
    fit = lambda rows: MultilayerPerceptronClassifier(featuresCol="_x", labelCol="y", probabilityCol="_p", layers=[len(features), *layers, 2], seed=seed, maxIter=50).fit(rows)
    return {None: fit(data)} | {k: fit(data.filter(F.col("regime") == k)) for k in ("up", "down", "range") if counts.get(k, 0) >= least}


def predict_per_regime(models: dict, df: DataFrame, features: list[str], blend: float = 0.5) -> DataFrame:
    """Add p: the regime's model and the general one, blended; the general one where a regime has none."""
    out = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    for k, model in models.items():
        out = model.copy({model.probabilityCol: f"_p_{k}", model.predictionCol: f"_y_{k}", model.rawPredictionCol: f"_r_{k}"}).transform(out)
    p = lambda k: vector_to_array(F.col(f"_p_{k}"))[1]
    own = F.lit(None).cast("double")
    for k in models:
        if k is not None:
            own = F.when(F.col("regime") == k, p(k)).otherwise(own)
    return out.withColumn("p", F.coalesce(blend * own + (1 - blend) * p(None), p(None))).drop("_x", *[f"_{c}_{k}" for k in models for c in "pyr"])


def _distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def anti_patterns(rows: DataFrame, k: int = 8, least: int = 20, bad: float = 0.45, rounds: int = 30) -> DataFrame:
    """(cluster, n_mistakes, n_correct, radius, hit_rate, is_bad, centroid) of clusters of mistaken vectors.

    ``rows``: id, vec array<double>, mistake boolean. Lloyd's rounds move k centroids, which are all
    that reaches the driver; the radius is the 90th percentile of a cluster's distances, and correct
    rows within it count for it.
    """
    from pyspark.ml.clustering import KMeans

    wrong = rows.filter(F.col("mistake") & F.col("vec").isNotNull()).withColumn("_x", array_to_vector("vec"))
    model = KMeans(k=k, maxIter=rounds, seed=11, featuresCol="_x", predictionCol="cluster").fit(wrong)
    centers = F.broadcast(rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>"))  # k rows
    near = model.transform(wrong).join(centers, "cluster").withColumn("_d", F.sqrt(_distance("vec", "centroid")))
    found = near.groupBy("cluster").agg(F.count("*").alias("n_mistakes"), F.percentile_approx("_d", 0.9, 10_000).alias("radius"), F.first("centroid").alias("centroid"))
    right = nearest_pattern(rows.filter(~F.col("mistake")), found).filter("in_radius").groupBy("cluster").agg(F.count("*").alias("n_correct"))
    out = found.join(right, "cluster", "left").fillna(0, ["n_correct"])
    rate = F.col("n_correct") / (F.col("n_correct") + F.col("n_mistakes"))
    return out.withColumns({"hit_rate": rate, "is_bad": (F.col("n_mistakes") >= least) & (rate <= bad)})


def pattern_profiles(rows: DataFrame, centers: list[list[float]], least: int = 20, bad: float = 0.45) -> DataFrame:
    """(cluster, n_mistakes, n_correct, hit_rate, is_bad, radius, centroid, errors, direction, regime): what the mistakes nearest to each centre share.

    ``rows``: id, vec array<double>, mistake, error_type, direction, regime. centroid is the mean of a cluster's mistakes, radius the
    squared distance to it that nine tenths of them keep (exact, by rank), n_correct the correct rows within it. errors counts
    the error types; direction is the side with more than twice the other's mistakes, else mixed; regime the commonest, ties by name,
    a null one counting as unknown. Ties of distance go to the lower cluster; clusters without a mistake have no row. Counts
    are summed before they are shuffled, so a cluster may hold any share of the rows.
    """
    each = F.array(*[F.struct(_distance(F.col("vec"), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(k).alias("cluster")) for k, c in enumerate(centers)])  # as many as there are clusters
    wrong = rows.filter(F.col("mistake") & F.col("vec").isNotNull()).withColumn("cluster", F.array_min(each)["cluster"])
    n = F.count("*").alias("n")
    by_error = wrong.groupBy("cluster", F.coalesce("error_type", F.lit("unknown")).alias("_e")).agg(n).groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_e", "n")))).alias("errors"))
    by_regime = wrong.groupBy("cluster", F.coalesce("regime", F.lit("unknown")).alias("_r")).agg(n).groupBy("cluster").agg(F.min(F.struct(-F.col("n"), "_r"))["_r"].alias("regime"))
    sums = [F.avg(F.col("vec")[j]).alias(f"_{j}") for j in range(len(centers[0]))]
    sides = wrong.groupBy("cluster").agg(F.count("*").alias("n_mistakes"), F.count_if(F.col("direction") == "long").alias("_long"), F.count_if(F.col("direction") == "short").alias("_short"), *sums)
    centroid = F.array(*[F.col(f"_{j}") for j in range(len(centers[0]))])
    found = sides.select("cluster", "n_mistakes", centroid.alias("centroid"), F.when(F.col("_long") > 2 * F.col("_short"), "long").when(F.col("_short") > 2 * F.col("_long"), "short").otherwise("mixed").alias("direction"))
    known = F.broadcast(found.select("cluster", "centroid"))  # a row a cluster
    away = wrong.join(known, "cluster").select("cluster", _distance("vec", "centroid").alias("radius"))
    rank = F.floor(0.9 * (F.col("n_mistakes") - 1) + 1e-9)
    radius = ranks.order_statistics(away, ["cluster"], "radius", found.select("cluster", rank.alias("rank"))).drop("rank")
    found = found.join(radius, "cluster").join(by_error, "cluster").join(by_regime, "cluster")
    every = F.broadcast(found.agg(F.collect_list(F.struct("cluster", "centroid", "radius")).alias("_all")))  # one row
    inside = rows.filter(~F.col("mistake") & F.col("vec").isNotNull()).crossJoin(every).select(F.explode(F.filter("_all", lambda p: _distance(F.col("vec"), p["centroid"]) <= p["radius"])).alias("p"))
    out = found.join(inside.groupBy(F.col("p.cluster").alias("cluster")).agg(F.count("*").alias("n_correct")), "cluster", "left").fillna(0, ["n_correct"])
    rate = F.col("n_correct") / (F.col("n_correct") + F.col("n_mistakes"))
    return out.withColumns({"hit_rate": rate, "is_bad": (F.col("n_mistakes") >= least) & (rate < bad)})


def nearest_pattern(rows: DataFrame, patterns: DataFrame, regime: str | None = None) -> DataFrame:
    """``rows`` with cluster, distance and in_radius of the nearest centroid, of those of ``regime`` if one is named. ``patterns`` are k rows, gathered into one array."""
    patterns = patterns if regime is None else patterns.filter(F.col("regime") == regime)
    all_ = patterns.agg(F.collect_list(F.struct("cluster", "centroid", "radius")).alias("_all"))
    out = rows.crossJoin(F.broadcast(all_))
    best = F.array_min(F.transform("_all", lambda p: F.struct(_distance(F.col("vec"), p["centroid"]).alias("d"), p["cluster"].alias("cluster"), p["radius"].alias("radius"))))
    return out.withColumn("_b", best).withColumns({"cluster": F.col("_b.cluster"), "distance": F.sqrt("_b.d"), "in_radius": F.sqrt("_b.d") <= F.col("_b.radius")}).drop("_all", "_b")


def meta_veto(rows: DataFrame) -> DataFrame:
    """What is left of a decision after the nearest pattern (in_radius, hit_rate): vetoed at a hit rate up to 0.25, softened up to 0.40.

    A veto takes confidence, and signal where there is one, to 0 and direction to neutral; softened are signal to 0.4 and
    confidence to 0.5 of what they were, and a signal then under 0.05 is neutral. Without a pattern, or a hit rate, all stays.
    """
    near = F.coalesce("in_radius", F.lit(False))
    veto, soft = near & F.coalesce(F.col("hit_rate") <= 0.25, F.lit(False)), near & F.coalesce(F.col("hit_rate") <= 0.40, F.lit(False))
    out = {"action": F.when(veto, "veto").when(soft, "soften").otherwise("pass"), "confidence": F.when(veto, 0.0).when(soft, F.col("confidence") * 0.5).otherwise(F.col("confidence"))}
    if "signal" in rows.columns:
        out["signal"] = F.when(veto, 0.0).when(soft, F.col("signal") * 0.4).otherwise(F.col("signal"))
        if "direction" in rows.columns:
            out["direction"] = F.when(veto | (soft & (F.abs(F.col("signal") * 0.4) < 0.05)), "neutral").otherwise(F.col("direction"))
    return rows.withColumns(out)


def champion_challenger(holdout: DataFrame, champion: str, challenger: str, y: str = "y", margin: float = 0.01) -> DataFrame:
    """One row: both sign accuracies and whether the challenger is better by the margin."""
    ok = lambda s: F.avg((F.signum(s) == F.signum(y)).cast("double"))
    return holdout.agg(ok(champion).alias("champion"), ok(challenger).alias("challenger")).withColumn("promote", F.col("challenger") >= F.col("champion") + margin)


def champion_drift(verdicts: DataFrame, baseline: float, window: int = 50, least: int = 20, drop: float = 0.1, alpha: float = 0.1) -> DataFrame:
    """(n, ewma, drifted): one row, the moving hit rate of a champion's last ``window`` verdicts (t, hit) against its ``baseline``.

    The average starts with the oldest verdict of the window, so each one's weight is known by its place and no state walks the
    rows; under ``least`` verdicts nothing is said. Ties of t go by hit.
    """
    last = verdicts.filter("hit is not null").orderBy(F.desc("t"), "hit").limit(window).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("t"), "hit")) - 1)  # at most a window's rows
    n = last.withColumn("_n", F.count("*").over(Window.partitionBy()))
    weight = F.pow(F.lit(1 - alpha), F.col("_k")) * F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(alpha)
    out = n.agg(F.count("*").alias("n"), F.sum(weight * F.col("hit").cast("double")).alias("ewma"))
    known = F.when(F.col("n") >= least, F.col("ewma"))
    return out.select("n", known.alias("ewma"), F.coalesce(known < baseline - drop, F.lit(False)).alias("drifted"))


def adaptive_weights(hits: DataFrame, alpha: float = 0.05, power: float = 1.5, floor: float = 0.05) -> DataFrame:
    """(module, rate, weight): exponentially weighted hit rate (prior 0.5) of each module's hits in order, to a power, floored, shared out.

    The average of n hits is a weighted sum with known weights, so no state walks the rows.
    """
    w = Window.partitionBy("module").orderBy(F.desc("t"))
    aged = hits.withColumn("_k", F.row_number().over(w) - 1)
    rate = aged.groupBy("module").agg(F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("_k")) * F.col("hit").cast("double")).alias("_s"), F.count("*").alias("_n"))
    rate = rate.withColumn("rate", F.col("_s") + 0.5 * F.pow(F.lit(1 - alpha), F.col("_n")))
    raw = F.greatest(F.lit(floor), F.pow("rate", F.lit(power)))
    return rate.select("module", "rate", raw.alias("_w")).withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy())).drop("_w")
