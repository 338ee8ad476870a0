"""Models over feature tables by Spark ML: scaling, regressions, boosted trees that stop early, calibration, clusters, importance, folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a column is shuffled among.
SHUFFLED = 10_000
#: Parts of [0, 1] in which probabilities are ranked.
PARTS = 256

MODELS = {
    "ridge": lambda y, **p: LinearRegression(featuresCol="features", labelCol=y, elasticNetParam=0.0, regParam=p.get("reg", 0.1)),
    "lasso": lambda y, **p: LinearRegression(featuresCol="features", labelCol=y, elasticNetParam=1.0, regParam=p.get("reg", 0.1)),
    "logistic": lambda y, **p: LogisticRegression(featuresCol="features", labelCol=y, regParam=p.get("reg", 0.0), **({"weightCol": p["weight"]} if "weight" in p else {})),
    "gbt_regressor": lambda y, **p: GBTRegressor(featuresCol="features", labelCol=y, maxIter=p.get("trees", 20), maxDepth=p.get("depth", 3), seed=0),
    "gbt_classifier": lambda y, **p: GBTClassifier(featuresCol="features", labelCol=y, maxIter=p.get("trees", 20), maxDepth=p.get("depth", 3), seed=0),
}


def fit(train: DataFrame, columns: list[str], label: str, kind: str, **params):
    """A pipeline of assembler, scaler and model; rows with a missing value do not count."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MODELS[kind](label, **params)]
    return Pipeline(stages=stages).fit(train.filter(F.col(label).isNotNull()))


def folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """Add fold 0 .. k of about equal size in the order of a column: fold i is tested on a model of the folds before it. Ties share a fold."""
    cuts = df.agg(F.percentile_approx(order, [i / (k + 1) for i in range(1, k + 1)], 100_000)).first()[0] or []
    return df.withColumn("fold", sum((F.when(F.col(order) > F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)))


def cross_validate(df: DataFrame, columns: list[str], label: str, kind: str, order: str, k: int = 3, **params) -> list[float]:
    """Score of each fold: area under the curve of a classifier, R2 of a regression."""
    df = folds(df, order, k)
    score = BinaryClassificationEvaluator(labelCol=label) if kind in ("logistic", "gbt_classifier") else RegressionEvaluator(labelCol=label, metricName="r2")
    return [score.evaluate(fit(df.filter(F.col("fold") < i), columns, label, kind, **params).transform(df.filter(F.col("fold") == i))) for i in range(1, k + 1)]


def permutation_importance(model, df: DataFrame, columns: list[str], label: str, metric) -> list[tuple[str, float]]:
    """Loss of the metric when a column is shuffled by a hash order within parts of about SHUFFLED random rows, the largest first."""
    base = metric.evaluate(model.transform(df))
    parts = max(1, df.count() // SHUFFLED)
    df = df.withColumn("_i", F.monotonically_increasing_id()).withColumn("_b", F.pmod(F.xxhash64("_i"), F.lit(parts)))
    own, other = (Window.partitionBy("_b").orderBy(x) for x in ("_i", F.xxhash64("_i", F.lit(1))))
    df = df.withColumn("_n", F.row_number().over(own))
    out = []
    for x in columns:
        mixed = df.select("_b", x, F.row_number().over(other).alias("_n"))
        out.append((x, base - metric.evaluate(model.transform(df.drop(x).join(mixed, ["_b", "_n"])))))
    return sorted(out, key=lambda p: -p[1])


def _kmeans(features: str, k: int, seed: int) -> KMeans:
    """At most k clusters: fewer where the rows have fewer distinct starts, which the solver by blocks can't do."""
    return KMeans(featuresCol=features, predictionCol="cluster", k=k, seed=seed, solver="row")


def clusters(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """df with a column cluster."""
    if df.isEmpty():
        return df.withColumn("cluster", F.lit(None).cast("int"))
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), _kmeans("_features", k, seed)]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_raw", "_features")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight: rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    rows, classes = counts.agg(F.sum("_n"), F.count("*")).first()
    return df.join(counts, label).withColumn("weight", F.lit(float(rows or 0)) / (F.lit(classes) * F.col("_n"))).drop("_n")


# --- early stopping -------------------------------------------------------------------------------


def fit_early(train: DataFrame, columns: list[str], label: str, kind: str, order: str, share: float = 0.15, trees: int = 300, depth: int = 4, pace: float = 0.05, tolerance: float = 0.01, weight: str | None = None) -> PipelineModel:
    """Boosted trees of at most ``trees`` trees: training ends when the loss on the last ``share`` of the rows by ``order`` no longer falls by tolerance.

    Ties of the order share a side. The number of trees is ``model.stages[-1].getNumTrees``.
    """
    train = train.filter(F.col(label).isNotNull())
    cut = train.agg(F.percentile_approx(order, 1 - share, 100_000)).first()[0]
    marked = train.withColumn("_late", F.coalesce(F.col(order) > F.lit(cut), F.lit(False)))
    make = {"gbt_classifier": GBTClassifier, "gbt_regressor": GBTRegressor}[kind]
    trees_ = make(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=pace, validationIndicatorCol="_late", validationTol=tolerance, seed=0)
    if weight is not None:
        trees_ = trees_.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), trees_]).fit(marked)


# --- calibration ----------------------------------------------------------------------------------


@dataclass
class Calibrated:
    """A classifier whose probability is mapped by an isotonic regression."""

    model: PipelineModel
    isotonic: IsotonicRegressionModel

    def transform(self, df: DataFrame) -> DataFrame:
        """df with p_raw, the classifier's probability of class 1, and p, the calibrated one."""
        return self.isotonic.transform(probabilities(self.model, df))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.isotonic.write().overwrite().save(f"{path}/isotonic")

    @classmethod
    def load(cls, path: str) -> Calibrated:
        return cls(PipelineModel.load(f"{path}/model"), IsotonicRegressionModel.load(f"{path}/isotonic"))


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df).withColumn("p_raw", vector_to_array("probability")[1])
    return out.select(*df.columns, "p_raw")


def held_out(df: DataFrame, columns: list[str], label: str, kind: str, order: str, k: int = 3, **params) -> DataFrame:
    """Rows of folds 1 .. k with fold and p_raw, each from a model of the folds before it."""
    df = folds(df.filter(F.col(label).isNotNull()), order, k)
    parts = [probabilities(fit(df.filter(F.col("fold") < i), columns, label, kind, **params), df.filter(F.col("fold") == i)) for i in range(1, k + 1)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def calibrate(df: DataFrame, columns: list[str], label: str, kind: str, order: str, k: int = 3, **params) -> Calibrated:
    """A classifier of all rows; its map comes from probabilities that models of earlier folds gave to later ones, never from rows a model has seen."""
    seen = held_out(df, columns, label, kind, order, k, **params).select("p_raw", F.col(label).cast("double").alias("_y"))
    isotonic = IsotonicRegression(featuresCol="p_raw", labelCol="_y", predictionCol="p").fit(seen)
    return Calibrated(fit(df, columns, label, kind, **params), isotonic)


def reliability(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate, gap: how often what was given a probability came true, by equal parts of [0, 1]; empty parts have no row."""
    rows = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull())
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))
    return out.withColumn("gap", F.col("mean_p") - F.col("rate"))


def _auc(rows: DataFrame) -> DataFrame:
    """Area under the curve of (p, y), ties counting a half: by running counts within parts of [0, 1] and over the parts."""
    g = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("part", F.floor(F.col("p") * PARTS))
    below = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = g.groupBy("part").agg(F.sum("neg").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    g = g.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0))).join(before, "part")
    won = F.sum(F.col("pos") * (F.col("before") + F.col("under") + F.col("neg") / 2.0))
    return g.agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def classification_metrics(df: DataFrame, p: str, label: str, threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """One row: n, base_rate, accuracy, precision, recall, f1, brier, log_loss, calibration_error, auc. NULL where a denominator is 0.

    Precision, recall and f1 are those of class 1 from ``threshold`` on; the calibration error
    is the mean distance of probability and rate over ``reliability``, weighted by rows.
    """
    rows = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).select(F.col(p).cast("double").alias("p"), F.col(label).cast("int").alias("y"))
    said = (F.col("p") >= threshold).cast("int")
    hit = F.sum(said * F.col("y")).cast("double")
    q = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    one = rows.agg(
        F.count("*").alias("n"), F.avg("y").alias("base_rate"), F.avg((said == F.col("y")).cast("double")).alias("accuracy"),
        F.try_divide(hit, F.sum(said)).alias("precision"), F.try_divide(hit, F.sum("y")).alias("recall"),
        F.try_divide(2 * hit, F.sum(said) + F.sum("y")).alias("f1"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
    )
    ece = reliability(rows, "p", "y", bins).agg(F.try_divide(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("calibration_error"))
    return one.crossJoin(ece).crossJoin(_auc(rows))


def class_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """class, precision, recall, f1, support of each class that occurs as a label or a prediction."""
    rows = df.select(F.col(predicted).cast("int").alias("p"), F.col(label).cast("int").alias("y")).dropna().groupBy("p", "y").agg(F.count("*").alias("n"))
    each = rows.select("n", F.explode(F.array_distinct(F.array("p", "y"))).alias("class"), "p", "y")
    own = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    of, said = F.col("y") == F.col("class"), F.col("p") == F.col("class")
    out = each.groupBy("class").agg(own(of & said).alias("hit"), own(said).alias("said"), own(of).alias("support"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return out.select("class", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


# --- two phases -----------------------------------------------------------------------------------


@dataclass
class TwoPhase:
    """Clusters of events, then a classifier that sees the cluster; one pipeline, so it is saved and loaded as one."""

    columns: list[str]
    pipeline: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], label: str, k: int = 4, trees: int = 100, depth: int = 3, seed: int = 0) -> TwoPhase:
        """Missing features count as 0; rows without a label are left out. Without a row with a label the model says NULL of every row."""
        train = df.filter(F.col(label).isNotNull()).fillna(0.0, columns)
        assembler = VectorAssembler(inputCols=columns, outputCol="_raw")
        if train.isEmpty():
            return cls(columns, PipelineModel([assembler]))
        stages = [
            assembler,
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
            _kmeans("_scaled", k, seed),
            VectorAssembler(inputCols=["_scaled", "cluster"], outputCol="_both"),
            GBTClassifier(featuresCol="_both", labelCol=label, predictionCol="_class", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed),
        ]
        return cls(columns, Pipeline(stages=stages).fit(train))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with cluster, pred (0 or 1) and pred_proba."""
        if len(self.pipeline.stages) == 1:
            return df.withColumns({"cluster": F.lit(None).cast("int"), "pred": F.lit(None).cast("int"), "pred_proba": F.lit(None).cast("double")})
        key = "_features_in"
        held = df.withColumn(key, F.struct(*df.columns)) if df.columns else df
        out = self.pipeline.transform(held.fillna(0.0, self.columns))
        return out.select(f"{key}.*", "cluster", F.col("_class").cast("int").alias("pred"), vector_to_array("probability")[1].alias("pred_proba"))

    def importances(self) -> list[tuple[str, float]]:
        """Features and the cluster by importance, the largest first; none of a model without rows."""
        if len(self.pipeline.stages) == 1:
            return []
        weights = self.pipeline.stages[-1].featureImportances.toArray()
        return sorted(zip([*self.columns, "cluster"], map(float, weights), strict=True), key=lambda x: -x[1])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> TwoPhase:
        pipeline = PipelineModel.load(path)
        return cls(pipeline.stages[0].getInputCols(), pipeline)


def cluster_report(df: DataFrame, label: str, means: list[str]) -> DataFrame:
    """cluster, n, rate (percent of label 1) and the means of some columns."""
    return df.groupBy("cluster").agg(F.count("*").alias("n"), (F.avg(F.col(label).cast("double")) * 100).alias("rate"), *[F.avg(x).alias(f"mean_{x}") for x in means])


def two_phase_scores(df: DataFrame, columns: list[str], label: str, order: str, k: int = 3, **params) -> list[float]:
    """Accuracy of each fold in the order of a column, by a model of the folds before it."""
    df = folds(df.filter(F.col(label).isNotNull()), order, k)
    out = []
    for i in range(1, k + 1):
        seen = TwoPhase.fit(df.filter(F.col("fold") < i), columns, label, **params).predict(df.filter(F.col("fold") == i))
        out.append(seen.agg(F.avg((F.col("pred") == F.col(label)).cast("double"))).first()[0])
    return out
