"""Baselines on pyspark.ml: what a candidate has to beat."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import q

FAMILIES = {
    "logistic": lambda seed: LogisticRegression(labelCol="label", maxIter=50),
    "forest": lambda seed: RandomForestClassifier(labelCol="label", numTrees=30, seed=seed),
    "boosted": lambda seed: GBTClassifier(labelCol="label", maxIter=20, seed=seed),
    "linear": lambda seed: LinearRegression(labelCol="label", maxIter=50, regParam=0.0),
    "elastic": lambda seed: LinearRegression(labelCol="label", maxIter=100, regParam=0.1, elasticNetParam=0.5),
    "forest_regressor": lambda seed: RandomForestRegressor(labelCol="label", numTrees=30, seed=seed),
    "boosted_regressor": lambda seed: GBTRegressor(labelCol="label", maxIter=20, seed=seed),
}


def fit(train: DataFrame, target: str, numbers: list[str], labels: list[str] = (), family: str = "logistic", seed: int = 7) -> PipelineModel:
    """Impute, scale and encode on the training rows only, then fit; unseen categories are kept as their own."""
    stages = []
    if numbers:
        stages += [Imputer(inputCols=numbers, outputCols=[f"{c}_i" for c in numbers], strategy="median"), VectorAssembler(inputCols=[f"{c}_i" for c in numbers], outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    for c in labels:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_x", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_x"], outputCols=[f"{c}_v"], handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=["scaled"] * bool(numbers) + [f"{c}_v" for c in labels], outputCol="features"))
    rows = train.withColumns({c: q(c).cast("double") for c in numbers}).withColumn("label", q(target).cast("double")).where("label IS NOT NULL")
    return Pipeline(stages=[*stages, FAMILIES[family](seed)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, numbers: list[str]) -> DataFrame:
    """df with prediction, and probability of the second class where the model has one."""
    out = model.transform(df.withColumns({c: q(c).cast("double") for c in numbers}))
    keep = [*map(q, df.columns), F.col("prediction")]
    return out.select(*keep, *([vector_to_array("probability")[1].alias("probability")] if "probability" in out.columns else []))


def prevalence(train: DataFrame, target: str) -> DataFrame:
    """majority (ties by value), share: the classifier that looks at nothing."""
    counts = train.where(q(target).isNotNull()).groupBy(q(target).alias("majority")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "majority").limit(1).crossJoin(F.broadcast(total)).select("majority", (F.col("n") / F.col("total")).alias("share"))


def out_of_fold(df: DataFrame, target: str, numbers: list[str], fold: str, k: int, family: str) -> DataFrame:
    """df with each row's prediction by the model that never saw its fold."""
    parts = [predict(fit(df.where(q(fold) != i), target, numbers, family=family), df.where(q(fold) == i), numbers) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pca_scores(df: DataFrame, numbers: list[str], k: int = 2) -> DataFrame:
    """df with reconstruction_error: the squared length outside the first k components of the standardised columns."""
    rows = df.withColumns({f"{c}_d": F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in numbers})
    prepared = Pipeline(stages=[VectorAssembler(inputCols=[f"{c}_d" for c in numbers], outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_p")]).fit(rows).transform(rows)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    return prepared.withColumn("reconstruction_error", F.greatest(F.lit(0.0), square("_z") - square("_p"))).select(*map(q, df.columns), "reconstruction_error")
