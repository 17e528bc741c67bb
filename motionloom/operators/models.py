"""Model fitting with MLlib."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import evaluate as E

C_GRID = [0.01, 0.1, 1.0, 10.0, 100.0]


def fit_logistic(z: DataFrame, feats: list[str], y: str, weight: str, c: float):
    """L2 logistic regression on standardised features; C as in sum(loss) * C + 0.5 |beta|^2."""
    total = z.agg(F.sum(weight)).first()[0]
    data = VectorAssembler(inputCols=feats, outputCol="_x").transform(z)
    lr = LogisticRegression(featuresCol="_x", labelCol=y, weightCol=weight, elasticNetParam=0.0, regParam=1.0 / (c * total), standardization=False, maxIter=200, tol=1e-10)
    return lr.fit(data)


def coefficient_table(spark, model, feats: list[str]) -> DataFrame:
    rows = [(f, float(v), abs(float(v))) for f, v in zip(feats, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, standardized_coefficient double, absolute_coefficient double").orderBy(F.desc("absolute_coefficient"))


def score_logistic(model, z: DataFrame, feats: list[str]) -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=feats, outputCol="_x").transform(z))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def _balanced(scored: DataFrame, group: str, y: str) -> float:
    return E.binary_metrics(E.group_vote(scored, group, y, "p"), "actual", "predicted").first()["balanced_accuracy"]


def _fold_fit(train: DataFrame, test: DataFrame, feats: list[str], y: str, group: str, c: float, stage: bool = True) -> DataFrame:
    weighted = staged(E.group_weights(train, y, group), "cv-train")
    s = E.scaler(weighted, feats).first()  # one row of scaler numbers
    spec = {"median": [s[f"_med_{f}"] for f in feats], "mean": [s[f"_mean_{f}"] for f in feats], "scale": [max(s[f"_sd_{f}"], 0.0) or 1.0 for f in feats]}
    spec["scale"] = [v if v >= 1e-12 else 1.0 for v in spec["scale"]]
    z = weighted.withColumns({f: (F.coalesce(E.finite(f), F.lit(m)) - mu) / sd for f, m, mu, sd in zip(feats, spec["median"], spec["mean"], spec["scale"])})
    model = fit_logistic(z, feats, y, "weight", c)
    spec.update(intercept=model.intercept, coefficients=[float(v) for v in model.coefficients])
    return E.logistic_score(test, feats, spec, "p")


def nested_cv(df: DataFrame, feats: list[str], y: str, group: str, grid: list[float] | None = None, outer: int = 5, inner: int = 4) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities and one row per outer fold (selected C, group balanced accuracy).

    The driver only loops over (fold, C); every fit and score is a Spark job. Ties prefer the
    stronger penalty.
    """
    grid = grid or C_GRID
    spark = df.sparkSession
    per_class = df.groupBy(y, group).agg(F.lit(1).alias("_o")).groupBy(y).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    outer, inner = min(outer, per_class), min(inner, per_class)
    if outer < 2:
        raise ValueError("training needs at least two groups per class")
    data = staged(E.spread_join(df, E.group_folds(df, y, group, outer, 42), [group]), "cv")
    parts, rows = None, []
    for fold in range(outer):
        train, test = data.filter(F.col("fold") != fold).drop("fold"), data.filter(F.col("fold") == fold)
        best = (-1.0, grid[0])
        tuned = staged(E.spread_join(train, E.group_folds(train, y, group, inner, 314), [group]), "cv-inner")
        for c in grid:
            scores = [_balanced(_fold_fit(tuned.filter(F.col("fold") != i), tuned.filter(F.col("fold") == i), feats, y, group, c), group, y) for i in range(inner)]
            mean = sum(scores) / len(scores)
            if mean > best[0] + 1e-12:
                best = (mean, c)
        scored = staged(_fold_fit(train, test, feats, y, group, best[1]), "cv-out")
        rows.append((fold, best[1], float(_balanced(scored, group, y))))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts, spark.createDataFrame(rows, "fold int, selected_c double, group_balanced_accuracy double")


def fit_forest(train: DataFrame, feats: list[str], label: str, weight: str, trees: int = 40, depth: int = 6, seed: int = 7):
    """Multiclass trees with sample weights; ``label`` holds 0..k-1."""
    return RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, seed=seed).fit(
        VectorAssembler(inputCols=feats, outputCol="_x").transform(train))


def score_forest(model, df: DataFrame, feats: list[str]) -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=feats, outputCol="_x").transform(df))
    return out.withColumn("probabilities", vector_to_array("probability")).withColumn("predicted", F.col("prediction").cast("int")).drop("_x", "rawPrediction", "probability", "prediction")


def feature_importance(spark, model, feats: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feats, model.featureImportances.toArray())], "feature string, gain double").orderBy(F.desc("gain"))
