"""Supervised scoring with Spark ML boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import hash_order
from riskloom.operators.evaluate import confusion, roc_auc
from riskloom.operators.features import fill_nulls
from riskloom.operators.impact import match_scenario
from riskloom.operators.labels import label_any, label_interval_join
from riskloom.plans.ranks import running_totals
from riskloom.plans.sampling import sample_rows

# Trees, depth, step, row share and column share per tree, weight cap, cut-off.
TREES, DEPTH, STEP, ROW_SHARE, COLUMN_SHARE = 100, 6, 0.1, 0.8, 0.8
MAX_CLASS_WEIGHT = 100.0
THRESHOLD = 0.5
SEED = 42


def training_set(
    features: DataFrame,
    labels: DataFrame,
    columns: Sequence[str] = tuple(C.MODEL_FEATURES),
    sample_size: int | None = None,
    one_row_per_event: bool = True,
) -> DataFrame:
    """Event id, filled model features and is_anomaly. One row for each event, unless rows are asked for each label."""
    joined = (label_any if one_row_per_event else label_interval_join)(features, labels)
    if sample_size:
        joined = sample_rows(joined, sample_size)
    present = [c for c in columns if c in joined.columns]
    return fill_nulls(joined.select("source_dataset", "event_id", *present, "is_anomaly"), present)


def stratified_split(df: DataFrame, label: str = "is_anomaly", test_size: float = 0.2, id_col: str = "event_id") -> DataFrame:
    """Add is_test: in each class (in the whole table if positives are 10 or fewer) the rows with the
    smallest id hashes, rounded share. Copies of one id stay on the same side.

    Only the hash at the cut is looked up, through distributed ranks, so a huge class is no bottleneck.
    """
    positives = df.filter(F.col(label) > 0).count()
    strata = F.col(label) if positives > 10 else F.lit(0)
    tagged = df.withColumn("_stratum", strata.cast("int")).withColumn("_hash", hash_order(id_col))
    counts = tagged.groupBy("_stratum", "_hash").agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, ["_stratum"], ["_hash"], ["_n"])
    sizes = ranked.groupBy("_stratum").agg(F.round(F.max("cum__n") * test_size).cast("long").alias("_want"))
    cuts = (
        ranked.join(F.broadcast(sizes), "_stratum")  # one row per class
        .filter(F.col("cum__n") <= F.col("_want"))
        .groupBy("_stratum")
        .agg(F.max("_hash").alias("_cut"))
    )
    return (
        tagged.join(F.broadcast(cuts), "_stratum", "left")
        .withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)))
        .drop("_stratum", "_hash", "_cut")
    )


def class_weight(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Negatives per positive, at most 100; 1 without positives."""
    counts = df.agg(F.count_if(F.col(label) > 0).alias("positives"), F.count_if(F.col(label) <= 0).alias("negatives"))
    weight = F.least(F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)), F.lit(MAX_CLASS_WEIGHT))
    return counts.withColumn("class_weight", F.when(F.col("positives") > 0, weight).otherwise(1.0))


def train(
    training: DataFrame,
    columns: Sequence[str] = tuple(C.MODEL_FEATURES),
    label: str = "is_anomaly",
    trees: int = TREES,
    depth: int = DEPTH,
    balance: bool = True,
) -> PipelineModel:
    """Boosted trees on the training rows; positives weigh as much as negatives when balanced."""
    present = [c for c in columns if c in training.columns]
    weight = class_weight(training, label).first()["class_weight"] if balance else 1.0
    weighted = training.withColumn("_weight", F.when(F.col(label) > 0, F.lit(float(weight))).otherwise(1.0)).withColumn(
        "_label", F.col(label).cast("double")
    )
    stages = [
        VectorAssembler(inputCols=present, outputCol="_features"),
        GBTClassifier(
            featuresCol="_features",
            labelCol="_label",
            weightCol="_weight",
            predictionCol="_prediction",
            maxIter=trees,
            maxDepth=depth,
            stepSize=STEP,
            subsamplingRate=ROW_SHARE,
            featureSubsetStrategy=str(COLUMN_SHARE),
            seed=SEED,
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def model_columns(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def predict(model: PipelineModel, features: DataFrame, rule_rows: DataFrame | None = None) -> DataFrame:
    """Add anomaly_score and is_anomaly (and scenario_match, given rules). Input values are untouched."""
    columns = model_columns(model)
    rows = features.withColumn("_in", F.struct(*[F.col(c) for c in columns]))
    scored = model.transform(fill_nulls(rows, columns))
    score = vector_to_array("probability")[1]
    kept = [F.col(f"_in.{c}").alias(c) if c in columns else F.col(c) for c in features.columns]
    out = scored.select(*kept, score.alias("anomaly_score")).withColumn(
        "is_anomaly", F.when(F.col("anomaly_score") >= THRESHOLD, 1).otherwise(0)
    )
    return match_scenario(out, rule_rows) if rule_rows is not None else out


def importances(model: PipelineModel) -> dict[str, float]:
    weights = model.stages[-1].featureImportances
    return {c: float(weights[i]) for i, c in enumerate(model_columns(model))}


def importance_table(model: PipelineModel, spark) -> DataFrame:
    rows = sorted(importances(model).items(), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def evaluate(model: PipelineModel, test: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Confusion measures and ROC AUC on held-out rows."""
    truth = test.withColumnRenamed(label, "_truth")
    scored = predict(model, truth).select("anomaly_score", "_truth").persist()
    auc = roc_auc(scored, "anomaly_score", "_truth").first()["roc_auc"]
    return confusion(scored, "anomaly_score", "_truth", THRESHOLD).withColumn("roc_auc", F.lit(auc))


def training_report(model: PipelineModel, training: DataFrame, test: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Held-out quality with the sizes of both parts, their anomaly rates, and the number of features."""
    rate = F.avg(F.when(F.col(label) > 0, 1.0).otherwise(0.0))
    parts = [df.agg(F.count("*").alias(f"{name}_size"), rate.alias(f"anomaly_rate_{name}")) for name, df in (("train", training), ("test", test))]
    sizes = parts[0].join(F.broadcast(parts[1]), F.lit(True))  # one row each
    quality = evaluate(model, test, label).join(F.broadcast(sizes), F.lit(True))
    return quality.withColumn("feature_count", F.lit(len(model_columns(model))))
