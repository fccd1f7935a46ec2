"""Fitted models kept in a shared folder: the pipeline, the features it takes, the statistics that explain its
scores, and how it did when it was trained. Versions stand beside each other; none is ever overwritten."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.explain import feature_stats, stats_dict
from riskloom.operators.model import importances, model_columns, predict, training_report
from riskloom.streaming.score import Scoring

STATS = "feature string, mean double, std double, importance double, position int"
REPORT = (
    "tp long, fp long, tn long, fn long, precision double, recall double, f1 double, accuracy double, total long, anomaly_rate double,"
    " roc_auc double, train_size long, test_size long, feature_count int, anomaly_rate_train double, anomaly_rate_test double"
)


@dataclass
class StoredModel:
    """A model as it was saved: its pipeline, features in their order, (mean, deviation) and weight of each, report."""

    version: int
    pipeline: PipelineModel
    columns: list[str]
    stats: dict[str, tuple[float, float]]
    importance: dict[str, float]
    report: DataFrame

    def score(self, features: DataFrame, rule_rows: DataFrame | None = None) -> DataFrame:
        """Features with anomaly_score and is_anomaly; a feature that the model takes must be there."""
        missing = [c for c in self.columns if c not in features.columns]
        if missing:
            raise ValueError(f"model version {self.version} needs the features {missing}")
        return predict(self.pipeline, features, rule_rows)

    def scoring(self, rule_rows: DataFrame, run: str | None = None) -> Scoring:
        """What a scoring stream needs to score, explain and log with this model."""
        return Scoring(self.score, self.stats, self.importance, rule_rows, run or f"model-v{self.version}")


class ModelStore:
    """Models under `path`, one folder for each version; a version counts once its `done` table is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        try:
            done = self.spark.read.schema("version int").parquet(f"{self.path}/done")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["version"] for r in done.distinct().collect())

    def save(self, pipeline: PipelineModel, training: DataFrame, test: DataFrame, label: str = "is_anomaly") -> int:
        """Store a fitted pipeline with statistics of its training rows and its report; returns the version."""
        version = max(self.versions(), default=0) + 1
        at = f"{self.path}/version={version}"
        columns, weights = model_columns(pipeline), importances(pipeline)
        known = stats_dict(feature_stats(training, columns))
        # a feature without any value in training deviates by nothing
        rows = [(c, *map(float, known.get(c, (0.0, 1.0))), weights[c], i) for i, c in enumerate(columns)]
        pipeline.write().overwrite().save(f"{at}/pipeline")
        self.spark.createDataFrame(rows, STATS).coalesce(1).write.mode("overwrite").json(f"{at}/stats")
        report = training_report(pipeline, training, test, label)
        names = [c.split()[0] for c in REPORT.split(", ")]
        report.select(*names).write.mode("overwrite").json(f"{at}/report")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        return version

    def load(self, version: int | None = None) -> StoredModel:
        """A version, the newest if none is named."""
        known = self.versions()
        if not known or version not in (None, *known):
            raise ValueError(f"no such model: {version}; there are {known}")
        version = known[-1] if version is None else version
        at = f"{self.path}/version={version}"
        rows = self.spark.read.schema(STATS).json(f"{at}/stats").orderBy("position").collect()
        pipeline = PipelineModel.load(f"{at}/pipeline")
        columns = [r["feature"] for r in rows]
        if columns != model_columns(pipeline):
            raise ValueError(f"version {version} holds the statistics of another model")
        stats = {r["feature"]: (r["mean"], r["std"]) for r in rows}
        return StoredModel(version, pipeline, columns, stats, {r["feature"]: r["importance"] for r in rows}, self.spark.read.schema(REPORT).json(f"{at}/report"))

    def reports(self) -> DataFrame:
        """The report of every version."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], f"version int, {REPORT}")
        found = self.spark.read.schema(REPORT).option("basePath", self.path).json([f"{self.path}/version={v}/report" for v in known])
        return found.select(F.col("version").cast("int").alias("version"), *[c.split()[0] for c in REPORT.split(", ")])
