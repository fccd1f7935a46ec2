"""Why a row scored high: deviation from the training mean times feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators.reports import top_anomalies

STD_FLOOR = 1e-6


def feature_stats(features: DataFrame, columns: Sequence[str] = tuple(C.MODEL_FEATURES)) -> DataFrame:
    """Mean and floored deviation per feature over its non-null values, in one pass."""
    present = [c for c in columns if c in features.columns]
    wide = features.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("n"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.greatest(F.stddev_samp(F.col(c).cast("double")), F.lit(STD_FLOOR)).alias("std"),
            ).alias(f"_{c}")
            for c in present
        ]
    )
    return (
        wide.select(F.explode(F.array(*[F.col(f"_{c}") for c in present])).alias("s"))
        .select("s.*")
        .filter(F.col("n") > 0)
        .select("feature", "mean", "std")
    )


def stats_dict(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """One entry per feature column: bounded by the schema, not by the data."""
    return {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}


# Expressions over many features are SQL text: one parse instead of a Column object per operator.


def _number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _value(column: str) -> str:
    return f"coalesce(CAST(`{column}` AS DOUBLE), 0D)"


def signed_z(column: str, stats: dict[str, tuple[float, float]]) -> str:
    """Deviation in standard units; a missing value counts as 0, an unknown feature as no deviation."""
    if column not in stats:
        return "0D"
    mean, std = stats[column]
    return f"(({_value(column)} - {_number(mean)}) / {_number(std)})"


def display_name(column: str) -> str:
    return column.replace("_", " ").title()


def _kind(column: str) -> str:
    return "count" if "count" in column else "seconds" if "seconds" in column else "plain"


def contributions(
    columns: Sequence[str], stats: dict[str, tuple[float, float]], importance: dict[str, float], top_n: int = 5
) -> Column:
    """Array of the strongest contributors, largest first, ties in feature order."""
    if not columns:
        return F.expr("CAST(array() AS array<struct<feature:string,zscore:double,value:double,kind:string,label:string>>)")
    items = []
    for position, c in enumerate(columns):
        z, weight = signed_z(c, stats), _number(importance.get(c, 0.0))
        # The negated contribution and the position lead, so the natural order is the ranking.
        items.append(
            f"named_struct('_key', -abs({z}) * {weight}, '_position', {position}, 'feature', '{c}', 'value', {_value(c)},"
            f" 'zscore', {z}, 'importance', {weight}, 'kind', '{_kind(c)}', 'label', '{display_name(c)}')"
        )
    ranked = f"slice(array_sort(array({', '.join(items)})), 1, {int(top_n)})"
    return F.expr(ranked)


_CONTRIBUTOR = """named_struct('feature', c.feature, 'value', c.value, 'zscore', c.zscore, 'importance', c.importance,
 'contribution', abs(c.zscore) * c.importance, 'direction', CASE WHEN c.zscore > 0 THEN 'high' ELSE 'low' END)"""

# Words for a deviation and the z-scores they start at; phrases of counts and times.
_PHRASE = """concat(
 CASE WHEN c.zscore > 2 THEN 'very high' WHEN c.zscore > 1 THEN 'high'
  WHEN c.zscore < -2 THEN 'very low' WHEN c.zscore < -1 THEN 'low' ELSE 'unusual' END,
 CASE WHEN c.kind = 'count' THEN concat(' ', c.label, ' (', format_string('%d', CAST(c.value AS BIGINT)), ')')
  WHEN c.kind = 'seconds' AND c.value / 3600 > 24 THEN concat(' time gap (', format_string('%.1f', c.value / 3600 / 24), ' days)')
  WHEN c.kind = 'seconds' THEN concat(' time gap (', format_string('%.1f', c.value / 3600), 'h)')
  ELSE concat(' ', c.label) END)"""


def summary_text(top: str, score: str) -> str:
    """Sentence naming the two strongest contributors of the array column `top`."""
    share = f"format_string('%.2f%%', `{score}` * 100)"
    reason = f"array_join(transform(slice({top}, 1, 2), c -> {_PHRASE}), ' and ')"
    return (
        f"CASE WHEN size({top}) > 0 THEN concat('Anomaly (score: ', {share}, ') due to ', {reason}, '.')"
        f" ELSE concat('Anomaly score: ', {share}, '. No significant contributors.') END"
    )


def explain(
    df: DataFrame,
    stats: dict[str, tuple[float, float]],
    importance: dict[str, float],
    score: str = "anomaly_score",
    columns: Sequence[str] = tuple(C.MODEL_FEATURES),
    top_n: int = 5,
) -> DataFrame:
    """Add top_contributors and summary to every row; row-local, no shuffle."""
    present = [c for c in columns if c in df.columns]
    ranked = df.withColumn("_top", contributions(present, stats, importance, top_n))
    top = f"transform(_top, c -> {_CONTRIBUTOR})" if present else "_top"
    return ranked.selectExpr(
        *[f"`{c}`" for c in df.columns], f"{top} AS top_contributors", f"{summary_text('_top', score)} AS summary"
    )


def explain_anomalies(
    df: DataFrame,
    stats: dict[str, tuple[float, float]],
    importance: dict[str, float],
    score: str = "anomaly_score",
    threshold: float = 0.5,
    top_n: int = 5,
    limit: int | None = None,
) -> DataFrame:
    """Only rows at or above the threshold, highest score first; filtered before the array work."""
    return explain(top_anomalies(df, score, threshold, limit), stats, importance, score, top_n=top_n)


def global_importance(df: DataFrame, importance: dict[str, float]) -> DataFrame:
    """Importances of the features a table carries, largest first."""
    rows = [(f, float(w)) for f, w in importance.items() if f in df.columns]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
