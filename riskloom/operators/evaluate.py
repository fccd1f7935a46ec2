"""Measuring scores against labels, exact under ties and at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.ranks import running_totals


def ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1)."""
    return num / F.greatest(den, F.lit(1))


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and positive rate at a threshold."""
    hit, pos = F.col(score) >= threshold, F.col(label) > 0
    counts = df.agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    found = tp * 2 + fp + fn
    return counts.select(
        "tp",
        "fp",
        "tn",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        F.when(found > 0, tp * 2 / found).otherwise(0.0).alias("f1"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        (tp + fp + tn + fn).alias("total"),
        ratio(tp + fn, tp + fp + tn + fn).alias("anomaly_rate"),
    )


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    pos = F.col(label) > 0
    return df.groupBy((F.col(score).cast("double") + F.lit(0.0)).alias("score")).agg(
        F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")
    )


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half; 0 without positives."""
    ranked = running_totals(_by_score(df, score, label), [], ["score"], ["n"])
    below = F.col("cum_n") - F.col("n")
    wins = F.sum(F.col("p") * (below + F.col("n") / 2))
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return ranked.agg(wins.alias("_w"), pairs.alias("_pairs")).select(
        F.when(F.col("_pairs") > 0, F.col("_w") / F.col("_pairs")).otherwise(0.0).alias("roc_auc")
    )


def curve_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC and precision-recall point for every distinct score used as threshold."""
    by_score = _by_score(df, score, label)
    ranked = running_totals(by_score, [], ["score"], ["p", "n"], descending=True)
    total = by_score.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    pos, neg = float(total["p"] or 0), float(total["n"] or 0)
    tp, fp = F.col("cum_p"), F.col("cum_n")
    return ranked.select(
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / pos if pos else F.lit(0.0)).alias("tpr"),
        (fp / neg if neg else F.lit(0.0)).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        (F.col("p") / pos if pos else F.lit(0.0)).alias("recall_step"),
    )


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision: precision at each threshold weighted by the recall it adds."""
    points = curve_points(df, score, label)
    return points.agg(F.coalesce(F.sum(F.col("precision") * F.col("recall_step")), F.lit(0.0)).alias("pr_auc"))


def compare_detectors(df: DataFrame, scores: list[str], label: str, threshold: float = 0.5) -> DataFrame:
    """One row of confusion measures per score column."""
    long = df.select(
        F.col(label).alias("_y"), F.explode(F.array(*[F.struct(F.lit(s).alias("detector"), F.col(s).alias("_s")) for s in scores])).alias("p")
    ).select("_y", "p.*")
    hit, pos = F.col("_s") >= threshold, F.col("_y") > 0
    counts = long.groupBy("detector").agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "detector", "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )
