"""Has the score distribution moved: population stability and Jensen-Shannon divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.plans.lineage import cut_lineage
from riskloom.plans.ranks import exact_quantiles

BINS = 10
FLOOR = 1e-6


def split_at(df: DataFrame, days: int = C.DRIFT_WINDOW_DAYS, ts: str = "ts") -> DataFrame:
    """Add is_current: inside the last `days` before the newest row."""
    newest = df.agg(F.max(ts)).first()[0]
    edge = F.lit(newest) - F.make_dt_interval(F.lit(days))
    return df.withColumn("is_current", F.col(ts) > edge)


def bin_shares(df: DataFrame, value: str = "score", bins: int = BINS) -> DataFrame:
    """Share of reference (p) and current (q) rows per bin, edges at the reference quantiles.

    Bin i holds values above edge i and up to edge i+1; the outer bins are open.
    """
    df = cut_lineage(df.select(value, "is_current"), "scores")  # read several times below
    reference = df.filter(~F.col("is_current"))
    probs = [i / bins for i in range(1, bins)]
    edges = sorted(r["quantile"] for r in exact_quantiles(reference, [], value, probs).collect())
    index = sum((F.when(F.col(value) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(index.alias("bin"))
        .agg(F.count_if(~F.col("is_current")).alias("ref"), F.count_if("is_current").alias("cur"))
    )
    totals = counts.agg(F.sum("ref").alias("r"), F.sum("cur").alias("c")).first()
    n_ref, n_cur = float(totals["r"] or 1) or 1.0, float(totals["c"] or 1) or 1.0
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    share = lambda c, n: F.coalesce(F.col(c), F.lit(0)) / F.lit(n)
    return all_bins.join(counts, "bin", "left").select("bin", share("ref", n_ref).alias("p"), share("cur", n_cur).alias("q"))


def psi(shares: DataFrame) -> DataFrame:
    """Sum of (p - q) ln(p / q) over bins, shares floored, with its band."""
    p, q = F.greatest("p", F.lit(FLOOR)), F.greatest("q", F.lit(FLOOR))
    value = shares.agg(F.sum((p - q) * F.log(p / q)).alias("psi"))
    band = F.when(F.col("psi") >= C.PSI_THRESHOLD, "major").when(F.col("psi") >= C.PSI_WATCH, "moderate").otherwise("stable")
    return value.withColumn("band", band)


def js_divergence(shares: DataFrame) -> DataFrame:
    """Base-2 Jensen-Shannon divergence: 0 for equal, 1 for disjoint distributions."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    value = shares.agg((F.sum(part(p)) / 2 + F.sum(part(q)) / 2).alias("js"))
    return value.withColumn("drifted", F.col("js") > C.JS_THRESHOLD)
