"""The distance at which breaks of different settings count as one, from the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CalibrationConfig


def gap_pairs(positions: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """Neighbouring positions of a run, with what their supports say of them.

    positions: (mip, family, break_m, support). A pair of a dominant and a satellite is
    likely the same break; one of two supported ones is risky to merge; the rest is neither.
    """
    w = Window.partitionBy("mip", "family").orderBy("break_m")
    pairs = positions.select(
        "mip", "family", F.col("break_m").alias("left_m"), F.lead("break_m").over(w).alias("right_m"), F.col("support").alias("left_support"), F.lead("support").over(w).alias("right_support")
    ).where("right_m is not null")
    high, low = F.greatest("left_support", "right_support"), F.least("left_support", "right_support")
    kind = F.when((high >= config.dominant_min) & (low <= config.satellite_max), "likely_same").when(low >= config.supported_min, "risky").otherwise("intermediate")
    return pairs.withColumn("gap_m", F.col("right_m") - F.col("left_m")).withColumn("gap_km", (F.col("right_m") - F.col("left_m")) / 1000).withColumn("pair_type", kind)


def family_gaps(pairs: DataFrame, config: CalibrationConfig = CalibrationConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles of the likely-same gaps of each family that has enough of them."""
    used = pairs.where((F.col("pair_type") == "likely_same") & F.col("family").isin(*config.families))
    return used.groupBy(*keys, "family").agg(
        F.count("*").alias("n_pairs"), F.percentile("gap_km", F.lit(0.9)).alias("q90_km"), F.percentile("gap_km", F.lit(0.95)).alias("q95_km"), F.max("gap_km").alias("max_km")
    ).where(F.col("n_pairs") >= config.min_pairs)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def weighted_median(df: DataFrame, value: str, weight: str, keys: tuple[str, ...], out: str) -> DataFrame:
    """The first value, by size, at which half of the weight is reached."""
    w = Window.partitionBy(*keys).orderBy(value, weight)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    share = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total
    return df.withColumn("_share", share).where("_share >= 0.5").groupBy(*keys).agg(F.min(value).alias(out))


def thresholds(gaps: DataFrame, keys: tuple[str, ...], config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """One threshold for each key: means and medians over families, weighted by pairs, of both quantiles.

    Each quantile is the middle of its weighted mean and weighted median; the threshold is
    the middle of both, rounded half to even.
    """
    base = gaps.groupBy(*keys).agg(
        F.count("*").alias("n_families"),
        F.sum("n_pairs").alias("n_pairs"),
        F.array_sort(F.collect_set("family")).alias("families"),
        weighted_mean(F.col("q90_km"), F.col("n_pairs")).alias("mean90"),
        weighted_mean(F.col("q95_km"), F.col("n_pairs")).alias("mean95"),
    )
    for q in ("90", "95"):
        base = base.join(weighted_median(gaps, f"q{q}_km", "n_pairs", keys, f"median{q}"), list(keys))
    raw = ((F.col("mean90") + F.col("median90")) / 2 + (F.col("mean95") + F.col("median95")) / 2) / 2
    return base.withColumn("raw_km", raw).withColumn("threshold_km", F.rint(raw / config.round_km) * config.round_km)


def sweep_limits(pairs: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """A threshold for each upper limit on the gaps; a limit without a family has none."""
    limits = F.explode(F.array(*[F.lit(float(u)) for u in config.upper_limits_km]))
    local = pairs.withColumn("upper_km", limits).where(F.col("gap_km") <= F.col("upper_km"))
    found = thresholds(family_gaps(local, config, ("upper_km",)), ("upper_km",), config)
    every = pairs.sparkSession.createDataFrame([(float(u),) for u in config.upper_limits_km], "upper_km double")
    return every.join(found, "upper_km", "left")


def first_plateau(sweep: DataFrame, config: CalibrationConfig = CalibrationConfig(), families: tuple[str, ...] | None = None) -> DataFrame:
    """The first limit from which enough in a row have the same families and thresholds within the tolerance.

    The sweep has a row for each limit, some ten.
    """
    n = config.min_consecutive
    w = Window.partitionBy(F.lit(1)).orderBy("upper_km")
    ahead = w.rowsBetween(0, n - 1)
    names = F.concat_ws(",", "families")
    steady = (
        (F.count("*").over(ahead) == n)
        & (F.count("threshold_km").over(ahead) == n)
        & (F.min(names).over(ahead) == F.max(names).over(ahead))
        & (F.max("threshold_km").over(ahead) - F.min("threshold_km").over(ahead) <= config.tolerance_km)
        & (F.col("n_families") >= config.min_families)
    )
    if families is not None:
        steady &= names == ",".join(sorted(families))
    return sweep.withColumn("_steady", steady).where("_steady").drop("_steady").orderBy("upper_km").limit(1)


def calibrate(positions: DataFrame, config: CalibrationConfig = CalibrationConfig(), frozen_km: float = 11.5) -> dict:
    """The merge threshold in km and how it was found: a plateau of three families, of two, or the frozen value."""
    pairs = gap_pairs(positions, config)
    sweep = sweep_limits(pairs, config)
    for least in (config.min_families, 2):
        row = first_plateau(sweep, CalibrationConfig(**{**config.__dict__, "min_families": least})).first()
        if row:
            return {"threshold_km": row["threshold_km"], "upper_km": row["upper_km"], "n_families": row["n_families"], "method": f"first_plateau_{least}", "pairs": pairs, "sweep": sweep}
    return {"threshold_km": frozen_km, "upper_km": None, "n_families": 0, "method": "frozen", "pairs": pairs, "sweep": sweep}
