"""Window sizes of each path and family, in one pass over the paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FAMILIES, Family, WindowConfig
from ..schemas import finite

RAW = 0.0


def label(window_m: Column) -> Column:
    """Wraw for 0, else W<km>km with at most six significant digits."""
    km = window_m / 1000
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(km))).cast("int")
    text = F.element_at(F.array(*[F.format_string(f"%.{d}f", F.round(km, d)) for d in range(7)]), F.least(digits, F.lit(6)) + 1)
    short = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(window_m <= 0, "Wraw").otherwise(F.concat(F.lit("W"), short, F.lit("km")))


def window_points(window_m: Column, spacing_m: Column) -> Column:
    """Points of a window: the nearest number of steps, ties to even, three at least; one for the raw window."""
    return F.when(window_m <= 0, 1).otherwise(F.greatest(F.rint(window_m / spacing_m), F.lit(3.0))).cast("int")


def path_facts(profile: DataFrame, config: WindowConfig) -> DataFrame:
    """Number of nodes, length, spacing and width quantiles of each path."""
    order = Window.partitionBy("mip").orderBy("pos")
    w = finite(F.col("width"))
    step = F.col("dist_m") - F.lag("dist_m").over(order)
    rows = profile.select("mip", "dist_m", F.when(w > 0, w).alias("_w"), F.when(step > 0, step).alias("_s"))
    return rows.groupBy("mip").agg(
        F.count("*").alias("n_nodes"),
        (F.max("dist_m") - F.min("dist_m")).alias("length_m"),
        F.percentile("_s", F.lit(0.5)).alias("spacing_m"),
        F.percentile("_w", F.array(F.lit(config.low_quantile), F.lit(config.high_quantile))).alias("_q"),
    ).select("mip", "n_nodes", "length_m", "spacing_m", F.get("_q", F.lit(0)).alias("width_low"), F.get("_q", F.lit(1)).alias("width_high"))


def plan_windows(profile: DataFrame, config: WindowConfig = WindowConfig(), families: Sequence[Family] = FAMILIES) -> DataFrame:
    """A row for each path, family and window, with its points and whether the path has so many nodes.

    Windows of a family are spaced evenly in the logarithm between the two width multiples,
    within a share of the path and no less than a few steps, rounded to whole steps, each
    once. A path without widths or steps has no windows but the raw one.
    """
    facts = path_facts(profile, config)
    table = F.array(*[F.struct(F.lit(f.name).alias("family"), F.lit(f.n_windows).alias("n"), F.lit(f.raw or config.method == "raw").alias("raw")) for f in families])
    rows = facts.withColumn("_f", F.explode(table)).select("*", "_f.family", F.col("_f.n").alias("n_nominal"), "_f.raw").drop("_f")
    least = F.col("spacing_m") * max(config.min_points, 3)
    known = F.col("width_low").isNotNull()
    top = F.when(known, F.lit(config.most_m)) if config.most_m is not None else F.col("width_high") * config.high_multiple
    if config.max_fraction is not None:
        top = F.least(top, F.col("length_m") * config.max_fraction)
    low = F.greatest(F.when(known, F.lit(config.least_m)) if config.least_m is not None else F.col("width_low") * config.low_multiple, least)
    low = F.when(known, low)
    rows = rows.withColumn("_low", low).withColumn("_high", F.greatest(top, F.col("_low")))
    n = F.col("n_nominal")
    close = F.abs(F.col("_high") - F.col("_low")) <= 1e-8 + 1e-5 * F.abs(F.col("_high"))
    spaced = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.exp(F.log("_low") + i * (F.log("_high") - F.log("_low")) / F.greatest(n - 1, F.lit(1))),
    )
    if config.method == "fixed":
        sizes = F.array(*[F.lit(float(x)) for x in config.windows_m])
    else:
        sizes = F.when((n == 1) | close, F.array("_low")).otherwise(spaced)
    if config.round_to_spacing:
        sizes = F.transform(sizes, lambda w: F.greatest(F.rint(w / F.col("spacing_m")) * F.col("spacing_m"), least))
    sizes = F.array_sort(F.array_distinct(sizes))
    sizes = F.when(F.col("raw"), F.array(F.lit(RAW))).when(F.col("_low").isNull() & F.lit(config.method != "fixed"), F.array().cast("array<double>")).otherwise(sizes)
    out = rows.select("*", F.posexplode(sizes).alias("_order", "window_m"))
    points = window_points(F.col("window_m"), F.col("spacing_m"))
    return out.select(
        "mip", "family", F.col("_order").cast("int").alias("window_order"), "window_m", label(F.col("window_m")).alias("window_label"),
        points.alias("window_pts"), (points <= F.col("n_nodes")).alias("is_feasible"), "n_nominal", "n_nodes", "spacing_m", "length_m", "width_low", "width_high",
    )


def feasibility(plan: DataFrame) -> DataFrame:
    """Windows of each path and family, and how many of them the path can hold."""
    return plan.groupBy("mip", "family").agg(
        F.first("n_nodes").alias("n_nodes"),
        F.count("*").alias("n_windows"),
        F.count_if("is_feasible").alias("n_feasible"),
        F.array_sort(F.collect_list(F.when(~F.col("is_feasible"), F.col("window_m")))).alias("dropped_windows_m"),
    )


def tuning_plan(plan: DataFrame) -> DataFrame:
    """Windows for tuning: a family with any window that does not fit is left out of its path."""
    every = Window.partitionBy("mip", "family")
    return plan.withColumn("_all", F.min(F.col("is_feasible").cast("int")).over(every)).where("_all = 1").drop("_all")


def final_plan(plan: DataFrame) -> DataFrame:
    """Windows for a final run: those that fit are kept."""
    return plan.where("is_feasible")


def excluded_runs(plan: DataFrame) -> DataFrame:
    """Families left out of tuning, with why."""
    facts = feasibility(plan).where("n_feasible < n_windows")
    return facts.select("mip", "family", F.lit("excluded").alias("status"), F.lit("window_exceeds_path").alias("reason"), "n_nodes", "n_windows", "n_feasible", "dropped_windows_m")


def skipped_paths(plan: DataFrame) -> DataFrame:
    """Families of a final run of which no window fits."""
    return feasibility(plan).where("n_feasible = 0").select("mip", "family", F.lit("skipped").alias("status"), F.lit("no_feasible_window").alias("reason"), "n_nodes", "n_windows")
