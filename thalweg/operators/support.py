"""Breaks of many runs, clustered along the path and scored by how many runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chain_clusters(breaks: DataFrame, tolerance_m: float, keys: tuple[str, ...] = ("mip", "family"), position: str = "break_m", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add cluster_id: a break joins the one before it if no further away than the tolerance."""
    w = Window.partitionBy(*keys).orderBy(position, *ties)
    new = F.when(F.col(position) - F.lag(position).over(w) > tolerance_m, 1).otherwise(0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return breaks.withColumn("_new", new).withColumn("cluster_id", F.sum("_new").over(run).cast("int")).drop("_new")


def support_table(runs: DataFrame, tolerance_m: float = 1000.0) -> DataFrame:
    """Clusters of each path and family with their support among runs, windows and penalties.

    Runs without breaks count in the totals.
    """
    # Sizes of sets: each distinct count beside another would go over a copy of all rows.
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    totals = runs.groupBy("mip", "family").agg(F.count("*").alias("runs_total"), distinct("window_m").alias("windows_total"))
    breaks = runs.select("mip", "family", "window_m", "window_label", "penalty", F.explode("break_m").alias("break_m"))
    clustered = chain_clusters(breaks, tolerance_m, ties=("window_m", "penalty"))
    pair = F.struct("window_m", "penalty")
    table = clustered.groupBy("mip", "family", "cluster_id").agg(
        F.percentile("break_m", F.lit(0.5)).alias("center_m"),
        F.count("*").alias("n_members"),
        F.sort_array(F.collect_list("break_m")).alias("members_m"),
        distinct("window_m").alias("n_windows_supported"),
        F.sort_array(F.collect_set("window_label")).alias("windows_supported"),
        distinct("penalty").alias("n_penalties_supported"),
        F.sort_array(F.collect_set("penalty")).alias("penalties_supported"),
        distinct(pair).alias("n_run_pairs_supported"),
        F.sort_array(F.collect_set(pair)).alias("run_pairs_supported"),
        F.sort_array(F.collect_list(F.struct("window_label", "window_m", "penalty"))).alias("_members"),
    )
    window = lambda m: F.struct(m["window_label"], m["window_m"])
    penalties = lambda w: F.transform(F.filter("_members", lambda m: window(m) == w), lambda m: m["penalty"])
    by_window = lambda value: F.map_from_entries(F.transform(F.array_distinct(F.transform("_members", window)), lambda w: F.struct(w["window_label"], value(penalties(w)))))
    out = table.join(totals, ["mip", "family"])
    return (
        out.withColumn("support_by_window", by_window(F.array_distinct))
        .withColumn("support_counts_by_window", by_window(F.size))
        .drop("_members")
        .withColumn("frequency", F.col("n_members") / F.col("runs_total"))
        .withColumn("support_runs", F.col("n_run_pairs_supported") / F.col("runs_total"))
        .withColumn("support_windows", F.col("n_windows_supported") / F.col("windows_total"))
    )


def in_support_order(table: DataFrame) -> DataFrame:
    """Best supported first: windows, runs, frequency, members."""
    return table.orderBy("mip", "family", F.desc("n_windows_supported"), F.desc("support_runs"), F.desc("frequency"), F.desc("n_members"), "cluster_id")


def support_class(support, core: float = 0.75, medium: float = 0.50):
    return F.when(support >= core, "core").when(support >= medium, "medium").otherwise("weak")


def collapse_exact(breaks: DataFrame, keys: tuple[str, ...] = ("mip", "family")) -> DataFrame:
    """One row for each position, with the settings that chose it and the gaps to its neighbours."""
    one = breaks.groupBy(*keys, "n_settings", "break_m").agg(F.countDistinct("setting").alias("n_supported"), F.sort_array(F.collect_set("setting")).alias("settings_supported"))
    w = Window.partitionBy(*keys).orderBy("break_m")
    return (
        one.withColumn("support", F.col("n_supported") / F.col("n_settings"))
        .withColumn("gap_before_m", F.col("break_m") - F.lag("break_m").over(w))
        .withColumn("gap_after_m", F.lead("break_m").over(w) - F.col("break_m"))
    )
