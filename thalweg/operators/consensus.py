"""Breaks on which the settings agree, and the segments they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConsensusConfig, final_stable_count
from .support import support_class


def anchored_starts(sorted_positions: Column, threshold_m: float) -> Column:
    """First positions of clusters that are closed once the next is further from their first than the threshold."""
    none = F.array().cast("array<double>")
    return F.aggregate(
        sorted_positions,
        none,
        lambda starts, b: F.when((F.size(starts) == 0) | (b - F.element_at(starts, -1) > threshold_m), F.concat(starts, F.array(b))).otherwise(starts),
    )


def anchored_clusters(breaks: DataFrame, threshold_m: float, keys: tuple[str, ...] = ("mip", "family")) -> DataFrame:
    """Add cluster_id: each cluster spans at most the threshold from its first break.

    The fold runs over the distinct positions of a path, which are few.
    """
    starts = breaks.groupBy(*keys).agg(anchored_starts(F.array_sort(F.collect_set(F.col("break_m").cast("double"))), threshold_m).alias("_starts"))
    number = F.size(F.filter("_starts", lambda s: s <= F.col("break_m"))) - 1
    return breaks.join(starts, list(keys)).withColumn("cluster_id", number).drop("_starts")


def consensus(breaks: DataFrame, config: ConsensusConfig = ConsensusConfig(), core: float = 0.75, medium: float = 0.50) -> DataFrame:
    """Clusters of (mip, family, setting, break_m, n_settings), with support and whether they are stable.

    Stable by a count of settings if the config has one, else by the share of valid settings.
    """
    clustered = anchored_clusters(breaks, config.merge_threshold_m)
    ordered = F.array_sort(F.collect_list(F.struct("break_m", "setting")))
    table = clustered.groupBy("mip", "family", "cluster_id").agg(
        F.percentile("break_m", F.lit(0.5)).alias("center_m"),
        F.min("break_m").alias("min_m"),
        F.max("break_m").alias("max_m"),
        F.count("*").alias("n_members"),
        F.size(F.collect_set("setting")).cast("long").alias("n_settings_supported"),
        F.max("n_settings").alias("n_settings_valid"),
        F.transform(ordered, lambda s: s["break_m"]).alias("members_m"),
        F.array_distinct(F.transform(ordered, lambda s: s["setting"])).alias("settings_supported"),
    )
    share = F.col("n_settings_supported") / F.col("n_settings_valid")
    count = F.ceil(F.lit(config.stable_fraction) * F.col("n_settings_valid") - 1e-12).cast("int")
    stable = share >= config.stable_fraction
    if config.stable_count is not None:
        count = F.lit(config.stable_count)
        stable = F.col("n_settings_supported") >= config.stable_count
    return (
        table.withColumn("span_m", F.col("max_m") - F.col("min_m"))
        .withColumn("support", share)
        .withColumn("support_class", support_class(share, core, medium))
        .withColumn("stable_support_count", count)
        .withColumn("is_stable", stable)
        .withColumn("threshold_m", F.lit(config.merge_threshold_m))
    )


def in_consensus_order(table: DataFrame) -> DataFrame:
    return table.orderBy("mip", "family", F.desc("n_settings_supported"), "center_m")


def stable_breaks(table: DataFrame) -> DataFrame:
    """Distinct stable centres of each path and family, rounded to six places, ascending."""
    center = F.when(F.col("is_stable"), F.round("center_m", 6))
    return table.groupBy("mip", "family").agg(F.array_sort(F.collect_set(center)).alias("stable_breaks_m"))


def final_config(n_settings: int, threshold_m: float) -> ConsensusConfig:
    return ConsensusConfig(threshold_m, stable_count=final_stable_count(n_settings))


def segments(profile: DataFrame, breaks: DataFrame, keys: tuple[str, ...] = ("mip",), column: str = "stable_breaks_m") -> DataFrame:
    """A row for each segment: its first row, the row after its last, and its distances.

    profile: rows (keys, pos, dist_m). breaks: an array for each key. A break belongs to the
    first row at or after it; breaks without rows between them make one segment.
    """
    labelled = label_rows(profile, breaks, keys, column, left=True)
    w = Window.partitionBy(*keys).orderBy("first_pos")
    found = labelled.groupBy(*keys, "_label").agg(F.min("pos").alias("first_pos"), (F.max("pos") + 1).alias("end_pos"), F.count("*").alias("n_nodes"), F.min("dist_m").alias("start_m"), F.max("dist_m").alias("end_m"))
    return found.withColumn("segment_id", (F.row_number().over(w) - 1).cast("int")).drop("_label")


def label_rows(profile: DataFrame, breaks: DataFrame, keys: tuple[str, ...] = ("mip",), column: str = "stable_breaks_m", left: bool = False) -> DataFrame:
    """Add _label, the number of breaks at or below each row's distance."""
    joined = profile.join(breaks.select(*keys, column), list(keys), "left")
    none = F.array().cast("array<double>")
    label = F.size(F.filter(F.coalesce(column, none), lambda b: b <= F.col("dist_m")))
    return joined.withColumn("_label", label).drop(column)


def cut_indices(profile: DataFrame, breaks: DataFrame, keys: tuple[str, ...] = ("mip",)) -> DataFrame:
    """The number of rows before each break (keys, break_m): where it cuts the path."""
    joined = profile.select(*keys, "dist_m").join(breaks.select(*keys, "break_m").distinct(), list(keys))
    return joined.groupBy(*keys, "break_m").agg(F.count_if(F.col("dist_m") < F.col("break_m")).cast("int").alias("cut"))
