"""From node tables to ordered profiles, all paths at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import finite, first_of, require


def renamed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path_id, new_path_id): the path that an old path's first shared reach has now; both tables have reach_id and main_path_id."""
    pairs = old.select("reach_id", F.col("main_path_id").alias("old_path_id")).join(new.select("reach_id", F.col("main_path_id").alias("new_path_id")), "reach_id")
    return pairs.where("old_path_id is not null and new_path_id is not null").groupBy("old_path_id").agg(F.min_by("new_path_id", F.struct("reach_id", "new_path_id")).alias("new_path_id"))


def mainstem(df: DataFrame) -> DataFrame:
    """Rows on the main stem; an unknown flag counts as no."""
    return df.where(F.coalesce(F.col("is_mainstem"), F.lit(False)))


def semi(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is among `keys`."""
    return df.join(keys.select(*on), list(on), "left_semi")


def filter_observations(obs: DataFrame, quality: float = 1.0, dark: float = 0.5, cross: tuple[float, float] = (10_000.0, 60_000.0)) -> DataFrame:
    """Observations of good quality, not dark, within the swath and above zero."""
    return obs.where(
        (F.col("wse_sm_u") <= quality)
        & (F.col("dark_frac") <= dark)
        & F.abs(F.col("xtrk_dist")).between(*cross)
        & (F.col("wse_sm") > 0)
    )


def node_heights(obs: DataFrame, reaches: DataFrame | None = None, **limits) -> DataFrame:
    """(node_id, wse): the median of a node's good observations, in the reaches given."""
    kept = filter_observations(obs, **limits)
    if reaches is not None:
        kept = semi(kept.withColumn("reach_id", F.col("reach_id").cast("string")), reaches.select(F.col("reach_id").cast("string").alias("reach_id")).distinct(), "reach_id")
    return kept.groupBy(F.col("node_id").cast("long").alias("node_id")).agg(F.percentile("wse_sm", F.lit(0.5)).alias("wse"))


def with_heights(nodes: DataFrame, heights: DataFrame) -> DataFrame:
    """nodes with their own heights replaced by those of `heights`, NULL where there is none."""
    return nodes.drop("wse").join(heights.select("node_id", "wse"), "node_id", "left")


def reach_means(nodes: DataFrame, value: str = "n_channels") -> DataFrame:
    return nodes.groupBy("reach_id").agg(F.avg(value).alias(f"mean_{value}"))


def enrich_nodes(nodes: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Add side channels: multi_n_chan and multi_width, with missing parts as 0."""
    joined = nodes.join(enrichment.select("reach_id", "k_eff", "width_extra"), "reach_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.withColumn("multi_n_chan", zero("n_channels") + zero("k_eff")).withColumn("multi_width", zero("width") + zero("width_extra"))


def order_nodes(nodes: DataFrame, key: str = "mip") -> DataFrame:
    """pos and dist_m by falling distance to the outlet, ties by node_id; dist_m counts a node's own length."""
    out = F.col(first_of(nodes, "hydro_dist_out", "dist_out"))
    length = F.col(first_of(nodes, "node_length", "node_len"))
    w = Window.partitionBy(key).orderBy(out.desc_nulls_last(), "node_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("dist_m", F.sum(length.cast("double")).over(run))


def ordered(profile: DataFrame, key: str = "mip") -> DataFrame:
    """pos by rising distance, for profiles that come with dist_m but in no order."""
    w = Window.partitionBy(key).orderBy("dist_m")
    return profile.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def distance_faults(profile: DataFrame, key: str = "mip") -> DataFrame:
    """Paths whose distances are missing or do not rise strictly, with how often."""
    w = Window.partitionBy(key).orderBy("pos")
    d = finite(F.col("dist_m"))
    bad = d.isNull() | (F.coalesce(d - F.lag(d).over(w), F.lit(1.0)) <= 0)
    return profile.withColumn("_bad", bad).groupBy(key).agg(F.count_if("_bad").alias("n_faults")).where("n_faults > 0")


def log_width(width: Column) -> Column:
    """Natural logarithm; widths of zero or less are missing."""
    w = finite(width)
    return F.when(w > 0, F.log(w))


def multi_channel(n: Column, threshold: float = 1.0) -> Column:
    """1 where there are more channels than the threshold, 0 where not, NULL where unknown."""
    n = finite(n)
    return F.when(n.isNotNull(), (n > threshold).cast("double"))


def feature_health(df: DataFrame, *columns: str) -> DataFrame:
    """For each column the share missing, distinct values, and range."""
    require(df, *columns)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("value")) for c in columns])).alias("_")).select("_.*")
    return long.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_fraction"),
        F.countDistinct("value").alias("n_unique"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres on the sphere of radius 6378137."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat) / 2)) * r


def spacing(profile: DataFrame, key: str = "mip") -> DataFrame:
    """Median positive step of each path; NULL where there is none."""
    w = Window.partitionBy(key).orderBy("pos")
    step = profile.withColumn("_step", F.col("dist_m") - F.lag("dist_m").over(w))
    return step.groupBy(key).agg(F.percentile(F.when(F.col("_step") > 0, F.col("_step")), F.lit(0.5)).alias("spacing_m"))


def width_quantiles(profile: DataFrame, low: float, high: float, key: str = "mip") -> DataFrame:
    """Quantiles of the finite positive widths of each path, linear between ranks."""
    w = finite(F.col("width"))
    both = F.percentile(F.when(w > 0, w), F.array(F.lit(low), F.lit(high)))
    return profile.groupBy(key).agg(both.alias("_q")).select(key, F.get("_q", F.lit(0)).alias("width_low"), F.get("_q", F.lit(1)).alias("width_high"))
