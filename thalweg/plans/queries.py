"""The engine's operators as named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CalibrationConfig, ConsensusConfig, Family, PipelineConfig, SelectionConfig, TuningConfig, WindowConfig
from ..operators import calibration, centerline, changepoint, consensus, features, geometry, graph, network, profile, selection, support, tuning, windows
from ..sources import wkb
from . import runner, standin

#: Windows of 5 and 10 points, for profiles of 50 points and more.
FIXED = WindowConfig(method="fixed", windows_m=(1000.0, 2000.0))
TWO = (Family("w2", 2, (1,)),)
SMALL = PipelineConfig(window=FIXED, families=TWO, selection=SelectionConfig(min_spacing_m=1000.0), jump=1, penalties=(1.0, 2.0, 5.0, 10.0))
#: Breaks from jumps of the width, as runs of two windows and two penalties, five settings.
BREAKS = """
SELECT mip, family, window_m, window_label, penalty, break_m, setting, n_settings FROM (
  SELECT p.mip, CASE WHEN p.mip % 2 = 0 THEN 'w2' ELSE 'w3' END AS family, r.window_m, r.window_label, r.penalty,
         p.dist_m AS break_m, r.setting, CAST(5 AS BIGINT) AS n_settings,
         abs(p.width - lag(p.width) OVER (PARTITION BY p.mip, r.setting ORDER BY p.pos)) AS jump, r.least
  FROM profile p CROSS JOIN (
    SELECT * FROM (VALUES (1000.0D, 'W1km', 1.0D, 's1', 60.0D), (1000.0D, 'W1km', 2.0D, 's2', 80.0D), (2000.0D, 'W2km', 1.0D, 's3', 70.0D),
                          (2000.0D, 'W2km', 2.0D, 's4', 100.0D), (4000.0D, 'W4km', 1.0D, 's5', 400.0D)) AS t(window_m, window_label, penalty, setting, least)
  ) r
) WHERE jump > least
"""
#: Measures of settings by path and family, out of orders.
EVALUATED = """
SELECT o_custkey % 40 AS mip, o_orderpriority AS family,
       concat('mw', CAST(1 + o_orderkey % 3 AS STRING), '_', CAST((o_orderkey / 3) % 4 AS INT), '_', CAST((o_orderkey / 12) % 3 AS INT)) AS setting,
       CAST(1 + o_orderkey % 3 AS INT) AS min_windows,
       0.05D * (1 + CAST((o_orderkey / 3) % 4 AS INT)) AS min_support_runs,
       0.01D * (1 + CAST((o_orderkey / 12) % 3 AS INT)) AS stop_relative,
       count(*) AS n_breaks,
       avg(o_totalprice) / 1000 AS ch,
       min(o_totalprice) / max(o_totalprice) AS centrality,
       max(o_totalprice) / 100 AS final_sse,
       avg(o_custkey) AS mean_span_m,
       CAST(max(o_custkey) AS DOUBLE) AS max_span_m,
       0.7D * max(o_custkey) + 0.3D * avg(o_custkey) AS span_penalty,
       CAST(count(*) % 3 AS BIGINT) AS n_core, CAST(count(*) % 2 AS BIGINT) AS n_medium, CAST(1 AS BIGINT) AS n_weak
FROM orders GROUP BY 1, 2, 3, 4, 5, 6
"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _short(spark: SparkSession, d: str) -> DataFrame:
    return standin.short(spark, d)


def _breaks(spark: SparkSession, d: str) -> DataFrame:
    _short(spark, d).createOrReplaceTempView("profile")
    return spark.sql(BREAKS)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _breaks(spark, d)
    none = F.array().cast("array<double>")
    keys = ["mip", "family", "window_m", "window_label", "penalty"]
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("break_m")).alias("break_m"))
    paths = _short(spark, d).select("mip").distinct().withColumn("family", F.when(F.col("mip") % 2 == 0, "w2").otherwise("w3"))
    grid = [(1000.0, "W1km", 1.0), (1000.0, "W1km", 2.0), (2000.0, "W2km", 1.0), (2000.0, "W2km", 2.0), (4000.0, "W4km", 1.0)]
    every = paths.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(a).alias("window_m"), F.lit(b).alias("window_label"), F.lit(c).alias("penalty")) for a, b, c in grid]))).select("mip", "family", "_g.*")
    return every.join(found, keys, "left").withColumn("break_m", F.coalesce("break_m", none))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    standin.views(spark, d, "orders")
    return spark.sql(EVALUATED)


def _settings(spark: SparkSession, d: str) -> DataFrame:
    return tuning.setting_statistics(tuning.relative_quality(_evaluated(spark, d)))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    standin.views(spark, d, "lineitem")
    return spark.sql("SELECT l_partkey AS node_id, CAST(l_suppkey AS STRING) AS reach_id, CAST(l_extendedprice AS DOUBLE) AS wse_sm, l_discount * 10 AS wse_sm_u, l_tax * 10 AS dark_frac, l_quantity * 1000 AS xtrk_dist FROM lineitem")


def profile_short(spark, d):
    p = _short(spark, d)
    return rounded(p.select("mip", "pos", "dist_m", profile.log_width(F.col("width")).alias("log_width"), profile.multi_channel(F.col("n_channels")).alias("multi")))


def node_heights(spark, d):
    standin.views(spark, d, "supplier")
    reaches = spark.table("supplier").select(F.col("s_suppkey").alias("reach_id"))
    return rounded(profile.node_heights(_observations(spark, d), reaches, dark=0.5))


def nodes_with_heights(spark, d):
    standin.views(spark, d, "part")
    nodes = spark.table("part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("reach_id"), F.lit(1.0).alias("wse"))
    return rounded(profile.with_heights(nodes, profile.node_heights(_observations(spark, d))))


def enriched_nodes(spark, d):
    standin.views(spark, d, "part", "supplier")
    nodes = spark.table("part").select(F.col("p_partkey").alias("node_id"), F.col("p_partkey").alias("reach_id"), F.col("p_size").cast("double").alias("n_channels"), F.col("p_retailprice").alias("width"))
    extra = spark.table("supplier").select(F.col("s_suppkey").alias("reach_id"), F.col("s_nationkey").cast("double").alias("k_eff"), F.col("s_acctbal").alias("width_extra"))
    return rounded(profile.enrich_nodes(nodes, extra).select("node_id", "multi_n_chan", "multi_width"))


def ordered_nodes(spark, d):
    standin.views(spark, d, "lineitem")
    nodes = spark.sql("SELECT l_suppkey AS mip, l_orderkey * 10 + l_linenumber AS node_id, l_extendedprice AS dist_out, l_quantity AS node_length FROM lineitem")
    return rounded(profile.order_nodes(nodes).select("mip", "node_id", "pos", "dist_m"), 4)


def reach_means(spark, d):
    standin.views(spark, d, "lineitem")
    nodes = spark.sql("SELECT l_suppkey AS reach_id, l_quantity AS n_channels FROM lineitem")
    return rounded(profile.reach_means(nodes))


def distance_faults(spark, d):
    rows = _short(spark, d).withColumn("dist_m", F.col("width"))
    return profile.distance_faults(rows)


def feature_health(spark, d):
    rows = _short(spark, d).withColumn("logw", F.when(F.col("width") > 50, F.col("width")))
    return rounded(profile.feature_health(rows, "width", "n_channels", "logw"))


def spacing_and_quantiles(spark, d):
    p = standin.long(spark, d)
    return rounded(profile.spacing(p).join(profile.width_quantiles(p, 0.1, 0.9), "mip"))


def window_plan(spark, d):
    plan = windows.plan_windows(standin.long(spark, d))
    return rounded(plan.select("mip", "family", "window_order", "window_m", "window_label", "window_pts", "is_feasible"))


def window_feasibility(spark, d):
    config = WindowConfig(method="fixed", windows_m=(1000.0, 11_000.0, 13_000.0))
    plan = windows.plan_windows(_short(spark, d), config, (Family("w3", 3, (1, 2)),))
    return windows.feasibility(plan).select("mip", "n_windows", "n_feasible", "n_nodes").join(windows.excluded_runs(plan).select("mip", "reason"), "mip", "left")


def rolling_features(spark, d):
    rows = features.expand(_short(spark, d), windows.plan_windows(_short(spark, d), FIXED, TWO))
    f, w = features.frame(), F.col("width")
    out = {how: features.rolling(w, how, f) for how in ("median", "mean", "rms", "p90")}
    return rounded(rows.select("mip", "window_m", "pos", *[c.alias(k) for k, c in out.items()], features.rolling(F.col("n_channels"), "mode", f).alias("mode")))


def rolling_slope(spark, d):
    rows = features.expand(_short(spark, d), windows.plan_windows(_short(spark, d), WindowConfig(method="fixed", windows_m=(3000.0,)), (Family("w1", 1, (1,)),)))
    rows = rows.withColumn("wse", F.when(F.col("node_id") % 7 != 0, F.col("wse")))
    return rounded(rows.select("mip", "pos", features.rolling_slope(F.col("dist_m"), F.col("wse"), F.col("window_pts"), features.frame()).alias("slope")))


def filled_gaps(spark, d):
    rows = _short(spark, d).withColumn("v", F.when((F.col("pos") % 20 < 7) & (F.col("pos") % 3 != 1) | (F.col("pos") % 20 == 12), F.col("width")))
    rows = features.fill_nearest(features.fill_gaps(rows, "v", "linear", ("mip",), 3), "linear", "filled", ("mip",))
    return rounded(rows.select("mip", "pos", "linear", "filled"))


def rolling_sinuosity(spark, d):
    rows = features.expand(_short(spark, d), windows.plan_windows(_short(spark, d), FIXED, TWO))
    return rounded(features.rolling_sinuosity(rows, "sinuosity").select("mip", "window_m", "pos", "sinuosity"))


def moving_average(spark, d):
    return rounded(features.moving_average(_short(spark, d), "width", "smooth", 9).select("mip", "pos", "smooth"))


def curvature(spark, d):
    return rounded(features.curvature(_short(spark, d), 200.0).select("mip", "pos", "kappa"), 9)


def standardized(spark, d):
    p = _short(spark, d).withColumn("window_m", F.lit(0.0)).withColumn("v", F.when(F.col("pos") % 5 != 2, F.col("width"))).withColumn("flat", F.lit(3.0))
    z = features.standardize(p, "v", "flat")
    return rounded(features.impute(z, "v", "flat").select("mip", "pos", "v", "flat"))


def useful_features(spark, d):
    p = _short(spark, d).withColumn("window_m", F.lit(0.0)).withColumn("flat", F.lit(3.0))
    return rounded(features.useful_features(p, "width", "flat", "n_channels"))


def nan_rates(spark, d):
    p = _short(spark, d).withColumn("window_m", F.lit(0.0)).withColumn("v", F.when(F.col("pos") % 5 != 2, F.col("width")))
    return rounded(features.nan_rates(p, "v", "width"))


def chain_clusters(spark, d):
    rows = _breaks(spark, d)
    return support.chain_clusters(rows, 300.0, ties=("window_m", "penalty", "setting")).groupBy("mip", "family", "cluster_id").agg(F.count("*").alias("n"), F.min("break_m").alias("lo"), F.max("break_m").alias("hi"))


def support_table(spark, d):
    t = support.support_table(_runs(spark, d), 300.0)
    return rounded(t.select("mip", "family", "cluster_id", "center_m", "n_members", "n_windows_supported", "n_penalties_supported", "n_run_pairs_supported", "runs_total", "windows_total", "frequency", "support_runs", "support_windows", F.concat_ws(",", "windows_supported").alias("windows_supported")))


def candidates(spark, d):
    t = support.support_table(_runs(spark, d), 300.0)
    c = selection.candidates(t, SelectionConfig(min_support_runs=0.4, min_windows=2, min_support_windows=0.5))
    return selection.interior(c, _short(spark, d))


def all_run_candidates(spark, d):
    return rounded(selection.all_run_candidates(_breaks(spark, d), 300.0))


def consensus_table(spark, d):
    t = consensus.consensus(_breaks(spark, d), ConsensusConfig(900.0, stable_fraction=0.6))
    return rounded(t.select("mip", "family", "cluster_id", "center_m", "min_m", "max_m", "span_m", "n_members", "n_settings_supported", "support", "support_class", "stable_support_count", "is_stable", F.concat_ws(",", "settings_supported").alias("settings_supported")))


def _stable(spark, d):
    return consensus.stable_breaks(consensus.consensus(_breaks(spark, d), ConsensusConfig(900.0, stable_count=3)))


def stable_segments(spark, d):
    return rounded(consensus.segments(_short(spark, d).select("mip", "pos", "dist_m"), _stable(spark, d)))


def segment_labels(spark, d):
    return consensus.label_rows(_short(spark, d).select("mip", "pos", "dist_m"), _stable(spark, d)).select("mip", "pos", F.col("_label").alias("label"))


def cut_indices(spark, d):
    return consensus.cut_indices(_short(spark, d), _breaks(spark, d).withColumn("break_m", F.col("break_m") - 50))


def exact_positions(spark, d):
    return rounded(support.collapse_exact(_breaks(spark, d)).withColumn("settings_supported", F.concat_ws(",", "settings_supported")))


_CAL = CalibrationConfig(dominant_min=0.6, satellite_max=0.2, supported_min=0.4, upper_limits_km=(0.4, 0.8, 1.5, 2.5, 4.0, 6.0), round_km=0.1, min_families=2)


def gap_pairs(spark, d):
    return rounded(calibration.gap_pairs(support.collapse_exact(_breaks(spark, d)), _CAL))


def family_gaps(spark, d):
    return rounded(calibration.family_gaps(calibration.gap_pairs(support.collapse_exact(_breaks(spark, d)), _CAL), _CAL))


def limit_sweep(spark, d):
    pairs = calibration.gap_pairs(support.collapse_exact(_breaks(spark, d)), _CAL)
    return rounded(calibration.sweep_limits(pairs, _CAL).select("upper_km", "n_families", "n_pairs", "mean90", "mean95", "median90", "median95", "threshold_km"))


def plateau(spark, d):
    pairs = calibration.gap_pairs(support.collapse_exact(_breaks(spark, d)), _CAL)
    return rounded(calibration.first_plateau(calibration.sweep_limits(pairs, _CAL), CalibrationConfig(**{**_CAL.__dict__, "tolerance_km": 2.0, "min_consecutive": 2})).select("upper_km", "threshold_km"))


def relative_quality(spark, d):
    return rounded(tuning.relative_quality(_evaluated(spark, d)).select("mip", "family", "setting", "sse_ratio", "ch_ratio"), 8)


def calinski_harabasz(spark, d):
    rows = _short(spark, d).withColumn("label", F.floor(F.col("pos") / 20)).withColumn("v", F.when(F.col("pos") % 11 != 3, F.col("width")))
    return rounded(tuning.calinski_harabasz(rows, ["v", "n_channels"], ("mip",)))


def span_statistics(spark, d):
    rows = _breaks(spark, d)
    lists = rows.groupBy("mip", "family", "setting").agg(F.array_sort(F.collect_set("break_m")).alias("breaks_m"))
    return rounded(tuning.span_statistics(lists, consensus.consensus(rows, ConsensusConfig(900.0)), 250.0))


def setting_centrality(spark, d):
    rows = _breaks(spark, d)
    lists = rows.groupBy("mip", "family", "setting").agg(F.array_sort(F.collect_set("break_m")).alias("breaks_m"))
    return rounded(tuning.centrality(lists, 450.0).select("mip", "family", "setting", "centrality"))


def setting_statistics(spark, d):
    return rounded(_settings(spark, d).select("family", "setting", "n_paths", "mean_ch", "sd_ch", "mean_centrality", "mean_sse_ratio", "mean_breaks", "sd_breaks", "mean_span_km", "mean_span_penalty"), 9)


def instability(spark, d):
    return rounded(tuning.instability(_settings(spark, d)).select("family", "setting", "instability", "n_neighbours"), 5)


def _front(spark, d):
    return tuning.pareto(rounded(tuning.instability(_settings(spark, d)), 5))


def pareto(spark, d):
    return _front(spark, d).select("family", "setting", "is_pareto")


def representatives(spark, d):
    return tuning.representatives(_front(spark, d)).select("family", "setting", "mean_ch")


def family_overview(spark, d):
    return rounded(tuning.family_overview(_front(spark, d)).select("family", "n_settings", "n_pareto", "best_ch", "average_ch", "rep_setting", "rep_ch"), 4)


def family_rank(spark, d):
    return tuning.rank_families(tuning.representatives(_front(spark, d))).select("family", "setting", "family_rank")


def local_grid(spark, d):
    f = _front(spark, d)
    return tuning.local_grid(f, tuning.representatives(f)).select("family", "setting", "step_distance")


def compare_families(spark, d):
    reps = tuning.representatives(_front(spark, d))
    return rounded(tuning.compare_families(_evaluated(spark, d), reps, "1-URGENT", "2-HIGH", 0.02), 8)


def threshold_summary(spark, d):
    return rounded(tuning.threshold_summary(consensus.consensus(_breaks(spark, d), ConsensusConfig(900.0))))


def percent_rank(spark, d):
    standin.views(spark, d, "part")
    p = spark.table("part")
    return rounded(p.select("p_partkey", tuning.percent_rank(F.col("p_size"), ("p_brand",), True).alias("up"), tuning.percent_rank(F.col("p_size"), ("p_brand",), False).alias("down")))


def threshold_candidates(spark, d):
    summary = tuning.threshold_summary(consensus.consensus(_breaks(spark, d), ConsensusConfig(900.0)))
    return tuning.threshold_candidates(rounded(summary)).select("family", "threshold", "rank")


def family_choice(spark, d):
    """How the two best families compare: the gap of their indexes, and the paths won by each."""
    front = _front(spark, d)
    evaluated = _evaluated(spark, d)
    found = tuning.choose_family(evaluated, front, TuningConfig(mean_ch_gap=1.0))
    names = [found["family"], found["runner_up"]]
    return rounded(spark.createDataFrame(
        [(found["family"], found["runner_up"], found["reason"], found["gap"], found["n_paths"], found["n_both"], found["n_decided"], found["n_ties"], *(found["wins"][f] for f in names))],
        "family string, runner_up string, reason string, gap double, n_paths long, n_both long, n_decided long, n_ties long, wins long, runner_up_wins long",
    ), 5)


def _chosen(spark, d):
    rows = _breaks(spark, d).groupBy("mip", "family", "setting").agg(F.array_sort(F.collect_set("break_m")).alias("breaks_m"))
    return rows.withColumn("status", F.lit("ok")).withColumn("n_candidates", F.size("breaks_m") + F.col("mip").cast("int") % 3).withColumn("final_sse", F.col("mip").cast("double"))


def break_faults(spark, d):
    return selection.break_faults(_chosen(spark, d), _short(spark, d), SelectionConfig(min_spacing_m=500.0, min_reach_m=600.0))


def run_comparison(spark, d):
    runs, _ = selection.compare_runs(_chosen(spark, d).withColumnRenamed("setting", "run"), 400.0)
    return rounded(runs.select("mip", "run", "n_breaks", "n_candidates", "final_sse", "candidates_per_break"))


def run_clusters(spark, d):
    _, clusters = selection.compare_runs(_chosen(spark, d).withColumnRenamed("setting", "run"), 400.0)
    return rounded(clusters.select("mip", "cluster_id", "center_km", "n_runs_supported", F.concat_ws(",", "runs_supported").alias("runs_supported"), F.size("members_km").alias("n_members")))


def renamed_paths(spark, d):
    standin.views(spark, d, "orders")
    old = spark.sql("SELECT o_orderkey AS reach_id, o_custkey AS main_path_id FROM orders")
    return profile.renamed_paths(old, spark.sql("SELECT o_orderkey AS reach_id, o_custkey % 100 AS main_path_id FROM orders WHERE o_orderkey % 3 > 0"))


def mainstem_paths(spark, d):
    standin.views(spark, d, "orders")
    return centerline.mainstem_paths(spark.sql("SELECT o_orderkey AS reach_id, o_custkey AS main_path_id, o_orderkey % 4 < 2 AS is_mainstem FROM orders"))


def aligned_features(spark, d):
    """Values of other points brought to the nodes: all of them, shifted ones, a few, one, and none, from path to path."""
    p = _short(spark, d)
    m = F.pmod("mip", F.lit(5))
    kept = F.when(m == 0, F.lit(True)).when(m == 1, F.col("pos") % 3 == 0).when(m == 2, F.col("pos") % 4 == 1).when(m == 3, F.col("pos") == 2).otherwise(F.lit(False))
    at = F.col("dist_m") + F.when(m == 0, 5e-7).when(m == 1, 70.0).otherwise(0.0)
    external = p.where(kept).select("mip", F.lit(1.0).alias("window_m"), at.alias("dist_m"), "width", F.when(F.col("pos") % 6 != 0, F.col("n_channels")).alias("n_channels"))
    points = p.select("mip", F.lit(1.0).alias("window_m"), "pos", "dist_m")
    return rounded(features.aligned(points, external, "width", "n_channels").select("mip", "pos", "width", "n_channels"))


def _standardized(spark, d):
    p = _short(spark, d)
    plan = windows.final_plan(windows.plan_windows(p, FIXED, TWO))
    return features.impute(features.standardize(features.build_features(p, plan, ("width", "channels")), "width", "channels"), "width", "channels")


def change_points_sql(spark, d):
    """The rows of change_points, from SQL by the table function."""
    changepoint.register(spark, "change_points", SMALL.penalties, 1)
    _standardized(spark, d).createOrReplaceTempView("standardized_rows")
    return spark.sql("""
      SELECT mip, window_m, penalty, n_points, min_size, concat_ws(',', transform(break_index, i -> CAST(i AS STRING))) AS breaks, status
      FROM change_points(TABLE(SELECT mip, window_m, pos, dist_m, window_pts, width, channels FROM standardized_rows) PARTITION BY (mip, window_m) ORDER BY pos)""")


def change_points(spark, d):
    runs = changepoint.sweep(_standardized(spark, d), ["width", "channels"], SMALL.penalties, 1)
    return runs.select("mip", "window_m", "penalty", "n_points", "min_size", F.concat_ws(",", F.transform("break_index", lambda i: i.cast("string"))).alias("breaks"), "status")


def selections(spark, d):
    done = runner.finalize(_short(spark, d), SMALL, "w2", threshold_m=1500.0)
    return rounded(done["selections"].select("mip", "family", "setting", "status", "n_candidates", "n_breaks", "base_sse", "final_sse", F.concat_ws(",", F.transform("breaks_m", lambda b: b.cast("string"))).alias("breaks")))


def segments(spark, d):
    """The whole way: profiles, windows, features, change points, support, selection, consensus, segments."""
    return runner.finalize(_short(spark, d), SMALL, "w2", threshold_m=1500.0)["segments"]


def support_sweep(spark, d):
    return rounded(runner.support_sweep(_short(spark, d), config=SMALL, threshold_m=1500.0))


def reach_summary(spark, d):
    return rounded(runner.reach_summary(runner.finalize(_short(spark, d), SMALL, "w2", threshold_m=1500.0)))


def two_stage(spark, d):
    p = _short(spark, d)
    first = runner.finalize(p, SMALL.with_(features=("width",)), "w2", threshold_m=1500.0)
    return runner.two_stage(p, first, SMALL.with_(features=("channels",)), "w2", threshold_m=1500.0)["segments"]


def downstream_pairs(spark, d):
    standin.views(spark, d, "lineitem")
    return graph.downstream_pairs(spark.sql("SELECT l_suppkey AS reach_id, collect_set(l_partkey % 100) AS rch_id_dn FROM lineitem GROUP BY l_suppkey"))


def line_graph(spark, d):
    standin.views(spark, d, "orders")
    return graph.line_graph(spark.sql("SELECT o_custkey AS u, (o_orderkey * 7) % 1500 AS v, o_orderkey AS reach_id FROM orders"))


def width_summary(spark, d):
    standin.views(spark, d, "part")
    rows = spark.sql("SELECT p_brand AS k, p_retailprice AS width, CAST(p_size % 5 AS DOUBLE) AS reach_len FROM part")
    out = graph.total_length(rows, ("k",))
    for how in ("median", "mean", "weighted"):
        out = out.join(graph.width_summary(rows, ("k",), how).withColumnRenamed("width", how), "k")
    return rounded(out)


def side_channels(spark, d):
    """Main stems out of the long profiles, with a side loop at every tenth node."""
    standin.long(spark, d).createOrReplaceTempView("profile")
    reaches = spark.sql("""
      SELECT mip * 1000000 + pos AS reach_id, mip AS main_path_id, true AS is_mainstem,
             CASE WHEN pos % 10 = 3 THEN array(mip * 1000000 + pos + 1, mip * 1000000 + 500000 + pos) ELSE array(mip * 1000000 + pos + 1) END AS rch_id_dn, 200.0D AS reach_len, width, n_channels AS n_chan FROM profile
      UNION ALL SELECT mip * 1000000 + 500000 + pos, mip, false, array(mip * 1000000 + 600000 + pos), 500.0D, width / 2, 1.0D FROM profile WHERE pos % 10 = 3
      UNION ALL SELECT mip * 1000000 + 600000 + pos, mip, false, array(mip * 1000000 + pos + 4), 400.0D, width / 3, 1.0D FROM profile WHERE pos % 10 = 3""")
    return rounded(graph.enrichment(reaches))


def _loops(spark, d) -> tuple[DataFrame, DataFrame]:
    """Junctions of main stems with a loop at every tenth node, and a short one inside every other of these; and the paths too large for a task."""
    standin.long(spark, d).createOrReplaceTempView("profile")
    reaches = spark.sql("""
      SELECT mip * 1000000 + pos AS reach_id, mip AS main_path_id, true AS is_mainstem,
             CASE WHEN pos % 10 = 3 THEN array(mip * 1000000 + pos + 1, mip * 1000000 + 500000 + pos) WHEN pos % 20 = 4 THEN array(mip * 1000000 + pos + 1, mip * 1000000 + 700000 + pos) ELSE array(mip * 1000000 + pos + 1) END AS rch_id_dn FROM profile
      UNION ALL SELECT mip * 1000000 + 500000 + pos, mip, false, array(mip * 1000000 + 600000 + pos) FROM profile WHERE pos % 10 = 3
      UNION ALL SELECT mip * 1000000 + 600000 + pos, mip, false, array(mip * 1000000 + pos + 4) FROM profile WHERE pos % 10 = 3
      UNION ALL SELECT mip * 1000000 + 700000 + pos, mip, false, array(mip * 1000000 + pos + 2) FROM profile WHERE pos % 20 = 4""")
    large = network.large_paths(reaches, "main_path_id")
    return network.junctions(reaches, large), large


def side_components(spark, d):
    net, large = _loops(spark, d)
    return network.side_components(net, large)


def corridors(spark, d):
    net, large = _loops(spark, d)
    return network.corridors(net, large=large)


def _lines(spark, d) -> DataFrame:
    p = _short(spark, d)
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y")))
    return p.groupBy("mip").agg(line.alias("line"))


def line_formats(spark, d):
    """Lines as binary and as text, read again; some cut in two parts, some cut short, some none."""
    half = F.floor(F.size("line") / 2).cast("int")
    two = F.array(F.slice("line", F.lit(1), half), F.slice("line", half + 1, F.size("line")))
    lines = _lines(spark, d).where("size(line) > 3").withColumn("parts", F.when(F.col("mip") % 3 == 0, two).otherwise(F.array("line")))
    made = lines.select("mip", wkb.to_wkb(F.col("parts")).alias("b"), wkb.to_wkt(F.col("parts")).alias("t"))
    spoilt = made.withColumn("b", F.when(F.col("mip") % 7 == 1, F.expr("substring(b, 1, length(b) - 3)")).when(F.col("mip") % 7 != 2, F.col("b")))
    back = wkb.with_parts(wkb.with_parts(spoilt, "b", "from_b", "status"), "t", "from_t", "text_status")
    length = lambda c: F.aggregate(F.transform(c, geometry.line_length), F.lit(0.0), lambda s, x: s + x)
    return rounded(back.select("mip", "status", F.size("from_b").alias("n_parts"), length("from_b").alias("length_m"), "text_status", length("from_t").alias("text_length_m"), F.hex(F.expr("substring(b, 1, 9)")).alias("head")), 4)


def line_summary(spark, d):
    return rounded(geometry.summarize_lines(_lines(spark, d).withColumnRenamed("mip", "main_path_id")), 4)


def oriented_lines(spark, d):
    lines = _lines(spark, d).withColumn("line", F.when(F.col("mip") % 2 == 1, F.reverse("line")).otherwise(F.col("line")))
    return rounded(geometry.orient(lines, _short(spark, d)).select("mip", "status", "reversed", "error_forward_m", "error_reverse_m", "margin_m"))


def geometry_windows(spark, d):
    p = _short(spark, d)
    return rounded(geometry.geometry_features(p, _lines(spark, d), windows.plan_windows(p, FIXED, TWO)))


def sampled_lines(spark, d):
    return rounded(geometry.sampled(_lines(spark, d), 50.0))


def node_coordinates(spark, d):
    return rounded(geometry.node_coordinates(_short(spark, d), _lines(spark, d)))


def metric_at_nodes(spark, d):
    p = _short(spark, d)
    return rounded(geometry.metric_at_nodes(p, p, "width", "median", 500.0))


def _reaches(spark, d, gap: str, overlap: str = "0") -> DataFrame:
    """Lines cut to reaches of ten nodes. gap: how far each reach starts behind the end of the one before; overlap: nodes of that one which it repeats."""
    _short(spark, d).createOrReplaceTempView("profile")
    return spark.sql(f"""
      SELECT main_path_id, r AS reach_id, true AS is_mainstem, min(dist_m) AS dist_out, transform(array_sort(collect_list(struct(pos, CASE WHEN r > 0 AND pos = 10 * r THEN x + {gap} ELSE x END AS x, y))), n -> struct(n.x AS x, n.y AS y)) AS geometry
      FROM (SELECT mip AS main_path_id, *, explode(sequence(CAST(greatest(floor((pos - 1) / 10), 0) AS INT), CAST(floor((pos + {overlap}) / 10) AS INT))) AS r FROM (SELECT *, max(pos) OVER (PARTITION BY mip) AS last FROM profile))
      WHERE 10 * r < last GROUP BY main_path_id, r""")


def merged_centerlines(spark, d):
    """Lines cut to reaches, with gaps, with overlaps and as they are, and merged again."""
    reaches = _reaches(spark, d, "CASE WHEN main_path_id % 3 = 0 THEN 3.0D ELSE 0.0D END", "CASE WHEN mip % 3 = 1 THEN 3 ELSE 0 END")
    turned = F.when(F.col("main_path_id") % 3 == 2, F.reverse("geometry")).otherwise(F.col("geometry"))
    merged = centerline.merge_mainpaths(reaches.withColumn("geometry", turned))
    return rounded(merged.select("main_path_id", "n_parts", "input_length_m", "merged_length_m", "loss_fraction", "terminals", "status", "n_snapped", "n_components", "cycle_rank", "repair"), 4)


def endpoint_diagnostics(spark, d):
    """Ends of parts with gaps of 3 and 8 metres between some of them."""
    found = centerline.endpoint_diagnostics(_reaches(spark, d, "CASE CAST(r AS INT) % 4 WHEN 1 THEN 0.0D WHEN 3 THEN 8.0D ELSE 3.0D END"))
    return rounded(found.select("main_path_id", "x", "y", "status", F.concat_ws(",", "reasons").alias("reasons"), "nearest_m", "moved_to_x", "moved_to_y"), 4)


def noded_lines(spark, d):
    """Networks of lines along two axes, which cross, touch and overlap."""
    standin.views(spark, d, "lineitem")
    lines = spark.sql("""
      SELECT l_suppkey AS main_path_id, CASE WHEN l_orderkey % 2 = 0
        THEN array(named_struct('x', CAST(l_quantity AS DOUBLE), 'y', 10.0D * l_linenumber), named_struct('x', CAST(l_quantity + 1 + l_partkey % 15 AS DOUBLE), 'y', 10.0D * l_linenumber))
        ELSE array(named_struct('x', CAST(l_quantity AS DOUBLE), 'y', 10.0D * l_linenumber - 5 * (l_partkey % 3)), named_struct('x', CAST(l_quantity AS DOUBLE), 'y', 10.0D * l_linenumber + 5 + 10 * (l_partkey % 4))) END AS line
      FROM lineitem""")
    return rounded(centerline.noded(lines).select("main_path_id", "n_nodes", "n_edges", "length_m"), 4)


def smoothed_lines(spark, d):
    return rounded(centerline.smooth_mainpaths(_lines(spark, d), 100.0).select("mip", F.size("line").alias("n_points"), "sigma_m", "drop", "status"))


NAMES = (
    "profile_short node_heights nodes_with_heights enriched_nodes ordered_nodes reach_means distance_faults feature_health spacing_and_quantiles window_plan window_feasibility "
    "rolling_features rolling_slope filled_gaps rolling_sinuosity moving_average curvature standardized useful_features nan_rates chain_clusters support_table candidates all_run_candidates "
    "consensus_table stable_segments segment_labels cut_indices exact_positions gap_pairs family_gaps limit_sweep plateau relative_quality calinski_harabasz span_statistics setting_centrality "
    "setting_statistics instability pareto representatives family_overview family_rank local_grid compare_families threshold_summary threshold_candidates family_choice break_faults run_comparison run_clusters renamed_paths mainstem_paths percent_rank aligned_features change_points change_points_sql selections segments support_sweep reach_summary two_stage "
    "downstream_pairs line_graph width_summary side_channels side_components corridors line_formats line_summary oriented_lines geometry_windows sampled_lines node_coordinates metric_at_nodes merged_centerlines endpoint_diagnostics noded_lines smoothed_lines"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
