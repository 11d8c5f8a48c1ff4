"""From profiles to stable segments: final runs, tuning runs, two-stage setups, all paths in one plan."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import (
    FINAL_SETTINGS, ConsensusConfig, PipelineConfig, Setting, Setup, TuningConfig, check_stage, final_stable_count, needs_geometry, select_families, selector_grid, target_families,
)
from ..operators import calibration, changepoint, consensus, features, selection, support, tuning, windows
from ..settled import settle


#: The names under which seconds are reported.
STEPS = (
    "window_selection", "prepare_nodes", "geometry_features", "feature_building", "standardization", "pelt_sweeps", "breakpoint_support", "final_break_selection", "final_break_selection_grid", "total",
)


class Metrics:
    """Seconds of steps, and counts that Spark observes while it writes what the steps make.

    A step counts once for each time it is timed; steps inside others are in both.
    """

    def __init__(self):
        self.seconds: dict[str, float] = dict.fromkeys(STEPS, 0.0)
        self.observed: dict[str, list[Observation]] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def watch(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """df with counts taken when it is first computed, under a name; to be settled or written before counts() is asked."""
        seen = Observation()
        self.observed.setdefault(name, []).append(seen)
        return df.observe(seen, *[c.alias(k) for k, c in counts.items()])

    def counts(self) -> dict[str, dict[str, int]]:
        """The sums of what was counted, by name."""
        out: dict[str, dict[str, int]] = {}
        for name, some in self.observed.items():
            for seen in some:
                for k, v in seen.get.items():
                    out.setdefault(name, {})[k] = out.get(name, {}).get(k, 0) + (v or 0)
        return out


def base_tables(profile: DataFrame, config: PipelineConfig = PipelineConfig(), tuning_run: bool = False, external: DataFrame | None = None, metrics: Metrics | None = None) -> dict[str, DataFrame]:
    """Window plan, standardised features, runs and support of every path and family.

    A tuning run leaves out families of which a window does not fit; a final run drops the window.
    metrics: gets seconds and counts; steps that are only planned, and computed with a later
    one, take as long as planning them.
    """
    m = metrics or Metrics()
    with m.step("window_selection"):
        # Three tables below and those of skipped paths need it; it is a row for each window of a path.
        plan = settle(windows.plan_windows(profile, config.window, config.families))
        used = windows.tuning_plan(plan) if tuning_run else windows.final_plan(plan)
    columns = list(config.features)
    with m.step("feature_building"):
        table = features.build_features(profile, used, config.features, config.feature, external)
    with m.step("standardization"):
        if config.standardize:
            table = features.standardize(table, *columns)
        # Several tables below are made from these, and solving is the dear part.
        z = features.impute(table, *columns)
        z = settle(m.watch(z, "features", rows=F.count("*")))
    with m.step("pelt_sweeps"):
        runs = changepoint.family_runs(changepoint.sweep(z, columns, config.penalties, config.jump, config.min_size), used)
        runs = settle(m.watch(runs, "solves", runs=F.count("*"), breaks=F.sum(F.size("break_m")), too_short=F.count_if(F.col("status") != "ok")))
    with m.step("breakpoint_support"):
        clusters = support.support_table(runs, config.stability_tolerance_m)
        if metrics is not None:
            clusters = settle(m.watch(clusters, "support", clusters=F.count("*")))
    return {"plan": plan, "windows": used, "features": table, "z": z, "runs": runs, "support": clusters}


def select_and_agree(base: dict[str, DataFrame], settings: dict[str, list[Setting]], config: PipelineConfig, agree: ConsensusConfig, metrics: Metrics | None = None, step: str = "final_break_selection") -> dict[str, DataFrame]:
    """Selections of every setting, and the consensus of them."""
    m = metrics or Metrics()
    breaks = changepoint.run_breaks(base["runs"]) if config.selection.source == "all_runs" else None
    with m.step(step):
        chosen = selection.select(base["z"], base["windows"], base["support"], config.features, settings, config.selection, breaks)
        chosen = settle(m.watch(chosen, "selections", selections=F.count("*"), breaks=F.sum("n_breaks"), not_ok=F.count_if(F.col("status") != "ok")))
    rows = selection.break_rows(chosen)
    table = consensus.consensus(rows, agree)
    return {"selections": chosen, "break_rows": rows, "consensus": table, "stable": consensus.stable_breaks(table)}


def finalize(profile: DataFrame, config: PipelineConfig = PipelineConfig(), family: str = "w2", settings=FINAL_SETTINGS, threshold_m: float = 11_500.0, stable_count: int | None = None, external: DataFrame | None = None, base: dict | None = None, metrics: Metrics | None = None) -> dict[str, DataFrame]:
    """The final run of one family with a few settings: stable breaks and segments of each path."""
    config = config.with_(families=select_families([family]))
    base = base or base_tables(profile, config, external=external, metrics=metrics)
    count = final_stable_count(len(settings)) if stable_count is None else stable_count
    out = base | select_and_agree(base, {family: list(settings)}, config, ConsensusConfig(threshold_m, stable_count=count), metrics)
    out["break_faults"] = selection.break_faults(out["selections"], profile, config.selection)
    out["segments"] = consensus.segments(profile.select("mip", "pos", "dist_m"), out["stable"])
    out["skipped"] = windows.skipped_paths(base["plan"])
    return out


def support_sweep(profile: DataFrame, counts=(3, 4, 5), **options) -> DataFrame:
    """Stable breaks of each path for several support counts, from one base."""
    done = finalize(profile, **options)
    rows = done["consensus"].withColumn("count", F.explode(F.array(*[F.lit(c) for c in counts])))
    return rows.groupBy("count", "mip").agg(F.count_if(F.col("n_settings_supported") >= F.col("count")).alias("n_stable"), F.avg("span_m").alias("mean_span_m"))


def tune(profile: DataFrame, config: PipelineConfig = PipelineConfig(), external: DataFrame | None = None, agree: ConsensusConfig = ConsensusConfig(), metrics: Metrics | None = None) -> dict[str, DataFrame]:
    """The grid of every family: selections and consensus."""
    base = base_tables(profile, config, tuning_run=True, external=external, metrics=metrics)
    grids = {f.name: list(selector_grid(f)) for f in config.families}
    out = base | select_and_agree(base, grids, config, agree, metrics, "final_break_selection_grid")
    out["excluded"] = windows.excluded_runs(base["plan"])
    return out


def recluster(grid: dict[str, DataFrame], agree: ConsensusConfig) -> dict[str, DataFrame]:
    """The same selections under another merge threshold; nothing before them is computed again."""
    table = consensus.consensus(grid["break_rows"], agree)
    return grid | {"consensus": table, "stable": consensus.stable_breaks(table)}


def evaluate(grid: dict[str, DataFrame], columns, config: TuningConfig = TuningConfig()) -> DataFrame:
    """Valid selections with index, centrality, span statistics and relative measures."""
    valid = grid["selections"].where("status = 'ok'")
    rows = grid["windows"].select("mip", "family", "window_m").distinct().join(grid["features"], ["mip", "window_m"])
    labelled = consensus.label_rows(rows.join(valid.select("mip", "family", "setting", "breaks_m"), ["mip", "family"]), valid.select("mip", "family", "setting", F.col("breaks_m").alias("_cuts")), ("mip", "family", "setting"), "_cuts")
    ch = tuning.mean_ch(labelled.withColumnRenamed("_label", "label"), list(columns), ("mip", "family", "setting"))
    spans = tuning.span_statistics(valid.select("mip", "family", "setting", "breaks_m"), grid["consensus"], config.match_tolerance_m)
    key = ["mip", "family", "setting"]
    out = tuning.centrality(valid, config.match_tolerance_m).join(ch, key, "left").join(spans, key, "left")
    return tuning.relative_quality(out.fillna(0, ["n_core", "n_medium", "n_weak", "mean_span_m", "max_span_m", "span_penalty", "n_matched"]))


def analyse(grid: dict[str, DataFrame], columns, config: TuningConfig = TuningConfig()) -> dict:
    """The tables of a tuning analysis and the chosen family with the settings to keep."""
    # Several tables and three collects are made from these.
    grid = grid | {"features": settle(grid["features"])}
    evaluated = settle(evaluate(grid, columns, config))
    stats = settle(tuning.pareto(tuning.instability(tuning.setting_statistics(evaluated))))
    reps = tuning.representatives(stats)
    choice = tuning.choose_family(evaluated, stats, config)
    local = tuning.local_grid(stats, reps, config.min_keep)
    kept = local.where(F.col("family") == F.lit(choice["family"])).select("min_support_runs", "min_windows", "stop_relative")
    return {
        "evaluated": evaluated, "setting_statistics": stats, "representatives": reps, "family_overview": tuning.family_overview(stats), "family_rank": tuning.rank_families(reps),
        "choice": choice, "recommended_grid": local, "recommended_settings": kept, "threshold_summary": tuning.threshold_summary(grid["consensus"], config),
    }


def recommended(analysis: dict) -> tuple[str, tuple[Setting, ...]]:
    """The family and settings for a final run, from an analysis; a grid of some settings."""
    rows = analysis["recommended_settings"].orderBy("min_windows", "min_support_runs", "stop_relative").collect()
    return analysis["choice"]["family"], tuple(Setting(r["min_support_runs"], r["min_windows"], r["stop_relative"]) for r in rows)


def calibrated(grid: dict[str, DataFrame], families=None) -> tuple[dict[str, DataFrame], dict]:
    """The grid under a merge threshold calibrated from its own breaks."""
    positions = settle(support.collapse_exact(grid["break_rows"]))
    if families is not None:
        positions = positions.where(F.col("family").isin(list(target_families(families))))
    found = calibration.calibrate(positions)
    return recluster(grid, ConsensusConfig(1000.0 * found["threshold_km"])), found


def run_stage(profile: DataFrame, stage, config: PipelineConfig = PipelineConfig(), external: DataFrame | None = None, known: dict | None = None) -> dict:
    """Tune, calibrate, analyse and finalise one stage; the seconds of each step are kept.

    known: family, settings and threshold_m of an earlier tuning, which is then not done again.
    """
    check_stage(stage)
    config = config.with_(features=stage.features, families=select_families(stage.families))
    if needs_geometry(stage.features) and external is None:
        raise ValueError("this stage needs geometry features")
    m = Metrics()
    out: dict = {}
    with m.step("total"):
        if known is None:
            grid = tune(profile, config, external, metrics=m)
            with m.step("calibration"):
                grid, found = calibrated(grid, stage.families)
            with m.step("analysis"):
                analysis = analyse(grid, stage.features)
                family, settings = recommended(analysis)
            if family is None:
                family = stage.families[-1]
            known = {"family": family, "settings": settings or FINAL_SETTINGS, "threshold_m": 1000.0 * found["threshold_km"]}
            out = {"grid": grid, "calibration": found, "analysis": analysis}
        final = finalize(profile, config, known["family"], known["settings"], known["threshold_m"], external=external, metrics=m)
    return out | known | {"final": final, "metrics": m, "seconds": m.seconds}


def tuning_tables(stage: dict) -> dict[str, DataFrame]:
    """The tables that a tuned stage leaves: its grid, what became of it, and the analysis."""
    grid, analysis = stage["grid"], stage["analysis"]
    summary = run_summary(grid).withColumn("break_range", F.col("max_breaks") - F.col("min_breaks")).withColumn("candidate_range", F.col("max_candidates") - F.col("min_candidates"))
    tables = {
        "windows": grid["plan"], "selections": grid["selections"], "consensus": grid["consensus"], "excluded": grid["excluded"], "run_summary": summary,
        "penalties": grid["runs"].select("mip", "family", "window_m", "window_label", "penalty", "status", F.size("break_m").alias("n_breaks")),
        "run_breaks": changepoint.run_breaks(grid["runs"]), "setting_breaks": grid["break_rows"].select("mip", "family", "setting", "break_m"),
        "history": grid["selections"].select("mip", "family", "setting", F.explode("history").alias("h")).select("mip", "family", "setting", "h.*"),
        "missing": features.nan_rates(grid["features"], *[c for c in grid["features"].columns if c not in ("mip", "window_m", "pos", "dist_m", "window_pts")]),
        "threshold_candidates": tuning.threshold_candidates(analysis["threshold_summary"], analysis["choice"]["family"]),
        "gap_pairs": stage["calibration"]["pairs"], "gap_sweep": stage["calibration"]["sweep"],
    }
    return tables | {k: v for k, v in analysis.items() if isinstance(v, DataFrame)}


def final_tables(final: dict[str, DataFrame], config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """The tables of a final run."""
    names = ("stable", "segments", "consensus", "selections", "break_faults", "skipped", "plan", "support")
    out = {k: final[k] for k in names if k in final}
    if "consensus" in final:
        reaches = reach_summary(final)
        out |= {"reach_summary": reaches, "summary": overall_summary(reaches)}
    return out


SEGMENT_KEY = 1_000_000


def sub_profiles(profile: DataFrame, segments: DataFrame, min_nodes: int = 10) -> tuple[DataFrame, DataFrame]:
    """Segments as paths of their own, with distances from their first node; and those too short for it."""
    rows = profile.join(segments.select("mip", "segment_id", "first_pos", "end_pos", "n_nodes"), "mip").where("pos >= first_pos and pos < end_pos")
    short = segments.where(F.col("n_nodes") < min_nodes).select("mip", "segment_id", F.lit("skipped_too_few_nodes").alias("status"), "n_nodes")
    w = Window.partitionBy("mip", "segment_id")
    shift = F.min("dist_m").over(w)
    out = rows.where(F.col("n_nodes") >= min_nodes).withColumn("shift_m", shift)
    out = out.withColumn("dist_m", F.col("dist_m") - F.col("shift_m")).withColumn("pos", (F.col("pos") - F.col("first_pos")).cast("int"))
    return out.withColumn("mip", F.col("mip") * SEGMENT_KEY + F.col("segment_id")).drop("first_pos", "end_pos", "n_nodes", "segment_id"), short


def two_stage(profile: DataFrame, first: dict[str, DataFrame], config: PipelineConfig, family: str, settings=FINAL_SETTINGS, threshold_m: float = 11_500.0, external: DataFrame | None = None) -> dict[str, DataFrame]:
    """Segment the segments of a first stage, and unite the breaks of both, shifted back.

    Breaks of the second stage are not held apart from those of the first.
    """
    parts, short = sub_profiles(profile, first["segments"])
    parts = settle(parts)
    second = finalize(parts, config, family, settings, threshold_m, external=external)
    shifts = parts.select("mip", "shift_m").distinct()
    added = second["stable"].join(shifts, "mip").select(F.floor(F.col("mip") / SEGMENT_KEY).cast("long").alias("mip"), F.explode("stable_breaks_m").alias("_b"), "shift_m")
    added = added.groupBy("mip").agg(F.collect_set(F.round(F.col("_b") + F.col("shift_m"), 6)).alias("_added"))
    none = F.array().cast("array<double>")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("stable_breaks_m", none), F.coalesce("_added", none))))
    paths = profile.select("mip").distinct()
    stable = paths.join(first["stable"].select("mip", "stable_breaks_m"), "mip", "left").join(added, "mip", "left").select("mip", both.alias("stable_breaks_m"))
    return {"first": first, "second": second, "skipped": short, "stable": stable, "segments": consensus.segments(profile.select("mip", "pos", "dist_m"), stable)}


def run_setup(profile: DataFrame, setup: Setup, config: PipelineConfig = PipelineConfig(), external: DataFrame | None = None, tuned: dict | None = None) -> dict:
    """A setup of one or two stages. tuned: stages that were run before, by name, to be used again."""
    tuned = dict(tuned or {})
    for stage in setup.stages:
        if stage.name not in tuned:
            tuned[stage.name] = run_stage(profile, stage, config, external)
    one = tuned[setup.stages[0].name]
    if len(setup.stages) == 1:
        return one | {"tuned": tuned}
    two, stage = tuned[setup.stages[1].name], setup.stages[1]
    second = replace(config, features=stage.features)
    return two_stage(profile, one["final"], second, two["family"], two["settings"], two["threshold_m"], external) | {"tuned": tuned}


def run_summary(grid: dict[str, DataFrame]) -> DataFrame:
    """One row for each path and family: ranges over its settings, and its consensus by class."""
    chosen = grid["selections"].groupBy("mip", "family").agg(
        F.count("*").alias("n_settings"), F.count_if(F.col("status") == "ok").alias("n_valid"), F.min("n_breaks").alias("min_breaks"), F.max("n_breaks").alias("max_breaks"),
        F.min("n_candidates").alias("min_candidates"), F.max("n_candidates").alias("max_candidates"), F.min("final_sse").alias("min_sse"), F.max("final_sse").alias("max_sse"),
    )
    classes = grid["consensus"].groupBy("mip", "family").agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("support_class") == "core").alias("n_core"), F.count_if(F.col("support_class") == "medium").alias("n_medium"),
        F.count_if(F.col("support_class") == "weak").alias("n_weak"), F.avg("span_m").alias("mean_span_m"), F.max("span_m").alias("max_span_m"),
    )
    return chosen.join(classes, ["mip", "family"], "left")


def reach_summary(final: dict[str, DataFrame]) -> DataFrame:
    """One row for each path of a final run, skipped ones too."""
    stable = final["consensus"].where("is_stable").groupBy("mip", "family").agg(F.count("*").alias("n_stable"), F.avg("support").alias("mean_support"), F.avg("span_m").alias("mean_span_m"))
    lengths = final["segments"].groupBy("mip").agg(F.count("*").alias("n_segments"), F.avg(F.col("end_m") - F.col("start_m")).alias("mean_segment_m"), F.percentile(F.col("end_m") - F.col("start_m"), F.lit(0.5)).alias("median_segment_m"))
    skipped = final["skipped"].select("mip", "status")
    return lengths.join(stable, "mip", "left").join(skipped, "mip", "left").withColumn("status", F.coalesce("status", F.lit("ok"))).fillna(0, ["n_stable"])


def overall_summary(reaches: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return reaches.agg(
        F.count("*").alias("n_paths"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_skipped"), F.sum("n_stable").alias("n_stable"), F.avg("n_stable").alias("mean_stable"),
        F.avg(F.when(ok, F.col("n_segments"))).alias("mean_segments"), F.percentile(F.when(ok, F.col("n_segments")), F.lit(0.5)).alias("median_segments"), F.avg(F.when(ok, F.col("mean_support"))).alias("mean_support"),
    )
