"""Which family and settings to keep: quality of every selection, Pareto front, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TuningConfig

RUN = ("mip", "family")


def relative_quality(selections: DataFrame) -> DataFrame:
    """Error relative to the least, and index relative to the greatest, of each path and family."""
    w = Window.partitionBy(*RUN)
    return selections.withColumn("sse_ratio", F.col("final_sse") / F.min("final_sse").over(w)).withColumn("ch_ratio", F.col("ch") / F.max("ch").over(w))


def calinski_harabasz(rows: DataFrame, columns: list[str], keys: tuple[str, ...], label: str = "label") -> DataFrame:
    """The index of labelled rows; NULL under two groups, with no more rows than groups, or without spread in them.

    Rows with any missing value do not count. From counts, sums and squares of each group.
    """
    known = rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in columns)))
    sums = [F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)]
    square = F.sum(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))).alias("_q")
    per = known.groupBy(*keys, label).agg(F.count("*").alias("_n"), square, *sums)
    own = sum((F.col(f"_s{i}") ** 2 for i in range(len(columns))), F.lit(0.0)) / F.col("_n")
    total = per.groupBy(*keys).agg(
        F.count("*").alias("_k"), F.sum("_n").alias("_N"), F.sum("_q").alias("_Q"), F.sum(own).alias("_own"), *[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(columns))]
    )
    all_ = sum((F.col(f"_t{i}") ** 2 for i in range(len(columns))), F.lit(0.0)) / F.col("_N")
    between, within = F.col("_own") - all_, F.col("_Q") - F.col("_own")
    ok = (F.col("_k") >= 2) & (F.col("_N") > F.col("_k")) & (within > 1e-12)
    index = (between / (F.col("_k") - 1)) / (within / (F.col("_N") - F.col("_k")))
    return total.select(*keys, F.when(ok, index).alias("ch"))


def mean_ch(rows: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    """The mean index over windows; those without one are skipped."""
    per = calinski_harabasz(rows, columns, (*keys, "window_m"))
    return per.groupBy(*keys).agg(F.avg("ch").alias("ch"))


def match_score(a: Column, b: Column, tolerance_m: float) -> Column:
    """Twice the number of pairs over the number of breaks of both ascending lists.

    Breaks of a in turn each take the nearest free one of b within the tolerance; two empty
    lists agree fully.
    """
    free = F.transform(b, lambda x: F.struct(x.alias("m"), F.lit(True).alias("free")))
    start = F.struct(free.alias("left"), F.lit(0).alias("hits"))

    def take(state: Column, x: Column) -> Column:
        near = F.filter(state["left"], lambda y: y["free"] & (F.abs(y["m"] - x) <= tolerance_m))
        best = F.array_min(F.transform(near, lambda y: F.struct(F.abs(y["m"] - x).alias("d"), y["m"].alias("m"))))
        rest = F.transform(state["left"], lambda y: F.struct(y["m"].alias("m"), (y["free"] & (best.isNull() | (y["m"] != best["m"]))).alias("free")))
        return F.struct(rest.alias("left"), (state["hits"] + F.when(best.isNull(), 0).otherwise(1)).alias("hits"))

    hits = F.aggregate(a, start, take, lambda s: s["hits"])
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * hits / both)


def centrality(selections: DataFrame, tolerance_m: float = 5000.0) -> DataFrame:
    """Mean match of each setting's breaks with those of the other settings of its path and family; 1 if alone.

    A family has some hundred settings, so the pairs of a path and family are few.
    """
    a = selections.select(*RUN, F.col("setting").alias("setting"), F.col("breaks_m").alias("_a"))
    b = selections.select(*RUN, F.col("setting").alias("_other"), F.col("breaks_m").alias("_b"))
    pairs = a.join(b, list(RUN), "left").where("setting <> _other").withColumn("_score", match_score(F.col("_a"), F.col("_b"), tolerance_m))
    mean = pairs.groupBy(*RUN, "setting").agg(F.avg("_score").alias("centrality"))
    return selections.join(mean, [*RUN, "setting"], "left").withColumn("centrality", F.coalesce("centrality", F.lit(1.0)))


def span_statistics(breaks: DataFrame, consensus: DataFrame, tolerance_m: float = 5000.0) -> DataFrame:
    """For each setting, the consensus clusters nearest to its breaks: how many, of which class, how wide.

    breaks: (mip, family, setting, breaks_m). A break further than the tolerance from all matches none.
    """
    single = breaks.select(*RUN, "setting", F.explode("breaks_m").alias("break_m"))
    near = single.join(consensus.select(*RUN, "cluster_id", "center_m", "span_m", "support_class"), list(RUN))
    key = F.struct(F.abs(F.col("center_m") - F.col("break_m")).alias("d"), "cluster_id")
    best = near.groupBy(*RUN, "setting", "break_m").agg(F.min(F.struct(key.alias("k"), "span_m", "support_class")).alias("_b"))
    hit = best.where(F.col("_b.k.d") <= tolerance_m).select(*RUN, "setting", F.col("_b.k.cluster_id").alias("cluster_id"), "_b.span_m", "_b.support_class").distinct()
    stats = hit.groupBy(*RUN, "setting").agg(
        F.count("*").alias("n_matched"),
        F.count_if(F.col("support_class") == "core").alias("n_core"),
        F.count_if(F.col("support_class") == "medium").alias("n_medium"),
        F.count_if(F.col("support_class") == "weak").alias("n_weak"),
        F.avg("span_m").alias("mean_span_m"),
        F.max("span_m").alias("max_span_m"),
    )
    every = breaks.select(*RUN, "setting").distinct().join(stats, [*RUN, "setting"], "left")
    return every.fillna(0).withColumn("span_penalty", 0.7 * F.col("max_span_m") + 0.3 * F.col("mean_span_m"))


def setting_statistics(evaluated: DataFrame) -> DataFrame:
    """Means and sample deviations over paths for each family and setting."""
    return evaluated.groupBy("family", "setting", "min_windows", "min_support_runs", "stop_relative").agg(
        F.countDistinct("mip").alias("n_paths"),
        F.avg("ch").alias("mean_ch"),
        F.stddev_samp("ch").alias("sd_ch"),
        F.avg("centrality").alias("mean_centrality"),
        F.stddev_samp("centrality").alias("sd_centrality"),
        F.avg("sse_ratio").alias("mean_sse_ratio"),
        F.avg("ch_ratio").alias("mean_ch_ratio"),
        F.avg("n_breaks").alias("mean_breaks"),
        F.stddev_samp("n_breaks").alias("sd_breaks"),
        (F.avg("mean_span_m") / 1000).alias("mean_span_km"),
        (F.avg("max_span_m") / 1000).alias("max_span_km"),
        F.avg("span_penalty").alias("mean_span_penalty"),
        F.avg("n_core").alias("mean_core"),
        F.avg("n_medium").alias("mean_medium"),
        F.avg("n_weak").alias("mean_weak"),
    )


AXES = ("min_windows", "min_support_runs", "stop_relative")


def grid_ranks(settings: DataFrame) -> DataFrame:
    """Add the dense rank of each parameter within its family."""
    for a in AXES:
        settings = settings.withColumn(f"_r_{a}", F.dense_rank().over(Window.partitionBy("family").orderBy(a)))
    return settings


def step_distance(left: str, right: str) -> Column:
    return sum((F.abs(F.col(f"{left}._r_{a}") - F.col(f"{right}._r_{a}")) for a in AXES), F.lit(0))


def instability(settings: DataFrame) -> DataFrame:
    """How much a setting's measures change to its grid neighbours, one step along one axis; NULL without any.

    Weights: centrality 1, span in km 0.20, breaks 0.15, error ratio 0.15, index 0.10.
    """
    ranked = grid_ranks(settings)
    a, b = ranked.alias("a"), ranked.alias("b")
    near = a.join(b, (F.col("a.family") == F.col("b.family")) & (step_distance("a", "b") == 1))
    change = sum((w * F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c, w in (("mean_centrality", 1.0), ("mean_span_km", 0.20), ("mean_breaks", 0.15), ("mean_sse_ratio", 0.15), ("mean_ch", 0.10))), F.lit(0.0))
    mean = near.groupBy(F.col("a.family").alias("family"), F.col("a.setting").alias("setting")).agg(F.avg(change).alias("instability"), F.count("*").alias("n_neighbours"))
    return settings.join(mean, ["family", "setting"], "left")


MAXIMIZE, MINIMIZE = ("mean_ch", "mean_centrality"), ("instability", "mean_span_penalty", "mean_sse_ratio")


def pareto(settings: DataFrame, maximize: tuple[str, ...] = MAXIMIZE, minimize: tuple[str, ...] = MINIMIZE) -> DataFrame:
    """Add is_pareto: no other row of the family is as good in all measures and better in one.

    A missing measure makes a comparison false, so such a row neither dominates nor is dominated.
    """
    a, b = settings.alias("a"), settings.alias("b")
    pairs = [(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in maximize] + [(-F.col(f"b.{c}"), -F.col(f"a.{c}")) for c in minimize]
    no_worse, better = F.lit(True), F.lit(False)
    for x, y in pairs:
        no_worse &= F.coalesce(x >= y, F.lit(False))
        better |= F.coalesce(x > y, F.lit(False))
    rule = (F.col("a.family") == F.col("b.family")) & no_worse & better
    front = a.join(b, rule, "left_anti").select("family", "setting").withColumn("_front", F.lit(True))
    return settings.join(front, ["family", "setting"], "left").withColumn("is_pareto", F.coalesce("_front", F.lit(False))).drop("_front")


def quality_order() -> list[Column]:
    return [
        F.col("mean_ch").desc_nulls_last(), F.col("mean_centrality").desc_nulls_last(), F.col("instability").asc_nulls_last(),
        F.col("mean_span_penalty").asc_nulls_last(), F.col("mean_sse_ratio").asc_nulls_last(),
    ]


def representatives(settings: DataFrame) -> DataFrame:
    """The first Pareto row of each family."""
    w = Window.partitionBy("family").orderBy(*quality_order(), "setting")
    return settings.where("is_pareto").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def family_overview(settings: DataFrame) -> DataFrame:
    """Best and mean measures of each family, with its representative's."""
    view = settings.groupBy("family").agg(
        F.count("*").alias("n_settings"), F.count_if("is_pareto").alias("n_pareto"), F.max("mean_ch").alias("best_ch"), F.avg("mean_ch").alias("average_ch"), F.max("n_paths").alias("n_paths")
    )
    rep = representatives(settings).select("family", F.col("setting").alias("rep_setting"), F.col("mean_ch").alias("rep_ch"), F.col("mean_centrality").alias("rep_centrality"), F.col("instability").alias("rep_instability"))
    return view.join(rep, "family", "left")


def rank_families(representative_rows: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy(*quality_order(), "family")  # a row for each family
    return representative_rows.withColumn("family_rank", F.row_number().over(w))


def local_grid(settings: DataFrame, representative: DataFrame, min_keep: int = 4) -> DataFrame:
    """Pareto rows within one grid step of their family's representative, or the nearest few if those are fewer."""
    ranked = grid_ranks(settings)
    center = ranked.join(representative.select("family", "setting"), ["family", "setting"], "left_semi").alias("r")
    away = ranked.where("is_pareto").alias("s").join(center, F.col("s.family") == F.col("r.family")).select("s.*", step_distance("s", "r").alias("step_distance"))
    w = Window.partitionBy("family")
    order = Window.partitionBy("family").orderBy("step_distance", *quality_order(), "setting")
    counted = away.withColumn("_near", F.count_if(F.col("step_distance") <= 1).over(w)).withColumn("_n", F.row_number().over(order))
    kept = counted.where(F.when(F.col("_near") >= min_keep, F.col("step_distance") <= 1).otherwise(F.col("_n") <= min_keep))
    return kept.drop("_near", "_n", *[f"_r_{a}" for a in AXES])


def compare_families(evaluated: DataFrame, reps: DataFrame, a: str, b: str, tie: float = 0.02) -> DataFrame:
    """Path by path, which of two families' representatives has the higher index, relative to the second's.

    A path that only one of them has counts as a win for it; within the tie band, or where an
    index is missing, none wins.
    """
    own = evaluated.join(reps.select("family", "setting"), ["family", "setting"], "left_semi").select("mip", "family", "ch")
    left = own.where(F.col("family") == a).select("mip", F.col("ch").alias("ch_a"), F.lit(True).alias("_a"))
    right = own.where(F.col("family") == b).select("mip", F.col("ch").alias("ch_b"), F.lit(True).alias("_b"))
    both = left.join(right, "mip", "full_outer")
    difference = (F.col("ch_a") - F.col("ch_b")) / F.greatest(F.abs("ch_b"), F.lit(1e-12))
    source = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    winner = F.when(F.col("_b").isNull(), a).when(F.col("_a").isNull(), b).when(difference > tie, a).when(difference < -tie, b).otherwise("tie")
    return both.select("mip", "ch_a", "ch_b", source.alias("source"), F.when(source == "both", difference).alias("ch_difference"), winner.alias("winner"))


def choose_family(evaluated: DataFrame, settings: DataFrame, config: TuningConfig = TuningConfig()) -> dict:
    """The winning family and why: by mean index, by won paths, or by robustness. The choice is among a few rows.

    gap is the difference of both mean indexes relative to the second's.
    """
    reps = representatives(settings)
    rows = rank_families(reps).orderBy("family_rank").collect()
    if not rows:
        return {"family": None, "reason": "no_pareto_rows"}
    if len(rows) == 1:
        return {"family": rows[0]["family"], "reason": "only_family", "setting": rows[0]["setting"]}
    first, second = rows[0], rows[1]
    x, y = first["mean_ch"], second["mean_ch"]
    found: dict = {"gap": None if x is None or y is None else (x - y) / max(abs(y), 1e-12)}

    def pick(r, why: str) -> dict:
        other = second if r is first else first
        return {"family": r["family"], "reason": why, "setting": r["setting"], "runner_up": other["family"], "mean_ch": r["mean_ch"], "runner_up_mean_ch": other["mean_ch"], **found}

    if found["gap"] is not None and found["gap"] > config.mean_ch_gap:
        return pick(first, "mean_ch_gap")
    pairs = compare_families(evaluated, reps, first["family"], second["family"], config.reach_tie)
    counts = {(r["source"], r["winner"]): r["count"] for r in pairs.groupBy("source", "winner").count().collect()}
    wins = {f["family"]: sum(n for (_, w), n in counts.items() if w == f["family"]) for f in (first, second)}
    ties = sum(n for (_, w), n in counts.items() if w == "tie")
    decided = sum(wins.values())
    found |= {"n_paths": decided + ties, "n_both": sum(n for (s, _), n in counts.items() if s == "both"), "n_decided": decided, "n_ties": ties, "wins": wins}
    for r in (first, second):
        if decided and wins[r["family"]] / decided >= config.win_share:
            return pick(r, "path_wins")
    last = float("inf")
    known = lambda v: last if v is None else v
    key = lambda r: (known(None if r["mean_centrality"] is None else -r["mean_centrality"]), known(r["instability"]), known(r["mean_span_penalty"]), known(r["mean_sse_ratio"]))
    return pick(min((first, second), key=key), "robustness")


def threshold_summary(consensus: DataFrame, config: TuningConfig = TuningConfig()) -> DataFrame:
    """What each support threshold would keep, by family: clusters of each path, their support and width."""
    rows = consensus.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in config.thresholds])))
    kept = F.col("support") >= F.col("threshold")
    per = rows.groupBy("family", "threshold", "mip").agg(
        F.count_if(kept).alias("n_kept"), F.count("*").alias("n_all"), F.avg(F.when(kept, F.col("support"))).alias("support"), F.avg(F.when(kept, F.col("span_m"))).alias("span_m"), F.max(F.when(kept, F.col("span_m"))).alias("max_span_m")
    )
    return per.groupBy("family", "threshold").agg(
        F.count("*").alias("n_paths"), F.avg("n_kept").alias("mean_kept"), F.avg(F.col("n_kept") / F.col("n_all")).alias("mean_kept_share"), F.avg("support").alias("mean_support"), F.avg("span_m").alias("mean_span_m"), F.max("max_span_m").alias("max_span_m"), F.avg("max_span_m").alias("mean_max_span_m")
    )


def threshold_candidates(summary: DataFrame, family: str | None = None) -> DataFrame:
    """Thresholds of each family (or of one) that none beats in kept clusters, their support and their widest, best first."""
    rows = summary.withColumn("setting", F.col("threshold").cast("string"))
    front = pareto(rows, ("mean_kept", "mean_support"), ("mean_max_span_m",)).where("is_pareto").drop("setting", "is_pareto")
    front = front if family is None else front.where(F.col("family") == family)
    order = Window.partitionBy("family").orderBy(F.col("mean_support").desc_nulls_last(), F.col("mean_max_span_m").asc_nulls_last(), F.col("mean_kept").desc_nulls_last(), "threshold")
    return front.withColumn("rank", F.row_number().over(order))


def percent_rank(value: Column, keys: tuple[str, ...], higher_is_better: bool = True) -> Column:
    """Average rank over the number of rows; ties share their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value.asc() if higher_is_better else value.desc())
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    n = F.count("*").over(Window.partitionBy(*keys))
    return (F.rank().over(w) + (ties - 1) / 2) / n
