"""Greedy choice of breaks that lower the squared error within segments, for a grid of settings.

Which break comes next does not depend on the stop rules, so one path of choices for each
set of candidates serves all stop values as its prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SelectionConfig, Setting
from ..settled import settle
from .changepoint import ROWS, by_path
from .support import chain_clusters
from .windows import label

HISTORY = "array<struct<k:int,added_m:double,total_sse:double,improvement:double,relative:double>>"
SELECTIONS = (
    "mip long, family string, setting string, min_windows int, min_windows_effective int, min_support_runs double, stop_relative double, "
    f"status string, n_candidates int, n_breaks int, breaks_m array<double>, base_sse double, final_sse double, history {HISTORY}"
)


#: Positions of all problems that one step of the greedy choice works on at once, empty places counted.
STEP_POSITIONS = 1 << 20


def candidates(support: DataFrame, config: SelectionConfig) -> DataFrame:
    """Clusters that pass every support rule, as (mip, family, center_m)."""
    rule = (F.col("support_runs") >= config.min_support_runs) & (F.col("n_windows_supported") >= config.min_windows) & (F.col("support_windows") >= config.min_support_windows)
    if config.min_frequency is not None:
        rule &= F.col("frequency") >= config.min_frequency
    return support.where(rule).select("mip", "family", "center_m")


def interior(points: DataFrame, profile: DataFrame, position: str = "center_m") -> DataFrame:
    """Distinct positions, rounded to six places, inside their path."""
    ends = profile.groupBy("mip").agg(F.min("dist_m").alias("_lo"), F.max("dist_m").alias("_hi"))
    kept = points.join(ends, "mip").where((F.col(position) > F.col("_lo")) & (F.col(position) < F.col("_hi")))
    return kept.select("mip", "family", F.round(position, 6).alias(position)).distinct()


def all_run_candidates(breaks: DataFrame, tolerance_m: float | None = None) -> DataFrame:
    """Candidates straight from the runs: their positions, or the medians of their chain clusters."""
    if tolerance_m is None:
        return breaks.select("mip", "family", F.col("break_m").alias("center_m")).distinct()
    clustered = chain_clusters(breaks, tolerance_m, ties=("window_m", "penalty"))
    return clustered.groupBy("mip", "family", "cluster_id").agg(F.percentile("break_m", F.lit(0.5)).alias("center_m")).drop("cluster_id")


def prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the features, and of all their squares, before each row and at the end; x: (..., rows, features)."""
    many = x.shape[:-2]
    return (
        np.concatenate([np.zeros((*many, 1, x.shape[-1])), np.cumsum(x, axis=-2)], axis=-2),
        np.concatenate([np.zeros((*many, 1)), np.cumsum((x * x).sum(axis=-1), axis=-1)], axis=-1),
    )


class Profile:
    """Prefix sums of standardised features over the windows of a family, for fast segment errors."""

    def __init__(self, dist: np.ndarray, tables: Sequence[np.ndarray], weights: Sequence[float] | None = None):
        weights = [1.0] * len(tables) if weights is None else list(weights)
        self._hold(dist, *prefix_sums(np.hstack([t * np.sqrt(w) for t, w in zip(tables, weights)]) if tables else np.zeros((len(dist), 0))))

    def _hold(self, dist: np.ndarray, run: np.ndarray, square: np.ndarray) -> Profile:
        self.dist, self.run, self.square = dist, run, square
        return self

    @classmethod
    def of_sums(cls, dist: np.ndarray, run: np.ndarray, square: np.ndarray) -> Profile:
        """The profile of what prefix_sums() gave."""
        return cls.__new__(cls)._hold(dist, run, square)

    def error(self, lo, hi):
        """Squared error within rows lo to hi - 1; lo and hi may be arrays."""
        n = np.maximum(hi - lo, 1)
        return self.square[hi] - self.square[lo] - ((self.run[hi] - self.run[lo]) ** 2).sum(axis=-1) / n


def greedy(profile: Profile, positions: np.ndarray, config: SelectionConfig, least: float | None = None) -> tuple[float, list[tuple[float, float, float]]]:
    """The error without breaks, and (position, error after, improvement) in the order of choice.

    least: the lowest relative stop value that is asked of prefix(). The first choice that it,
    or the absolute one, does not let through is then the last one made, as no prefix goes beyond.
    """
    return greedy_all([(profile, positions, least)], config)[0]


def greedy_all(problems: Sequence[tuple[Profile, np.ndarray, float | None]], config: SelectionConfig) -> list[tuple[float, list[tuple[float, float, float]]]]:
    """What greedy() gives for each profile, positions and least: all of them make their next choice in one step."""
    out: list = [None] * len(problems)
    columns = np.array([p.run.shape[1] for p, _, _ in problems], dtype=int)
    counts = np.array([len(c) for _, c, _ in problems], dtype=int)
    order = np.lexsort((counts, columns))
    while len(order):
        last = order[-1]  # of those with as many columns the one with most positions
        alike = len(order) - int(np.searchsorted(columns[order], columns[last]))
        some, order = np.split(order, [-min(alike, max(1, STEP_POSITIONS // max(1, counts[last])))])[::-1]
        for i, found in zip(some.tolist(), _greedy([problems[i] for i in some.tolist()], config)):
            out[i] = found
    return out


def _greedy(problems: list[tuple[Profile, np.ndarray, float | None]], config: SelectionConfig) -> list[tuple[float, list[tuple[float, float, float]]]]:
    """greedy_all() for profiles of as many columns: positions are columns of one table with a row for each problem."""
    profiles = [p for p, _, _ in problems]
    n = np.array([len(p.dist) for p in profiles])
    first = np.cumsum(n + 1) - (n + 1)
    run, square = np.concatenate([p.run for p in profiles]), np.concatenate([p.square for p in profiles])

    def error(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = first[of] + lo, first[of] + hi
        return square[b] - square[a] - ((run[b] - run[a]) ** 2).sum(axis=-1) / np.maximum(hi - lo, 1)

    counts = np.array([len(c) for _, c, _ in problems])
    slots = np.arange(counts.max()) < counts[:, None]
    at, here = np.full(slots.shape, np.nan), np.zeros(slots.shape, dtype=int)
    at[slots] = np.concatenate([c for _, c, _ in problems])
    here[slots] = np.concatenate([np.searchsorted(p.dist, c, side="left") for p, c, _ in problems])
    lo, hi = np.zeros_like(here), np.repeat(n[:, None], here.shape[1], axis=1)  # the segment that a position lies in
    reach = config.min_reach_m
    if reach is not None:  # and the breaks or ends around it
        before, after = (np.repeat([[p.dist[k]] for p in profiles], here.shape[1], axis=1) for k in (0, -1))
    base = error(np.arange(len(n)), np.zeros_like(n), n)
    now, made = base.copy(), [[] for _ in problems]
    relative = np.array([-np.inf if r is None else r for _, _, r in problems])
    absolute = np.array([-np.inf if r is None else config.stop_absolute for _, _, r in problems])
    free = slots & (here > 0) & (here < n[:, None])
    going = np.flatnonzero(free.any(axis=1))
    for _ in range(config.max_breaks):
        if not len(going):
            break
        i, j = np.nonzero(free[going])
        of = going[i]
        low, high, mid = lo[of, j], hi[of, j], here[of, j]
        gain = error(of, low, high) - error(of, low, mid) - error(of, mid, high)
        gain[(mid == low) | np.isnan(gain)] = 0.0  # no new segment
        if reach is not None:
            gain[np.minimum(at[of, j] - before[of, j], after[of, j] - at[of, j]) < reach - 1e-9] = 0.0
        gains = np.zeros((len(going), free.shape[1]))
        gains[i, j] = gain
        which = _first_best(gains)
        best = gains[np.arange(len(going)), which]
        kept = best > 1e-12
        going, which, best = going[kept], which[kept], best[kept]
        now[going] -= best
        for g, m, e, b in zip(going.tolist(), at[going, which].tolist(), now[going].tolist(), best.tolist()):
            made[g].append((m, e, b))
        share = np.divide(best, base[going], out=np.zeros_like(best), where=base[going] > 0)
        on = (best >= absolute[going]) & (share >= relative[going])
        going, which = going[on], which[on]
        cut, new = here[going, which][:, None], at[going, which][:, None]
        mids = here[going]
        lo[going] = np.where(cut <= mids, np.maximum(lo[going], cut), lo[going])
        hi[going] = np.where(cut > mids, np.minimum(hi[going], cut), hi[going])
        if reach is not None:
            before[going] = np.where(new <= at[going], np.maximum(before[going], new), before[going])
            after[going] = np.where(new >= at[going], np.minimum(after[going], new), after[going])
        free[going] &= np.abs(at[going] - new) >= config.min_spacing_m
        free[going, which] = False
        going = going[free[going].any(axis=1)]
    return list(zip(base.tolist(), made))


def _first_best(gains: np.ndarray) -> np.ndarray:
    """The column of the best gain in each row, where a later one must be better by more than rounding."""
    which = gains.argmax(axis=1)
    best = gains[np.arange(len(gains)), which][:, None]
    near = ((gains + 1e-12 >= best) & (np.arange(gains.shape[1]) < which[:, None])).any(axis=1)
    for r in np.flatnonzero(near).tolist():
        best, which[r] = 0.0, 0
        for j, g in enumerate(gains[r].tolist()):
            if g > best + 1e-12:
                best, which[r] = g, j
    return which


def prefix(base: float, made: list[tuple[float, float, float]], stop_relative: float, stop_absolute: float) -> int:
    """How many of the choices a stop rule lets through; improvements are relative to the error without breaks."""
    for k, (_, _, gain) in enumerate(made):
        relative = gain / base if base > 0 else 0.0
        if gain < stop_absolute or relative < stop_relative:
            return k
    return len(made)


def select(features: DataFrame, windows: DataFrame, support: DataFrame, columns: Sequence[str], settings: dict[str, Sequence[Setting]], config: SelectionConfig = SelectionConfig(), breaks: DataFrame | None = None) -> DataFrame:
    """A row for each path, family and setting of the family (see SELECTIONS).

    features: imputed z-scores by (mip, window_m, pos). windows: (mip, family, window_m).
    breaks: those of the runs (mip, family, break_m, ...), where candidates come from all runs.
    Statuses: ok, no_candidates, constant_features.
    """
    columns = list(columns)
    settings = {k: list(v) for k, v in settings.items()}
    known = ["support_runs", "support_windows", "n_windows_supported", "frequency"]
    none = F.lit(None).cast("double")
    if config.source == "all_runs":
        if breaks is None:
            raise ValueError("candidates of all runs need the breaks of the runs")
        # Support rules do not hold for them.
        support = all_run_candidates(breaks, config.candidate_tolerance_m).select("*", *[F.lit(float("inf")).alias(k) for k in known])
    elif config.source != "support":
        raise ValueError(f"unknown source of candidates: {config.source}")
    weight = F.lit(1.0)
    for named, w in config.window_weights:
        weight = F.when(label(F.col("window_m")) == named, float(w)).otherwise(weight)
    rows = windows.select("mip", "family", "window_m").distinct().join(features.select("mip", "window_m", "pos", "dist_m", *columns), ["mip", "window_m"])
    # Points and candidates of a path stand in one order, points first, so that a batch holds many paths.
    rows = rows.select("mip", "family", F.lit(0).alias("kind"), "window_m", "pos", "dist_m", *columns, weight.alias(known[0]), *[none.alias(k) for k in known[1:]])
    points = support.select("mip", "family", F.lit(1).alias("kind"), none.alias("window_m"), F.lit(0).alias("pos"), F.col("center_m").alias("dist_m"), *[none.alias(c) for c in columns], *[F.col(k).cast("double").alias(k) for k in known])

    least = {k: min((s.stop_relative for s in v), default=0.0) for k, v in settings.items()}

    def profiles(lo: np.ndarray, points: np.ndarray, window: np.ndarray, dist: np.ndarray, x: np.ndarray, weights: np.ndarray) -> tuple[list[Profile | None], list[int]]:
        """The profile of each path (None without useful features) and its number of windows; all windows of a path have its points."""
        new = np.append(True, window[1:] != window[:-1])
        new[lo] = True
        until = np.append(0, np.cumsum(new))
        n_windows = until[lo + points] - until[lo]
        found: list[Profile | None] = [None] * len(lo)
        for k, m in sorted(set(zip(n_windows.tolist(), points.tolist()))):
            alike = np.flatnonzero((n_windows == k) & (points == m))
            n = m // k
            borders = lo[alike, None] + n * np.arange(k)
            if m % k or not new[borders].all():
                raise ValueError("the windows of a path differ in their points")
            tables = x[lo[alike, None] + np.arange(m)].reshape(len(alike), k, n, -1)
            useful = tables.std(axis=2).max(axis=1) > 1e-12
            tables = (tables * np.sqrt(weights[borders])[:, :, None, None]).swapaxes(1, 2)
            for kept in np.unique(useful, axis=0):
                if kept.any():
                    same = np.flatnonzero((useful == kept).all(axis=1))
                    sums = prefix_sums(np.ascontiguousarray(tables[same][..., kept]).reshape(len(same), n, -1))
                    for g, run, square in zip(alike[same].tolist(), *sums):
                        end = lo[g] + m
                        found[g] = Profile.of_sums(dist[end - n : end], run, square)
        return found, n_windows.tolist()

    def candidates_of(family: str, n_windows: int, ends: tuple[float, float], center: np.ndarray, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each setting the windows it asks for, and its candidates; the same array where settings have the same."""
        done: dict[tuple[float, int], np.ndarray] = {}
        held: dict[bytes, np.ndarray] = {}
        out = []
        for setting in settings.get(family, []):
            effective = min(setting.min_windows, n_windows)
            key = (setting.min_support_runs, effective)
            if key not in done:
                ok = (s[:, 0] >= setting.min_support_runs) & (s[:, 2] >= effective) & (s[:, 1] >= config.min_support_windows)
                if config.min_frequency is not None:
                    ok &= s[:, 3] >= config.min_frequency
                c = np.unique(center[ok])
                c = c[(c > ends[0]) & (c < ends[1])]
                done[key] = held.setdefault(c.tobytes(), c)
            out.append((effective, done[key]))
        return out

    names = [f.split()[0] for f in SELECTIONS.split(f", history {HISTORY}")[0].split(", ")] + ["history"]

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        mip, family, kind = batch["mip"].to_numpy(), batch["family"].to_numpy(), batch["kind"].to_numpy()
        window, dist = batch["window_m"].to_numpy(dtype=float), batch["dist_m"].to_numpy(dtype=float)
        x, s = batch[columns].to_numpy(dtype=float), batch[known].to_numpy(dtype=float)
        starts = np.flatnonzero(np.append(True, (mip[1:] != mip[:-1]) | (family[1:] != family[:-1])))
        ends, points = np.append(starts[1:], len(batch)), np.add.reduceat((kind == 0).astype(int), starts)
        starts, ends, points = starts[points > 0], ends[points > 0], points[points > 0]
        center = np.round(dist, 6)
        asked, problems, number = [], [], {}
        for lo, m, hi, profile, n in zip(starts.tolist(), (starts + points).tolist(), ends.tolist(), *profiles(starts, points, window, dist, x, s[:, 0])):
            known_as, chosen = str(family[lo]), []
            for effective, c in candidates_of(known_as, n, (dist[lo], dist[m - 1]), center[m:hi], s[m:hi]):
                if profile is not None and len(c) and id(c) not in number:
                    number[id(c)] = len(problems)
                    problems.append((profile, c, least[known_as]))
                chosen.append((effective, c))
            asked.append((int(mip[lo]), known_as, profile is not None, chosen))
        found = []
        for base, made in greedy_all(problems, config):
            found.append((base, made, [{"k": i + 1, "added_m": m, "total_sse": e, "improvement": g, "relative": g / base if base > 0 else 0.0} for i, (m, e, g) in enumerate(made)]))
        out = []
        for path, known_as, useful, chosen in asked:
            for setting, (effective, c) in zip(settings.get(known_as, []), chosen):
                status = "constant_features" if not useful else "no_candidates" if not len(c) else "ok"
                base, made, history = found[number[id(c)]] if status == "ok" else (None, [], [])
                k = prefix(base, made, setting.stop_relative, config.stop_absolute) if status == "ok" else 0
                out.append(
                    (path, known_as, setting.label, setting.min_windows, effective, setting.min_support_runs, setting.stop_relative, status, len(c), k, sorted(m for m, _, _ in made[:k]),
                     base, None if base is None else (made[k - 1][1] if k else base), history[:k])
                )
        return pd.DataFrame(out, columns=names)

    # Clusters are counted by themselves: in one stage with the many points of the paths they would get a single task.
    points = settle(points)
    ordered = rows.unionByName(points).repartition("mip").sortWithinPartitions("mip", "family", "kind", "window_m", "pos")
    return ordered.mapInPandas(lambda batches: by_path(batches, each, ROWS), SELECTIONS)


def break_faults(selections: DataFrame, profile: DataFrame, config: SelectionConfig = SelectionConfig()) -> DataFrame:
    """(mip, family, setting, fault): chosen breaks that break a rule. None are to be expected."""
    ends = profile.groupBy("mip").agg(F.min("dist_m").alias("_lo"), F.max("dist_m").alias("_hi"))
    rows = selections.where("status = 'ok' and size(breaks_m) > 0").join(ends, "mip").withColumn("_b", F.array_sort("breaks_m"))
    gaps = lambda a: F.zip_with(F.slice(a, 2, 1 << 30), F.slice(a, F.lit(1), F.size(a) - 1), lambda y, x: y - x)
    some = lambda a, rule: F.coalesce(F.exists(a, rule), F.lit(False))
    whole = F.concat(F.array("_lo"), F.col("_b"), F.array("_hi"))
    rules = {
        "not_finite": some(F.col("_b"), lambda b: b.isNull() | F.isnan(b) | (F.abs(b) == F.lit(float("inf")))),
        "not_increasing": some(gaps(F.col("_b")), lambda g: g <= 0),
        "outside": some(F.col("_b"), lambda b: (b <= F.col("_lo")) | (b >= F.col("_hi"))),
        "too_near": some(gaps(F.col("_b")), lambda g: g < config.min_spacing_m - 1e-9),
    }
    if config.min_reach_m is not None:
        rules["short_reach"] = some(gaps(whole), lambda g: g < config.min_reach_m - 1e-9)
    faults = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda f: f.isNotNull())
    return rows.select("mip", "family", "setting", F.explode(faults).alias("fault"))


def compare_runs(selections: DataFrame, tolerance_m: float = 2000.0) -> tuple[DataFrame, DataFrame]:
    """Runs of a path side by side: a row for each run, and the chain clusters of their breaks with the runs that have them.

    selections: (mip, run, breaks_m, n_candidates, final_sse), of any kind of runs.
    """
    km = lambda a: F.transform(F.array_sort(a), lambda b: F.round(b / 1000, 2))
    runs = selections.select(
        "mip", "run", F.size("breaks_m").alias("n_breaks"), km("breaks_m").alias("breaks_km"), "n_candidates", "final_sse",
        (F.col("n_candidates") / F.greatest(F.size("breaks_m"), F.lit(1))).alias("candidates_per_break"),
    )
    single = selections.select("mip", "run", F.explode("breaks_m").alias("break_m"))
    clusters = chain_clusters(single, tolerance_m, keys=("mip",), ties=("run",)).groupBy("mip", "cluster_id").agg(
        (F.percentile("break_m", F.lit(0.5)) / 1000).alias("center_km"), F.countDistinct("run").alias("n_runs_supported"),
        F.sort_array(F.collect_set("run")).alias("runs_supported"), F.transform(F.sort_array(F.collect_list("break_m")), lambda b: F.round(b / 1000, 2)).alias("members_km"),
    )
    return runs, clusters


def break_rows(selections: DataFrame) -> DataFrame:
    """(mip, family, setting, break_m) of the valid selections, with how many of them there are."""
    valid = selections.where("status = 'ok'")
    n = valid.groupBy("mip", "family").agg(F.count("*").alias("n_settings"))
    return valid.select("mip", "family", "setting", F.explode("breaks_m").alias("break_m")).join(n, ["mip", "family"])
