"""Penalised change points by least squares, exact on a grid.

Breaks minimise the sum of squared deviations from segment means over all features plus a
penalty for each break, subject to a least segment size, among the multiples of `jump`.
Method: the optimal partitioning recursion (Jackson and others, 2005; Killick, Fearnhead and
Eckley, 2012), with segment costs from prefix sums that all penalties share, for many
profiles of one length in each step. A start that a later one beats even without its penalty
is dropped, but only for ends that leave the later one its least segment; so the minimum is
exact on the grid, and among equal costs the earliest start wins.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RUNS


#: Numbers that one step of the recursion works on at once, over all profiles solved together.
STEP_NUMBERS = 1 << 21


#: Profiles of more grid points are solved one by one, so that a start is dropped as soon as this profile can do without it.
ALONE = 4096
#: Costs of all pairs of grid points are taken in one step where they are no more numbers than this.
AT_ONCE = 1 << 18
#: Rows that are solved together at least, if there are so many: only profiles of nearly one length share their steps.
ROWS = 1 << 18
#: Profiles of no more points are solved together with those that have this share of their points at least.
MIXED, NEARLY = 256, 7 / 8
#: Steps between looks for starts to drop, and the share of a cost that rounding may hide.
CLEAR, HIDDEN = 16, 1e-9


def solve_all(x: np.ndarray, penalties: Sequence[float], min_size: int, jump: int = 1, work: list[int] | None = None, sizes: np.ndarray | None = None) -> list[list[list[int]]]:
    """For each of many profiles of one length (profiles by points by features), what solve() gives.

    sizes: the points of each profile, all multiples of jump, where shorter ones are filled up to
    the length of x. What is filled in lies behind a profile's end and changes none of its breaks.

    work: gets the number of starts that were compared for each end.
    """
    many, n = x.shape[:2]
    if n < 2 * min_size or n < 2:
        return [[[] for _ in penalties] for _ in range(many)]
    run = np.concatenate([np.zeros((many, 1, x.shape[2])), np.cumsum(x, axis=1)], axis=1)
    square = np.concatenate([np.zeros((many, 1)), np.cumsum((x * x).sum(axis=2), axis=1)], axis=1)
    grid = np.unique(np.append(np.arange(0, n, jump), n))
    run, square = run[:, grid], square[:, grid]
    pen = np.asarray(penalties, dtype=float)
    ends = [len(grid) - 1] * many if sizes is None else np.searchsorted(grid, sizes).tolist()
    best = np.full((many, len(pen), len(grid)), np.inf)
    best[:, :, 0] = -pen
    came = np.zeros((len(grid), many, len(pen)), dtype=np.int32)
    lasts = np.searchsorted(grid, grid - min_size, side="right")  # starts far enough back
    if run.size * len(grid) <= AT_ONCE and work is None:
        _step_at_once(run, square, grid, lasts, pen, best, came)
        return _breaks(best, came, grid, ends)
    # What each start that is still compared brings, side by side.
    held, held_run, held_square, held_best = np.zeros(len(grid), dtype=np.int64), np.empty_like(run), np.empty_like(square), np.empty_like(best)
    m = seen = 0
    going: deque[tuple[int, np.ndarray]] = deque()  # starts to drop, and from which end on
    noise = HIDDEN * (1 + square[:, -1].max())
    for k in range(1, len(grid)):
        last = int(lasts[k])
        if not last:
            continue
        if last > seen:
            new = slice(m, m + last - seen)
            held[new], held_run[:, new], held_square[:, new], held_best[:, :, new] = np.arange(seen, last), run[:, seen:last], square[:, seen:last], best[:, :, seen:last]
            m, seen = m + last - seen, last
        if not k % CLEAR and going and going[0][0] <= grid[k]:
            gone = np.zeros(len(grid), dtype=bool)
            while going and going[0][0] <= grid[k]:
                gone[going.popleft()[1]] = True
            stay = np.flatnonzero(~gone[held[:m]])
            for array, axis in ((held, 0), (held_run, 1), (held_square, 1), (held_best, 2)):
                moved = np.take(array, stay, axis=axis)
                array[(slice(None),) * axis + (slice(0, len(stay)),)] = moved
            m = len(stay)
        apart = run[:, k : k + 1] - held_run[:, :m]
        cost = square[:, k : k + 1] - held_square[:, :m] - (apart * apart).sum(axis=2) / (grid[k] - grid[held[:m]])
        total = held_best[:, :, :m] + cost[:, None, :]
        at = total.argmin(axis=2)
        came[k] = held[at]
        best[:, :, k] = np.take_along_axis(total, at[:, :, None], axis=2)[:, :, 0] + pen
        if work is not None:
            work.append(m)
        if not k % CLEAR and last > CLEAR:
            beaten = (total > best[:, :, k : k + 1] + noise).all(axis=(0, 1))
            if beaten.any():
                going.append((int(grid[k]) + min_size, held[:m][beaten]))
    return _breaks(best, came, grid, ends)


def _step_at_once(run: np.ndarray, square: np.ndarray, grid: np.ndarray, lasts: np.ndarray, pen: np.ndarray, best: np.ndarray, came: np.ndarray) -> None:
    """The recursion for few short profiles: all costs first, no start is dropped."""
    apart = run[:, :, None] - run[:, None, :]
    cost = square[:, :, None] - square[:, None, :] - (apart * apart).sum(axis=3) / np.maximum(grid[:, None] - grid, 1)
    for k in range(int(np.searchsorted(lasts, 0, side="right")), len(grid)):
        total = best[:, :, : lasts[k]] + cost[:, k, None, : lasts[k]]
        came[k] = total.argmin(axis=2)
        best[:, :, k] = total.min(axis=2) + pen


def _breaks(best: np.ndarray, came: np.ndarray, grid: np.ndarray, ends: list[int]) -> list[list[list[int]]]:
    """The breaks of each profile and penalty, from the start of the last segment back; ends: where profiles end on the grid."""
    at, known, back = grid.tolist(), np.isfinite(best).tolist(), came.transpose(1, 2, 0).tolist()
    out = []
    for of_known, of_back, end in zip(known, back, ends):
        of = []
        for ok, start in zip(of_known, of_back):
            breaks, k = [], end
            while k > 0 and ok[k]:
                k = start[k]
                if k:
                    breaks.append(at[k])
            of.append(breaks[::-1])
        out.append(of)
    return out


def solve(x: np.ndarray, penalties: Sequence[float], min_size: int, jump: int = 1) -> list[list[int]]:
    """Break positions (first index of each later segment) for every penalty; none if two segments do not fit."""
    return solve_all(np.asarray(x, dtype=float)[None], penalties, min_size, jump)[0]


def by_path(batches: Iterator[pd.DataFrame], use: Callable[[pd.DataFrame], pd.DataFrame], least: int = 0) -> Iterator[pd.DataFrame]:
    """use() on whole paths, many at once, of batches whose rows ascend by mip; the last path of a batch may go on in the next.

    least: rows to wait for before paths are used.
    """
    kept: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        last = batch["mip"].iloc[-1]
        at = int(np.searchsorted(batch["mip"].to_numpy(), last))
        if rows + at >= least and (at or (kept and kept[-1]["mip"].iloc[-1] != last)):
            yield use(pd.concat([*kept, batch.iloc[:at]], ignore_index=True))
            kept, rows, batch = [], 0, batch.iloc[at:]
        kept.append(batch)
        rows += len(batch)
    if kept:
        yield use(pd.concat(kept, ignore_index=True))


def sweep(features: DataFrame, columns: Sequence[str], penalties: Sequence[float], jump: int = 1, min_size: int | None = None) -> DataFrame:
    """A row for each path, window and penalty (see RUNS), from standardised features without missing values.

    The least segment is the window's number of points unless it is given. Paths are dealt to
    partitions and read in order, many in one batch; short profiles of nearly one length and long ones of one length are solved together.
    """
    columns, penalties = list(columns), [float(p) for p in penalties]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        mip, window = rows["mip"].to_numpy(), rows["window_m"].to_numpy()
        starts = np.flatnonzero(np.append(True, (np.diff(mip) != 0) | (np.diff(window) != 0)))
        sizes = np.diff(np.append(starts, len(rows)))
        x, dist = rows[columns].to_numpy(dtype=float), rows["dist_m"].to_numpy()
        least = np.maximum(rows["window_pts"].to_numpy()[starts] if min_size is None else np.full(len(starts), int(min_size)), 1)
        breaks: list = [None] * len(starts)
        for m in np.unique(least).tolist():
            alike = np.flatnonzero(least == m)
            alike = alike[np.argsort(sizes[alike], kind="stable")]  # the longest last
            while len(alike):
                n = int(sizes[alike[-1]])
                step = 1 if n > ALONE * max(jump, 1) else max(1, STEP_NUMBERS // (n * max(len(penalties), len(columns), 1)))
                shortest = n * NEARLY if jump == 1 and n <= MIXED else n
                lo = max(len(alike) - step, int(np.searchsorted(sizes[alike], shortest)))
                some, alike = alike[lo:], alike[:lo]
                rows_of = starts[some, None] + np.minimum(np.arange(n), sizes[some, None] - 1)
                for g, found in zip(some, solve_all(x[rows_of], penalties, m, jump, sizes=sizes[some])):
                    breaks[g] = found
        each = len(penalties)
        return pd.DataFrame(
            {
                "mip": np.repeat(mip[starts], each), "window_m": np.repeat(window[starts], each), "penalty": penalties * len(starts),
                "n_points": np.repeat(sizes, each), "min_size": np.repeat(least, each), "break_index": [b for of in breaks for b in of],
                "break_m": [dist[lo + np.array(b, dtype=int)].tolist() for lo, of in zip(starts, breaks) for b in of],
                "status": np.repeat(np.where(sizes >= 2 * least, "ok", "too_short"), each),
            }
        )

    rows = features.select("mip", "window_m", "pos", "dist_m", "window_pts", *columns)
    return rows.repartition("mip").sortWithinPartitions("mip", "window_m", "pos").mapInPandas(lambda batches: by_path(batches, fit, ROWS), RUNS)


def family_runs(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """runs for each family that has their window."""
    windows = plan.where("is_feasible").select("mip", "family", "window_m", "window_label").distinct()
    return windows.join(runs, ["mip", "window_m"])


def run_breaks(runs: DataFrame) -> DataFrame:
    """A row for each break of each run."""
    return runs.select("mip", "family", "window_m", "window_label", "penalty", F.explode("break_m").alias("break_m"))


#: Columns of a table function's rows that are no features.
KEYS = ("mip", "window_m", "pos", "dist_m", "window_pts")


def table_function(penalties: Sequence[float], jump: int = 1, min_size: int | None = None):
    """A Python table function for SQL: change_points(TABLE(rows) PARTITION BY mip, window_m ORDER BY pos).

    Rows have mip, window_m, dist_m and window_pts, and features in all other columns but pos,
    standardised and without missing values. It gives the rows of sweep().
    """
    wanted = [float(p) for p in penalties]

    class ChangePoints:
        def __init__(self):
            self.held: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            self.held.append(rows)
            return iter(())

        def terminate(self) -> Iterator[pa.RecordBatch]:
            if not self.held:
                return
            column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in self.held])
            first, dist = self.held[0], column("dist_m")
            x = np.stack([column(c).astype(float) for c in first.schema.names if c not in KEYS], axis=1)
            n, least = len(x), max(1, int(min_size if min_size is not None else first.column("window_pts")[0].as_py()))
            found = solve(x, wanted, least, jump)
            each = lambda value, kind: pa.array([value] * len(wanted), kind)
            yield pa.RecordBatch.from_arrays([
                each(first.column("mip")[0].as_py(), pa.int64()), each(first.column("window_m")[0].as_py(), pa.float64()), pa.array(wanted, pa.float64()), each(n, pa.int32()), each(least, pa.int32()),
                pa.array(found, pa.list_(pa.int32())), pa.array([[float(dist[b]) for b in breaks] for breaks in found], pa.list_(pa.float64())), each("ok" if n >= 2 * least else "too_short", pa.string()),
            ], names=[c.split()[0] for c in RUNS.split(", ")])

    return F.arrow_udtf(ChangePoints, returnType=RUNS).asDeterministic()


def register(spark, name: str = "change_points", penalties: Sequence[float] = (2.5, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0), jump: int = 1, min_size: int | None = None) -> None:
    """Let SQL call table_function() by a name."""
    spark.udtf.register(name, table_function(penalties, jump, min_size))
