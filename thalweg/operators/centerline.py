"""One line for each path out of the pieces of its reaches, and a smoother for lines."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LINE
from .gaps import ENDS, end_rows, longest_way, snap_gaps
from .geometry import along, as_points, at_distance, smooth_gaussian
from .noding import POINTS, Network, advances, chained, end_network, figures, node_lines

NODED = "main_path_id long, n_nodes long, n_edges long, n_components long, cycle_rank long, n_dead_ends long, length_m double"

MERGED = (
    f"main_path_id long, line {LINE}, n_parts int, reach_ids array<long>, input_length_m double, merged_length_m double, removed_m double, loss_fraction double, "
    "terminals string, status string, n_snapped int, n_nodes int, n_edges int, n_components int, cycle_rank int, repair string"
)
#: Bounds beyond which a line is not repaired and a network not searched.
MAX_CYCLES, MAX_VERTICES = 5, 250_000
#: Lines that are held as points at once.
LINES = 64
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    LINE: pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])),
}


def nearest_on(xy: np.ndarray, p: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Distance of a point to a line, how far along its nearest point is, and that point."""
    a, b = xy[:-1], xy[1:]
    v = b - a
    size = np.maximum((v**2).sum(axis=1), 1e-300)
    t = np.clip(((p - a) * v).sum(axis=1) / size, 0, 1)
    q = a + t[:, None] * v
    d = np.hypot(*(q - p).T)
    k = int(np.argmin(d))
    return float(d[k]), float(along(xy)[k] + t[k] * np.sqrt(size[k])), q[k]


def insert_point(xy: np.ndarray, distance: float, tolerance: float = 1e-6) -> np.ndarray:
    """The line with a vertex at a distance, unless one is there."""
    s = along(xy)
    if np.abs(s - distance).min() <= tolerance:
        return xy
    k = int(np.searchsorted(s, distance))
    return np.insert(xy, k, at_distance(xy, np.array([distance]))[0], axis=0)


class Ways:
    """Ways through a network of pieces; closed pieces are no way."""

    def __init__(self, net: Network):
        self.net = net
        self.near = defaultdict(list)
        for k, (a, b) in enumerate(net.ends.tolist()):
            if a != b:
                length = float(along(net.pieces[k])[-1])
                self.near[a].append((b, length, k, False))
                self.near[b].append((a, length, k, True))

    def path(self, source: int, sink: int) -> np.ndarray | None:
        """The shortest line between two nodes."""
        if source == sink:
            return None
        far, came, todo = {source: 0.0}, {}, [(0.0, source)]
        while todo:
            d, u = heapq.heappop(todo)
            if u == sink:
                break
            if d > far[u]:
                continue
            for v, w, k, back in self.near[u]:
                if d + w < far.get(v, np.inf):
                    far[v] = d + w
                    came[v] = (u, k, back)
                    heapq.heappush(todo, (d + w, v))
        if sink not in came:
            return None
        steps, n = [], sink
        while n != source:
            n, k, back = came[n]
            steps.append(self.net.pieces[k][::-1] if back else self.net.pieces[k])
        steps = steps[::-1]
        return np.vstack([steps[0], *[s[1:] for s in steps[1:]]])

    def nearest(self, p: np.ndarray) -> int:
        used = np.array(sorted(n for n in self.near if self.near[n]))
        return int(used[np.argmin(np.hypot(*(self.net.points[used] - p).T))])

    def longest_ends(self) -> tuple[int | None, int | None]:
        """The pair of dead ends that are furthest apart along the pieces; in networks of rings, of any nodes."""
        dead = sorted(n for n in self.near if len(self.near[n]) == 1)
        a, b, _ = longest_way(self.near, dead)
        return (a, b) if a is not None else longest_way(self.near, sorted(self.near))[:2]


def terminals(lines: list[np.ndarray], order: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Outer ends of the first and the last reach by distance to the outlet: those furthest from the other reaches."""
    ranked = sorted(range(len(lines)), key=lambda i: (order[i], i))

    def outer(i: int) -> np.ndarray:
        ends = (lines[i][0], lines[i][-1])
        others = lines[:i] + lines[i + 1 :]
        a = np.concatenate([p[:-1] for p in others])
        v = np.concatenate([p[1:] for p in others]) - a
        size = np.maximum((v**2).sum(axis=1), 1e-300)
        gaps = []
        for p in ends:
            t = np.clip(((p - a) * v).sum(axis=1) / size, 0, 1)
            gaps.append(np.hypot(*(a + t[:, None] * v - p).T).min())
        return ends[int(np.argmax(gaps))]

    if len(lines) == 1:
        return lines[0][0], lines[0][-1]
    return outer(ranked[0]), outer(ranked[-1])


def repair(line: np.ndarray, tolerance: float = 1e-6, max_cycles: int = MAX_CYCLES, max_vertices: int = MAX_VERTICES) -> tuple[np.ndarray, str, int | None]:
    """A line without its loops, a status and the line's cycle rank: the shortest way from its start to its end over itself.

    Statuses: simple, repaired; the line stays as it is with too_many_vertices (its rank is not
    known then), too_many_cycles or closed.
    """
    if len(line) > max_vertices:
        return line, "too_many_vertices", None
    if advances(line, tolerance):
        return line, "simple", 0
    net = node_lines([line], tolerance)
    rank = net.cycle_rank()
    if len(net.pieces) <= 1 and not rank:
        return line, "simple", rank
    if rank > max_cycles:
        return line, "too_many_cycles", rank
    ways = Ways(net)
    if not ways.near:
        return line, "closed", rank
    found = ways.path(ways.nearest(line[0]), ways.nearest(line[-1]))
    return (line, "closed", rank) if found is None else (found, "repaired", rank)


def merge_path(lines: list[np.ndarray], order: list[float], gap: float = 5.0, tolerance: float = 1e-6, max_cycles: int = MAX_CYCLES, max_vertices: int = MAX_VERTICES) -> dict:
    """One line along the parts between the terminals, how it was found, and what the network was like.

    Reaches are joined where two ends meet, small gaps between the parts are closed, loops of
    single parts are taken out, and of the network that the parts make where they cross, touch
    or overlap the shortest way between the two terminals is kept. Where these are not connected it is the
    longest of all ways between dead ends, and the status is other_terminals.
    """
    lines = [p for p in lines if len(p) >= 2]
    out = {"line": np.zeros((0, 2)), "terminals": "none", "status": "empty", "n_snapped": 0, "n_nodes": 0, "n_edges": 0, "n_components": 0, "cycle_rank": 0, "repair": "simple", "parts": [], "ends": []}
    if not lines:
        return out
    first, last = terminals(lines, order)
    parts = chained(end_network(lines, tolerance))
    before = parts
    parts, ends, _ = snap_gaps(parts, gap, tolerance, tolerance, points=(first, last))
    moved = [r for r in ends if r["moved_to"] is not None]
    # A terminal that moved onto another part is where it moved to.
    first, last = [next((r["moved_to"] for r in moved if (r["at"] == p).all()), p) for p in (first, last)]
    kinds = []
    for k, p in enumerate(parts):
        parts[k], kind, _ = repair(p, tolerance, max_cycles, max_vertices)
        kinds.append(kind)
    worst = next((k for k in ("too_many_vertices", "too_many_cycles", "closed", "repaired") if k in kinds), "simple")
    out |= {"line": max(parts, key=lambda p: along(p)[-1], default=lines[0]), "status": "no_path", "n_snapped": len(moved), "repair": worst, "parts": before, "ends": ends}
    if sum(map(len, parts)) > max_vertices:
        return out | {"status": "too_many_vertices"}
    net = node_lines(parts, tolerance)
    out |= {"n_nodes": len(net.points), "n_edges": len(net.pieces), "n_components": len(set(net.components())), "cycle_rank": net.cycle_rank()}
    ways = Ways(net)
    if not ways.near:
        return out | {"line": lines[0], "status": "only_closed_pieces"}
    found = ways.path(ways.nearest(first), ways.nearest(last))
    if found is not None:
        return out | {"line": found, "terminals": "reach_order", "status": "ok"}
    a, b = ways.longest_ends()
    found = None if a is None else ways.path(a, b)
    return out if found is None else out | {"line": found, "terminals": "longest_pair", "status": "other_terminals"}


def _mainstem(reaches: DataFrame) -> DataFrame:
    rows = reaches.where(F.coalesce("is_mainstem", F.lit(False)) & F.col("main_path_id").isNotNull())
    if "geometry_parts" in reaches.columns:  # a reach of several lines is as many rows
        line = F.explode_outer(F.coalesce("geometry_parts", F.array("geometry")))
        return rows.select("main_path_id", "reach_id", "dist_out", line.alias("geometry"))
    return rows.select("main_path_id", "reach_id", "dist_out", "geometry")


def _of_whole_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int]]]:
    """(rows, their paths, where each path starts, and the end) of batches whose rows ascend by path; the last path of a batch may go on in the next."""

    def join(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray, list[int]]:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = rows.column("main_path_id").to_numpy(zero_copy_only=False)
        return rows, key, [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), len(key)]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("main_path_id").to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(key, key[-1]))
        if at or (held and held[-1].column("main_path_id")[-1].as_py() != key[-1]):
            yield join([*held, batch.slice(0, at)] if at else held)
            held = []
        held.append(batch.slice(at))
    if held:
        yield join(held)


def _whole_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(path, its rows, its rows' order upstream from the outlet) of batches whose rows ascend by path."""
    for rows, key, starts in _of_whole_paths(batches):
        far = rows.column("dist_out").cast(pa.float64()).to_numpy(zero_copy_only=False)
        order = np.lexsort((pd.factorize(rows.column("reach_id").to_pandas(), sort=True, use_na_sentinel=False)[0], far, key))
        for lo, hi in zip(starts, starts[1:]):
            yield int(key[lo]), rows.slice(lo, hi - lo), order[lo:hi] - lo


def _points(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The points of all lines behind each other, and where each line starts, and the end."""
    cuts = lines.offsets.to_numpy()
    held = lines.values.slice(cuts[0], cuts[-1] - cuts[0])
    return np.stack([held.flatten()[held.type.get_field_index(c)].to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1), cuts - cuts[0]


def _path_lines(rows: pa.RecordBatch, order: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """A path's lines of two points at least, in the order, and their distances to the outlet."""
    geometry, far = rows.column("geometry"), rows.column("dist_out").to_pylist()
    points, cuts = _points(geometry)
    known = geometry.is_valid().to_numpy(zero_copy_only=False)
    lines, at = [], []
    for k in order.tolist():
        line = as_points(points[cuts[k] : cuts[k + 1]]) if known[k] else points[:0]
        if len(line) >= 2:
            lines.append(line)
            at.append(np.nan if far[k] is None else float(far[k]))
    return lines, at


def _for_paths(reaches: DataFrame, use, schema: str) -> DataFrame:
    """use(path, lines, order, rows) gives rows of the schema, as tuples, for every path. Paths are dealt to partitions and read in order, many in a batch."""
    fields = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), fields)], schema=fields)
        for n, (key, rows, order) in enumerate(_whole_paths(batches), 1):
            made += use(key, *_path_lines(rows, order), rows)
            if made and not n % LINES:
                yield table()
                made = []
        if made:
            yield table()

    return _mainstem(reaches).repartition("main_path_id").sortWithinPartitions("main_path_id").mapInArrow(run, schema)


def merge_mainpaths(reaches: DataFrame, gap: float = 5.0, tolerance: float = 1e-6, max_cycles: int = MAX_CYCLES, max_vertices: int = MAX_VERTICES) -> DataFrame:
    """MERGED lines of all paths from the geometry of their mainstem reaches, running upstream from the outlet."""
    names = [c.split()[0] for c in MERGED.replace(LINE, "LINE").split(", ")]

    def merge(key: int, lines: list[np.ndarray], order: list[float], rows: pa.RecordBatch) -> list[tuple]:
        r = merge_path(lines, order, gap, tolerance, max_cycles, max_vertices)
        before, after = sum(float(along(p)[-1]) for p in lines), float(along(r["line"])[-1]) if len(r["line"]) else 0.0
        row = r | {
            "main_path_id": key, "n_parts": len(lines), "reach_ids": sorted({int(i) for i in rows.column("reach_id").to_pylist() if i is not None}), "input_length_m": before,
            "merged_length_m": after, "removed_m": before - after, "loss_fraction": (before - after) / before if before else None, "line": [{"x": x, "y": y} for x, y in r["line"].tolist()],
        }
        return [tuple(row[c] for c in names)]

    return _for_paths(reaches, merge, MERGED)


def endpoint_diagnostics(reaches: DataFrame, gap: float = 5.0, tolerance: float = 1e-6) -> DataFrame:
    """Every end of a path's parts as merge_mainpaths() meets it: what protects it, whether it is an outer end, and where it moved."""

    def of(key: int, lines: list[np.ndarray], order: list[float], rows: pa.RecordBatch) -> list[tuple]:
        r = merge_path(lines, order, gap, tolerance)
        return [(key, *row) for row in end_rows(r["parts"], r["ends"])]

    return _for_paths(reaches, of, f"main_path_id long, {ENDS}")


def node_batches(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """NODED rows of batches of (main_path_id, line) that ascend by path."""
    fields = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in NODED.split(", ")])
    for rows, key, starts in _of_whole_paths(batches):
        points, cuts = _points(rows.column("line"))
        line, stops = np.repeat(np.arange(len(key)), np.diff(cuts)), cuts[starts]
        path = np.repeat(np.arange(len(starts) - 1), np.diff(stops))
        at = 0
        while at < len(starts) - 1:  # as many paths at once as have few points, and one at least
            to = max(at + 1, int(np.searchsorted(stops, stops[at] + POINTS, side="right")) - 1)
            held = slice(stops[at], stops[to])
            made = figures(points[held], line[held], path[held] - at, to - at, tolerance)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([key[starts[at:to]], *made], fields)], schema=fields)
            at = to


def noded(lines: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The network of each path's lines(main_path_id, line): nodes, edges, components, cycle rank, dead ends and the length without repeats."""
    rows = lines.where("main_path_id is not null").select("main_path_id", "line").repartition("main_path_id").sortWithinPartitions("main_path_id")
    return rows.mapInArrow(lambda batches: node_batches(batches, tolerance), NODED)


def mainstem_paths(reaches: DataFrame) -> DataFrame:
    """How many paths have mainstem reaches, and how many reaches these are."""
    rows = reaches.where(F.coalesce("is_mainstem", F.lit(False)) & F.col("main_path_id").isNotNull())
    return rows.agg(F.countDistinct("main_path_id").alias("n_paths"), F.countDistinct("reach_id").alias("n_reaches"))


def line_faults(merged: DataFrame, reaches: DataFrame) -> DataFrame:
    """(main_path_id, fault) of paths whose merged line is missing, empty, made up or much shorter than its parts."""
    paths = reaches.where(F.coalesce("is_mainstem", F.lit(False)) & F.col("main_path_id").isNotNull()).select("main_path_id").distinct()
    rows = paths.join(merged, "main_path_id", "left")
    fault = (
        F.when(F.col("status").isNull(), "missing_line").when(F.size("line") < 2, "empty_line").when(F.col("status") != "ok", F.col("status"))
        .when(F.col("terminals") != "reach_order", "terminals_not_by_order").when(F.col("loss_fraction") > 0.05, "length_lost")
    )
    return rows.select("main_path_id", fault.alias("fault")).where("fault is not null")


def resample(xy: np.ndarray, step: float) -> np.ndarray:
    """Equal spacing of at most a step, both ends kept."""
    total = along(xy)[-1]
    return at_distance(xy, np.linspace(0.0, total, int(np.floor(total / step)) + 2))


def turning_energy(xy: np.ndarray) -> float:
    """Sum of absolute turns over the length."""
    v = np.diff(xy, axis=0)
    v = v[(v != 0).any(axis=1)]
    if len(v) < 2:
        return 0.0
    heading = np.arctan2(v[:, 1], v[:, 0])
    turn = np.abs((np.diff(heading) + np.pi) % (2 * np.pi) - np.pi)
    return float(turn.sum() / along(xy)[-1])


#: How much wider the steps of the coarse pass are, and how near to its result only fine tests count.
COARSE, UNSURE = 4, 1.3


class Similarity:
    """Whether a line smoothed with a sigma stays within a budget of itself, on points of equal spacing."""

    def __init__(self, xy: np.ndarray, step_m: float, allowed, statistic: str):
        self.line, self.step = resample(xy, step_m), step_m
        self.allowed = np.broadcast_to(np.asarray(allowed(along(self.line)), dtype=float), len(self.line))
        self.of = {"max": np.max, "mean": np.mean, "p95": lambda x: np.quantile(x, 0.95)}[statistic]
        self.known: dict[float, bool] = {}

    def __call__(self, sigma: float) -> bool:
        if sigma not in self.known:
            away = distances(smooth_gaussian(self.line, sigma, self.step), self.line)
            self.known[sigma] = bool(self.of(away - self.allowed) <= 0)
        return self.known[sigma]


def largest_sigma(feasible, low: float, high: float, iterations: int) -> tuple[float, float]:
    """The largest feasible sigma of those tried and the smallest that is not (infinite if all are).

    Sigma is doubled from high on while it is feasible, then bisected in the logarithm.
    """
    for _ in range(9):
        if not feasible(high):
            break
        low, high = high, 2 * high
    else:
        return low, np.inf
    for _ in range(iterations):
        if high / low < 1.01:
            break
        middle = float(np.sqrt(low * high))
        low, high = (middle, high) if feasible(middle) else (low, middle)
    return low, high


def simplest_similar(xy: np.ndarray, step_m: float = 50.0, budget=None, budget_fraction: float = 0.30, width=None, statistic: str = "p95", iterations: int = 18, least_drop: float = 0.15, coarse: float = COARSE) -> dict:
    """The most smoothed line that stays within a budget of the original, if its turning falls enough.

    budget: metres at a distance along the line; by default a share of `width`, or a 400th
    of the length. A pass over points `coarse` times as far apart finds about where the
    largest sigma is; the search is then made with full spacing, but tests only sigmas near
    that, and both ends of what it finds. Should a test contradict the coarse pass, the
    search is made again with full tests, so the result is that of a search without it.
    """
    length = float(along(xy)[-1])
    if budget is not None:
        allowed = budget if callable(budget) else lambda d: budget
    elif width is not None:
        allowed = lambda d: budget_fraction * np.asarray(width(d), dtype=float)
    else:
        allowed = lambda d: length / 400
    fine = Similarity(xy, step_m, allowed, statistic)
    line = fine.line
    if not np.isfinite(fine.allowed).all():
        return {"line": line, "sigma_m": 0.0, "status": "budget_not_finite", "drop": 0.0, "n_fine": 0}
    low, high = 2 * step_m, max(length / 2, 2000.0)
    if not fine(low):
        return {"line": line, "sigma_m": 0.0, "status": "nothing_feasible", "drop": 0.0, "n_fine": 1}
    search = fine
    if coarse > 1 and length > 2 * coarse * step_m:
        rough = Similarity(xy, coarse * step_m, allowed, statistic)
        near = largest_sigma(rough, low, high, iterations)[0]
        search = lambda sigma: sigma < near if not 1 / UNSURE < sigma / near < UNSURE else fine(sigma)
    best, over = largest_sigma(search, low, high, iterations)
    if search is not fine and not (fine(best) and (over == np.inf or not fine(over))):
        best, over = largest_sigma(fine, low, high, iterations)
    smooth = smooth_gaussian(line, best, step_m)
    before = turning_energy(line)
    drop = 1 - turning_energy(smooth) / before if before > 0 else 0.0
    status = "turning_not_reduced" if drop < least_drop else "ok"
    return {"line": smooth if status == "ok" else line, "sigma_m": best, "status": status, "drop": drop, "n_fine": len(fine.known)}


def relative_groups(width: np.ndarray, length: np.ndarray, tolerance: float = 0.2, statistic: str = "mean") -> tuple[list[float], list[float]]:
    """Where groups of widths near their running mean end, by cumulative length from 0 on, and the width of each.

    A group whose mean is zero takes no further reach.
    """
    run = np.cumsum(length)
    groups, start, mean = [], 0, float(width[0])
    for i in range(1, len(width)):
        if mean != 0 and abs(width[i] - mean) / abs(mean) <= tolerance:
            mean += (width[i] - mean) / (i - start + 1)
        else:
            groups.append((start, i))
            start, mean = i, float(width[i])
    groups.append((start, len(width)))
    of = {"mean": np.mean, "median": np.median, "first": lambda x: x[0]}[statistic]
    return [0.0, *(float(run[z - 1]) for _, z in groups)], [float(of(width[a:z])) for a, z in groups]


def width_profile(breaks: list[float], widths: list[float]):
    """The width at distances: widths[k] from breaks[k] up to breaks[k + 1], and the last beyond."""
    at, w = np.asarray(breaks, dtype=float), np.asarray(widths, dtype=float)
    if len(at) != len(w) + 1 or not (np.diff(at) > 0).all():
        raise ValueError("breaks must rise and be one more than widths")
    return lambda d: w[np.clip(np.searchsorted(at[1:], np.asarray(d, dtype=float), side="right"), 0, len(w) - 1)]


#: Segments of a block whose box is compared with points before its segments are.
BLOCK = 32


def distances(line: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of each point to a line.

    Segments stand in blocks along the line. The vertex at a point's own share of the line
    gives a first bound, and only blocks whose boxes are nearer than the bound are looked into.
    """
    a, v = line[:-1], np.diff(line, axis=0)
    size = np.maximum((v**2).sum(axis=1), 1e-300)
    guess = np.minimum(np.arange(len(points)) * len(line) // max(len(points), 1), len(line) - 1)
    best = ((points - line[guess]) ** 2).sum(axis=1)
    blocks = -(-len(a) // BLOCK)
    for k in np.argsort(np.abs(np.arange(blocks) - blocks // 2), kind="stable") if blocks else ():
        lo, hi = k * BLOCK, min(len(a), (k + 1) * BLOCK)
        corners = line[lo : hi + 1]
        out = np.maximum(np.maximum(corners.min(axis=0) - points, points - corners.max(axis=0)), 0)
        some = np.flatnonzero((out**2).sum(axis=1) < best)
        if len(some):
            d = points[some, None, :] - a[None, lo:hi]
            t = np.clip((d * v[lo:hi]).sum(axis=2) / size[lo:hi], 0, 1)
            best[some] = np.minimum(best[some], ((d - t[:, :, None] * v[lo:hi]) ** 2).sum(axis=2).min(axis=1))
    return np.sqrt(best)


#: Reaches of this width in metres or less do not count for a path's budget.
LEAST_WIDTH_M = 30.0


def smooth_mainpaths(lines: DataFrame, step_m: float = 50.0, reaches: DataFrame | None = None, budget_fraction: float = 0.30, tolerance: float = 0.2) -> DataFrame:
    """Every path's line smoothed as far as it stays similar: (mip, line, sigma_m, drop, status).

    reaches(main_path_id, is_mainstem, width, dist_out, reach_len): the budget follows the widths of
    a path's mainstem reaches over LEAST_WIDTH_M, in groups of like width, upstream first. Without
    them, or for a path without such reaches, it is a 400th of the line's length.
    """
    schema = f"mip long, line {LINE}, sigma_m double, drop double, status string"
    lines = lines.where("line is not null and size(line) >= 3").select("mip", "line")
    if reaches is None:
        wide = lines.select("mip", F.array().cast("array<struct<d:double,width:double,len:double>>").alias("wide"))
    else:
        used = reaches.where(F.coalesce("is_mainstem", F.lit(False)) & (F.col("width") > LEAST_WIDTH_M))
        row = F.struct((-F.col("dist_out")).alias("d"), F.col("width").alias("width"), F.coalesce("reach_len", F.lit(0.0)).alias("len"))
        wide = used.groupBy(F.col("main_path_id").alias("mip")).agg(F.array_sort(F.collect_list(row)).alias("wide"))

    def smooth(part: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for line, rows in zip(part.column("line"), part.column("wide").to_pylist()):
            xy = np.stack([line.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
            profile = None
            rows = [r for r in (rows if rows is not None else ()) if r["len"] > 0]
            if rows:
                profile = width_profile(*relative_groups(np.array([r["width"] for r in rows]), np.array([r["len"] for r in rows]), tolerance))
            found.append(simplest_similar(as_points(xy), step_m, width=profile, budget_fraction=budget_fraction))
        x, y = (pa.array(c, from_pandas=True) for c in np.concatenate([r["line"] for r in found]).T)
        points = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(r["line"]) for r in found])).astype(np.int32), pa.StructArray.from_arrays([x, y], names=["x", "y"]))
        sigma, drop = (pa.array([r[c] for r in found], pa.float64(), from_pandas=True) for c in ("sigma_m", "drop"))
        return pa.RecordBatch.from_arrays([part.column("mip").cast(pa.int64()), points, sigma, drop, pa.array([r["status"] for r in found], pa.string())], names=["mip", "line", "sigma_m", "drop", "status"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, LINES):
                yield smooth(batch.slice(k, LINES))

    return lines.join(wide, "mip", "left").mapInArrow(run, schema)
