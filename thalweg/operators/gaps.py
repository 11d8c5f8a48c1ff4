"""Ends of line parts: what each touches, which are the outer ones, and small gaps closed."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

from .geometry import along
from .noding import places

ENDS = (
    "part int, end string, x double, y double, next_x double, next_y double, step_m double, tolerance_m double, status string, "
    "reasons array<string>, nearest_part int, nearest_m double, moved_to_x double, moved_to_y double"
)
#: Nearest parts are looked for in rows of cells up to this many before all segments are tried.
ROWS = 64
#: Pairs of points, or of a path's ends and segments, up to which all are compared at once in place of a look at cells.
ALL_PAIRS = 1 << 14


class SegmentGrid:
    """Segments of parts by the cells of a grid that their boxes touch."""

    def __init__(self, parts: list[np.ndarray]):
        self.a, self.b = np.vstack([p[:-1] for p in parts]), np.vstack([p[1:] for p in parts])
        self.part = np.repeat(np.arange(len(parts)), [len(p) - 1 for p in parts])
        far = [along(p) for p in parts]
        self.start = np.concatenate([s[:-1] for s in far])
        self.total = np.array([s[-1] for s in far])
        self.r = self.b - self.a
        self.size = np.hypot(*self.r.T)
        self.square = np.maximum(self.size**2, 1e-300)
        self.few = 2 * len(parts) * len(self.part) <= ALL_PAIRS
        if not self.few:
            self._deal()

    def _deal(self) -> None:
        """Deal the segments to cells."""
        lo, hi = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        self.origin = lo.min(axis=0)
        self.extent = float((hi.max(axis=0) - self.origin).max())
        self.cell = max(float(np.quantile(self.size, 0.9)), self.extent / 4096, 1e-9)
        first, last = self._cells(lo), self._cells(hi)
        self.width = int(last[:, 1].max()) + 2
        span = last - first + 1
        n = span.prod(axis=1)
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        key = (first[which, 0] + inside // span[which, 1]) * self.width + first[which, 1] + inside % span[which, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.entries = key[order], which[order]

    def _cells(self, p: np.ndarray) -> np.ndarray:
        return np.floor((p - self.origin) / self.cell).astype(np.int64)

    def within(self, p: np.ndarray, radius: float, but: int) -> np.ndarray:
        """Segments of other parts that may be as near as the radius."""
        if self.few:
            return np.flatnonzero(self.part != but)
        x0, y0 = np.maximum(self._cells(p - radius), 0)
        x1, y1 = self._cells(p + radius)
        if x1 < 0 or y1 < 0:
            return self.entries[:0]
        if x1 - x0 > ROWS:
            found = np.arange(len(self.part))
        else:
            rows = np.arange(x0, x1 + 1) * self.width
            lo, hi = np.searchsorted(self.keys, rows + y0), np.searchsorted(self.keys, rows + min(y1, self.width - 1), side="right")
            found = np.unique(np.concatenate([self.entries[s:t] for s, t in zip(lo, hi)]))
        return found[self.part[found] != but]

    def distances(self, p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of a point to segments, and how far along their parts the nearest points are."""
        t = np.clip(((p - self.a[which]) * self.r[which]).sum(axis=1) / self.square[which], 0, 1)
        return np.hypot(*(self.a[which] + t[:, None] * self.r[which] - p).T), self.start[which] + t * self.size[which]

    def all_distances(self, points: np.ndarray, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """distances() of points to all segments, a row for each point; infinite to the part in `but`."""
        x, y = points[:, :1], points[:, 1:]
        (ax, ay), (rx, ry) = self.a.T, self.r.T
        t = ((x - ax) * rx + (y - ay) * ry) / self.square
        t = np.minimum(np.maximum(t, 0), 1)
        d = np.hypot(ax + t * rx - x, ay + t * ry - y)
        d[np.asarray(but)[:, None] == self.part] = np.inf
        return d, self.start + t * self.size

    def touched(self, points: np.ndarray, radius: float, but: np.ndarray) -> np.ndarray:
        """Whether a part other than that in `but` is within the radius of each point."""
        if self.few:
            return self.all_distances(points, but)[0].min(axis=1) <= radius
        out = np.zeros(len(points), dtype=bool)
        for k, (p, part) in enumerate(zip(points, but)):
            which = self.within(p, radius, part)
            out[k] = len(which) and self.distances(p, which)[0].min() <= radius
        return out

    def all_nearest(self, points: np.ndarray, but: np.ndarray) -> list[tuple[float, int]]:
        """nearest() for many points."""
        if not self.few:
            return [self.nearest(p, int(part)) for p, part in zip(points, but)]
        d, _ = self.all_distances(points, but)
        least = d.min(axis=1)
        part = np.where(d <= least[:, None], self.part, len(self.total)).min(axis=1)
        return [(x, k) if x < np.inf else (np.inf, -1) for x, k in zip(least.tolist(), part.tolist())]

    def nearest(self, p: np.ndarray, but: int) -> tuple[float, int]:
        """The nearest other part: its distance and number; of equal ones the first."""
        if self.few:
            return self.all_nearest(p[None], np.array([but]))[0]
        radius = self.cell
        while True:
            which = self.within(p, radius, but)
            if len(which):
                d, _ = self.distances(p, which)
                if d.min() <= radius:
                    k = which[d <= d.min()]
                    return float(d.min()), int(self.part[k].min())
            if radius > 2 * self.extent + float(np.abs(p - self.origin).max()):
                return np.inf, -1
            radius *= 4


def end_records(parts: list[np.ndarray], tolerance: float = 5.0, adaptive: bool = False, margin: float = 0.10, least: float = 10.0, most: float | None = None) -> list[dict]:
    """Both ends of every part. adaptive: the tolerance follows the length of an end's last segment."""
    out = []
    for part, p in enumerate(parts):
        for end, at, inner in (("start", p[0].copy(), p[1].copy()), ("end", p[-1].copy(), p[-2].copy())):
            step = float(np.hypot(*(at - inner)))
            allowed = max(least, min(tolerance if most is None else most, step * (1 + margin))) if adaptive else tolerance
            out.append({"part": part, "end": end, "at": at, "next": inner, "step_m": step, "tolerance_m": float(allowed), "status": "unresolved", "reasons": set(), "moved_to": None})
    return out


def _near(points: np.ndarray, others: np.ndarray, radius: float):
    """(k, those of others within radius of points[k]), by cells of the radius if there are many."""
    if len(points) * len(others) <= ALL_PAIRS:
        gap = others[None, :, :] - points[:, None, :]
        near = np.hypot(gap[:, :, 0], gap[:, :, 1]) <= radius
        yield from ((k, np.flatnonzero(near[k]).tolist()) for k in range(len(points)))
        return
    cell = max(radius, 1e-9)
    held = defaultdict(list)
    for n, c in enumerate(np.floor(others / cell).astype(np.int64).tolist()):
        held[c[0], c[1]].append(n)
    for k, (p, c) in enumerate(zip(points, np.floor(points / cell).astype(np.int64).tolist())):
        found = [n for x in (-1, 0, 1) for y in (-1, 0, 1) for n in held.get((c[0] + x, c[1] + y), ())]
        yield k, [n for n in found if np.hypot(*(others[n] - p)) <= radius]


def protect(records: list[dict], grid: SegmentGrid, connected: float, stump: float) -> None:
    """Note why an end must stay: it touches another part, or its last segment repeats one."""
    at, inner = np.array([r["at"] for r in records]), np.array([r["next"] for r in records])
    for k, near in _near(at, at, connected):
        if any(records[n]["part"] != records[k]["part"] for n in near):
            records[k]["reasons"].add("connected_endpoint")
    for k, near in _near(inner, at, stump):
        for n in near:
            if records[n]["part"] != records[k]["part"]:
                records[k]["reasons"].add("stump_candidate")
                records[n]["reasons"].add("stump_target")
    own = np.array([r["part"] for r in records])
    for points, radius, reason in ((at, connected, "connected_to_line"), (inner, stump, "stump_candidate_line")):
        for k in np.flatnonzero(grid.touched(points, radius, own)):
            records[k]["reasons"].add(reason)
    for r in records:
        if r["reasons"]:
            r["status"] = "protected"


def _farthest(records: list[dict]) -> list[dict]:
    """The two records that are furthest apart as the crow flies; of equal pairs the first."""
    if len(records) < 2:
        return records[:1]
    p = np.array([r["at"] for r in records])
    best = (-1.0, 0, 0)
    for k in range(len(p) - 1):
        d = np.hypot(*(p[k + 1 :] - p[k]).T)
        if d.max() > best[0]:
            best = (float(d.max()), k, k + 1 + int(d.argmax()))
    return [records[best[1]], records[best[2]]]


def by_points(loose: list[dict], points, within: float) -> list[dict]:
    """The loose ends nearest to given points, each within a distance."""
    out: list[dict] = []
    for p in points[:2]:
        near = [(float(np.hypot(*(r["at"] - p))), k) for k, r in enumerate(loose) if not any(r is x for x in out)]
        if near and min(near)[0] <= within:
            out.append(loose[min(near)[1]])
    return out


def by_graph(parts: list[np.ndarray], records: list[dict], loose: list[dict], tolerance: float) -> list[dict]:
    """Of loose ends that no other end meets: the two furthest apart along the parts, or as the crow flies if parts are not connected."""
    if len(loose) < 2:
        return []
    node, _ = places(np.array([r["at"] for r in records]), tolerance)
    of = {(r["part"], r["end"]): int(n) for r, n in zip(records, node)}
    links = defaultdict(list)
    for k, p in enumerate(parts):
        a, b = of[k, "start"], of[k, "end"]
        if a != b:
            length = float(along(p)[-1])
            links[a].append((b, length))
            links[b].append((a, length))
    dead: dict[int, dict] = {}
    for r in loose:
        n = of[r["part"], r["end"]]
        if len(links[n]) == 1:
            dead.setdefault(n, r)
    if len(dead) < 2:
        return []
    nodes = list(dead)
    reached = shortest(links, nodes[0])
    if any(n not in reached for n in nodes):
        return _farthest(list(dead.values()))
    a, b, _ = longest_way(links, nodes)
    return [dead[a], dead[b]]


def shortest(links: dict, source) -> dict:
    """The distance of every node that source is connected with. links: (node, length, ...) by node."""
    far, todo = {source: 0.0}, [(0.0, source)]
    while todo:
        d, u = heapq.heappop(todo)
        if d > far[u]:
            continue
        for v, w, *_ in links[u]:
            if d + w < far.get(v, np.inf):
                far[v] = d + w
                heapq.heappush(todo, (d + w, v))
    return far


def longest_way(links: dict, nodes: list) -> tuple:
    """The two of nodes that are connected and furthest apart along the links, and how far; of equal pairs the first."""
    best = (None, None, -1.0)
    rank = {n: k for k, n in enumerate(nodes)}
    done: set = set()
    for n in nodes:
        if n in done:
            continue
        far = shortest(links, n)
        mine = [m for m in nodes if m in far]
        done.update(mine)
        tree = sum(len(links[m]) for m in far) // 2 == len(far) - 1
        # In a tree what is furthest from any node is an end of the longest way.
        starts = [max(mine, key=lambda m: (far[m], -rank[m]))] if tree else mine
        for a in starts:
            reach = shortest(links, a)
            for b in mine:
                if a != b and reach[b] > best[2]:
                    best = (*sorted((a, b), key=rank.get), reach[b])
    return best


def outer_ends(parts: list[np.ndarray], records: list[dict], points=(), tolerance: float = 1e-6, within: float = 1e-5) -> tuple[list[dict], str]:
    """The two ends that the whole line should have, and how they were found: by points, by the graph of parts, then the furthest pair."""
    loose = [r for r in records if r["status"] == "unresolved"]
    if len(parts) < 2 or not loose:
        return [], "none"
    found = by_points(loose, points, within)
    asked = bool(found)
    if len(found) == 2:
        return found, "points"
    rest = [r for r in loose if not any(r is x for x in found)] or loose
    for how, more in (("graph", by_graph(parts, records, rest, tolerance)), ("farthest", _farthest(rest))):
        found = found + [r for r in more if not any(r is x for x in found)]
        if len(found) >= 2:
            return found[:2], f"points+{how}" if asked else how
    return found[:2], "points" if asked else "farthest"


def snap_gaps(parts: list[np.ndarray], gap: float = 5.0, connected: float = 1e-6, stump: float = 1e-6, points=(), to_lines: bool = True) -> tuple[list[np.ndarray], list[dict], str]:
    """Parts with gaps of up to `gap` metres closed, the records of their ends, and how the outer ends were found.

    Ends that touch another part, or look like a stump of one, stay, and so do the two outer
    ends while pairs are made. Of the others mutual nearest ends of different parts meet
    halfway, unless another part passes one of them more closely; then ends that are left
    move onto the inside of the nearest part. A part is met by another one once at most.
    """
    parts = [p.copy() for p in parts]
    records = end_records(parts, gap)
    if len(parts) < 2:
        return parts, records, "none"
    grid = SegmentGrid(parts)
    protect(records, grid, connected, stump)
    outer, how = outer_ends(parts, records, points, tolerance=connected, within=max(10 * connected, 1e-6))
    for r in outer:
        r["status"] = "outer"
    free = [r for r in records if r["status"] == "unresolved"]

    def set_end(r: dict, p: np.ndarray, status: str) -> None:
        parts[r["part"]][0 if r["end"] == "start" else -1] = p
        r["status"], r["moved_to"] = status, p

    at = np.array([r["at"] for r in free]).reshape(-1, 2)
    nearest = {}
    for k, near in _near(at, at, gap):
        others = [(float(np.hypot(*(at[k] - at[n]))), n) for n in near if free[n]["part"] != free[k]["part"]]
        if others:
            nearest[k] = min(others)
    passing = dict(zip(nearest, _all_inside(grid, [free[k] for k in nearest], gap, connected)))
    pairs = sorted((d, k, n) for k, (d, n) in nearest.items() if k < n and nearest.get(n, (0, -1))[1] == k)
    for d, k, n in pairs:
        if (passing[k] or (np.inf,))[0] >= d and (passing[n] or (np.inf,))[0] >= d:
            middle = (at[k] + at[n]) / 2
            set_end(free[k], middle, "snapped_to_end")
            set_end(free[n], middle, "snapped_to_end")
    if to_lines:
        if any(r["moved_to"] is not None for r in records):
            grid = SegmentGrid(parts)
        left = [r for r in records if r["status"] in ("unresolved", "outer")]
        found = [(best[0], r["part"], r["end"], best, r) for r, best in zip(left, _all_inside(grid, left, gap, stump, connected)) if best]
        met = set()
        added: dict[int, list[tuple[float, np.ndarray]]] = defaultdict(list)
        for _, part, _, (d, target, far, p), r in sorted(found, key=lambda f: f[:3]):
            if (part, target) not in met:
                met.add((part, target))
                added[target].append((far, p))
                set_end(r, p, "snapped_to_line")
        for target, cuts in added.items():
            line, s = parts[target], along(parts[target])
            cuts = [(far, p) for far, p in sorted(cuts, key=lambda c: c[0]) if np.abs(s - far).min() > stump]
            # Measured on the line before its own ends moved; these are no further than the gap.
            parts[target] = np.insert(line, np.searchsorted(s, [far for far, _ in cuts]), np.array([p for _, p in cuts]).reshape(-1, 2), axis=0)
    return parts, records, how


def _all_inside(grid: SegmentGrid, records: list[dict], gap: float, edge: float, apart: float = -1.0) -> list:
    """_inside() for many ends."""
    if not records or not grid.few:
        return [_inside(grid, r, grid.within(r["at"], gap, r["part"]), gap, edge, apart) for r in records]
    d, far = grid.all_distances(np.array([r["at"] for r in records]), np.array([r["part"] for r in records]))
    return [_inside(grid, r, which, gap, edge, apart, (d[k, which], far[k, which])) for k, r in enumerate(records) for which in [np.flatnonzero(d[k] <= gap)]]


def _inside(grid: SegmentGrid, r: dict, which: np.ndarray, gap: float, edge: float, apart: float = -1.0, known: tuple | None = None):
    """(distance, part, how far along, point) of the nearest other part with its inside within the gap of an end, if there is one.

    which: segments that may be as near; known: their distances(), if these were taken.
    """
    if not len(which):
        return None
    d, far = known or grid.distances(r["at"], which)
    best = None
    for target in np.unique(grid.part[which]):
        own = np.flatnonzero(grid.part[which] == target)
        k = own[int(np.argmin(d[own]))]
        if apart < d[k] <= gap and edge < far[k] < grid.total[target] - edge and (best is None or d[k] < best[0]):
            s = which[k]
            best = (float(d[k]), int(target), float(far[k]), grid.a[s] + (far[k] - grid.start[s]) / max(grid.size[s], 1e-300) * grid.r[s])
    return best


def end_rows(parts: list[np.ndarray], records: list[dict]) -> list[tuple]:
    """Rows of ENDS, with the nearest other part of each end before anything moved."""
    near = [(np.inf, -1)] * len(records)
    if len(parts) > 1:
        near = SegmentGrid(parts).all_nearest(np.array([r["at"] for r in records]), np.array([r["part"] for r in records]))
    out = []
    for r, (d, part) in zip(records, near):
        to = r["moved_to"] if r["moved_to"] is not None else (None, None)
        out.append((
            r["part"], r["end"], *map(float, r["at"]), *map(float, r["next"]), r["step_m"], r["tolerance_m"], r["status"], sorted(r["reasons"]),
            part if part >= 0 else None, d if part >= 0 else None, *[None if v is None else float(v) for v in to],
        ))
    return out
