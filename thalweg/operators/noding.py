"""Lines cut wherever they meet: crossings, touching ends and stretches that lie on each other.

Straight lines along an axis that lie on each other are first made one, with cuts where they
ended. A sweep over the boxes of segments finds the pairs that can meet, and numpy tests them
many at once. Pieces between the cuts are edges of a network whose nodes are places; a stretch
that several lines share is one edge.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .geometry import along

#: Pairs that are tested at once.
PAIRS = 1 << 18
#: Segments whose directions differ by a smaller sine do not cross in a point.
PARALLEL = 1e-12
#: Lines made one stay so where all others cross them by at least this sine.
STEEP = 0.5
#: Points of small paths that are noded at once.
POINTS = 1 << 15


@dataclass
class Network:
    """Pieces as edges between nodes: ends[k] are the nodes of pieces[k], points the nodes' places, path the paths they are of if there are several."""

    pieces: list[np.ndarray]
    ends: np.ndarray
    points: np.ndarray
    path: np.ndarray | None = None

    def components(self) -> list[int]:
        """The smallest node that each node is connected with."""
        root = np.arange(len(self.points))
        while len(self.ends):
            a, b = root[self.ends].T
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        return root.tolist()

    def cycle_rank(self) -> int:
        """Independent cycles: edges less nodes plus components."""
        return len(self.pieces) - len(self.points) + len(set(self.components()))

    def lengths(self) -> np.ndarray:
        """The length of each piece."""
        if not self.pieces:
            return np.zeros(0)
        xy = np.concatenate(self.pieces)
        step = np.hypot(*(xy[1:] - xy[:-1]).T)
        stop = np.cumsum([len(p) for p in self.pieces])
        step[stop[:-1] - 1] = 0.0  # from the end of a piece to the next one's start
        return np.add.reduceat(step, np.append(0, stop[:-1]))

    def length(self) -> float:
        return float(self.lengths().sum())


def box_pairs(a: np.ndarray, b: np.ndarray, pad: float, path: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of segments a[k] to b[k], of one path each, whose boxes, each wider by pad, overlap."""
    low, high = np.minimum(a, b) - pad, np.maximum(a, b) + pad
    path = np.zeros(len(a), dtype=np.int64) if path is None else path
    sweeps = []
    for axis in (0, 1):
        values, rank = np.unique(np.concatenate([low[:, axis], high[:, axis]]), return_inverse=True)
        first, last = path * len(values) + rank[: len(a)], path * len(values) + rank[len(a) :]
        order = np.argsort(first, kind="stable")
        partners = np.searchsorted(first[order], last[order], side="right") - np.arange(len(order)) - 1
        sweeps.append((order, partners, np.bincount(path[order], weights=partners, minlength=1)))
    along_x = sweeps[0][2] <= sweeps[1][2]  # of each path the axis along which fewer boxes are open at a time
    for axis, (order, partners, _) in enumerate(sweeps):
        partners = np.where(along_x[path[order]] == (axis == 0), partners, 0)
        lo, hi = low[order], high[order]
        ends = np.cumsum(partners)
        at = 0
        while at < len(order) and ends[-1] > (ends[at - 1] if at else 0):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n = partners[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            other = 1 - axis
            meet = (lo[j, other] <= hi[i, other]) & (hi[j, other] >= lo[i, other])
            if meet.any():
                yield order[i[meet]], order[j[meet]]
            at = stop


def _united(a: np.ndarray, b: np.ndarray, may: np.ndarray, tolerance: float, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments along an axis, of those that may, that lie on each other as one: for each segment the
    number of the one that it is part of or -1, starts and ends of these, and (number, place along it) of their cuts."""
    which = np.flatnonzero(may & ((a == b).sum(axis=1) == 1) & np.isfinite(a + b).all(axis=1))
    axis = (a[which, 0] == b[which, 0]).astype(np.int64)
    p, q, level = a[which, axis], b[which, axis], a[which, 1 - axis]
    lo, hi = np.minimum(p, q), np.maximum(p, q)
    order = np.lexsort((lo, level, axis, path[which]))
    which, axis, level, lo, hi = which[order], axis[order], level[order], lo[order], hi[order]
    of = np.full(len(a), -1)
    none = of, np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0, dtype=np.int64), np.zeros(0)
    if len(which) < 2:
        return none
    other = np.append(True, (np.diff(axis) != 0) | (np.diff(level) != 0) | (np.diff(path[which]) != 0))
    values, rank = np.unique(hi, return_inverse=True)
    base = (np.cumsum(other) - 1) * len(values)
    reach = values[np.maximum.accumulate(base + rank) - base]  # the furthest that lines of the level went so far
    island = np.cumsum(other | np.append(True, lo[1:] > reach[:-1])) - 1
    # Ends that are nearly one place are left to the tests of pairs.
    n, e = np.tile(island, 2), np.concatenate([lo, hi])
    order = np.lexsort((e, n))
    n, e = n[order], e[order]
    fresh = np.append(True, (np.diff(n) != 0) | (np.diff(e) != 0))
    n, e = n[fresh], e[fresh]
    united = np.bincount(island) > 1
    united[n[1:][(np.diff(n) == 0) & (np.diff(e) <= 8 * tolerance)]] = False
    if not united.any():
        return none
    number = np.where(united, np.cumsum(united) - 1, -1)
    of[which] = number[island]
    first = np.flatnonzero(np.append(True, np.diff(island) != 0))
    last = np.append(first[1:], len(island)) - 1
    ends = []
    for along_axis in (lo[first], reach[last]):
        at = np.stack([along_axis, level[first]], axis=1)
        at[axis[first] == 1] = at[axis[first] == 1, ::-1]
        ends.append(at[united])
    held = united[n]
    return of, *ends, number[n[held]], e[held] - lo[first][n[held]]


def _cuts(a: np.ndarray, b: np.ndarray, part: np.ndarray, rank: np.ndarray, tolerance: float, united: int, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, share of its length) of every cut, and those of the last segments, which were united, that others run along or cross at a flat angle."""
    r = b - a
    size = np.hypot(*r.T)
    segments, shares, along_others = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
    own = len(a) - united

    def cut(which: np.ndarray, at: np.ndarray) -> None:
        segments.append(which)
        shares.append(at)

    for i, j in box_pairs(a, b, tolerance, path):
        cross = r[i, 0] * r[j, 1] - r[i, 1] * r[j, 0]
        d = a[j] - a[i]
        slanted = np.abs(cross) > PARALLEL * size[i] * size[j]
        if united:
            flat = ~(np.abs(cross) >= STEEP * size[i] * size[j])
            along_others += [s[flat & (s >= own)] for s in (i, j)]
        safe = np.where(slanted, cross, 1.0)
        u = (d[:, 0] * r[j, 1] - d[:, 1] * r[j, 0]) / safe
        v = (d[:, 0] * r[i, 1] - d[:, 1] * r[i, 0]) / safe
        same = part[i] == part[j]
        i_first, j_first = same & (rank[j] - rank[i] == 1), same & (rank[i] - rank[j] == 1)
        crossing = slanted & (u > 0) & (u < 1) & (v > 0) & (v < 1) & ~(i_first | j_first)
        cut(i[crossing], u[crossing])
        cut(j[crossing], v[crossing])
        # Ends that lie on the other segment cut both; neighbours in a line always meet in their vertex.
        back = np.zeros(len(i), dtype=bool)
        for s, t, end, shared in ((i, j, 0, j_first), (i, j, 1, i_first), (j, i, 0, i_first), (j, i, 1, j_first)):
            p = (b if end else a)[s]
            at = np.clip(((p - a[t]) * r[t]).sum(axis=1) / size[t] ** 2, 0, 1)
            on = (np.hypot(*(a[t] + at[:, None] * r[t] - p).T) <= tolerance) & ~shared
            cut(t[on], at[on])
            cut(s[on], np.full(int(on.sum()), float(end)))
            back |= on & (i_first | j_first)
        # A line that turns back on itself is cut where it turns, too.
        for s, end, turn in ((i, 1.0, back & i_first), (j, 0.0, back & i_first), (i, 0.0, back & j_first), (j, 1.0, back & j_first)):
            cut(s[turn], np.full(int(turn.sum()), end))
    return np.concatenate(segments), np.concatenate(shares), np.unique(np.concatenate(along_others))


def places(points: np.ndarray, tolerance: float, path: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each point, the same for points of one place and path, and the places."""
    cell = max(2 * tolerance, 1e-9)
    if not len(points):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 2))
    path = np.zeros(len(points), dtype=np.int64) if path is None else path
    order = np.lexsort((points[:, 1], points[:, 0], path))
    fresh = np.append(True, (points[order[1:]] != points[order[:-1]]).any(axis=1) | (np.diff(path[order]) != 0))
    firsts = order[fresh]  # of equal points the first
    by_first = np.argsort(firsts)
    which = np.zeros(len(points), dtype=np.int64)
    which[order] = np.argsort(by_first)[np.cumsum(fresh) - 1]
    p, path = points[firsts[by_first]], path[firsts[by_first]]
    # Clumps of points: those of different clumps are not near each other.
    order = np.lexsort((p[:, 0], path))
    run = np.zeros(len(p), dtype=np.int64)
    run[order] = np.cumsum(np.append(True, ~(np.diff(p[order, 0]) <= cell) | (np.diff(path[order]) != 0)))
    order = np.lexsort((p[:, 1], run))
    clump = np.zeros(len(p), dtype=np.int64)
    clump[order] = np.cumsum(np.append(True, (np.diff(run[order]) != 0) | ~(np.diff(p[order, 1]) <= cell))) - 1
    first = np.full(clump.max() + 1, len(p))
    np.minimum.at(first, clump, np.arange(len(p)))
    owner = first[clump]
    off = np.hypot(*(p - p[owner]).T) > cell
    if off.any():  # clumps that are not all near their first point, one point after the other
        known: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        rest = np.flatnonzero(np.isin(clump, clump[off]))
        for k, of, at, c in zip(rest.tolist(), path[rest].tolist(), p[rest].tolist(), np.floor(p[rest] / cell).astype(np.int64).tolist()):
            near = [n for x in (-1, 0, 1) for y in (-1, 0, 1) for n in known.get((of, c[0] + x, c[1] + y), ())]
            owner[k] = min((n for n in near if np.hypot(p[n, 0] - at[0], p[n, 1] - at[1]) <= cell), default=k)
            if owner[k] == k:
                known[of, c[0], c[1]].append(k)
    kept, out = np.unique(owner, return_inverse=True)
    return out[which], p[kept]


def advances(p: np.ndarray, tolerance: float = 1e-6) -> bool:
    """Whether a line goes on along an axis with every step, by so much that it can't meet itself.

    Such a line is one piece of its own network. Others may be, too.
    """
    if len(p) < 2:
        return False
    v = p[1:] - p[:-1]
    least, most = v.min(axis=0), v.max(axis=0)
    return bool((np.maximum(least, -most) > max(8 * tolerance, 1e-8)).any())


def node_lines(parts: list[np.ndarray], tolerance: float = 1e-6) -> Network:
    """The network of all parts, cut where they meet each other or themselves."""
    return node_points(np.concatenate([np.zeros((0, 2)), *parts]), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), tolerance)


def node_points(xy: np.ndarray, part: np.ndarray, tolerance: float = 1e-6, path: np.ndarray | None = None) -> Network:
    """node_lines() of parts that stand behind each other, with the number of each point's part; only parts of one path meet."""
    none = Network([], np.zeros((0, 2), dtype=np.int64), np.zeros((0, 2)), np.zeros(0, dtype=np.int64))
    path = np.zeros(len(xy), dtype=np.int64) if path is None else path
    if len(xy) < 2:
        return none
    keep = np.append(True, (xy[1:] != xy[:-1]).any(axis=1) | (part[1:] != part[:-1]))
    xy, part, path = xy[keep], part[keep], path[keep]
    step = part[1:] == part[:-1]
    if not step.any():
        return none
    a, b, path = xy[:-1][step], xy[1:][step], path[:-1][step]
    part = np.unique(part[:-1][step], return_inverse=True)[1]
    count = np.bincount(part)
    first = np.cumsum(count) - count
    rank = np.arange(len(part)) - first[part]
    of, low, high, cut_of, cut_at = _united(a, b, count[part] == 1, tolerance, path)
    while True:
        own, n = of < 0, int(of.max()) + 1
        a2, b2 = np.vstack([a[own], low]), np.vstack([b[own], high])
        part2, rank2 = np.concatenate([part[own], len(count) + np.arange(n)]), np.concatenate([rank[own], np.zeros(n, dtype=np.int64)])
        path2 = np.concatenate([path[own], np.zeros(n, dtype=np.int64)])
        path2[int(own.sum()) + of[~own]] = path[~own]
        segment, share, mixed = _cuts(a2, b2, part2, rank2, tolerance, n, path2)
        if not len(mixed):
            break
        # Others lie on these, so that their inner ends cut others too: they go in as they were.
        stays = np.ones(n, dtype=bool)
        stays[mixed - int(own.sum())] = False
        number = np.append(np.where(stays, np.cumsum(stays) - 1, -1), -1)
        of, low, high = number[of], low[stays], high[stays]
        cut_of, cut_at = number[cut_of[stays[cut_of]]], cut_at[stays[cut_of]]
    a, b, rank = a2, b2, rank2
    part = np.unique(part2, return_inverse=True)[1]
    count = np.bincount(part)
    first = np.cumsum(count) - count
    size = np.hypot(*(b - a).T)
    several = np.flatnonzero(count > 1).tolist()
    start, whole = np.zeros(len(a)), size[first]
    s = {k: np.append(0.0, np.cumsum(size[first[k] : first[k] + count[k]])) for k in several}
    for k in several:
        start[first[k] : first[k] + count[k]], whole[k] = s[k][:-1], s[k][-1]
    # Each part's start, cuts and end in order, without those beside the one before.
    every = np.arange(len(count))
    owner = np.concatenate([every, part[segment], len(count) - n + cut_of, every])
    far = np.concatenate([np.zeros(len(count)), start[segment] + share * size[segment], cut_at, whole])
    kind = np.repeat([0, 1, 2], [len(count), len(segment) + len(cut_of), len(count)])
    order = np.lexsort((far, kind, owner))
    owner, far = owner[order], far[order]
    keep = np.append(True, (np.diff(owner) != 0) | (np.diff(far) > tolerance))
    owner, far = owner[keep], far[keep]
    last = np.append(owner[1:] != owner[:-1], True)
    beside = last & np.append(False, owner[1:] == owner[:-1])
    far[beside] = np.where(whole[owner[beside]] > far[beside], whole[owner[beside]], far[beside])  # a cut beside the end is the end
    # Where the cuts are, and the vertices between them.
    ratio = far / whole[owner]
    at = a[first[owner]] + (b - a)[first[owner]] * ratio[:, None]
    at = np.where((far >= whole[owner])[:, None], b[first[owner]], np.where((far <= 0)[:, None], a[first[owner]], at))
    k = np.flatnonzero(~last)
    inner: dict[int, np.ndarray] = {}
    where = np.searchsorted(owner, several), np.searchsorted(owner, several, side="right")
    for m, i, j in zip(several, *(w.tolist() for w in where)):
        p = np.vstack([a[first[m] : first[m] + 1], b[first[m] : first[m] + count[m]]])
        at[i:j] = np.stack([np.interp(far[i:j], s[m], p[:, 0]), np.interp(far[i:j], s[m], p[:, 1])], axis=1)
        lo, hi = np.searchsorted(s[m], far[i : j - 1] + tolerance, side="right").tolist(), np.searchsorted(s[m], far[i + 1 : j] - tolerance).tolist()
        piece = int(np.searchsorted(k, i))
        inner |= {piece + x: p[lo[x] : hi[x]] for x in range(j - i - 1) if hi[x] > lo[x]}
    if not len(k):
        return none
    path = path2[first[owner[k]]]
    where, points = places(np.stack([at[k], at[k + 1]], axis=1).reshape(-1, 2), tolerance, np.repeat(path, 2))
    ends = where.reshape(-1, 2)
    of_place = np.zeros(len(points), dtype=np.int64)
    of_place[ends[:, 0]] = of_place[ends[:, 1]] = path
    bent = np.zeros(len(k), dtype=bool)
    bent[list(inner)] = True
    # Straight pieces without length go, and of a stretch that several have all but the first.
    straight = np.flatnonzero(~bent & (ends[:, 0] != ends[:, 1]))
    pair = np.sort(ends[straight], axis=1)
    kept = np.sort(np.concatenate([straight[np.unique(pair[:, 0] * len(points) + pair[:, 1], return_index=True)[1]], np.flatnonzero(bent)]))
    ends = ends[kept]
    pieces = list(points[ends])
    for m in np.flatnonzero(bent[kept]).tolist():
        pieces[m] = np.vstack([pieces[m][:1], inner[int(kept[m])], pieces[m][1:]])
    used, ends = np.unique(ends, return_inverse=True)
    return Network(pieces, ends.reshape(-1, 2), points[used], of_place[used])


def figures(xy: np.ndarray, part: np.ndarray, path: np.ndarray, paths: int, tolerance: float = 1e-6) -> list[np.ndarray]:
    """Nodes, edges, components, cycle rank, dead ends and length of the network of each of the paths, whose points stand behind each other."""
    net = node_points(xy, part, tolerance, path)
    of = net.path[net.ends[:, 0]]
    nodes, edges = np.bincount(net.path, minlength=paths), np.bincount(of, minlength=paths)
    whole = np.bincount(net.path[np.unique(np.array(net.components(), dtype=np.int64))], minlength=paths)
    dead = np.bincount(net.path[np.bincount(net.ends.reshape(-1), minlength=len(net.points)) == 1], minlength=paths)
    return [nodes, edges, whole, edges - nodes + whole, dead, np.bincount(of, weights=net.lengths(), minlength=paths)]


def end_network(parts: list[np.ndarray], tolerance: float = 1e-6) -> Network:
    """Parts as they are, between the places of their ends."""
    if not parts:
        return Network([], np.zeros((0, 2), dtype=np.int64), np.zeros((0, 2)))
    where, points = places(np.array([e for p in parts for e in (p[0], p[-1])]), tolerance)
    return Network([np.vstack([points[a], p[1:-1], points[b]]) for p, (a, b) in zip(parts, where.reshape(-1, 2).tolist())], where.reshape(-1, 2), points)


def chained(net: Network) -> list[np.ndarray]:
    """The pieces joined where exactly two ends meet: lines as long as they are without a branch."""
    meets: list[list[tuple[int, int]]] = [[] for _ in range(len(net.points))]
    for k, (x, y) in enumerate(net.ends.tolist()):
        meets[x].append((k, 0))
        meets[y].append((k, 1))
    used = [False] * len(net.pieces)

    def walk(k: int, end: int) -> np.ndarray:
        """From the end of a piece on, as far as it goes without a branch."""
        out = []
        while not used[k]:
            used[k] = True
            out.append(net.pieces[k] if end == 0 else net.pieces[k][::-1])
            n = int(net.ends[k, 1 - end])
            if len(meets[n]) != 2:
                break
            k, end = meets[n][1] if meets[n][0] == (k, 1 - end) else meets[n][0]
        return np.vstack([out[0], *[p[1:] for p in out[1:]]])

    lines = [walk(k, end) for n in range(len(meets)) if len(meets[n]) != 2 for k, end in meets[n] if not used[k]]
    return lines + [walk(k, 0) for k in range(len(net.pieces)) if not used[k]]
