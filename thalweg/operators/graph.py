"""Side channels of a river network, resolved path by path.

Reaches are edges of a graph of junctions. What lies beside the main stem falls into
components; each adds channels and width to the main reaches that it runs along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the enumeration of ways over reaches in either direction, and the least extra length in metres that counts.
CUTOFF, MAX_PATHS, MIN_EXTRA_M = 200, 5000, 10.0
ENRICHMENT = "mip long, reach_id long, component int, k_max int, k_eff double, k_eff_raw double, width_extra double, l_main double, l_dominant double, l_extra double, status string"


def downstream_pairs(reaches: DataFrame) -> DataFrame:
    """(reach_id, dn_id) for every downstream id but 0 and the reach itself."""
    pairs = reaches.select("reach_id", F.explode("rch_id_dn").alias("dn_id")).where("dn_id is not null and dn_id <> 0 and dn_id <> reach_id")
    return pairs.distinct()


def line_graph(edges: DataFrame) -> DataFrame:
    """(from_reach, to_reach) for edges (u, v, reach_id) that meet at a junction."""
    a = edges.select(F.col("reach_id").alias("from_reach"), F.col("v").alias("j"))
    b = edges.select(F.col("reach_id").alias("to_reach"), F.col("u").alias("j"))
    return a.join(b, "j").where("from_reach <> to_reach").select("from_reach", "to_reach").distinct()


class DisjointSets:
    """Union-find with path halving and union by size."""

    def __init__(self):
        self.parent: dict = {}
        self.size: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        if self.size.get(a, 1) < self.size.get(b, 1):
            a, b = b, a
        self.parent[b] = a
        self.size[a] = self.size.get(a, 1) + self.size.get(b, 1)


class Network:
    """Junctions and reaches of one path. Of a repeated reach the first row counts."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.drop_duplicates("reach_id").sort_values("reach_id")
        self.reach = {int(r.reach_id): r for r in rows.itertuples()}
        sets = DisjointSets()
        for i, r in self.reach.items():
            sets.find(("U", i))
            sets.find(("D", i))
            for dn in r.rch_id_dn if r.rch_id_dn is not None else ():
                if dn and dn == dn and dn != i and int(dn) in self.reach:
                    sets.union(("D", i), ("U", int(dn)))
        members = defaultdict(set)
        for i in self.reach:
            for end in ("U", "D"):
                members[sets.find((end, i))].add(i)
        labels, used = {}, set()
        for root in sorted(members, key=lambda x: (sorted(members[x]), str(x))):
            name = base = "-".join(map(str, sorted(members[root])))
            k = 1
            while name in used:
                k += 1
                name = f"{base}#{k}"
            used.add(name)
            labels[root] = name
        self.edges = {i: (labels[sets.find(("U", i))], labels[sets.find(("D", i))]) for i in self.reach}

    def main(self, i: int) -> bool:
        return self.reach[i].is_mainstem is True or self.reach[i].is_mainstem == 1

    def length(self, i: int) -> float:
        x = self.reach[i].reach_len
        return 1.0 if x is None or x != x or x == 0 else float(x)

    def wide(self, i: int) -> float:
        x = self.reach[i].width
        return 1.0 if x is None or x != x or x == 0 else float(x)

    def out(self, ids) -> dict[str, list[tuple[str, int]]]:
        found = defaultdict(list)
        for i in sorted(ids):
            u, v = self.edges[i]
            found[u].append((v, i))
        return found

    def components(self) -> list[tuple[set[str], set[int]]]:
        """Weakly connected side components with at least two reaches of the whole network inside them."""
        side = [i for i in self.reach if not self.main(i)]
        sets = DisjointSets()
        for i in side:
            sets.union(*self.edges[i])
        nodes = defaultdict(set)
        for i in side:
            for n in self.edges[i]:
                nodes[sets.find(n)].add(n)
        of = {n: root for root, group in nodes.items() for n in group}
        inside, own = defaultdict(int), defaultdict(set)
        for u, v in self.edges.values():
            if u in of and of[u] == of.get(v):
                inside[of[u]] += 1
        for i in side:
            own[of[self.edges[i][0]]].add(i)
        return [(nodes[root], own[root]) for root in sorted(nodes, key=lambda x: min(nodes[x])) if inside[root] >= 2]

    def main_order(self) -> list[str]:
        """Junctions of the main stem from its one source to its one sink, by fewest reaches."""
        main = [i for i in self.reach if self.main(i)]
        into, out = defaultdict(int), self.out(main)
        for i in main:
            into[self.edges[i][1]] += 1
        nodes = {n for i in main for n in self.edges[i]}
        sources, sinks = [n for n in nodes if not into[n]], [n for n in nodes if not out.get(n)]
        if len(sources) != 1 or len(sinks) != 1:
            raise ValueError("the main stem has no single source and sink")
        came, todo = {sources[0]: None}, deque(sources)
        while todo:
            n = todo.popleft()
            for v, _ in out.get(n, ()):
                if v not in came:
                    came[v] = n
                    todo.append(v)
        path, n = [], sinks[0]
        while n is not None:
            path.append(n)
            n = came[n]
        return path[::-1]


def reachable(start: str, out: dict[str, list[tuple[str, int]]]) -> set[str]:
    seen, todo = {start}, [start]
    while todo:
        for v, _ in out.get(todo.pop(), ()):
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


def reverse(out: dict[str, list[tuple[str, int]]]) -> dict[str, list[tuple[str, int]]]:
    back = defaultdict(list)
    for u, ways in out.items():
        for v, i in ways:
            back[v].append((u, i))
    return back


def first_met(starts: list[str], out: dict[str, list[tuple[str, int]]]) -> dict[str, int]:
    """For each junction that some start reaches, the first of the starts that does, by its number."""
    met: dict[str, int] = {}
    for k, start in enumerate(starts):
        todo = [] if start in met else [start]
        while todo:
            n = todo.pop()
            if n not in met:
                met[n] = k
                todo.extend(v for v, _ in out.get(n, ()) if v not in met)
    return met


class Corridors:
    """The reaches between any two places of the main stem, found without another walk over the network.

    A place reaches all places after it. So what lies between two places is decided by the last
    place that a reach's upper end is reached from, and the first that its lower end reaches.
    """

    def __init__(self, net: Network, order: list[str]):
        self.at = {n: k for k, n in enumerate(order)}
        every = net.out(net.reach)
        up = {n: len(order) - 1 - k for n, k in first_met(order[::-1], every).items()}
        down = first_met(order, reverse(every))
        held = sorted((up[u], down[v], i) for i, (u, v) in net.edges.items() if u in up and v in down)
        self.straight = [x for x in held if x[0] <= x[1]]
        self.turned = [x for x in held if x[0] > x[1]]  # only where ways run in a circle
        self.main = net.out(i for i in net.reach if net.main(i))

    def between(self, source: str, sink: str) -> set[int]:
        s, t = self.at[source], self.at[sink]
        near = self.straight[bisect_left(self.straight, (s,)) : bisect_left(self.straight, (t + 1,))]
        return {i for low, high, i in [*near, *self.turned] if low >= s and high <= t}


def topological(out: dict) -> list[str]:
    """Junctions in downstream order; a cycle is an error."""
    into = defaultdict(int)
    nodes = set(out)
    for ways in out.values():
        for v, _ in ways:
            into[v] += 1
            nodes.add(v)
    todo, order = deque(sorted(n for n in nodes if not into[n])), []
    while todo:
        order.append(todo.popleft())
        for v, _ in out.get(order[-1], ()):
            into[v] -= 1
            if not into[v]:
                todo.append(v)
    if len(order) < len(nodes):
        raise ValueError("the corridor has a cycle")
    return order


def depth(out: dict, source: str, weight=lambda i: 1.0) -> dict[str, float]:
    """Longest weighted distance of each junction that is reached from the source."""
    far = {source: 0.0}
    for u in topological(out):
        for v, i in out.get(u, ()) if u in far else ():
            far[v] = max(far.get(v, 0.0), far[u] + weight(i))
    return far


def best_way(out: dict, source: str, sink: str, score) -> list[int] | None:
    """The way from source to sink with the greatest sum of scores, of equal ones that of the smaller reach ids; exact, since there is no cycle."""
    best: dict[str, tuple[float, list[int]]] = {sink: (0.0, [])}
    for u in reversed(topological(out)):
        for v, i in out.get(u, ()) if u != sink else ():
            if v in best:
                new = (best[v][0] + score(i), [i, *best[v][1]])
                old = best.get(u)
                if old is None or new[0] > old[0] or (new[0] == old[0] and new[1] < old[1]):
                    best[u] = new
    return best[source][1] if source in best and best[source][1] else None


def reach_ways(edges: dict[int, tuple[str, str]], source: str, sink: str, cutoff: int = CUTOFF, limit: int = MAX_PATHS) -> tuple[list[list[int]], bool]:
    """Simple ways over reaches that meet head to tail, in either direction, from those that leave
    the source to those that enter the sink; and whether a bound cut them off."""
    heads, tails = defaultdict(list), defaultdict(list)
    for i in sorted(edges):
        tails[edges[i][0]].append(i)
        heads[edges[i][1]].append(i)
    ends, found, cut = set(heads[sink]), [], False
    near = {i: sorted({*tails[v], *heads[u]} - {i}) for i, (u, v) in edges.items()}
    for first in tails[source]:
        way, todo = [first], [iter(near[first])]
        if first in ends:
            found.append([first])
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                way.pop()
            elif step not in way:
                if step in ends:
                    if len(found) >= limit:
                        return found, True
                    found.append([*way, step])
                if len(way) <= cutoff:
                    way.append(step)
                    todo.append(iter(near[step]))
                else:
                    cut = True
    return found, cut


def most_parallel(net: Network, ids: set[int], source: str, sink: str) -> int:
    """The largest number of reaches side by side, main reaches stretched so that both ways from source to sink are as deep.

    Reaches between the same junctions are one step; it is a main one if one of them is.
    """
    steps: dict[tuple[str, str], bool] = {}
    for i in sorted(ids):
        steps[net.edges[i]] = steps.get(net.edges[i], False) or net.main(i)

    def ways(kind: bool | None) -> dict:
        out = defaultdict(list)
        for (u, v), is_main in steps.items():
            if kind is None or is_main is kind:
                out[u].append((v, (u, v)))
        return out

    whole = ways(None)
    topological(whole)
    side, main = (depth(ways(kind), source).get(sink, 0.0) for kind in (False, True))
    stretch = side / main if side > 0 and main > 0 else 1.0
    far = depth(whole, source, lambda step: stretch if steps[step] else 1.0)
    slices = int(far.get(sink, 0))
    if slices < 1:
        return 0
    change = [0] * (slices + 1)
    for i in ids:
        u, v = net.edges[i]
        if u not in far or v not in far or far[v] <= far[u]:
            continue
        lo, hi = -int(-far[u] // 1), -int(-far[v] // 1)  # whole slices from far[u] on and under far[v]
        lo, hi = min(max(lo, 0), slices), min(max(hi, 0), slices)
        change[lo] += 1
        change[hi] -= 1
    best = run = 0
    for k in range(slices):
        run += change[k]
        best = max(best, run)
    return best


def _channels(net: Network, ids) -> float | None:
    """Mean number of channels over the nodes of reaches."""
    known = [(float(net.reach[i].chan_sum), int(net.reach[i].chan_nodes)) for i in ids if net.reach[i].chan_nodes]
    return sum(s for s, _ in known) / sum(n for _, n in known) if known else None


def _median(values) -> float | None:
    known = sorted(float(v) for v in values if v is not None and v == v)
    if not known:
        return None
    k = len(known) // 2
    return known[k] if len(known) % 2 else (known[k - 1] + known[k]) / 2


def main_between(out: dict[str, list[tuple[str, int]]], source: str, sink: str) -> list[int]:
    """Main reaches of the way of fewest reaches from source to sink. out: ways along main reaches."""
    came, todo = {source: None}, deque([source])
    while todo and sink not in came:
        n = todo.popleft()
        for v, i in out.get(n, ()):
            if v not in came:
                came[v] = (n, i)
                todo.append(v)
    way, n = [], sink
    while came[n] is not None:
        n, i = came[n]
        way.append(i)
    return way[::-1]


def resolve_component(net: Network, order: list[str], nodes: set[str], side: set[int], by_width: bool = False, undirected: bool = True, corridors: Corridors | None = None) -> dict | None:
    """What one side component adds, and to which main reaches; None if it does not leave and join the main stem.

    by_width: the dominant side way is the greatest by length times width. undirected: where no
    side way runs downstream all along, ways over reaches in either direction are tried; if their
    bound cuts them off, the status is "truncated".
    """
    corridors = corridors or Corridors(net, order)
    at = corridors.at
    touched = sorted((n for n in nodes if n in at), key=at.get)
    starts = {net.edges[i][0] for i in side}
    ends = {net.edges[i][1] for i in side}
    splits = [n for n in touched if n in starts]
    merges = [n for n in touched if n in ends and splits and at[n] > at[splits[0]]]
    if not splits or not merges:
        return None
    source, sink = splits[0], merges[-1]
    ids = corridors.between(source, sink)
    k_max = most_parallel(net, ids, source, sink)
    main = main_between(corridors.main, source, sink)
    length = lambda p: sum(net.length(i) for i in p)
    score = (lambda i: net.length(i) * net.wide(i)) if by_width else net.length
    l_main = length(i for i in main if i in ids)
    beside = [i for i in ids if not net.main(i)]
    best, status = best_way(net.out(beside), source, sink, score), "ok"
    if best is None and undirected:
        found, cut = reach_ways({i: net.edges[i] for i in beside}, source, sink)
        best = max(found, key=lambda p: sum(map(score, p)), default=None)
        status = "truncated" if cut else "ok"
    if best is None:
        return {"reaches": set(main), "k_max": k_max, "k_eff": 1.0, "k_eff_raw": 1.0, "width_extra": None, "l_main": l_main, "l_dominant": 0.0, "l_extra": 0.0, "status": "no_side_path"}
    extra = ids.difference(main, best)
    l_extra = length(extra)
    share = l_extra / l_main if l_extra > MIN_EXTRA_M and l_main > 0 else 0.0
    base, more = _channels(net, best), 0.0
    k_eff = raw = base
    if share > k_max - 2:  # extra channels count only over the cap
        more = _channels(net, extra) if extra else None
        known = base is not None and more is not None and share > 0
        k_eff, raw = (base + k_max / share * more, base + share * more) if known else (None, None)
        if share == 0:
            k_eff = raw = base
    w_dominant, w_extra = _median(net.reach[i].width for i in best), 0.0
    if extra:
        w_extra = _median(net.reach[i].width for i in extra)
        w_extra = None if w_extra is None else min(share, max(0, k_max - 2)) * w_extra
    width = None if w_dominant is None or w_extra is None else w_dominant + w_extra
    return {"reaches": set(main), "k_max": k_max, "k_eff": k_eff, "k_eff_raw": raw, "width_extra": width, "l_main": l_main, "l_dominant": length(best), "l_extra": l_extra, "status": status}


def enrich(rows: pd.DataFrame, by_width: bool = False, undirected: bool = True) -> pd.DataFrame:
    """Enrichment of the main reaches of one path; of several components on a reach the last counts.

    rows without chan_sum and chan_nodes, the sum over a reach's nodes and their number, have one
    node for each reach, with its n_chan.
    """
    if "chan_nodes" not in rows:
        rows = rows.assign(chan_sum=rows["n_chan"], chan_nodes=rows["n_chan"].notna().astype(int))
    names = [c.split()[0] for c in ENRICHMENT.split(", ")]
    mip = int(rows["mip"].iloc[0])
    net = Network(rows)
    found: dict[int, tuple] = {}
    try:
        order = net.main_order()
    except ValueError as e:
        return pd.DataFrame([(mip, None, None, None, None, None, None, None, None, None, str(e))], columns=names)
    corridors = Corridors(net, order)
    for k, (nodes, side) in enumerate(net.components()):
        try:
            r = resolve_component(net, order, nodes, side, by_width, undirected, corridors)
        except ValueError as e:
            r = {"reaches": set(), "status": str(e)}
        for i in sorted(r["reaches"]) if r else ():
            found[i] = (mip, i, k, r["k_max"], r["k_eff"], r["k_eff_raw"], r["width_extra"], r["l_main"], r["l_dominant"], r["l_extra"], r["status"])
    return pd.DataFrame(list(found.values()), columns=names)


def enrichment(reaches: DataFrame, nodes: DataFrame | None = None, by_width: bool = False, undirected: bool = True) -> DataFrame:
    """ENRICHMENT rows of every path: reaches(reach_id, main_path_id, is_mainstem, rch_id_dn, reach_len, width).

    Channels are averaged over nodes(reach_id, n_chan_mod), or, without these, over reaches by their n_chan.
    """
    rows = reaches.select(F.col("main_path_id").alias("mip"), "reach_id", "is_mainstem", "rch_id_dn", "reach_len", "width", *(["n_chan"] if nodes is None else []))
    if nodes is None:
        rows = rows.withColumn("chan_sum", F.coalesce("n_chan", F.lit(0.0)).cast("double")).withColumn("chan_nodes", F.col("n_chan").isNotNull().cast("long")).drop("n_chan")
    else:
        sums = nodes.groupBy("reach_id").agg(F.sum(F.col("n_chan_mod").cast("double")).alias("chan_sum"), F.count("n_chan_mod").alias("chan_nodes"))
        rows = rows.join(sums, "reach_id", "left").fillna(0, ["chan_sum", "chan_nodes"])
    return rows.groupBy("mip").applyInPandas(lambda part: enrich(part, by_width, undirected), ENRICHMENT)


def width_summary(reaches: DataFrame, keys: tuple[str, ...], how: str = "median") -> DataFrame:
    """Median, mean or length-weighted mean width of sets of reaches."""
    if how == "median":
        x = F.percentile("width", F.lit(0.5))
    elif how == "mean":
        x = F.avg("width")
    elif how == "weighted":
        ok = F.col("width").isNotNull() & (F.col("reach_len") > 0)
        x = F.sum(F.when(ok, F.col("width") * F.col("reach_len"))) / F.sum(F.when(ok, F.col("reach_len")))
    else:
        raise ValueError(f"unknown statistic: {how}")
    return reaches.groupBy(*keys).agg(x.alias("width"))


def total_length(reaches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Summed length; an unknown or zero length counts as 1."""
    own = F.when(F.col("reach_len").isNull() | (F.col("reach_len") == 0), 1.0).otherwise(F.col("reach_len"))
    return reaches.groupBy(*keys).agg(F.sum(own).alias("length_m"))
