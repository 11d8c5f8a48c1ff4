"""Mixing sources to target weights by fitting whole documents to a budget of words.

Sources share the mix by weight; a source gets at most MOST times its words, and what it
leaves is shared by the others again, until none is above. Of a source with target t and s
words every document is taken floor(t / s) times, and some once more so that their words
make up the rest, b. Which ones is a bounded knapsack over the number of documents of each
exact length: the same share of every length is taken first, then long ones, until RESERVE
words are left, and what is left is fitted by dynamic programming over the sums that the
remaining documents can reach. So a source of up to RESERVE words is fitted as well as its
documents allow, and a larger one to the word unless it lacks short documents. Which of the
documents of a length are taken is settled by a seeded hash, with exact ranks (ranks.py), so
a length that a third of all rows share is divided like any other.

A task holds the lengths of one source, of which there are no more than words in the
longest text, never its documents.

Defined cases: a null or empty text has size 0 and is taken with 0 words; a null source is
a source of its own, the last; a source without words has target 0; a null doc_id is an id;
repeated rows are rows of their own; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_empty
from .ranks import digits, ranked

#: Weights of sources in order, repeating; the share of all words that the mix has, and the most of a source's.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words that are left to the dynamic programming.
RESERVE = 1 << 16
SEED = 2024


def records(docs: DataFrame) -> DataFrame:
    """doc_id, _g (the source as text that is never null; null sorts last) and size in words of each row, settled."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    group = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    rows = docs.select("doc_id", group.alias("_g"), words.alias("size"))
    return cut(rows.withColumn("_row", F.monotonically_increasing_id()))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (_g, source_size) with target: their part of share * all words by weight, at most `most` times their own."""
    order = ranked(cut(sources.withColumn("_all", F.lit(0))), ["_all"], F.hex(F.encode("_g", "utf-8")))
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = cut(order.select("_g", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("most"), F.lit(True).alias("_open")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        # Each round stops the sources whose part is above their most; none of them comes back.
        stopped, weight_left = rows.agg(F.sum(F.when(~F.col("_open"), F.col("most"))), F.sum(F.when(F.col("_open"), F.col("w")))).first()
        part = F.col("w") * F.lit(total - (stopped or 0.0)) / F.lit(weight_left or 1.0)
        above = F.col("_open") & (part > F.col("most"))
        if is_empty(rows.where(above)):
            return rows.select("_g", "source_size", F.when(F.col("_open"), part).otherwise(F.col("most")).alias("target"))
        rows = cut(rows.withColumn("_open", F.col("_open") & ~above))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near as can be to the budget.

    lengths: distinct and positive. Of two sums as near as each other the smaller is taken.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    even = max(0, budget - reserve)
    took = np.array([n * even // total for n in counts.tolist()], dtype=np.int64)  # exact: whole numbers of Python
    left = budget - int((lengths * took).sum())
    order = np.argsort(-lengths, kind="stable")
    for at_most in (1, budget):  # what rounding left is spread over the lengths first
        for i in order:
            more = min(int(counts[i] - took[i]), max(0, left - reserve) // int(lengths[i]), at_most)
            took[i] += more
            left -= more * int(lengths[i])
    return took + _exact(lengths, counts - took, left, reserve)


def _exact(lengths: np.ndarray, counts: np.ndarray, left: int, reserve: int) -> np.ndarray:
    """fit() of what is left, by the sums that can be reached."""
    out = np.zeros(len(lengths), dtype=np.int64)
    if left > 2 * reserve:
        # Every length at hand is above left - reserve, so no two documents fit: the one that comes nearest, or none.
        best = min((abs(left - int(v)), int(v), i) for i, v in enumerate([*lengths, 0]) if i == len(lengths) or counts[i])
        if best[2] < len(lengths):
            out[best[2]] = 1
        return out
    most = 2 * left  # nothing is as far as that: taking no document is as near
    stage = np.full(most + 1, -1, dtype=np.int32)  # the first length with which a sum was reached
    reach = np.zeros(most + 1, dtype=bool)
    reach[0] = True
    for i in np.argsort(-lengths, kind="stable"):
        size, have = int(lengths[i]), int(min(counts[i], most // lengths[i]))
        step = 1
        before = reach.copy()
        while have > 0:
            k = min(step, have)  # 1, 2, 4, ... and the rest reach every number of copies
            reach[size * k :] |= reach[: most + 1 - size * k].copy()
            have -= k
            step *= 2
        stage[reach & ~before] = i
        if reach[left]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at > 0:
        i = stage[at]
        out[i] += 1
        at -= int(lengths[i])
    return out


def plan(counts: DataFrame, goals: DataFrame, reserve: int = RESERVE) -> DataFrame:
    """(_g, size, n, copies, more): every document of a length is taken `copies` times and `more` of them once more."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
        total, goal = int(rows["source_size"].iloc[0]), int(round(rows["target"].iloc[0]))
        copies = goal // total if total else 0
        sized = rows["size"].to_numpy() > 0
        more = np.zeros(len(rows), dtype=np.int64)
        more[sized] = fit(rows["size"].to_numpy()[sized], rows["n"].to_numpy()[sized], goal - copies * total, reserve)
        return pd.DataFrame({"_g": rows["_g"], "size": rows["size"], "n": rows["n"], "copies": copies, "more": more})

    return counts.join(goals, "_g").groupBy("_g").applyInPandas(of, "_g string, size long, n long, copies long, more long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, reserve: int = RESERVE) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words of it in the mix) and copies of each row."""
    rows = records(docs)
    counts = cut(rows.groupBy("_g", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("_g").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = cut(targets(sources, weights, share, most))
    todo = plan(counts, goals, reserve).join(goals, "_g")
    planned = cut(rows.join(cut(todo), ["_g", "size"]))
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    chosen = ranked(cut(planned.where(some)), ["_g", "size"], _draw(seed)).withColumn("copies", F.col("copies") + (F.col("_rank") < F.col("more")).cast("long")).drop("_rank")
    rest = planned.where(~some).withColumn("copies", F.col("copies") + (F.col("more") > 0).cast("long"))
    out = chosen.unionByName(rest)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _draw(seed: int) -> Column:
    """The key by which documents of a length are drawn: a hash of the id, then the row."""
    return F.concat(digits(F.xxhash64(F.lit(seed), "doc_id")), digits(F.col("_row")))


def by_hand(rows: list[tuple], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """(source_size, target, nearest sum that its documents can give) by source of (source, text) rows, by trying all sums; for tests."""
    import re

    sizes: dict = {}
    for s, t in rows:
        sizes.setdefault(s, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = share * sum(map(sum, sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        part = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if part[s] > most * sum(sizes[s])]
        if not above:
            break
        stopped |= {s: most * sum(sizes[s]) for s in above}
    goal = part | stopped
    out = {}
    for s in names:
        own, want = sum(sizes[s]), int(round(goal[s]))
        copies = want // own if own else 0
        sums = {0}
        for n in sizes[s]:
            sums |= {x + n for x in sums}
        out[s] = (own, goal[s], copies * own + min(sums, key=lambda x: (abs(want - copies * own - x), x)))
    return out
