"""Benchmark items in documents, paraphrases too, by latent semantic retrieval and two checks.

Terms are the words of the benchmark that few of its items share. Document texts are read
as passages of PASSAGE words. A distributed randomised SVD of their TF-IDF matrix A gives
the latent space: with S = T' T W for counts T and a random W, summed over all passages in
one pass, and D the diagonal of inverse document frequencies known after that pass,
Y = D S is a sketch of the Gram matrix A'A = D T'T D, and its leading eigenvectors follow
from Y (W'S)^-1 Y' (the Nystrom form of Halko, Martinsson and Tropp, 2011). The
benchmark's own passages count as much as all others, so that its topics are in the space.

A second pass goes over every passage, in steps of half a passage, and takes as candidates
the items whose latent vector has a cosine of at least CANDIDATE with it. Around a
candidate the longest common subsequence of words with the item is measured. An item is
held to be in a document if the subsequence covers COPY of its words, or PARAPHRASE of
them and the answer is there too: ANSWER of the words of the text after "answer:", or,
without such a part, of the item's rarest terms.

Items are taken in blocks of ITEM_BLOCK, so what is broadcast is bounded whatever the
benchmark's size.

Defined cases: a null or empty text holds no item; a null item, or one without words, is in
no document; a null doc_id is kept as it is; repeated rows and repeated items are reported
each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, mix64, one_thread, plain_id, release, small_batches, working

PASSAGE = 32
DIM, EXTRA = 128, 16
#: Terms are words of at most this share of the items (two items at least), and the rarest of each item.
TERM_SHARE, TERMS_AT_LEAST = 0.02, 4
CANDIDATE = 0.45
COPY, PARAPHRASE, ANSWER = 0.75, 0.5, 0.6
ANSWER_TERMS = 5
ITEM_BLOCK = 1024
_CHUNK = 64
#: Terms that are worked on at once, which bounds a task's memory.
_PART = 1 << 14
FOUND = "doc_id long, item_id long, lcs double, answer double, cosine double, first_word long, last_word long"

#: All ASCII but letters and digits parts words, and so do capitals' differences vanish.
_FOLD = bytes((i | 32) if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Items:
    """A block of benchmark items: their words, terms and answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(i, w, t) for i, t in rows if i is not None and (w := words_of(t))]
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, w, _ in kept]
        in_items = Counter(w for ws in self.words for w in set(ws))
        most = max(2, int(TERM_SHARE * len(self.words)))
        terms = {w for w, c in in_items.items() if c <= most}
        for ws in self.words:
            terms.update(sorted(set(ws), key=lambda w: (in_items[w], -len(w), w))[:TERMS_AT_LEAST])
        self.terms = {w: k for k, w in enumerate(sorted(terms))}
        self.answers = []
        for ws, (_, _, text) in zip(self.words, kept):
            said = re.split(r"(?i)\banswer\s*:", text)
            own = words_of(said[-1]) if len(said) > 1 else []
            self.answers.append(set(own) or set(sorted(set(ws), key=lambda w: (in_items[w], -len(w), w))[:ANSWER_TERMS]))
        self.masks = []
        for ws in self.words:
            at: dict[bytes, int] = {}
            for k, w in enumerate(ws):
                at[w] = at.get(w, 0) | 1 << k
            self.masks.append(at)

    def counts(self) -> np.ndarray:
        out = np.zeros((len(self.words), len(self.terms)))
        for i, ws in enumerate(self.words):
            for w in ws:
                if w in self.terms:
                    out[i, self.terms[w]] += 1
        return out

    def common(self, item: int, words: list[bytes]) -> int:
        """Length of the longest common subsequence of words with an item, by bits (Hyyro, 2004)."""
        at, n = self.masks[item], len(self.words[item])
        full = (1 << n) - 1
        v = full
        for m in filter(None, map(at.get, words)):
            u = v & m
            v = ((v + u) | (v - u)) & full
        return n - v.bit_count()


def _test_matrix(terms: int, columns: int) -> np.ndarray:
    """Random signs by hash, the same in every task."""
    k = np.arange(terms * columns, dtype=np.uint64)
    return (((mix64(k + np.uint64(10)) >> np.uint64(40)) & np.uint64(1)).astype(np.float32) * 2 - 1).reshape(terms, columns)


def _term_rows(texts: list[str | None], terms: dict[bytes, int], cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """(term, cell) of every term in texts, the first cell of each text, and the words. Cells have `cell` words."""
    get = terms.get
    all_terms, all_cells, firsts, lists, at = [], [], [], [], 0
    for t in texts:
        words = words_of(t)
        lists.append(words)
        firsts.append(at)
        ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
        where = np.flatnonzero(ids >= 0)
        all_terms.append(ids[where])
        all_cells.append(at + where // cell)
        at += -(-len(words) // cell)
    firsts.append(at)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(all_terms or [none]), np.concatenate(all_cells or [none]), np.array(firsts), lists


def _sum_rows(table: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table[rows] with the same key; keys ascend, and most have few rows."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(starts, append=len(keys))
    out = table[rows[starts]]
    for r in range(1, min(int(counts.max(initial=0)), 64)):
        more = np.flatnonzero(counts > r)
        out[more] += table[rows[starts[more] + r]]
    for i in np.flatnonzero(counts > 64):
        out[i] += table[rows[starts[i] + 64 : starts[i] + counts[i]]].sum(axis=0)
    return keys[starts], out


def sketch(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray, int]:
    """T'T W, the document frequencies of terms, and the number of passages, over all of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    n, k = len(items.terms), DIM + EXTRA
    terms = spark.sparkContext.broadcast(items.terms)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("decontam")
        w = _test_matrix(n, k)
        total = np.zeros((n, k + 1))
        passages = 0
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch["text"]]
            term, cell, firsts, _ = _term_rows(texts, terms.value, PASSAGE)
            passages += int(firsts[-1])
            if not len(term):
                continue
            lo = 0
            while lo < len(term):  # bounds the memory; no passage is cut
                hi = int(np.searchsorted(cell, cell[min(lo + _PART, len(cell)) - 1], side="right"))
                t, c, lo = term[lo:hi], cell[lo:hi], hi
                seen, y = _sum_rows(w, t, c)
                order = np.argsort(t, kind="stable")
                which, s = _sum_rows(y, np.searchsorted(seen, c[order]), t[order])
                total[which, :k] += s
                once = np.unique(c.astype(np.int64) * n + t) % n
                total[:, k] += np.bincount(once, minlength=n)
        used = [q for q in range(0, n, _CHUNK) if total[q : q + _CHUNK, k].any()]
        rows = [(q, passages if not i else 0, total[q : q + _CHUNK].astype(np.float32).tobytes()) for i, q in enumerate(used)]
        yield pd.DataFrame(rows or [(0, passages, np.zeros((min(_CHUNK, n), k + 1), dtype=np.float32).tobytes())], columns=["chunk", "passages", "part"])
        release()

    def join_up(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, dtype=np.float32).astype(np.float64) for p in rows["part"])
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "passages": [rows["passages"].sum()], "part": [total.tobytes()]})

    schema = "chunk int, passages long, part binary"
    # A row for every _CHUNK terms comes back: at most some MB for a block of items.
    got = docs.select("text").mapInPandas(add_up, schema).groupBy("chunk").applyInPandas(join_up, schema).collect()
    s = np.zeros((n, k + 1))
    for r in got:
        part = np.frombuffer(r["part"]).reshape(-1, k + 1)
        s[r["chunk"] : r["chunk"] + len(part)] = part
    terms.destroy()
    return s[:, :k], s[:, k], sum(r["passages"] for r in got)


def latent_space(items: Items, s: np.ndarray, df: np.ndarray, passages: int) -> np.ndarray:
    """A vector of at most DIM numbers for each term: its weight times the leading right singular vectors."""
    own = items.counts()
    idf = np.log((1 + passages + len(own)) / (1 + df + (own > 0).sum(axis=0))) + 1
    w = _test_matrix(len(items.terms), DIM + EXTRA).astype(np.float64)
    mass = (df * idf**2).sum() / max(1e-9, (own.sum(axis=0) * idf**2).sum())
    s = s + max(mass, 1.0) * (own.T @ (own @ w))
    y = s * idf[:, None]
    core = w.T @ s
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > max(value.max(), 1e-12) * 1e-9
    half = y @ (vector[:, good] / np.sqrt(value[good]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    return (u[:, :DIM] * idf[:, None]).astype(np.float32)


def _search(docs: DataFrame, items: Items, space: np.ndarray) -> DataFrame:
    spark = docs.sparkSession
    asked = (items.counts().astype(np.float32) @ space)
    asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast((items, space, np.ascontiguousarray(asked.T)))
    half = PASSAGE // 2

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("decontam")
        one_thread()
        items, space, asked = shared.value
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch["text"]]
            term, cell, firsts, lists = _term_rows(texts, items.terms, half)
            best: dict[tuple[int, int], tuple] = {}
            for lo, cos in _cosines(term, cell, firsts, space, asked):
                at, which = np.nonzero(cos >= CANDIDATE)
                score = cos[at, which]
                at = lo[at]
                owner = np.searchsorted(firsts, at, side="right") - 1
                for a, d, i, c in zip(at.tolist(), owner.tolist(), which.tolist(), score.tolist()):
                    words, n = lists[d], len(items.words[i])
                    # Some passage starts within a quarter of its length of where the item does.
                    margin = max(PASSAGE // 4, n - half)
                    first = max(0, (a - int(firsts[d])) * half - margin)
                    last = min(len(words), (a - int(firsts[d])) * half + PASSAGE + margin)
                    region = words[first:last]
                    lcs = items.common(i, region) / n
                    if lcs < PARAPHRASE:
                        continue
                    answer = len(items.answers[i].intersection(region)) / max(1, len(items.answers[i]))
                    if lcs >= COPY or answer >= ANSWER:
                        old = best.get((d, i))
                        if old is None or (lcs, answer) > old[:2]:
                            best[d, i] = (lcs, answer, c, first, last)
            rows = [(d, items.ids[i], *v) for (d, i), v in sorted(best.items())]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "lcs", "answer", "cosine", "first_word", "last_word"])
            yield out.assign(doc_id=ids_of(batch).take(out["doc_id"].to_numpy(dtype=np.int64)))
        release()

    return plain_id(docs, "text").mapInPandas(find, FOUND)


def _cosines(term: np.ndarray, cell: np.ndarray, firsts: np.ndarray, space: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First cells of passages (two cells each) and their cosines with every item."""
    if not len(term):
        return
    for lo in range(0, len(term), _PART):
        # A cell that is cut here is taken whole with the later part.
        hi = lo + _PART
        a = lo if not lo else int(np.searchsorted(cell, cell[lo] - 1))
        t, c = term[a:hi], cell[a:hi]
        seen, value = _sum_rows(space, t, c)
        # A passage starts at each cell with terms, and at the cell before it if its text has one.
        after = np.searchsorted(seen, seen + 1)
        ends = firsts[np.searchsorted(firsts, seen, side="right")]
        follows = (after < len(seen)) & (seen[np.minimum(after, len(seen) - 1)] == seen + 1) & (seen + 1 < ends)
        both = value + np.where(follows[:, None], value[np.minimum(after, len(seen) - 1)], 0)
        norm = np.linalg.norm(both, axis=1, keepdims=True)
        yield seen, both @ asked / np.maximum(norm, 1e-9)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it, with how much was found and in which words.

    The columns are those of FOUND; first_word and last_word bound the words that were compared.
    """
    spark = docs.sparkSession
    numbered = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    blocks = max(1, -(-numbered.count() // ITEM_BLOCK))
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        items = Items(sorted((r["item_id"], r["text"]) for r in part.collect()))
        if not items.ids:
            continue
        space = latent_space(items, *sketch(docs, items))
        out = out.unionByName(_search(docs, items, space))
    return out
