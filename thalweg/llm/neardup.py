"""Near-duplicate groups: SuperMinHash signatures, banding, checks on whole sets, union-find.

SuperMinHash (Ertl, 2017) gives each element a random permutation of the signature's
places and draws its values as rank + fraction along it, so an element's values are
correlated over places and the estimate varies less than with independent hashes. Ranks
are visited one after another for all elements of a batch, and a document is done as soon
as no later rank can lower any of its places.

Steps: documents with equal shingle sets form one class by a 128-bit fingerprint, and only
class representatives go on. Equal bands put them in buckets. In each bucket members are
checked against one hub, on whole shingle sets, never all against all. What is linked is
grouped; buckets that then still hold several groups get another hub. What is left after
that is joined by prefixes of rare shingles, an exact filter: every pair across groups that
can be similar enough is checked, so no link is left out, and a pair that is not checked
is already in one group. Groups come from union-find inside partitions and minimum labels
with pointer jumping between them.

With 20 bands of 4 rows a pair of similarity 0.85 is missed with chance 4e-7.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text of
fewer words than a shingle is one shingle; a null doc_id is never compared, has a null
component and is kept; equal rows are one document, rows that share a doc_id but not their
text are documents of their own under that id; repeated texts are one class; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ids_of, is_empty, mix64, plain_id, release, small_batches, working
from .shingles import shingle_sets

BANDS, ROWS = 20, 4
#: Random bits of a signature value below its rank.
_FRACTION = 25
#: Members, and their shingles, that are checked against a hub in one group.
GROUP_ROWS, GROUP_SHINGLES = 256, 2_000_000
#: Rounds with one hub a bucket before pairs across groups are all checked.
HUB_ROUNDS = 2
FEATURES = "doc_id long, n_shingles long, fp_hi long, fp_lo long, bands array<long>"


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, a row for each; an empty set has all ones."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sig = np.full((len(sets), places), 0xFFFFFFFF, dtype=np.uint32)
    if not sizes.sum():
        return sig
    flat = sig.reshape(-1)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None  # each element's permutation, made once a document needs a second rank
    for rank in range(places):
        with np.errstate(over="ignore"):
            x = mix64(items + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = rank + ((x >> np.uint64(32)) % np.uint64(places - rank)).astype(np.int64)
        value = (x & np.uint64((1 << _FRACTION) - 1)).astype(np.uint32) + np.uint32(rank << _FRACTION)
        if order is None:
            place = pick
        else:
            rows = np.arange(len(items))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, rank]
        np.minimum.at(flat, owner * places + place, value)
        open_ = sig.max(axis=1) >= np.uint32(min((rank + 1) << _FRACTION, 0xFFFFFFFF))
        open_ &= sizes > 0
        if not open_.any():
            break
        still = open_[owner]
        if order is None:
            items, owner, pick = items[still], owner[still], pick[still]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(items), 1))
            order[np.arange(len(items)), pick] = 0
        elif not still.all():
            items, owner, order = items[still], owner[still], order[still]
    return sig


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit number for each band of each signature, different between bands."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def features(docs: DataFrame, k: int) -> DataFrame:
    """Size, fingerprint and bands of each document's shingle set."""
    import xxhash

    small_batches(docs.sparkSession)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("shingles")
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch["text"]]
            for lo in range(0, len(texts), 128):
                sets = shingle_sets(texts[lo : lo + 128], k)
                bands = band_hashes(signatures(sets))
                part = batch.iloc[lo : lo + 128]
                prints = np.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], dtype="S16")
                halves = np.frombuffer(prints.tobytes(), dtype=np.int64).reshape(-1, 2)
                none = part["_null"].to_numpy(dtype=bool) | np.array([not len(s) for s in sets])
                yield pd.DataFrame(
                    {
                        "doc_id": ids_of(part), "n_shingles": [len(s) for s in sets],
                        "fp_hi": pd.arrays.IntegerArray(halves[:, 0].copy(), none), "fp_lo": pd.arrays.IntegerArray(halves[:, 1].copy(), none),
                        "bands": [None if n else b for n, b in zip(none, bands)],
                    }
                )
        release()

    return plain_id(docs, "text").mapInPandas(make, FEATURES)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The shingle sets, as bytes, of the documents whose doc_id is in ids.id."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("shingles")
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), k)
            yield pd.DataFrame({"id": batch["doc_id"], "shingles": [s.tobytes() for s in sets]})
        release()

    return _wanted(docs, ids).mapInPandas(make, "id long, shingles binary")


def tokens_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """A row for each shingle of the documents whose doc_id is in ids.id."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("shingles")
        for batch in batches:
            texts, at = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for lo in range(0, len(texts), 64):
                sets = shingle_sets(texts[lo : lo + 64], k)
                yield pd.DataFrame({"id": np.repeat(at[lo : lo + 64], [len(s) for s in sets]), "token": np.concatenate(sets).view(np.int64)})
        release()

    return _wanted(docs, ids).mapInPandas(make, "id long, token long")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b, n_a, n_b) with 100 * intersection >= percent * union, on whole sets.

    The members of a hub are dealt to groups of bounded size, each with a copy of the hub's set.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(sets_of(docs, ids, k))
    load = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / GROUP_ROWS, F.sum("n_b") / GROUP_SHINGLES)).cast("long").alias("_parts"))
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_parts").alias("part"))
    members = dealt.join(sets.select(F.col("id").alias("b"), "shingles"), "b")
    hubs = dealt.select("a", "part").distinct().join(sets.select(F.col("id").alias("a"), "shingles"), "a")
    # Names of their own, or Spark takes the two sides for one.
    hubs = hubs.select(F.col("a").alias("hub"), F.col("part").alias("hub_part"), F.col("shingles").alias("hub_shingles"))

    def check(hub: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for raw in hub["hub_shingles"]:
            a = np.frombuffer(raw, dtype=np.uint64)
            for b, raw_b in zip(rows["b"], rows["shingles"]):
                s = np.frombuffer(raw_b, dtype=np.uint64)
                if raw_b == raw:
                    found.add(b)
                    continue
                at = np.searchsorted(a, s)
                same = int((a[np.minimum(at, len(a) - 1)] == s).sum())
                if 100 * same >= percent * (len(a) + len(s) - same):
                    found.add(b)
        return pd.DataFrame({"a": np.full(len(found), rows["a"].iloc[0] if len(rows) else 0, dtype=np.int64), "b": np.array(sorted(found), dtype=np.int64)})

    return hubs.groupBy("hub", "hub_part").cogroup(members.groupBy("a", "part")).applyInPandas(check, "a long, b long")


def forest(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: as few edges (a, b) with the same groups."""

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        rows = [(find(x), x) for x in list(root)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype=np.int64)
        del rows
        root.clear()
        release()

    return edges.mapInPandas(unite, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of edges (a, b): the smallest id that it reaches."""
    edges = cut(forest(edges.select("a", "b")))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        lower = cut(lower)
        # The label of my label is at least as small.
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut(lower.join(jump, "label", "left").select("id", "was", F.least("label", "further").alias("label")))
        settled = is_empty(new.where("label <> was"))
        labels = new.select("id", "label")
        if settled:
            return labels


def groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    k: words in a shingle. percent: linked if 100 * intersection >= percent * union.
    """
    seen = cut(features(docs, k))
    several = seen.where("fp_hi is not null").groupBy("doc_id").agg(F.min("fp_hi").alias("lo"), F.max("fp_hi").alias("hi")).where("lo < hi")
    if not is_empty(several):
        return _by_row(docs, k, percent)
    # Equal sets have equal sizes and bands, so a class takes those of any of its rows; copies are united before they are sent.
    classes = seen.where("fp_hi is not null").groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes)
    reps = classes.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("h"))
    buckets = reps.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    members = cut(reps.join(buckets, "h"))
    labels = _linked(members, docs, k, percent)
    named = classes.select("fp_hi", "fp_lo", F.col("doc_id").alias("id")).join(labels, "id", "left")
    # Settled, so that a join is all that its stage does and large classes can be split.
    named = cut(named.select("fp_hi", "fp_lo", F.coalesce("label", "id").alias("_component")))
    own = seen.select("doc_id", "n_shingles", "fp_hi", "fp_lo")
    component = F.coalesce("_component", "doc_id")
    out = own.where("fp_hi is not null").join(named, ["fp_hi", "fp_lo"]).select("doc_id", "n_shingles", component.alias("component_id"))
    # Rows without shingles are in no class, and stay out of the join.
    out = out.unionByName(own.where("fp_hi is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def row_key(docs: DataFrame) -> DataFrame:
    """docs with doc_id replaced by a number of the row's id and text; a null id stays null."""
    return docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))


def _by_row(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """groups() where different texts share an id: each is a document of its own."""
    own = docs.select(F.col("doc_id").alias("own"), F.xxhash64("doc_id", "text").alias("doc_id")).where("own is not null").distinct()
    found = groups(row_key(docs), k, percent)
    named = found.join(own, "doc_id", "left")
    least = named.where("own is not null").groupBy("component_id").agg(F.min("own").alias("least"))
    out = named.join(least, "component_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _candidates(left: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs, hub first, whose sizes allow the similarity."""
    sized = left.where((F.col("a") != F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    return sized.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _hub_pairs(members: DataFrame, round_: int) -> DataFrame:
    """Each bucket's members with its hub: first the one that most others meet, then any."""
    chance = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = members.groupBy("h").agg(F.count("*").alias("c"))
    met = members.join(sizes, "h").groupBy("id").agg(F.sum("c").alias("met"))
    order = (F.col("met") + chance) if not round_ else chance
    hubs = members.join(met, "id").groupBy("h").agg(F.max_by("id", order).alias("a"), F.max_by("n", order).alias("n_a"))
    return members.join(hubs, "h").select("a", "n_a", F.col("id").alias("b"), F.col("n").alias("n_b"))


def prefix_pairs(who: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every pair of who (id, n, label) with different labels that may be similar enough, and few others.

    In any fixed order of shingles, two similar sets share one of their first few, and what
    stands behind the first that they share must still make up the overlap that is needed
    (the prefix and position filters of Xiao and others, 2008). The order is by rising
    number of sets, so those few are mostly a text's own and met by nobody.
    """
    tokens = cut(tokens_of(docs, who.select("id"), k))
    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    order = Window.partitionBy("id").orderBy("df", "token")
    ranked = cut(tokens.join(counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))).withColumn("r", F.row_number().over(order)).join(who, "id")
    large = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    # rest: the overlap that this shingle and those behind it can give at most.
    first = cut(ranked.where((F.col("r") <= large) & (F.col("df") > 1)).select("token", "id", "n", "label", (F.col("n") - F.col("r") + 1).alias("rest")))
    # Most rows of a token belong to one group; only the others look for partners.
    shares = first.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("token").agg(F.max_by("label", "c").alias("top"), F.count("*").alias("groups")).where("groups > 1")
    rows = cut(first.join(cut(mixed.select("token", "top")), "token"))
    names = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label", "rest")]
    x = rows.where("label <> top").select("token", *names("x"))
    y = rows.select("token", "top", *names("y"))
    once = (F.col("label_y") == F.col("top")) | (F.col("id_x") < F.col("id_y"))
    # 100 * overlap >= percent * (n_x + n_y - overlap), which also bounds the sizes.
    fits = (100 + percent) * F.least("rest_x", "rest_y") >= percent * (F.col("n_x") + F.col("n_y"))
    same = x.join(y, "token").where((F.col("label_x") != F.col("label_y")) & once & fits)
    return same.select(F.col("id_x").alias("a"), F.col("n_x").alias("n_a"), F.col("id_y").alias("b"), F.col("n_y").alias("n_b"))


def _linked(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Labels of the representatives that are linked with another one."""
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, label long")
    tested = spark.createDataFrame([], "a long, b long")
    left = members
    for round_ in range(HUB_ROUNDS + 1):
        if round_ < HUB_ROUNDS:
            pairs = _hub_pairs(left, round_)
        else:
            pairs = prefix_pairs(left.select("id", "n", "label").distinct(), docs, k, percent)
        pairs = _candidates(pairs, percent)
        if round_:
            known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if not is_empty(pairs):
            found = cut(verify(pairs, docs, k, percent))
            tested = tested.unionByName(pairs.select("a", "b"))
            links = links.unionByName(found)
            labels = components(links)
        if round_ == HUB_ROUNDS:
            break
        named = members.join(labels, "id", "left").select("h", "id", "n", F.coalesce("label", "id").alias("label"))
        split = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
        left = cut(named.join(split, "h"))
        if is_empty(left):
            break
    return labels


def by_hand(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """(set size, smallest id reached) by comparing all pairs; for tests."""
    import re

    sets = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    label = {d: d for d in sets}

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


#: Three-word shingles and similarity 0.85 in SQL, by all pairs that share a shingle; for tables with distinct ids.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), single AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM sets LEFT JOIN least ON a = doc_id
"""
