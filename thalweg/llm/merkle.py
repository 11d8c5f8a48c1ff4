"""A Merkle manifest of a data set: digests, proofs and checks for every row.

A row is a leaf: the digest of its fields, each with its length in bytes before it. Leaves
of a source stand by doc_id. Their places in it come from histograms of the digits of
doc_id (ranks.py), so nothing is sorted as a whole and a source with a third of all rows
is no larger a task than others. A place's digits to the base of the fanout are its way
through a trie: nodes that share all digits but the last are one run, and become their
digest under the prefix they share. Runs are reduced from the longest prefix on, for all
sources at once, until each source has one node, its subroot; subroots, by source, are
reduced to the root in the same way. The way back down hands each node the siblings of all
runs above it, so a leaf gets its proof from its own run alone.

Defined cases: a null field counts as `-`; rows with a null source are a source of their
own, before the others; a null doc_id stands after all others; rows that share a doc_id
stand by their digests, and equal rows have equal digests; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_crc, is_empty
from .ranks import digits, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Digests that stand before a node in its run and after it, for each run from the node's own up to the root.
STEPS = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it; `-` if null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    """sha256 of the values, as lower-case hexadecimal."""
    return F.sha2(F.concat(*fields), 256)


def group_of(source: Column) -> Column:
    """A source as a string that is never null; null sorts first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def leaves(docs: DataFrame, changed: Column | None = None, to: Column | None = None) -> DataFrame:
    """doc_id, _g (the source), leaf and other of each row, settled; other: the leaf where `changed` holds, with `to` for the text."""
    own = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed, digest(*[field(to if c == "text" else F.col(c)) for c in FIELDS]))
    rows = docs.select(F.col("doc_id"), group_of(F.col("source")).alias("_g"), digest(*map(field, own)).alias("leaf"), other.alias("other"))
    return cut(rows.withColumn("_row", F.monotonically_increasing_id()))


def _reduce(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, and (_g, height, top) of each group's last node.

    nodes: _g, _at (the place in the group), h (the digest), and columns to carry.
    """
    runs, tops = [], None
    while True:
        row = F.struct("_at", "h", *[c for c in nodes.columns if c not in ("_g", "_at", "h")])
        run = cut(nodes.groupBy("_g", F.floor(F.col("_at") / fanout).cast("long").alias("_run")).agg(F.array_sort(F.collect_list(row)).alias("kids")).withColumnRenamed("_run", "_at"))
        # The first run of a group has one node only if that is all there is.
        alone = (F.col("_at") == 0) & (F.size("kids") == 1)
        top = run.where(alone).select("_g", F.lit(len(runs)).alias("height"), F.col("kids")[0]["h"].alias("top"))
        tops = top if tops is None else tops.unionByName(top)
        runs.append(run.withColumn("alone", alone))
        nodes = run.where(~alone).select("_g", "_at", F.sha2(F.array_join(F.col("kids.h"), ""), 256).alias("h"))
        if is_empty(nodes):
            return runs, cut(tops)


def _expand(runs: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """(_g, kid, steps and what tops has beside) of every node of the lowest level. tops: _g, height, steps, ..."""
    beside = [c for c in tops.columns if c not in ("_g", "height")]
    above = tops.where(F.col("height") == len(runs) - 1).select("_g", F.lit(0).cast("long").alias("_at"), *beside)
    out = None
    for level in reversed(range(len(runs))):
        hs = F.col("kids.h")
        kid = lambda k, i: F.struct(
            k.alias("kid"),
            F.struct(F.array_join(F.slice(hs, F.lit(1), i), "").alias("l"), F.array_join(F.slice(hs, i + 2, F.lit(fanout)), "").alias("r")).alias("step"),
        )
        met = runs[level].join(above, ["_g", "_at"])
        each = met.select("_g", "_at", "alone", *beside, F.explode(F.transform("kids", kid)).alias("k"))
        steps = F.when(F.col("alone"), F.col("steps")).otherwise(F.concat(F.array(F.col("k.step")), F.col("steps")))
        out = each.select("_g", F.col("k.kid").alias("kid"), *[steps.alias("steps") if c == "steps" else F.col(c) for c in beside])
        if level:
            lower = tops.where(F.col("height") == level - 1).select("_g", F.lit(0).cast("long").alias("_at"), *beside)
            above = cut(out.select("_g", F.col("kid._at").alias("_at"), *beside).unionByName(lower))
    return out


def manifest(docs: DataFrame, changed: Column | None = None, to: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, leaf, other, steps (the proof), subroot and root of every row.

    changed, to: rows whose leaf is also made with another text, as `other`.
    """
    rows = leaves(docs, changed, to)
    order = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.coalesce(digits(F.col("doc_id")), F.lit("")), F.upper("leaf"), digits(F.col("_row")))
    placed = ranked(rows, ["_g"], order)
    runs, tops = _reduce(placed.select("_g", F.col("_rank").alias("_at"), F.col("leaf").alias("h"), "doc_id", "other"), fanout)
    every = ranked(cut(tops.withColumn("_all", F.lit(0))), ["_all"], F.hex(F.encode("_g", "utf-8")))
    over, root = _reduce(every.select(F.lit("").alias("_g"), F.col("_rank").alias("_at"), F.col("top").alias("h"), F.col("_g").alias("source"), "height"), fanout)
    found = root.first()  # one row
    if found is None:
        return _named(docs.sparkSession.createDataFrame([], f"_g string, kid struct<doc_id:bigint,h:string,other:string>, steps {STEPS}, subroot string, root string"), docs)
    start = root.select("_g", "height", F.array().cast(STEPS).alias("steps"))
    sources = _expand(over, start, fanout).select(F.col("kid.source").alias("_g"), F.col("kid.height").alias("height"), "steps", F.col("kid.h").alias("subroot"), F.lit(found["top"]).alias("root"))
    return _named(_expand(runs, cut(sources), fanout), docs)


def _named(found: DataFrame, docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    source = F.when(F.col("_g") != "0", F.expr("substring(_g, 2)"))
    return found.select(F.col("kid.doc_id").cast(kind).alias("doc_id"), source.alias("source"), F.col("kid.h").alias("leaf"), F.col("kid.other").alias("other"), "steps", "subroot", "root")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof, level by level from the leaf's run to the root's, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "")


def audit(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every row's leaf, subroot, root and proof digest, and whether its leaf folds to the root when some texts are tampered with.

    Tampered with are rows whose crc32 of doc_id is divisible by 5: capitals A-Z of the text become small.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.coalesce(F.pmod(doc_crc(), F.lit(5)) == 0, F.lit(False))
    found = manifest(docs, changed, F.translate("text", letters, letters.lower()), fanout)
    out = found.withColumn("proof_sha256", F.sha2(siblings(F.col("steps")), 256)).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def by_hand(rows: list[tuple], fanout: int = FANOUT) -> list[tuple]:
    """audit() of (doc_id, source, lang, n_chars, text) rows with distinct ids, one after another; for tests."""
    import hashlib
    import zlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    small = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        ways: list[list[tuple[str, str]]] = [[] for _ in nodes]
        held = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            new, new_held = [], []
            for lo in range(0, len(nodes), fanout):
                run = nodes[lo : lo + fanout]
                for k in range(len(run)):
                    for i in held[lo + k]:
                        ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                new.append(h("".join(run)))
                new_held.append([i for x in held[lo : lo + fanout] for i in x])
            nodes, held = new, new_held
        return nodes[0], ways

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is None, r[0] or 0))
        trees[s] = (members, *climb([h("".join(map(one, r))) for r in members]))
    root, tops = climb([trees[s][1] for s in names]) if names else ("", [])
    out = []
    for s, top in zip(names, tops):
        members, subroot, ways = trees[s]
        for r, way in zip(members, ways):
            steps = way + top
            leaf = h("".join(map(one, r)))
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                at = h("".join(map(one, (*r[:4], small(r[4])))))
            for l, rest in steps:
                at = h(l + at + rest)
            out.append((r[0], leaf, subroot, root, h("".join(l + rest for l, rest in steps)), at, at == root))
    return out


def _oracle(levels: int) -> str:
    """audit() in SQL with runs of 16, for at most 16^levels rows of a source and as many sources; doc_ids are distinct."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(enc(c) for c in (*FIELDS[:4], text)) + "))"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tree = []
    for name, start in (("a", "SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST) - 1 AS spot, leaf AS h FROM leaves"), ("b", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS spot, h FROM top_a")):
        tree.append(f"{name}0 AS ({start})")
        for k in range(levels):
            # Groups of one node keep it.
            tree.append(f"{name}{k + 1} AS (SELECT g, spot // 16 AS spot, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY spot)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}) GROUP BY g, spot // 16)")
        tree.append(f"top_{name} AS (SELECT g, h FROM {name}{levels})")
    joins, before = [], []
    for name in "ab":
        for k in range(levels):
            n = f"s{name}{k}"
            tree.append(f"{n} AS (SELECT x.g, x.spot, coalesce(string_agg(y.h, '' ORDER BY y.spot) FILTER (WHERE y.spot < x.spot), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.spot) FILTER (WHERE y.spot > x.spot), '') AS r, max(x.c) > 1 AS some FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}) x JOIN {name}{k} y ON x.g = y.g AND x.spot // 16 = y.spot // 16 GROUP BY x.g, x.spot)")
            place = f"d.spot // {16**k}" if name == "a" else f"t.spot // {16**k}"
            group = "d.g" if name == "a" else "0"
            joins.append(f"JOIN {n} ON {n}.g = {group} AND {n}.spot = {place}")
            before.append(n)
    proof = ", ".join(f"{n}.l, {n}.r" for n in before)
    steps = ", ".join(f"{{'l': {n}.l, 'r': {n}.r, 'some': {n}.some}}" for n in before)
    return f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, {leaf('text')} AS leaf,
         CASE WHEN xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')]),
                       lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 THEN {leaf(small)} END AS other
  FROM documents, crc
), {", ".join(tree)},
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST) - 1 AS spot FROM leaves),
t AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS spot FROM top_a),
way AS (
  SELECT d.doc_id, d.leaf, coalesce(d.other, d.leaf) AS mine, t.h AS subroot, (SELECT h FROM top_b) AS root, sha256(concat({proof})) AS proof_sha256, [{steps}] AS steps
  FROM d JOIN t ON t.g = d.g {" ".join(joins)}
), fold(doc_id, k, h, steps) AS (
  SELECT doc_id, 0, mine, steps FROM way
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN steps[k + 1].some THEN sha256(concat(steps[k + 1].l, h, steps[k + 1].r)) ELSE h END, steps FROM fold WHERE k < {2 * levels}
)
SELECT w.doc_id, leaf, subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM way w JOIN fold f ON w.doc_id = f.doc_id AND f.k = {2 * levels}
"""


#: For at most 65,536 rows of a source.
ORACLE = _oracle(4)
