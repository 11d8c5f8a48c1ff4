"""Secrets in texts, with DataFrame functions only: three patterns and a character model.

The model holds, for random strings and for ordinary identifiers, the chance of each
character after the one before. A token's log-likelihood ratio by character says which of
the two it looks like. Both chains are trained from labelled samples that rules make:
random strings over the alphabets of keys (label 1), and identifiers and prose words
joined in the usual ways (label 0), so nothing of the scanned corpus is needed. The
threshold is the sample quantile at which at most `MISS` of the ordinary strings pass.

Spans are in code points, end exclusive. Positions come from splitting a text at the
matches of a pattern: what lies between them and their own lengths add up. Everything is
linear in a text's length and its matches, but for a logarithm, so a text with many
thousand matches and a token of a megabyte are scanned like others.

Defined cases: a null text counts as an empty one and has no spans; repeated rows are
scanned each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of

#: The base patterns, in the order of their kinds. A match of a run pattern
#: that is too short fails, so its least length is written in the pattern itself.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

#: A token that the model looks at: a run of key characters with no letter or digit beside it.
TOKEN = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_=-]{20,}(?![\p{L}\p{N}])"
#: Share of the ordinary sample that may pass the threshold, and strings in each sample.
MISS = 0.0005
SAMPLE = 20_000

#: Parts of ordinary identifiers and prose.
PARTS = (
    "get set is has new old add remove update delete create find make load save open close read write parse format "
    "user name file path data item list map key value index count size type node state event time date start end first "
    "last next previous current default config option request response handler manager service factory builder client "
    "server session message error result table column row field string number integer boolean object array buffer "
    "stream thread process window button image color width height title content text word line page document report "
    "international administration understanding responsibility communication development organisation information "
    "verantwortung gesellschaft entwicklung wissenschaft universitaet geschichte regierung bundesrepublik versicherung "
    "developpement gouvernement administration connaissance responsabilite mouvement organisation environnement "
    "desarrollo gobierno conocimiento responsabilidad movimiento organizacion universidad comunicacion informacion "
    "thing tion ing the and that ther with ment able ness less ful ance ence ship hood ward wise"
).split()


def samples(n: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Labelled strings: random ones and ordinary ones, always the same."""
    draw = random.Random(8)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [digits + "abcdef", upper + digits, lower + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-"]
    keys = ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 64))) for i in range(n)]
    styles = [
        lambda w: "".join(w),
        lambda w: "_".join(w),
        lambda w: "-".join(w),
        lambda w: "/".join(w),
        lambda w: "_".join(w).upper(),
        lambda w: "".join(w).upper(),
        lambda w: w[0] + "".join(x.capitalize() for x in w[1:]),
        lambda w: "".join(x.capitalize() for x in w),
        lambda w: "-".join(w) + str(draw.randint(1, 2030)),
        lambda w: draw.choice(["=", "-", "_", "/"]) * draw.randint(20, 60),
    ]
    plain = []
    while len(plain) < n:
        words = draw.choices(PARTS, k=draw.randint(2, 9))
        s = styles[len(plain) % len(styles)](words)
        if len(s) >= 20:
            plain.append(s)
    return keys, plain


def train(n: int = SAMPLE, miss: float = MISS) -> tuple[list[float], float]:
    """The table of log-likelihood ratios by (character before, character), and the threshold by character."""
    keys, plain = samples(n)
    half = n // 2  # the other half sets the threshold

    def chain(strings: list[str]) -> np.ndarray:
        count = np.full((128, 128), 0.05)
        for s in strings:
            x = np.frombuffer(s.encode(), dtype=np.uint8)
            np.add.at(count, (x[:-1], x[1:]), 1)
        used = [i for i in range(128) if chr(i).isalnum() or chr(i) in "+/_=-"]
        return np.log(count / count[:, used].sum(axis=1, keepdims=True))

    table = chain(keys[:half]) - chain(plain[:half])

    def score(s: str) -> float:
        x = np.frombuffer(s.encode(), dtype=np.uint8)
        return float(table[x[:-1], x[1:]].mean())

    threshold = float(np.quantile([score(s) for s in plain[half:]], 1 - miss))
    return table.round(4).reshape(-1).tolist(), max(threshold, 0.0)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once; a column named inside a lambda is computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join) -> Column:
    """Running totals of an array under `join` (a sum, a maximum): log2(n) rounds, each adding what stands 2^r places before."""
    rounds = F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int")

    def step(totals: Column, r: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), r)
        return F.transform(totals, lambda x, i: F.when(i >= back, join(x, F.get(totals, i - back))).otherwise(x))

    return F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(0), rounds - 1), values, step)).otherwise(values)


def _ends(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, stop, g) of every match as an array, g being the text of a group. Linear in text and matches, but for a logarithm."""
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
    )

    def place(p: Column) -> Column:
        sizes = F.zip_with(F.slice(p["between"], F.lit(1), F.size(p["found"])), p["found"], lambda b, m: b + F.length(m))
        return _once(
            _running(sizes, lambda a, b: a + b),
            lambda stops: F.transform(
                stops,
                lambda stop, i: F.struct((stop - F.length(F.get(p["found"], i))).alias("start"), stop.alias("stop"), F.get(p["g"], i).alias("g")),
            ),
        )

    return _once(parts, place)


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def _meets(spans: Column, s: Column) -> Column:
    """Whether s overlaps one of spans, which are of one kind: the last that starts before s stops is found by halving."""
    bits = F.sequence(F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))
    before = F.aggregate(
        bits,
        F.lit(0),
        lambda n, r: _once(
            n + F.call_function("shiftleft", F.lit(1), r),
            lambda more: F.when((more <= F.size(spans)) & (F.get(spans, more - 1)["start"] < s["stop"]), more).otherwise(n),
        ),
    )
    return F.when(F.size(spans) > 0, _once(before, lambda n: (n > 0) & (F.get(spans, n - 1)["stop"] > s["start"]))).otherwise(F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """Each document's doc_id, text and spans: an array of (start, kind, stop), sorted.

    kind indexes KINDS; the first three are the base patterns, "random" is the model's,
    which only adds tokens that no base span overlaps.
    """
    table, threshold = train()
    # A constant of 128 x 128 numbers.
    ratio = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    assign = F.filter(_ends(t, ASSIGN, 2), lambda s: F.length(s["g"]) >= ASSIGN_LEAST)
    rows = rows.withColumn("_assign", F.when(t.rlike(ASSIGN), _kind(assign, 0)).otherwise(none))
    rows = rows.withColumn("_access", F.when(t.contains("AKIA"), _kind(_ends(t, ACCESS), 1)).otherwise(none))
    rows = rows.withColumn("_hex", F.when(t.rlike(HEX), _kind(_ends(t, HEX), 2)).otherwise(none))
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    rows = rows.withColumn("_tokens", F.when(t.rlike(TOKEN), _ends(t, TOKEN)).otherwise(F.array().cast("array<struct<start:int,stop:int,g:string>>")))

    def looks_random(s: Column) -> Column:
        total = F.aggregate(
            F.split(s["g"], ""),
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(
                F.ascii(c).alias("last"),
                (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(ratio, acc["last"] * 128 + F.ascii(c)))).alias("sum"),
            ),
            lambda acc: acc["sum"],
        )
        return total / (s["stop"] - s["start"] - 1) > F.lit(threshold)

    free = lambda s: ~(_meets(F.col("_assign"), s) | _meets(F.col("_access"), s) | _meets(F.col("_hex"), s))
    rows = rows.withColumn("_random", _kind(F.filter(F.filter("_tokens", free), looks_random), 3))
    return rows.withColumn("spans", F.array_sort(F.concat("_base", "_random"))).select("doc_id", "text", F.col("_base").alias("base"), "spans")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, hash and list of spans, from what scan() returns."""
    names = F.lit(KINDS)
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


#: Code points in a piece of a text that is being masked, so that a span is not looked for from the text's start.
PIECE = 1024


def _part(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop - 1 of a text cut into pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(stop > start, F.substring(some, start - first * PIECE + 1, stop - start)).otherwise("")


def mask(docs: DataFrame, sign: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by `sign`; overlapping spans count as one. A null text stays null."""
    scanned = scan(docs.select(F.struct(*columns_of(docs)).alias("doc_id"), "text"))
    parts = F.struct(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"),
        _running(F.transform("spans", lambda s: s["stop"]), F.greatest).alias("reach"),
    )

    def cutting(p: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(p["reach"], i - 1)).otherwise(0)
        kept = F.transform("spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(_part(p["pieces"], before(i), s["start"]), F.lit(sign))))
        return F.concat(F.array_join(kept, ""), _part(p["pieces"], F.element_at(p["reach"], -1), F.length("text")))

    clean = F.when(F.size("spans") > 0, _once(parts, cutting)).otherwise(F.col("doc_id.text"))
    own = F.col("doc_id")
    return scanned.select(*[clean.alias(c) if c == "text" else own.getField(c).alias(c) for c in docs.columns])


def base_by_hand(text: str | None) -> list[tuple[int, int, int]]:
    """The base spans by Python's re, for tests."""
    import re

    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for kind, p, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(p, text) if len(m[0]) >= least]
    return sorted(out)


def spans_by_hand(text: str | None) -> list[tuple[int, int, int]]:
    """All spans by Python's re and a loop over characters, for tests."""
    import re

    base = base_by_hand(text)
    table, threshold = train()
    out = list(base)
    for m in re.finditer(r"(?<![^\W_])[A-Za-z0-9+/_=-]{20,}(?![^\W_])", text or ""):
        if any(a < m.end() and m.start() < z for a, _, z in base):
            continue
        codes = m[0].encode()
        if sum(table[a * 128 + b] for a, b in zip(codes, codes[1:])) / (len(codes) - 1) > threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def mask_by_hand(text: str, sign: str = "[SECRET]") -> str:
    out, at = "", 0
    for start, _, stop in spans_by_hand(text):
        if start >= at:
            out += text[at:start] + sign
        at = max(at, stop)
    return out + text[at:]


def sha_by_hand(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans).encode()).hexdigest()
