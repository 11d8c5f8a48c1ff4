"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features.

The trees see numbers only: lengths, depth, shares of digits and signs, entropy, parameter
counts, shapes of labels, and the host's suffix by its odds and number in the training
sample. No feature is a word. They are trained in numpy on labelled URLs, second-order
boosting of the logistic loss over binned features. `fit` takes a table of labelled URLs;
without one, `sample_urls` makes them by rule.

Defined cases: a null url, and one without "://", has an empty host and path, fits no rule
and is judged as an empty string; repeated rows are judged each; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ALLOW, BLOCK = "allow", "block"

#: Syllables of made-up words, suffixes, and how an ordinary and an unwanted sample URL choose among these.
SYLLABLES = "an ar be ble co de di ed en er es ha he in ing la le li lo ly ma me mo nd ne no nt on or ou pa ra re ri ro sa sh st ta te th ti tion to un ve wh".split()
SUFFIXES = "com org net edu gov info biz xyz top click de fr es uk io ru cn tk".split()
GOOD_WEIGHTS = [30, 20, 16, 6, 4, 3, 1, 1, 1, 0, 5, 4, 4, 5, 3, 1, 1, 0]
BAD_WEIGHTS = [22, 12, 16, 0, 0, 8, 6, 8, 8, 6, 1, 1, 1, 1, 2, 4, 4, 5]
#: Bound of the training sample from a table of labelled URLs: rows of each kind.
TRAIN_ROWS = 20_000


def _processes(draw: random.Random, pool: int) -> tuple[dict, dict]:
    """Ways of making ordinary URLs, and ways of making unwanted ones, by name; each gives one without its scheme."""
    letters, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mixed = letters + letters.upper() + digits

    def text(alphabet: str, lo: int, hi: int) -> str:
        return "".join(draw.choices(alphabet, k=draw.randint(lo, hi)))

    def word(lo: int = 2, hi: int = 4) -> str:
        while True:
            w = "".join(draw.choices(SYLLABLES, k=draw.randint(lo, hi)))
            if zlib.crc32(w.encode()) % 2 == pool:
                return w

    words = lambda sign, lo, hi: sign.join(word(1, 4) for _ in range(draw.randint(lo, hi)))
    title = lambda sign, lo, hi: sign.join(word(1, 4).capitalize() for _ in range(draw.randint(lo, hi)))
    year = lambda: str(draw.randint(1998, 2026))
    version = lambda: ".".join(text(digits, 1, 2) for _ in range(draw.randint(2, 3)))
    some = lambda x, share: x if draw.random() < share else ""

    def site() -> str:
        name = draw.choice([word(), word(), word(1, 2), word() + "-" + word(), word() + text(digits, 1, 2), text(letters, 2, 5)])
        return draw.choice(["", "", "www.", "www.", word(1, 2) + ".", text(letters, 2, 3) + "."]) + name + some("." + word(1, 2), 0.15) + "." + draw.choices(SUFFIXES, GOOD_WEIGHTS)[0]

    good = {
        "front pages": lambda: site() + draw.choice(["", "/", "/" + word() + "/"]),
        "sections": lambda: site() + "/" + words("/", 1, 4) + draw.choice(["", "/", ".html", ".php"]),
        "encyclopedias": lambda: site() + "/" + draw.choice(["wiki/", "w/", ""]) + title("_", 1, 6) + some("_(" + word() + ")", 0.2) + some("%27s_" + word(), 0.1) + some("#" + title("_", 1, 3), 0.2),
        "source trees": lambda: site() + f"/{word()}/{word()}/{draw.choice(['blob', 'tree', 'raw'])}/{draw.choice(['main', 'master', 'v' + version(), text(hexes, 7, 40)])}/" + words("/", 2, 8) + "/" + draw.choice([title("", 1, 3), words("_", 1, 3)]) + "." + text(letters, 1, 5) + some("#L" + text(digits, 1, 4), 0.2),
        "videos": lambda: site() + draw.choice([f"/watch?{text(letters, 1, 1)}={text(mixed + '-_', 10, 12)}", f"/{text(mixed + '-_', 9, 12)}", f"/v/{text(digits, 7, 10)}"]) + some(f"&{word(1, 1)}={text(mixed, 12, 34)}", 0.2) + some(f"&t={text(digits, 1, 4)}s", 0.2),
        "shops": lambda: site() + draw.choice([f"/dp/{text(letters.upper() + digits, 10, 10)}", f"/{title('-', 2, 6)}/dp/{text(letters.upper() + digits, 10, 10)}", f"/p/{words('-', 2, 6)}-{text(digits, 4, 9)}", f"/products/{words('-', 1, 5)}?{word(1, 2)}={text(digits, 6, 14)}", f"/itm/{text(digits, 10, 13)}"]),
        "forums": lambda: site() + draw.choice([f"/questions/{text(digits, 4, 8)}/{words('-', 3, 9)}", f"/t/{words('-', 2, 8)}/{text(digits, 2, 7)}", f"/viewtopic.php?f={text(digits, 1, 3)}&t={text(digits, 2, 7)}", f"/r/{word()}/comments/{text(letters + digits, 6, 7)}/{words('_', 2, 8)}/"]) + some("#" + text(digits, 2, 8), 0.15),
        "news": lambda: site() + draw.choice([f"/{year()}/{text('01', 1, 1)}{text(digits, 1, 1)}/{text('0123', 1, 1)}{text(digits, 1, 1)}/", f"/{word()}/{year()}/", f"/{word()}/"]) + words("-", 3, 10) + draw.choice(["", "/", ".html", "-" + text(digits, 5, 8), "_" + text(digits, 3, 9) + ".html"]),
        "manuals": lambda: site() + f"/{draw.choice(['docs', 'doc', 'manual', 'en', word()])}/{draw.choice(['latest', 'stable', version()])}/" + words("/", 1, 4) + draw.choice([".html", "/", ""]) + some("#" + words(draw.choice("-._"), 1, 4), 0.4),
        "searches": lambda: site() + f"/{draw.choice(['search', 'find', 's', ''])}?{word(1, 1)}={words('+', 1, 6)}" + "".join(f"&{word(1, 2)}={draw.choice([word(1, 1), text(digits, 1, 3), word(1, 3)])}" for _ in range(draw.choice([0, 0, 1, 2, 4]))),
        "interfaces": lambda: site() + f"/{draw.choice(['api/', ''])}v{text(digits, 1, 1)}/{word()}/" + draw.choice([text(digits, 2, 9), "-".join(text(hexes, k, k) for k in (8, 4, 4, 4, 12)), word()]) + some("/" + word(), 0.4) + some(f"?{word(1, 2)}={words('%2C', 1, 4)}", 0.3),
        "papers": lambda: site() + draw.choice([f"/abs/{text(digits, 4, 4)}.{text(digits, 5, 5)}", f"/pdf/{text(digits, 4, 4)}.{text(digits, 5, 5)}v{text('123', 1, 1)}", f"/10.{text(digits, 4, 4)}/{word(1, 2)}.{year()}.{text(digits, 3, 6)}", f"/article/S{text(digits, 4, 4)}-{text(digits, 4, 4)}({text(digits, 2, 2)}){text(digits, 5, 5)}-{text(digits, 1, 1)}/fulltext"]),
        "downloads": lambda: (lambda n, v: site() + f"/{word()}/{n}/{draw.choice(['releases/download', 'files', 'archive'])}/v{v}/{n}-{v}{draw.choice(['', '-' + word(1, 2), '-x86_64'])}.{draw.choice(['zip', 'tar.gz', 'pdf', 'exe', 'jar'])}")(word(), version()),
        "short links": lambda: text(letters, 2, 6) + "." + draw.choice("co ly io me gl".split()) + "/" + text(mixed, 5, 8),
    }
    bad_suffix = lambda: "." + draw.choices(SUFFIXES, BAD_WEIGHTS)[0]
    plain = lambda: draw.choice(["", "", "www."]) + draw.choice([word(), word() + "-" + word(), word() + text(digits, 1, 3)]) + bad_suffix()
    tail = lambda: draw.choice(["", "/", "/" + word(), "/" + text(letters + digits, 4, 12), "/?" + word(1, 1) + "=" + text(digits, 1, 8), "/" + words("-", 2, 5) + ".html", f"/{title('_', 1, 3)}"])
    value = lambda: draw.choice([text(hexes, 16, 48), text(mixed, 20, 60), "http%3A%2F%2F" + word() + "%2F" + word(), text(digits, 8, 16)])
    bad = {
        "generated hosts": lambda: text(draw.choice([letters, letters + digits, "bcdfghjklmnpqrstvwxz" + digits]), 9, 26) + bad_suffix() + tail(),
        "hyphen farms": lambda: "-".join([*(word(1, 3) for _ in range(draw.randint(3, 6))), *draw.choice([[], [text(digits, 2, 5)]])]) + bad_suffix() + tail(),
        "stacks of subdomains": lambda: ".".join(draw.choice([word(1, 3), text(letters + digits, 4, 12), text(digits, 2, 8)]) for _ in range(draw.randint(4, 7))) + bad_suffix() + tail(),
        "bare addresses": lambda: ".".join(str(draw.randint(1, 254)) for _ in range(4)) + draw.choice(["", ":" + text("12345678", 4, 4)]) + "/" + draw.choice([text(letters + digits, 6, 20), word() + "/" + word() + ".php"]),
        "redirects": lambda: plain() + "/" + draw.choice(["", word(1, 2), text(letters, 1, 3)]) + "?" + "&".join(word(1, 2) + "=" + value() for _ in range(draw.randint(3, 9))),
        "numbered paths": lambda: plain() + "/" + "/".join(draw.choice([text(digits, 3, 12), text(letters + digits, 6, 24), word(1, 2)]) for _ in range(draw.randint(5, 10))) + draw.choice(["", "?" + word(1, 1) + "=" + value()]),
    }
    return good, bad


#: Names of the processes, for those that leave some out.
GOOD_PROCESSES, BAD_PROCESSES = (tuple(x) for x in _processes(random.Random(0), 0))


def sample_urls(n: int = 12_000, seed: int = 6, pool: int = 0, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray]:
    """n labelled URLs (1: unwanted), always the same, half of each kind, by all processes in turn.

    Ordinary ones are made as sites of many sorts name their pages, with deep trees, numbers,
    capitals and long parameters among them; unwanted ones as machines build hosts, paths and
    queries. Words are made up of syllables; those of pool 0 and of pool 1 are disjoint.
    without, only: processes that are left out, or that alone are used.
    """
    draw = random.Random(seed)
    kinds = [[f for name, f in x.items() if name not in without and (not only or name in only)] for x in _processes(draw, pool)]
    y = np.arange(n) % 2 if all(kinds) else np.full(n, int(bool(kinds[1])))
    return [draw.choice(["http://", "https://"]) + kinds[bad][(i // 2) % len(kinds[bad])]() for i, bad in enumerate(y.tolist())], y


FEATURES = (
    "length host_length path_length query_length depth longest_part params longest_value has_fragment digit_ratio host_digit_ratio path_digit_ratio "
    "sign_ratio percent_signs hyphens labels longest_label is_address has_port entropy host_entropy path_entropy vowel_ratio longest_consonant_run "
    "case_changes suffix_length suffix_odds suffix_count"
).split()
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]+")
_CASE = re.compile(r"[a-z][A-Z]|[A-Z][a-z]|[0-9][A-Za-z]|[A-Za-z][0-9]")


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    p = np.fromiter(Counter(s).values(), dtype=float) / len(s)
    return float(-(p * np.log2(p)).sum())


def _digits(s: str) -> float:
    return sum(map(str.isdigit, s)) / max(1, len(s))


def _suffix(url: str | None) -> str:
    m = _URL.search(url or "")
    return m[1].lower().partition(":")[0].rpartition(".")[2] if m else ""


_URL = re.compile(r"://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.S)


def featurise(urls: list[str | None], suffixes: dict[str, tuple[float, float]]) -> np.ndarray:
    """A row of FEATURES for each url. suffixes: log odds and log count of each in the training sample."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        url = url or ""
        m = _URL.search(url)
        host, path, query, mark = (m[1].lower(), m[2], m[3] or "", m[4]) if m else ("", "", "", None)
        name, _, port = host.partition(":")
        labels = name.split(".") if name else []
        parts = [p for p in path.split("/") if p]
        pairs = [p for p in query[1:].split("&") if p]
        out[i] = (
            len(url), len(host), len(path), len(query), len(parts), max(map(len, parts), default=0), len(pairs),
            max((len(p.partition("=")[2]) for p in pairs), default=0), mark is not None, _digits(url), _digits(name), _digits(path),
            sum(not c.isalnum() for c in url) / max(1, len(url)), url.count("%"), name.count("-"), len(labels), max(map(len, labels), default=0),
            bool(labels) and all(map(str.isdigit, labels)), bool(port), _entropy(url), _entropy(name), _entropy(path),
            sum(c in "aeiou" for c in name) / max(1, len(name)), max(map(len, _CONSONANTS.findall(name)), default=0),
            len(_CASE.findall(path + query)), len(labels[-1]) if labels else 0, *suffixes.get(labels[-1] if labels else "", (0.0, 0.0)),
        )
    return out


class Model:
    """Suffix statistics and boosted trees, from labelled URLs."""

    def __init__(self, urls: list[str | None], y: np.ndarray, **options):
        seen: dict[str, list[float]] = {}
        for u, label in zip(urls, y):
            seen.setdefault(_suffix(u), [0.0, 0.0])[int(label)] += 1
        # Eight more rows of either kind, so that a suffix of few rows says little.
        self.suffixes = {s: (float(np.log((c[1] + 8) / (c[0] + 8))), float(np.log1p(sum(c)))) for s, c in seen.items()}
        self.trees = Trees(**options).fit(featurise(urls, self.suffixes), np.asarray(y, dtype=float))

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.score(featurise(urls, self.suffixes)) if len(urls) else np.zeros(0)


def fit(labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Train on labelled(url, label 0 or 1), at most about `rows` of each kind drawn by a hash; on sample_urls() without it."""
    if labelled is None:
        return Model(*sample_urls())
    known = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 30))
    limit = F.when(F.col("label") == 1, F.lit(int(min(1.0, rows / max(1, counts.get(1, 0))) * (1 << 30)))).otherwise(F.lit(int(min(1.0, rows / max(1, counts.get(0, 0))) * (1 << 30))))
    drawn = sorted((r["url"], r["label"]) for r in known.where(draw < limit).select("url", "label").collect())
    if len({label for _, label in drawn}) < 2:
        raise ValueError("labelled URLs of both kinds are needed")
    return Model([u for u, _ in drawn], np.array([label for _, label in drawn]))


class Trees:
    """Boosted trees for a yes-or-no target, over features cut into bins at training quantiles."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, p - y, p * (1 - p))
            self.made.append(tree)
            margin += self._apply(tree, b)
        return self

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = (1 << (self.depth + 1)) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(nodes)
        at = np.zeros(len(b), dtype=int)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            g, h = grad[here].sum(), hess[here].sum()
            value[node] = -self.rate * g / (h + self.penalty)
            if node >= (1 << self.depth) - 1 or len(here) < 2:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                k = b[here, j]
                gl = np.cumsum(np.bincount(k, grad[here], self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(k, hess[here], self.bins + 1))[:-1]
                gain = gl**2 / (hl + self.penalty) + (g - gl) ** 2 / (h - hl + self.penalty) - g**2 / (h + self.penalty)
                gain[(hl < self.least * 0.05) | (h - hl < self.least * 0.05)] = -1
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (float(gain[c]), j, c)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[here] = 2 * node + 1 + (b[here, best[1]] > best[2])
        return feature, cut, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), dtype=int)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        margin = np.full(len(b), self.base)
        for tree in self.made:
            margin += self._apply(tree, b)
        return 1 / (1 + np.exp(-margin))


def host_and_path(url: Column) -> tuple[Column, Column]:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, capitals, capitals.lower()), path


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of each url.

    model: that of fit(), of made-up URLs by default. rules: (verdict, rule), a rule being a host and a path. It fits the host and its
    subdomains where the url's path starts with the rule's; the longest rule wins, then
    the first given.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit() if model is None else model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for url in batches:
            yield pd.Series(shared.value.score(url.where(url.notna(), None).tolist()), dtype="float64")

    host, path = host_and_path(F.col("url"))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        name, slash, rest = r.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, by_rule = F.when(fits, r).otherwise(rule), F.when(fits, verdict).otherwise(by_rule)
    out = pages.select("page_id", F.col("url").alias("_url"), host.alias("host"), path.alias("path")).withColumn("score", score("_url"))
    own = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, own).alias("verdict"), "score")
