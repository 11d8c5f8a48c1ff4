"""Lines as well-known binary and text, to and from arrays of points.

Read are line strings and collections of them, in both byte orders, with heights or measures
(which are dropped) and with a reference system's number before the points. A row that is
not one gets no parts and a status instead of stopping the scan. Text is handled by SQL
functions; binary by numpy, over a batch of rows at a time.

Statuses: ok, missing (null), empty (no points), wrong_type (points, areas and so on) and
malformed (cut short, or of no known form).
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LINE

#: Fixed values of the format: kinds of geometry, and the flags of its extended form.
LINE_STRING, MULTI_LINE_STRING = 2, 5
KNOWN = range(1, 18)
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
FLAT = "xs array<double>, ys array<double>, sizes array<int>, status string"


class Malformed(ValueError):
    pass


def _number(raw: bytes, at: int, order: str) -> int:
    if at + 4 > len(raw):
        raise Malformed
    return struct.unpack_from(order + "I", raw, at)[0]


def _parts(raw: bytes, at: int, found: list[np.ndarray]) -> tuple[int, int]:
    """Append the lines of the geometry at a place to found; its kind and where it ends."""
    if at >= len(raw) or raw[at] > 1:
        raise Malformed
    order = "<" if raw[at] else ">"
    code = _number(raw, at + 1, order)
    at += 5
    if code & HAS_SRID:
        at += 4
    kind, more = (code & 0x0FFFFFFF) % 1000, (code & 0x0FFFFFFF) // 1000
    if more > 3 or kind not in KNOWN:
        raise Malformed
    numbers = 2 + bool(code & HAS_Z) + bool(code & HAS_M) + (0, 1, 1, 2)[more]
    if kind not in (LINE_STRING, MULTI_LINE_STRING):
        return kind, at
    n = _number(raw, at, order)
    at += 4
    if kind == LINE_STRING:
        end = at + 8 * numbers * n
        if end > len(raw):
            raise Malformed
        found.append(np.frombuffer(raw, dtype=order + "f8", count=numbers * n, offset=at).reshape(n, numbers)[:, :2])
        return kind, end
    for _ in range(n):
        inner, at = _parts(raw, at, found)
        if inner != LINE_STRING:
            raise Malformed
    return kind, at


def parse(raw: bytes | None) -> tuple[list[np.ndarray], str]:
    """The lines of a geometry, each an array of points, and a status."""
    if raw is None:
        return [], "missing"
    found: list[np.ndarray] = []
    try:
        kind, end = _parts(raw, 0, found)
        if kind not in (LINE_STRING, MULTI_LINE_STRING):
            return [], "wrong_type"
        if end != len(raw) or not all(np.isfinite(p).all() for p in found):
            raise Malformed
    except Malformed:
        return [], "malformed"
    found = [p for p in found if len(p)]
    return found, "ok" if found else "empty"


def build(parts: list[np.ndarray], big_endian: bool = False) -> bytes:
    """A line string, or a collection of them if there is more than one."""
    order, first = (">", b"\0") if big_endian else ("<", b"\1")
    one = lambda p: first + struct.pack(order + "II", LINE_STRING, len(p)) + np.asarray(p, dtype=order + "f8").tobytes()
    if len(parts) == 1:
        return one(parts[0])
    return first + struct.pack(order + "II", MULTI_LINE_STRING, len(parts)) + b"".join(map(one, parts))


def _flat_rows(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        parts, status = parse(None if r is None else bytes(r))
        xy = np.vstack(parts) if parts else np.zeros((0, 2))
        rows.append((xy[:, 0].astype(float), xy[:, 1].astype(float), [len(p) for p in parts], status))
    return pd.DataFrame(rows, columns=["xs", "ys", "sizes", "status"])


def _binary_rows(xs: pd.Series, ys: pd.Series, sizes: pd.Series) -> pd.Series:
    out = []
    for x, y, n in zip(xs, ys, sizes):
        out.append(None if x is None or n is None or not len(n) else build(np.split(np.stack([x, y], axis=1), np.cumsum(n)[:-1])))
    return pd.Series(out, dtype=object)


def with_parts(df: DataFrame, column: str, parts: str = "parts", status: str = "geometry_status") -> DataFrame:
    """df with the lines of a binary or text column as an array of arrays of points, and their status."""
    if dict(df.dtypes)[column] == "string":
        found = df.withColumn("_g", _from_text(F.col(column)))
        return found.withColumn(parts, F.col("_g.parts")).withColumn(status, F.col("_g.status")).drop("_g")
    found = df.withColumn("_g", F.pandas_udf(_flat_rows, FLAT)(F.col(column)))
    points = F.zip_with("_g.xs", "_g.ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    found = found.withColumn("_p", points)
    start = lambda i: F.aggregate(F.slice("_g.sizes", F.lit(1), i), F.lit(0), lambda s, n: s + n)
    cut = F.transform("_g.sizes", lambda n, i: F.slice("_p", start(i) + 1, n))
    return found.withColumn(parts, F.when(F.col("_g.status") == "ok", cut)).withColumn(status, F.col("_g.status")).drop("_g", "_p")


#: A signed decimal number, with an exponent or not, and some of them apart by blanks.
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POINT = rf"\s*{_NUMBER}(?:\s+{_NUMBER}){{1,3}}\s*"
_LIST = rf"\(({_POINT}(?:,{_POINT})*)\)"
_HEAD = r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*"
_DIMENSIONS = r"\s*(?:Z|M|ZM)?\s*"


def _from_text(text: Column) -> Column:
    """A struct of parts and status from well-known text."""
    one = F.regexp_like(text, F.lit(rf"(?i){_HEAD}LINESTRING{_DIMENSIONS}{_LIST}\s*$"))
    many = F.regexp_like(text, F.lit(rf"(?i){_HEAD}MULTILINESTRING{_DIMENSIONS}\(\s*{_LIST}(?:\s*,\s*{_LIST})*\s*\)\s*$"))
    empty = F.regexp_like(text, F.lit(rf"(?i){_HEAD}(?:MULTI)?LINESTRING{_DIMENSIONS}EMPTY\s*$"))
    other = F.regexp_like(text, F.lit(rf"(?i){_HEAD}(?:MULTI)?(?:POINT|POLYGON)|{_HEAD}GEOMETRYCOLLECTION"))
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    points = lambda line: F.transform(F.split(line, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    parts = F.transform(F.regexp_extract_all(text, F.lit(_LIST), F.lit(1)), points)
    status = F.when(text.isNull(), "missing").when(one | many, "ok").when(empty, "empty").when(other, "wrong_type").otherwise("malformed")
    return F.struct(F.when(one | many, parts).alias("parts"), status.alias("status"))


def to_wkb(parts: Column) -> Column:
    """Binary of an array of lines, each an array of points; null if there is none."""
    points = F.flatten(parts)
    return F.when(F.size(points) > 0, F.pandas_udf(_binary_rows, "binary")(points["x"], points["y"], F.transform(parts, lambda p: F.size(p))))


def to_wkt(parts: Column) -> Column:
    """Text of an array of lines; null if there is none."""
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    line = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda q: F.concat_ws(" ", number(q["x"]), number(q["y"]))), ", "), F.lit(")"))
    one = F.concat(F.lit("LINESTRING "), line(F.get(parts, F.lit(0))))
    many = F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(parts, line), ", "), F.lit(")"))
    return F.when(F.size(parts) == 1, one).when(F.size(parts) > 1, many)


def lines_out(df: DataFrame, form: str) -> DataFrame:
    """df with every column of points written as wkb or wkt; any other form leaves it as it is."""
    of = {"wkb": to_wkb, "wkt": to_wkt}.get(form)
    if of is None:
        return df
    return df.select(*[of(F.array(F.col(c))).alias(c) if t == LINE else F.col(c) for c, t in df.dtypes])
