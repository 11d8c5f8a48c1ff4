"""Exact ranks inside groups by hierarchical histograms of key digits.

No table and no group is sorted as a whole. A key is a string of hexadecimal digits. A
group of more than CELL rows is divided into cells by the digits that follow what all its
keys have in common, as many as its size asks for; counts of cells are summed upwards in
steps of STEP digits, and running sums among the siblings of each step give the number of
rows before every cell. A cell that is still too large is divided again by the digits
after its own common ones. So a task holds the rows of a cell or the siblings of a step,
never a group, even if one group has all rows or one key leads most of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that are ranked by a window, and digits of one step of a histogram (4,096 siblings).
CELL, STEP = 4096, 3


def digits(number: Column) -> Column:
    """A 64-bit number as 16 digits that sort as the numbers do."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _shared(lo: Column, hi: Column) -> Column:
    """Leading digits that two keys share."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(lo)), lambda i: F.substr(lo, F.lit(1), i) == F.substr(hi, F.lit(1), i)))


def _before(cells: DataFrame, group: list[str], steps: int) -> DataFrame:
    """cells with _sum: the rows of their parent in cells with smaller keys."""
    up = lambda i: F.substr("_cell", F.lit(1), F.least(F.col("_skip") + STEP * i, F.col("_skip") + F.col("_take")))
    out = cells.withColumn("_sum", F.lit(0).cast("long"))
    for i in range(1, steps + 1):
        sums = cells.groupBy(*group, "_parent", up(i - 1).alias("_over"), up(i).alias("_up")).agg(F.sum("n").alias("_n"))
        ahead = Window.partitionBy(*group, "_parent", "_over").orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*group, "_parent", "_up", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_more"))
        out = out.withColumn("_up", up(i)).join(sums, [*group, "_parent", "_up"]).withColumn("_sum", F.col("_sum") + F.col("_more")).drop("_up", "_more")
    return out


def ranked(rows: DataFrame, group: list[str], key: Column, cell: int = CELL) -> DataFrame:
    """rows with _rank: the rows of the same group with a smaller key.

    rows must be settled (a checkpoint or a written table), its group columns not null, and
    no key may occur twice in a group.
    """
    names = rows.columns
    held = rows.withColumn("_cell", F.lit(""))
    sized = [F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")]
    cells = cut(held.withColumn("_key", key).groupBy(*group, "_cell").agg(*sized).withColumn("_base", F.lit(0).cast("long")))
    divided = False
    while True:
        take = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("n") / F.lit(cell)))).cast("int")
        full = cells.where(F.col("n") > cell).select(*group, "_cell", "_base", _shared(F.col("lo"), F.col("hi")).alias("_skip"), take.alias("_take"))
        most = full.agg(F.max("_take")).first()[0]
        if most is None:
            break
        divided = True
        new = F.when(F.col("_take").isNotNull(), F.substr(F.col("_key"), F.lit(1), F.col("_skip") + F.col("_take"))).otherwise(F.col("_cell"))
        held = cut(
            held.join(full, [*group, "_cell"], "left").withColumn("_key", key)
            .select(*names, F.col("_cell").alias("_parent"), "_base", "_skip", "_take", new.alias("_cell"))
        )
        inside = held.where("_take is not null").withColumn("_key", key).groupBy(*group, "_parent", "_base", "_skip", "_take", "_cell").agg(*sized)
        found = _before(cut(inside), group, -(-most // STEP))
        cells = cut(cells.where(F.col("n") <= cell).unionByName(found.select(*group, "_cell", "n", "lo", "hi", (F.col("_base") + F.col("_sum")).alias("_base"))))
        held = held.select(*names, "_cell")
    order = Window.partitionBy(*group, "_cell").orderBy("_key")
    out = held.withColumn("_key", key)
    if divided:
        out = out.join(cells.select(*group, "_cell", "_base"), [*group, "_cell"])
    else:
        out = out.withColumn("_base", F.lit(0).cast("long"))
    return out.withColumn("_rank", F.col("_base") + F.row_number().over(order) - 1).select(*names, "_rank")
