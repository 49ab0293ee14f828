"""Running values along chromosomes in stretches: a window holds a stretch of positions, or a row a stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a stretch.
WIDTH = 100_000


def running(rows: DataFrame, by: list[str], order: list[str | Column], values: dict[str, tuple[Column, str]], at: str = "pos", before_only: bool = False, width: int = WIDTH) -> DataFrame:
    """``rows`` with running values by ``by`` in the order of the position ``at`` and then of ``order``: values[name] is (what,
    "sum" or "max").  ``before_only``: over the rows before a row, else over it too; null where there is none.

    The window within a stretch is followed by one over the stretches' totals, so a chromosome's rows never meet."""
    laid = rows.withColumn("_stretch", F.floor(F.col(at) / width))
    within = Window.partitionBy(*by, "_stretch").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {"sum": F.sum, "max": F.max}
    totals = laid.groupBy(*by, "_stretch").agg(*[kinds[k](c).alias(f"_t_{n}") for n, (c, k) in values.items()])
    totals = totals.select(*by, "_stretch", *[kinds[k](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (_, k) in values.items()])
    out = laid.withColumns({f"_w_{n}": kinds[k](c).over(within) for n, (c, k) in values.items()}).join(totals, [*by, "_stretch"])

    def united(name: str, kind: str) -> Column:
        own, earlier_ = F.col(f"_w_{name}"), F.col(f"_b_{name}")
        if kind == "max":
            return F.when(own.isNull() | (earlier_ > own), earlier_).otherwise(own)
        return F.when(own.isNull() | earlier_.isNull(), F.coalesce(own, earlier_)).otherwise(own + earlier_)

    return out.withColumns({n: united(n, k) for n, (_, k) in values.items()}).drop("_stretch", *[f"{p}{n}" for n in values for p in ("_w_", "_b_")])


def runs(rows: DataFrame, by: list[str], end: Column, order: list[str | Column], width: int = WIDTH) -> DataFrame:
    """``rows`` with run, the position at which their run starts: a row is in the run before it if it starts (pos) before the
    largest ``end`` of all rows before it."""
    reached = running(rows, by, order, {"_reach": (end, "max")}, before_only=True, width=width)
    new = F.col("_reach").isNull() | (F.col("_reach") <= F.col("pos"))
    return running(reached, by, order, {"run": (F.when(new, F.col("pos")), "max")}, width=width).drop("_reach")
