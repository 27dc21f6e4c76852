"""Numbers of rows and values carried along rows, within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def ranged(df: DataFrame, within: list[str], order: list[Column | str], written: bool = False) -> DataFrame:
    """df with __at and __range: rows dealt out by ranges of group and order and sorted there, so that a large group lies in many tasks.

    __at increases in this order, __range is the task's number. Rows are written twice, for their ranges and their
    places not to change; once if df is `written` already, as ranges are sampled first.
    """
    rows = df if written else materialize(df, "rows")
    placed = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn("__at", F.monotonically_increasing_id())
    return materialize(placed, "ranges").withColumn("__range", F.shiftrightunsigned("__at", 33))


def numbered(df: DataFrame, within: list[str], order: list[Column | str], name: str, written: bool = False) -> DataFrame:
    """df with the number, from 1, of each row among those of its group in this order.

    Each task numbers what it has, and the counts of the ranges before are added.
    """
    return _numbered(ranged(df, within, order, written), within, name).drop("__at", "__range")


def _numbered(placed: DataFrame, within: list[str], name: str) -> DataFrame:
    by = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*within, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    starts = starts.select(*within, "__range", "__first", F.coalesce(F.sum("__n").over(by), F.lit(0)).alias("__before"))
    return placed.join(starts, [*within, "__range"]).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__first", "__before")


def carried(df: DataFrame, within: list[str], order: list[Column | str], values: dict[str, Column], number: str | None = None, written: bool = False) -> DataFrame:
    """df with columns that hold, of each value, the last one in its group up to the row that isn't null; and, where `number` names it, the row's number.

    A range carries its own values; what the ranges before it leave is added: a row of each group and range, and
    the last value that isn't null of those before, whatever a group's size. A value may use `number`.
    """
    placed = ranged(df, within, order, written)
    if number:
        placed = _numbered(placed, within, number)
    placed = placed.withColumns({f"__v_{k}": v for k, v in values.items()})
    inside = Window.partitionBy(*within, "__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*within, "__range").agg(*[F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), F.col("__at"))).alias(f"__e_{k}") for k in values])
    ends = ends.select(*within, "__range", *[F.last(f"__e_{k}", ignorenulls=True).over(before).alias(f"__b_{k}") for k in values])
    own = placed.withColumns({f"__o_{k}": F.last(f"__v_{k}", ignorenulls=True).over(inside) for k in values})
    out = own.join(ends, [*within, "__range"])
    helpers = [f"__{x}_{k}" for x in "vob" for k in values]
    return out.withColumns({k: F.coalesce(f"__o_{k}", f"__b_{k}") for k in values}).drop("__at", "__range", *helpers)
