"""Order statistics of groups too large to be sorted in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Bits of a value that a round decides, and rounds: values lie within 2^40 of 0 on either side.
BITS, ROUNDS, MIDDLE = 14, 3, 2**40


def at_places(values: DataFrame, wanted: DataFrame, key: str = "product_id", value: str = "cents", times: str | None = None) -> DataFrame:
    """The value at each wanted place (from 0) of its group in ascending order: wanted's key and name, and the value.

    values: key, value (whole numbers, nulls don't count), and where `times` names a column, how often each counts;
    wanted: key, name, place. A round counts, in every group,
    the values of each range of equal leading bits that holds a wanted place by their next bits, and keeps the range
    that holds it; counts are summed before they are shuffled, 2^BITS a range at most, so no task holds a group.
    wanted must be small enough to broadcast: a few rows for each large group. Places beyond a group have no row.
    """
    often = F.col(times) if times else F.lit(1).cast("long")
    codes = values.filter(F.col(value).isNotNull()).select(key, (F.col(value) + MIDDLE).alias("__code"), often.alias("__c"))
    state = wanted.select(key, "name", F.lit(0).cast("long").alias("__head"), F.col("place").cast("long").alias("place"))
    by = Window.partitionBy(key, "__head").orderBy("__next")
    for r in range(ROUNDS - 1, -1, -1):
        asked = F.broadcast(state.select(key, "__head").distinct())
        heads = codes.withColumn("__head", F.shiftright("__code", BITS * (r + 1))).join(asked, [key, "__head"], "left_semi")
        counts = heads.groupBy(key, "__head", F.shiftright("__code", BITS * r).alias("__next")).agg(F.sum("__c").alias("__n"))
        counts = counts.withColumn("__upto", F.sum("__n").over(by))
        here = (F.col("place") >= F.col("__upto") - F.col("__n")) & (F.col("place") < F.col("__upto"))
        state = state.join(counts, [key, "__head"]).filter(here).select(key, "name", F.col("__next").alias("__head"), (F.col("place") - F.col("__upto") + F.col("__n")).alias("place"))
        state = materialize(state, "places")
    return state.select(key, "name", (F.col("__head") - MIDDLE).alias(value))
