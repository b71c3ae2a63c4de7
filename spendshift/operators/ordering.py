"""Positions in a total order without a single-task sort.

The rows are range-sorted and written to the checkpoint folder, so every partition is
an ordered slice. Slice sizes give each slice's first position; a row adds its place
inside the slice. Only the slice table (one row per slice and group) is windowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendshift.session import checkpoint_dir

_ROW = "__row"
_SLICE = "__slice"


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Add the row's position (from 0) in its group under the given order.

    ``order`` must end in a unique key; range slices then stay even on a hot group.
    """
    checkpoint_dir(df.sparkSession)
    group = list(group)
    ordered = df.orderBy(*[F.col(name) for name in group], *order).checkpoint(eager=True)
    numbered = ordered.withColumn(_ROW, F.monotonically_increasing_id()).withColumn(
        _SLICE, F.shiftright(F.col(_ROW), 33)
    )
    slices = numbered.groupBy(_SLICE, *group).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_ROW).alias("__first")
    )
    before = (
        Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = slices.select(
        _SLICE,
        *group,
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    # Without groups there is one row a slice, so the rows need not be dealt again.
    joined = numbered.join(starts if group else F.broadcast(starts), [_SLICE, *group])
    return joined.withColumn(name, F.col(_ROW) + F.col("__shift")).drop(_ROW, _SLICE, "__shift")
