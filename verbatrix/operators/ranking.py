"""Places within groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable


def places(rows: DataFrame, group_col: str, order: list[str], place_col: str = "place", size_col: str = "n") -> DataFrame:
    """``rows`` with each one's place from 1 within its group, and the size of the group.

    ``order`` has names of columns, with ``-`` before one that goes down.  Rows are
    range-partitioned by group and order, so a large group is spread over tasks;
    each task numbers its own rows, and a narrow table of how many rows each task
    has of a group shifts them.  Null is a group of its own and comes first in an
    order that goes up, last in one that goes down; rows that are equal have
    consecutive places.  A name that is taken is an error.
    """
    if {place_col.lower(), size_col.lower()} & {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {place_col} or {size_col} already")
    keys = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    everything = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("r")
    dealt = rows.repartitionByRange(F.col(group_col), *keys).sortWithinPartitions(F.col(group_col), *keys)
    numbered = durable(dealt.select(everything, F.col(group_col).alias("g"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    held = numbered.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = held.select(
        F.col("g").alias("hg"), F.col("part").alias("hp"), (before - F.col("first") + 1).alias("shift"), F.sum("held").over(Window.partitionBy("g")).alias("size")
    )
    joined = numbered.join(shifts, F.col("g").eqNullSafe(F.col("hg")) & (part == F.col("hp")))
    return joined.select("r.*", (F.col("at") + F.col("shift")).alias(place_col), F.col("size").alias(size_col))
