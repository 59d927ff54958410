"""Row numbers by distributed prefix sums: no task holds more than a range of the order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.scratch import free_name, materialise

_ROWS = 33  #: bits of the row's number within its partition, in monotonically_increasing_id


def numbered(df: DataFrame, order: list[Column], name: str, within: list[str] | None = None, spread: bool = False) -> DataFrame:
    """``df`` and ``name``, a bigint: 1, 2, 3, ... in ``order``, in each group of ``within`` (one group without any).

    The rows are dealt by ranges of group and order, so that a group of any size fills as many tasks as its share of the
    rows.  Each range is counted by group, and what lies before a range is added to the numbers within it.  ``df`` is read
    twice (once for the sample that sets the ranges) and its sorted rows are written to the shared folder.

    Nulls in ``within`` are a group; nulls in the order stand where the order puts them.  Rows that are equal in group and
    order have any order among each other and meet in one range; ``spread`` parts those too, by their place in ``df``,
    which has to be a stored table then.  An empty table gives an empty one.
    """
    within = within or []
    tie, at, part, first, before = (free_name([*df.columns, name], c) for c in ("_tie", "_at", "_part", "_first", "_before"))
    keys = [*(F.col(c) for c in within), *order]
    if spread:
        df, keys = df.withColumn(tie, F.monotonically_increasing_id()), [*keys, F.col(tie)]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    placed = materialise(sorted_.withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(at, _ROWS))
    ranges = placed.groupBy(part, *within).agg(F.count("*").alias(name), F.min(at).alias(first))
    # one row for each range of a group: few for any group
    earlier = F.coalesce(F.sum(name).over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn(before, earlier).drop(name).alias("r")
    same = reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [part, *within]))
    return placed.alias("l").join(ranges, same).select(*(F.col(f"l.{c}") for c in df.columns if c != tie), (F.col(f"l.{at}") - F.col(f"r.{first}") + F.col(f"r.{before}") + 1).alias(name))
