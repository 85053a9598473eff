"""Running values over an order of the whole table, by ranges.

Rows are dealt to ranges of their sort keys, whose bounds Spark samples, so their
number follows the session and their sizes follow the rows. Each range is folded by
itself, and so are the ranges' own results, a row a range; the two are put together.
A group that is most of the table is thereby spread over tasks. Keys may be null
(first) and need no arithmetic; rows with equal keys are in no fixed order, so an
order that must be repeatable has its ties in the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import stored

PART = "__part"


def dealt(rows: DataFrame, group: list[str], order: list[str], tag: str = "ranges") -> DataFrame:
    """The rows, stored, with the number of their range."""
    return stored(rows.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()), tag)


def _last(value: str, order: list[str]) -> Column:
    return F.max_by(value, F.struct(*order))


#: By name: the fold over rows, that of a range, and how what came before the range is put to what came within it.
_KINDS = {
    "sum": (F.sum, lambda v, _: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda v, _: F.min(v), F.least),
    "max": (F.max, lambda v, _: F.max(v), F.greatest),
    "last": (F.last, _last, lambda a, b: F.coalesce(a, b)),
}


def running(ranged: DataFrame, group: list[str], order: list[str], kind: str, value: Column, out: str, inclusive: bool = False) -> DataFrame:
    """Adds the sum, min, max or last of ``value`` over the rows before in the group, and
    with ``inclusive`` the row itself. Without a row before: 0 for sums, else null."""
    fold, of_range, joined = _KINDS[kind]
    within = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("__value", value)
    ends = rows.groupBy(*group, PART).agg(of_range("__value", order).alias("__end"))
    ends = ends.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(PART).alias("__range"), fold("__end").over(across).alias("__before"))
    same = F.col(PART) == F.col("__range")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    rows = rows.withColumn("__inside", fold("__value").over(within)).join(ends, same)
    rows = rows.withColumn(out, joined(F.col("__inside"), F.col("__before")))
    return rows.drop("__value", "__inside", "__before", "__range", *[f"__{g}" for g in group])


def before(ranged: DataFrame, group: list[str], order: list[str], columns: list[str], out: str) -> DataFrame:
    """Adds a struct of ``columns`` of the row before in the group; null for the first row."""
    return running(ranged, group, order, "last", F.struct(*columns), out)


def places(rows: DataFrame, group: list[str], order: list[str], out: str, tag: str = "places") -> DataFrame:
    """Adds a row's place in its group, from 0."""
    ranged = dealt(rows, group, order, tag)
    return running(ranged, group, order, "sum", F.lit(1).cast("long"), out).drop(PART)
