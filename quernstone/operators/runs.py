"""Contiguous runs over the order of the whole table, and ordered merges.

Whether a row starts a run depends on the row before, which may lie in another range:
the last row of each range is carried over to the next. So runs of any length, one
that is most of the table included, are found by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import PART, before, dealt, places, running


def numbered(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """Adds ``at`` (a row's place in the table) and ``run`` (from 0; a run is of consecutive rows of equal key, null or not)."""
    ranged = running(dealt(rows, [], order, "runs"), [], order, "sum", F.lit(1).cast("long"), "at")
    ranged = before(ranged, [], order, [key], "__last")
    starts = F.col("__last").isNull() | ~F.col(f"__last.{key}").eqNullSafe(F.col(key))
    return running(ranged.withColumn("__start", starts.cast("long")), [], order, "sum", F.col("__start"), "__run", inclusive=True).withColumn("run", F.col("__run") - 1).drop("__last", "__start", "__run")


def books(rows: DataFrame, order: list[str], key: str, line: str, dropped: Column) -> DataFrame:
    """``run, key, first, last, n_lines, n_kept, text, fault`` of each run of lines.

    Lines that are ``dropped`` don't part a run and are not in its text. A range joins
    its own lines first, so what is gathered for one run is a text a range. Faults:
    ``reappears`` for a key that has had a run before, ``empty`` for a run without a line."""
    lines = numbered(rows, order, key).withColumn("__kept", ~F.coalesce(dropped, F.lit(False)) & F.col(line).isNotNull())
    kept = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__kept"), F.struct("at", F.col(line).alias("l"))))), lambda s: s["l"]), "\n")
    parts = lines.groupBy("run", PART).agg(
        F.first(key).alias("key"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n_lines"), F.count_if("__kept").alias("n_kept"), kept.alias("text")
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n_kept") > 0, F.struct("first", "text")))), lambda s: s["text"]), "\n")
    runs = parts.groupBy("run").agg(
        F.first("key").alias("key"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_lines").alias("n_lines"), F.sum("n_kept").alias("n_kept"), text.alias("text")
    )
    earliest = runs.groupBy("key").agg(F.min("run").alias("__first")).withColumnRenamed("key", "__key")
    runs = runs.join(earliest, F.col("key").eqNullSafe(F.col("__key")))
    fault = F.when(F.col("run") > F.col("__first"), "reappears").when(F.col("n_kept") == 0, "empty")
    return runs.withColumn("fault", fault).drop("__first", "__key")


def merged(rows: DataFrame) -> DataFrame:
    """Manifests ``origin, at, id`` (``at``: a row's place in its manifest) merged by id.

    Adds ``place`` in the merged order and ``fault``: ``not_ordered`` where the id isn't
    above the one before in its manifest, else ``repeated`` where a row before in the
    merged order has it. Ids are compared as they are, so their column's type decides the order."""
    ranged = before(dealt(rows, ["origin"], ["at"], "manifests"), ["origin"], ["at"], ["id"], "__last").drop(PART)
    ranged = ranged.withColumn("__late", F.coalesce(F.col("id") <= F.col("__last.id"), F.lit(False))).drop("__last")
    keys = ["id", "origin", "at"]
    placed = running(dealt(ranged, [], keys, "merge"), [], keys, "sum", F.lit(1).cast("long"), "place")
    placed = before(placed, [], keys, ["id"], "__last").drop(PART)
    fault = F.when(F.col("__late"), "not_ordered").when(F.col("__last.id") == F.col("id"), "repeated")
    return placed.withColumn("fault", fault).drop("__late", "__last")


def canonical_first(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows as their sink orders them: by the key as text, with ``place``."""
    return places(rows.orderBy(F.col(key).cast("string")).limit(n).withColumn("__key", F.col(key).cast("string")), [], ["__key"], "place").drop("__key")
