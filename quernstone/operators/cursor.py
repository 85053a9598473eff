"""Orders over finite tables: epochs, batches and their digests, plans of positions and fields.

Places come from counts by ranges of a hash, so no task ranks the whole table. What
is read next, and where reading goes on later, is in ``stream``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import places


def epochs(rows: DataFrame, id_column: str, seed: str, n_epochs: int, group: Column | None = None) -> DataFrame:
    """Each row once an epoch, with ``place`` in that epoch's hash order (by group)."""
    group = F.lit("") if group is None else group
    spread = rows.withColumn("objective", group).withColumn("epoch", F.explode(F.array(*map(F.lit, range(n_epochs)))))
    key = F.sha2(F.concat_ws(":", F.lit(seed), "objective", F.col("epoch").cast("string"), F.col(id_column).cast("string")), 256)
    return places(spread.withColumn("order_key", key), ["objective", "epoch"], ["order_key", id_column], "place")


def batches(placed: DataFrame, size: int, whole_only: bool) -> DataFrame:
    """Adds ``batch`` within an epoch. Fixed-width streams drop an unfilled last batch, packed ones keep it."""
    out = placed.withColumn("batch", F.expr(f"place div {size}"))
    if not whole_only:
        return out
    count = placed.groupBy("objective", "epoch").agg(F.count(F.lit(1)).alias("rows_"))
    return out.join(count, ["objective", "epoch"]).where(F.col("batch") < F.expr(f"rows_ div {size}")).drop("rows_")


def batch_digests(batched: DataFrame, id_column: str) -> DataFrame:
    """A row a batch: its size and a digest of its ids in order; batches are bounded."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(id_column).cast("string").alias("i")))), lambda s: s["i"]), "\n")
    return batched.groupBy("objective", "epoch", "batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(listed, 256).alias("digest"))


def evenly_spaced(positions: Column, k: int) -> Column:
    """``k`` of an array's entries: entry i * (n - 1) div (k - 1); all of a shorter array."""
    n = F.size(positions)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(positions, (F.floor(i * (n - 1) / F.lit(max(1, k - 1))) + 1).cast("int")))
    return F.when(n <= k, positions).otherwise(picks)


def exposure_steps(steps: Column, planned: int, base: int) -> Column:
    """Step numbers scaled to another plan: at least 1, half to even, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(steps, lambda s: F.greatest(F.lit(1), F.bround(s * planned / base)).cast("long"))))


def lanes(index: Column, weights: dict[str, int]) -> Column:
    """Weighted round robin: the lane at ``index`` modulo the sum of weights."""
    expanded = [name for name, w in weights.items() for _ in range(w)]
    return F.element_at(F.array(*map(F.lit, expanded)), (F.pmod(index, F.lit(len(expanded))) + 1).cast("int"))


def hash_choice(digest: Column, byte: int, options: list[str]) -> Column:
    """One of ``options`` by a byte of a hexadecimal digest."""
    value = F.conv(F.substring(digest, 2 * byte + 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), (value % len(options) + 1).cast("int"))


def mixed_radix(spark: SparkSession, start: int, stop: int, sizes: dict[str, int], seed: str) -> DataFrame:
    """The plan of the indices from ``start`` to before ``stop``."""
    return planned(spark.range(start, stop).select(F.col("id").alias("index")), sizes, seed)


def planned(rows: DataFrame, sizes: dict[str, int], seed: str) -> DataFrame:
    """Adds a value of each field to rows with an ``index``: digits of the index in the radices ``sizes``,
    each shifted by a hash of seed and block, so combinations never collide within a block and each
    value of a field comes equally often."""
    block = math.prod(sizes.values())
    out = rows.withColumn("block", F.expr(f"index div {block}")).withColumn("rest", F.expr(f"index % {block}"))
    below = block
    for name, n in sizes.items():
        below //= n
        shift = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("block").cast("string")), 256), 1, 7), 16, 10).cast("long")
        out = out.withColumn(name, F.pmod(F.expr(f"rest div {below}") + shift, F.lit(n)).cast("int")).withColumn("rest", F.expr(f"rest % {below}"))
    return out.drop("rest")


def planned_once(rows: DataFrame, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """``planned`` for a table by its key, where no combination may come twice: more rows than there are is an error."""
    indexed = places(rows, [], [key], "index")
    capacity = math.prod(sizes.values())
    if indexed.where(F.col("index") >= capacity).limit(1).count():
        raise ValueError(f"there are only {capacity} combinations")
    return planned(indexed, sizes, seed)
