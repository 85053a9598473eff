"""Measures of vectors, series, sketches and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_or_unknown(value: Column) -> Column:
    """A sum that one null makes null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def usage_totals(rows: DataFrame, group: str, value: str, model: str) -> DataFrame:
    """Totals by group, how many rows don't say, and the models seen."""
    return rows.groupBy(group).agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"), F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models"), F.count_if(F.col(model).isNull()).alias("n_without_model"),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def geometry_by_prefix(pairs: DataFrame, name: str, one: str, two: str) -> DataFrame:
    """Dot, norms and cosine of paired vectors for each name, each dotted prefix of it, and all together."""
    levels = F.split(name, r"\.")
    scopes = F.transform(F.sequence(F.lit(0), F.size(levels)), lambda i: F.array_join(F.slice(levels, 1, i), "."))
    sums = pairs.select(F.explode(scopes).alias("scope"), _dot(F.col(one), F.col(two)).alias("d"), _dot(F.col(one), F.col(one)).alias("a"), _dot(F.col(two), F.col(two)).alias("b"))
    out = sums.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("dot"), F.sqrt(F.sum("a")).alias("norm_one"), F.sqrt(F.sum("b")).alias("norm_two"))
    return out.withColumn("cosine", F.when((F.col("norm_one") > 0) & (F.col("norm_two") > 0), F.col("dot") / (F.col("norm_one") * F.col("norm_two"))))


def drift(pairs: DataFrame, group: str, reference: str, candidate: str) -> DataFrame:
    """How far candidates are from their references: mean squared error, cosine distance of
    all values together, symmetric KL of their softmaxes, greatest difference."""
    # Log-softmaxes differ by r - c and a constant, which weighs nothing as both softmaxes add up to 1. The
    # greatest values are a column of their own, or they would be sought again for each value.
    rows = pairs.select(group, F.col(reference).cast("array<double>").alias("r"), F.col(candidate).cast("array<double>").alias("c"))
    rows = rows.select(group, "r", "c", F.explode(F.array(F.struct(F.array_max("r").alias("r"), F.array_max("c").alias("c")))).alias("most"))
    gap = F.zip_with("r", "c", lambda x, y: y - x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    part = lambda v: F.transform(v, lambda x: F.exp(x - F.col(f"most.{v}")))
    weighed = lambda v: total(F.zip_with(part(v), gap, lambda e, g: e * g)) / total(part(v))
    kl = 0.5 * (weighed("c") - weighed("r"))
    rows = rows.select(group, total(F.transform(gap, lambda g: g * g)).alias("se"), F.array_max(F.transform(gap, F.abs)).alias("top"), kl.alias("kl"), _dot(F.col("r"), F.col("c")).alias("d"), _dot(F.col("r"), F.col("r")).alias("a"), _dot(F.col("c"), F.col("c")).alias("b"), F.size("r").alias("n"))
    out = rows.groupBy(group).agg(F.sum("se").alias("se"), F.max("top").alias("max_difference"), F.avg("kl").alias("symmetric_kl"), F.sum("d").alias("d"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n_values"))
    none = lambda c: F.col(c) <= 1e-24
    cosine = F.when(none("a") & none("b"), 1.0).when(none("a") | none("b"), 0.0).otherwise(F.col("d") / F.sqrt(F.col("a") * F.col("b")))
    return out.select(group, (F.col("se") / F.greatest("n_values", F.lit(1))).alias("mean_squared_error"), (1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("cosine_distance"), "symmetric_kl", "max_difference", "n_values")


def turning(snapshots: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """Velocities of two neighbouring intervals and the acceleration between them, whatever the intervals' lengths."""
    line = Window.partitionBy(series).orderBy(step)
    ahead = lambda c, k: F.lead(c, k).over(line)
    rows = snapshots.select(series, F.col(step).alias("step"), F.col(value).alias("x0"), ahead(value, 1).alias("x1"), ahead(value, 2).alias("x2"), (ahead(step, 1) - F.col(step)).alias("d1"), (ahead(step, 2) - ahead(step, 1)).alias("d2"))
    rows = rows.where("x2 IS NOT NULL AND d1 > 0 AND d2 > 0").withColumn("velocity", (F.col("x1") - F.col("x0")) / F.col("d1")).withColumn("next_velocity", (F.col("x2") - F.col("x1")) / F.col("d2"))
    return rows.select(series, "step", "velocity", "next_velocity", ((F.col("next_velocity") - F.col("velocity")) / ((F.col("d1") + F.col("d2")) / 2.0)).alias("acceleration"))


def extrapolated(snapshots: DataFrame, series: str, step: str, value: str, target: Column, most: float) -> DataFrame:
    """The last interval carried on to ``target``; null beyond ``most`` times its length, or where target is not ahead."""
    line = Window.partitionBy(series).orderBy(step)
    rows = snapshots.withColumn("before_", F.lag(step).over(line)).withColumn("was_", F.lag(value).over(line)).withColumn("after_", F.lead(step).over(line))
    rows = rows.where("after_ IS NULL AND before_ IS NOT NULL").withColumn("spacing_", F.col(step) - F.col("before_")).withColumn("ahead_", target - F.col(step))
    allowed = (F.col("ahead_") > 0) & (F.col("spacing_") > 0) & (F.col("ahead_") <= most * F.col("spacing_"))
    return rows.select(series, F.when(allowed, F.col(value) + (F.col(value) - F.col("was_")) * F.col("ahead_") / F.col("spacing_")).alias("forecast"))


def chain_faults(stages: DataFrame, series: str, order: str, start: str, end: str) -> DataFrame:
    """Stages that don't begin where the one before ended, or whose end isn't beyond their start."""
    line = Window.partitionBy(series).orderBy(order)
    rows = stages.withColumn("ended", F.lag(end).over(line))
    fault = F.when(F.col(end) <= F.col(start), "not_increasing").when(F.col("ended").isNotNull() & (F.col("ended") != F.col(start)), "not_connected")
    return rows.select(series, order, fault.alias("fault")).where("fault IS NOT NULL")


#: Fixed values of the sketch's two linear congruential hashes.
PRIME, INDEX_BY, INDEX_PLUS, SIGN_BY, SIGN_PLUS = 2_147_483_647, 1_103_515_245, 12_345, 214_013, 2_531_011


def _wrapped(value: Column, by: int, plus: int) -> Column:
    """value * by + plus in 64 bits that wrap around, from halves that don't: shifts drop what is beyond, and ``by`` is below 2**31."""
    low = F.lit(2**32 - 1)
    right = value.bitwiseAND(low) * F.lit(by) + F.lit(plus)
    left = F.shiftright(value, 32) * F.lit(by) + F.shiftrightunsigned(right, 32)
    return F.shiftleft(left, 32) + right.bitwiseAND(low)


def sketch_slot(value: Column, dim: int, seed: int) -> Column:
    """``slot`` and ``sign`` of an integer: products wrap at 64 bits, remainders are never negative."""
    mixed = lambda by, plus: F.pmod(_wrapped(value.cast("long"), by, plus), F.lit(PRIME).cast("long"))
    return F.struct((mixed(INDEX_BY, seed * INDEX_PLUS) % dim).alias("slot"), (mixed(SIGN_BY, seed * SIGN_PLUS) % 2 * 2 - 1).alias("sign"))


def count_sketch(values: DataFrame, value: str, dim: int, seed: int) -> DataFrame:
    """``slot, total`` of a table of integers: signs are added up where the values are, so no more than the slots is dealt."""
    slots = values.select(sketch_slot(F.col(value), dim, seed).alias("s"))
    return slots.groupBy(F.col("s.slot").alias("slot")).agg(F.sum("s.sign").cast("long").alias("total"))


def bigram_values(ids: Column) -> Column:
    """first * (2**31 - 1) + second of each neighbouring pair."""
    return F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: a.cast("long") * PRIME + b.cast("long"))


def byte_counts(rows: DataFrame, text: str) -> DataFrame:
    pairs = F.regexp_extract_all(F.hex(F.encode(F.col(text), "UTF-8")), F.lit(".."), F.lit(0))
    return rows.select(F.explode(pairs).alias("byte")).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))


def hashed_features(values: DataFrame, key: str, path: str, number: str, text: str, dim: int, seed: int) -> DataFrame:
    """Records flattened to (path, number or text): numbers add their signed log1p to a slot of
    the path, texts add 1 to a slot of path and text; each record's slots have length 1."""
    name = F.when(F.col(number).isNotNull(), F.lit("number")).otherwise(F.col(text))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(path), name), 256)
    little_endian = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    slot = F.pmod(F.conv(little_endian, 16, 10).cast("decimal(20,0)"), F.lit(dim).cast("decimal(20,0)")).cast("long")
    worth = F.when(F.col(number).isNotNull(), F.signum(number) * F.log1p(F.abs(F.col(number)))).otherwise(1.0)
    slots = values.where(F.col(number).isNotNull() | F.col(text).isNotNull()).select(key, slot.alias("slot"), worth.alias("w")).groupBy(key, "slot").agg(F.sum("w").alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return slots.withColumn("weight", F.when(length == 0, 0.0).otherwise(F.col("w") / length)).drop("w")


def graph_edges(nodes: DataFrame) -> DataFrame:
    """``src, dst`` both ways of a tensor inventory (``idx, layer``): neighbours within a layer,
    all of one layer with all of the next present one, nodes without a layer with every node.
    An inventory is metadata; its edges are of the size of the product by definition."""
    layered = nodes.where("layer IS NOT NULL")
    line = Window.partitionBy("layer").orderBy("idx")
    chain = layered.select(F.col("idx").alias("src"), F.lead("idx").over(line).alias("dst")).where("dst IS NOT NULL")
    layers = layered.select("layer").distinct()
    following = layers.select("layer", F.lead("layer").over(Window.orderBy("layer")).alias("layer_after"))
    later = layered.select(F.col("idx").alias("dst"), F.col("layer").alias("layer_after"))
    across = layered.join(following, "layer").join(later, "layer_after").select(F.col("idx").alias("src"), "dst")
    star = nodes.where("layer IS NULL").select(F.col("idx").alias("src")).crossJoin(nodes.select(F.col("idx").alias("dst"))).where("src <> dst")
    one = chain.unionByName(across).unionByName(star)
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
