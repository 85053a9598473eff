"""Blind comparisons of two candidates: pairs in an order that a hash decides, and what judges chose, told apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored

CHOICES = ("A", "B", "tie")


def _hash(seed: int, *fields: Column) -> Column:
    nul = F.char(F.lit(0))
    parts = [F.lit(str(seed))]
    for f in fields:
        parts += [nul, f]
    return F.sha2(F.concat(*parts), 256)


def _covered(key: str, said: str, *tables: DataFrame) -> None:
    """Every table must have every key of any of them once, and some key at all."""
    every = None
    for i, t in enumerate(tables):
        own = t.select(F.col(key).cast("string").alias("k"), *[F.lit(int(i == j)).alias(f"n{j}") for j in range(len(tables))])
        every = own if every is None else every.unionByName(own)
    counts = every.groupBy("k").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(tables))])
    bad = counts.where(F.col("k").isNull() | F.greatest(*[(F.col(f"n{j}") != 1) for j in range(len(tables))], F.lit(False))).orderBy("k").first()
    if bad:
        raise ValueError(f"{said}: {key} {bad['k']!r} comes {[bad[f'n{j}'] for j in range(len(tables))]} times")
    if every.limit(1).count() == 0:
        raise ValueError(f"{said}: there is none")


def compared(requests: DataFrame, outputs_a: DataFrame, outputs_b: DataFrame, seed: int, partition: str, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The comparisons of a partition's requests (``request_id, case_id, seed, partition``) with the outputs
    (``request_id, text``) of both sides, and the key that tells which side is which. Outputs
    must cover the requests exactly. Neither the order nor the id of a pair gives a side away."""
    chosen = requests.where(F.col("partition") == partition).select("request_id", "case_id", "seed")
    _covered("request_id", "outputs must cover the requests", chosen, outputs_a, outputs_b)
    rows = chosen.join(outputs_a.select("request_id", F.col("text").alias("a")), "request_id").join(outputs_b.select("request_id", F.col("text").alias("b")), "request_id")
    rid = F.col("request_id").cast("string")
    rows = rows.withColumn("swapped", F.conv(F.substring(_hash(seed, rid), 1, 2), 16, 10).cast("int") % 2 == 1)
    first, second = F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a")), F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b"))
    rows = stored(rows.select(F.substring(_hash(seed, rid, first, second), 1, 24).alias("comparison_id"), "request_id", "case_id", "seed", first.alias("first"), second.alias("second"), "swapped"), "comparisons")
    side = lambda one, other: F.when(F.col("swapped"), other).otherwise(one)
    return rows.drop("swapped"), rows.select("comparison_id", side(*names).alias("A"), side(*reversed(names)).alias("B"))


def tallied(key: DataFrame, judgments: DataFrame, criteria: list[str], names: tuple[str, str]) -> DataFrame:
    """``criterion, wins_a, wins_b, ties`` of judgments (``comparison_id`` and a column of choices a
    criterion), which must cover the comparisons exactly. A choice but A, B or tie is an error."""
    _covered("comparison_id", "judgments must cover the comparisons", key, judgments)
    wrong = judgments.where(~F.least(*[F.coalesce(F.col(c).isin(*CHOICES), F.lit(False)) for c in criteria], F.lit(True))).first()
    if wrong:
        raise ValueError(f"{wrong['comparison_id']!r} has a choice that is none of {CHOICES}")
    picks = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("choice")) for c in criteria])).alias("p")
    rows = judgments.select("comparison_id", picks).select("comparison_id", "p.*").join(key, "comparison_id")
    winner = F.element_at(F.create_map(F.lit("A"), F.col("A"), F.lit("B"), F.col("B"), F.lit("tie"), F.lit(None).cast("string")), F.col("choice"))
    rows = rows.select("criterion", "choice", winner.alias("winner"))
    return rows.groupBy("criterion").agg(F.count_if(F.col("winner") == names[0]).alias("wins_a"), F.count_if(F.col("winner") == names[1]).alias("wins_b"), F.count_if(F.col("choice") == "tie").alias("ties"))
