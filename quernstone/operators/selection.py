"""Ordered selections: running totals, budget prefixes, greedy disjoint choice, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import stored
from .ranges import PART, dealt, running


def running_total(rows: DataFrame, key: str, value: str, out: str, tie: str) -> DataFrame:
    """Adds the running sum of ``value`` in the order of hexadecimal hash ``key``, by
    ranges of the key's first two digits: no task sorts the whole table."""
    rows = rows.withColumn("__r", F.substring(key, 1, 2))
    sums = rows.groupBy("__r").agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("__r").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.sum(value).over(inside)).join(F.broadcast(sums.select("__r", before.alias("__b"))), "__r")
    return rows.withColumn(out, (F.col("__in") + F.col("__b")).cast("long")).drop("__r", "__in", "__b")


def budget_prefix(rows: DataFrame, key: str, value: str, target: int, tie: str) -> DataFrame:
    """Rows in hash order up to and with the one whose total reaches ``target``."""
    return running_total(rows, key, value, "total", tie).where(F.col("total") - F.col(value) < target)


def greedy_disjoint(items: DataFrame) -> DataFrame:
    """``id, accepted``: ids in order are accepted if they share no token with an accepted
    one (rows ``id, token``). In a round, a row that is the least of all its tokens is
    accepted, and rows that share a token with it are not. Rounds follow the longest chain
    of conflicts; decided rows take no part in later ones. Items are dealt by token once: a token
    of one row is in no conflict, and tokens of the same rows are one. Tokens are folded to their
    least row before the shuffle, so a token that most rows have costs no single task."""
    each = Window.partitionBy("token")
    shared = items.select("id", "token").repartition("token").distinct().withColumn("n", F.count(F.lit(1)).over(each)).withColumn("same", F.bit_xor(F.xxhash64("id")).over(each))
    every = stored(shared.groupBy("id").agg(F.collect_set(F.when(F.col("n") > 1, F.struct("n", "same"))).alias("tokens")), "greedy-ids")
    rest = stored(every.select("id", F.explode("tokens").alias("token")), "greedy-items")
    accepted, every = stored(every.where("size(tokens) = 0").select("id"), "greedy-accepted"), every.select("id")
    while not rest.isEmpty():
        least = rest.groupBy("token").agg(F.min("id").alias("least"))
        first = rest.join(least, "token").groupBy("id").agg(F.max((F.col("least") < F.col("id")).cast("int")).alias("behind")).where("behind = 0")
        first = stored(first.select("id"), "greedy-accepted")
        gone = rest.join(first, "id", "left_semi").select("token").distinct()
        out = rest.join(gone, "token", "left_semi").select("id").distinct()
        rest = stored(rest.join(out, "id", "left_anti"), "greedy-items")
        accepted = accepted.unionByName(first)
    return every.join(accepted.withColumn("accepted", F.lit(True)), "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def open_dedup(rows: DataFrame, budgets: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """Rows ``id, split, size, keys`` accepted in the order of ids, and where each split closed.

    A row is accepted if its split is still open and no accepted row before it has one of
    its keys, whatever that row's split. A split closes with the row that brings its sizes
    to its budget; rows of a closed split neither enter nor keep others out. Splits without
    a budget stay open. Each round takes the rows of open splits as if none closed later:
    up to the first closing that is right, so that one is settled, and so rounds are as many as splits."""
    rows = stored(rows.select("id", "split", F.col("size").cast("long").alias("size"), "keys"), "open-rows")
    closed: dict[str, int] = {}
    while True:
        shut = F.lit(False)
        for split, last in closed.items():
            shut |= (F.col("split") == split) & (F.col("id") > last)
        live = rows.where(~F.coalesce(shut, F.lit(False)))
        chosen = greedy_disjoint(live.select("id", F.explode("keys").alias("token"))).where("accepted").select("id")
        taken = live.join(chosen, "id", "left_semi").unionByName(live.where(F.size("keys") <= 0)).drop("keys")
        total = running(dealt(taken, ["split"], ["id"], "open-taken"), ["split"], ["id"], "sum", F.col("size"), "total", inclusive=True).drop(PART)
        full = F.lit(False)
        for split in sorted(budgets.keys() - closed.keys()):
            full |= (F.col("split") == split) & (F.col("total") >= budgets[split])
        total = stored(total, "open-totals")
        first = total.where(full).orderBy("id").select("id", "split").first()
        if first is None:
            return total, closed
        closed[first["split"]] = first["id"]


def next_fit(rows: DataFrame, group: str, order: str, length: str, width: int) -> DataFrame:
    """Packs rows in order into bins of ``width`` within a group: a bin closes when the
    next row doesn't fit. Adds ``bin`` (from 0 in its group). The fold is sequential, so
    groups are its unit of parallel work and hold one document family each."""
    listed = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("long").alias("n")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<o:bigint,bin:bigint>>)").alias("out"))

    def step(acc, r):
        full = (acc["used"] > 0) & (acc["used"] + r["n"] > width)
        at = acc["bin"] + F.when(full, 1).otherwise(0)
        used = F.when(full, r["n"]).otherwise(acc["used"] + r["n"])
        return F.struct(at.alias("bin"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(r["o"].alias("o"), at.alias("bin")))).alias("out"))

    packed = listed.select(group, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("p"))
    return packed.select(group, F.col("p.o").alias(order), F.col("p.bin").alias("bin"))
