"""Mixing sources to target weights: hash-random order, distributed prefix sums.

Sources in code-point order (null last) weigh ``weights``, repeating. The target
of a source is its share of all sizes, but at most ``cap`` times its own size;
what a source can't take is shared again by weight (water filling: one level
``lambda``, target = min(cap * size, lambda * weight)). Each document has a
hash-random key. Keys are uniform, so equal ranges of them are even parts of any
source, a hot one too: sizes are summed by (source, range), offsets are a running
sum over that small table, and only a range's own rows are sorted. The budget is
taken in whole epochs, then from the first documents in key order; the document
at the cut gives the words that are missing, so the budget is met exactly.

Defined results: null texts have size 0 and take nothing; a source of size 0 has
target 0. Null sources form the last source. Ties of keys fall by doc_id; rows
that repeat a doc_id are mixed each for itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, nested, read_table, word_array, word_count

WEIGHTS, CAP = (5, 2, 1), 3
#: Key ranges a source is dealt to, at least; more where a range would hold more rows than this.
RANGES, RANGE_ROWS = 256, 100_000
_KEY_BITS = 60


def hash_key(doc_id: Column) -> Column:
    """60 random bits of an id, the same everywhere and at each run."""
    text = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to one row a source (``source, source_size``)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("__w", weight.cast("long")).withColumn("__cap", F.col("source_size") * cap)
    rows = rows.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    line = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    capped = F.coalesce(F.sum("__cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("__w").over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__level", (total - capped) / open_weight)
    # The first source, by how soon it is full, that the level doesn't fill.
    level = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(Window.partitionBy())["__level"]
    rows = rows.withColumn("target", F.least(F.col("__cap").cast("double"), level * F.col("__w")))
    return rows.drop("__w", "__cap", "__ratio", "__level")


def _takes(docs: DataFrame, weights: tuple, cap: int) -> DataFrame:
    """``doc_id, text_key, source, size, source_size, target, taken`` for every row of ``docs``."""
    group = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", word_count(F.col("text")).alias("size"), hash_key(F.col("doc_id")).alias("key"))
    rows = cut(rows.withColumn("group", group), "mix-rows")
    ranges = max(RANGES, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("range", F.shiftright("key", _KEY_BITS - (ranges - 1).bit_length()).cast("int"))
    parts = cut(rows.groupBy("group", "range").agg(F.first("source").alias("source"), F.sum("size").alias("n")), "mix-parts")
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("group", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    sizes = parts.groupBy("group").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    offsets = offsets.join(targets(sizes, weights, cap).drop("source"), "group")
    inside = Window.partitionBy("group", "range").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(offsets, ["group", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(cap).cast("long"), F.floor(budget / F.col("source_size")))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least("size", budget - epochs * F.col("source_size") - F.col("offset") - F.col("start")))
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", (epochs * F.col("size") + rest).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    return _takes(docs, weights, cap).drop("text_key", "source")


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``number`` (from 0) among rows of equal ``key``, counted by parts: a group
    that holds a third of all rows is spread over the tasks that read it."""
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "mix-repeated").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"{k}_") for k in key], F.col("part").alias("part_"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy(*key, "part").orderBy("at")) - 1
    same = F.col("part") == F.col("part_")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.withColumn("own", own).join(counts, same).withColumn("number", F.col("before") + F.col("own")).select("row", *key, "number")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once an epoch,
    and the ones at a budget's cut with their first words only. Of rows that repeat
    doc_id, text and source, each is given what one of them takes: their words
    follow one another in the mix, so they take three different amounts at most."""
    key = ["id", "text_key", "origin"]
    takes = _takes(docs, WEIGHTS, CAP).withColumnsRenamed({"doc_id": "id", "source": "origin"})
    takes = takes.groupBy(*key, "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    takes = takes.groupBy(*key, "size").agg(F.sum("n").alias("n_rows"), F.sort_array(F.collect_list(F.struct("taken", "n")), False).alias("amounts"))
    takes = cut(takes, "mix-taken").where("amounts[0].taken > 0").withColumnsRenamed({k: f"{k}_" for k in key})
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    rows = nested(docs, F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), F.col("source").alias("origin"))
    once = rows.join(takes.where("n_rows = 1"), same).select("row", "size", F.col("amounts")[0]["taken"].alias("taken"))
    again = _numbered(rows.join(takes.where("n_rows > 1"), same, "left_semi"), key).join(takes, same)
    # The amount of the first entry whose running count passes the number.
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("taken"))
    pick = F.aggregate(
        "amounts", start,
        lambda acc, a: F.struct((acc["seen"] + a["n"]).alias("seen"), F.when(acc["taken"].isNull() & (F.col("number") < acc["seen"] + a["n"]), a["taken"]).otherwise(acc["taken"]).alias("taken")),
        lambda acc: acc["taken"],
    )
    rows = once.unionByName(again.select("row", "size", pick.alias("taken")))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    short = words < F.col("size")
    text = F.when(short, F.array_join(F.slice(word_array(F.col("row.text")), 1, words), " ")).otherwise(F.col("row.text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(short, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 AS cap, source_size * 3 / w AS ratio FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM r),
t AS (SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(round(target) AS BIGINT) // source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, b.source_size, b.target, b.epochs,
             CAST(round(b.target) AS BIGINT) - b.epochs * b.source_size - (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size) AS room
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM p
"""
