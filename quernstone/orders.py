"""Global orders and overlaps as distributed plans; their SQL is that of the plan of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import overlap
from .operators.encoding import with_offsets
from .sequences import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n")).withColumn("all", F.lit(0))


def _weight() -> Column:
    return F.when(F.col("lang") == "en", 3).when(F.col("lang") == "fr", 2).otherwise(1)


def fair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-2, WIN-10
    rows = with_offsets(_sized(spark, sf_dir), "lang", "doc_id", "n", "before").withColumn("due", F.col("before") * F.floor(F.lit(6) / _weight())).withColumn("one", F.lit(1))
    return with_offsets(rows, "all", "due", "one", "place", ("lang", "doc_id")).select("doc_id", "lang", (F.col("place") + 1).cast("int").alias("step"), "n", "all")


def exposure_plan(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-4
    rows = with_offsets(fair_schedule(spark, sf_dir), "all", "step", "n", "before").withColumn("total", F.col("before") + F.col("n"))
    return rows.where("total >= 100000").agg(F.min("step").alias("steps"), F.min("total").cast("long").alias("tokens"))


def curriculum_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:  # TOP-8
    rows = _sized(spark, sf_dir).withColumn("easy", -F.col("n_chars")).withColumn("one", F.lit(1))
    n = rows.count()
    placed = with_offsets(rows, "all", "easy", "one", "at", ("doc_id",)).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return placed.select("epoch", "doc_id", F.pmod(F.col("at") - F.col("epoch"), F.lit(n)).cast("long").alias("place"))


def stride_spans(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-1
    rows = with_offsets(_sized(spark, sf_dir), "source", "doc_id", "n", "first_token").where("n > 0")
    return rows.select("source", "doc_id", "first_token", F.expr("greatest(first_token - 1, 0) div 64").alias("first_row"), F.expr("(first_token + n - 1) div 64").alias("last_row"))


def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG-10, JOIN-13
    return overlap.overlap_rates(_table(spark, sf_dir, "benchmark"), "item_id", _table(spark, sf_dir, "documents"), "text")


def longest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG-10
    rates = ngram_overlap(spark, sf_dir)
    return rates.groupBy("item_id").agg(F.max(F.when(F.col("n_found") > 0, F.col("n"))).alias("longest"), F.max("rate").alias("best_rate"))


def decontaminate_12gram(spark: SparkSession, sf_dir: str) -> DataFrame:  # DEC-3, JOIN-13
    return overlap.contaminated(_table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "benchmark"), "text")


def protected_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-7, SET-4
    """Documents whose folded text no benchmark item has; digests are compared, not texts."""
    digest = F.sha2(F.lower("text"), 256).alias("digest")
    rows = _table(spark, sf_dir, "documents").select("doc_id", digest)
    return rows.join(_table(spark, sf_dir, "benchmark").select(digest), "digest", "left_anti").select("doc_id")


QUERIES = {f.__name__: f for f in (exposure_plan, curriculum_cyclic, stride_spans, ngram_overlap, longest_overlap, decontaminate_12gram, protected_antijoin)}
QUERIES["fair_schedule"] = lambda spark, sf_dir: fair_schedule(spark, sf_dir).select("doc_id", "lang", "step")
