"""Artifacts written from the given tables and read back, each with SQL written apart from it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encoding
from .plans.tables import shared_dir
from .relations import _FRACTION, _SPLIT, _split
from .sequences import _CHAT, _MASKED, _ROWS, _SHOWN, _bits, _chats, _shown
from .sources import publish, scan, token_rows

WIDTH, SEED, TARGET, MOST_WORDS = 65, "scan-28", 300, 5


def _folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, gone when the session ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    folder = publish.Folder(spark, path)
    folder.system.deleteOnExit(folder.path)
    return path


def published_splits(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK-3, SNK-6, GOV-4, GOV-5, GOV-11
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("split", _split(F.col("doc_id")))
    path = _folder(spark, "published")
    publish.publish(spark, {s: docs.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}, path)
    tables, _ = publish.load(spark, path)
    counted = [t.agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("ids"), F.sum("n_chars").cast("long").alias("chars")) for s, t in sorted(tables.items())]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:  # SNK-4, SNK-5, SRC-15, PCK-6: conversations as files of 65 ids a row
    rows = encoding.trained_rows(encoding.stride_rows(_chats(spark, sf_dir).withColumn("g", F.lit("sft")), "g", "conv_id", WIDTH))
    path = _folder(spark, "token-rows")
    token_rows.write(rows.select("row", F.transform("ids", lambda i: i % 65536).alias("ids"), "mask"), path, WIDTH, ["row"])
    token_rows.verify(spark, path)
    back = encoding.trained_rows(token_rows.read(spark, path, 500))
    return back.select("row", _shown(F.col("ids")).alias("ids"), _bits(F.col("mask")).alias("mask"), "n_trained")


def _pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of JSON, of which some are broken or unfit."""
    kind = F.col("doc_id") % 13
    one = F.when(kind == 5, "same").when(kind == 6, "w w w w w w").otherwise(F.sha2("text", 256))
    other = F.when(kind == 3, F.upper(one)).when(kind == 4, "  ").when(kind == 5, "pair").otherwise(F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256))
    whole = F.concat(F.lit('{"instruction": "'), one, F.lit('", "response": "'), other, F.lit('"}'))
    line = F.when(kind == 0, F.concat(F.lit('{"instruction": "'), one)).when(kind == 1, "[1, 2]").when(kind == 2, '{"instruction": "x", "response": 5}').otherwise(whole)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", line.alias("value"))


def _letters() -> Column:
    return F.regexp_count("one", F.lit("a")) + F.regexp_count("other", F.lit("a"))


def seeded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:  # SRC-7, STM-6, SRC-6
    path = _folder(spark, "pair-lines")
    _pair_lines(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    found = scan.scan(spark, path, SEED, TARGET, "instruction", "response", MOST_WORDS, _letters())
    return found.select("start", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.when(F.col("reason").isNull(), F.col("size")).alias("size"), F.col("total").cast("long").alias("total"))


_BY_SPLIT = _SPLIT.format(_FRACTION.format("doc_id"))
SQL = {
    "published_splits": f"SELECT {_BY_SPLIT} AS split, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "binary_rows": f"""WITH {_CHAT}, s AS (SELECT 1 AS g, conv_id AS o, ids, mask FROM x), {_ROWS.format(src='s', step=WIDTH - 1)}
      SELECT row_number() OVER (ORDER BY r) - 1 AS row, {_SHOWN.format('list_transform(ids, lambda i: i % 65536)')} AS ids, mask, {_MASKED} AS n_trained FROM f WHERE {_MASKED} > 0""",
    "seeded_scan": f"""WITH k AS (SELECT doc_id, doc_id % 13 AS k, CASE doc_id % 13 WHEN 5 THEN 'same' WHEN 6 THEN 'w w w w w w' ELSE sha256(text) END AS one, sha256(source || doc_id) AS h FROM documents),
      o AS (SELECT *, CASE k WHEN 3 THEN upper(one) WHEN 4 THEN '  ' WHEN 5 THEN 'pair' ELSE h END AS other FROM k),
      l AS (SELECT *, CASE k WHEN 0 THEN '{{"instruction": "' || one WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{{"instruction": "x", "response": 5}}' ELSE '{{"instruction": "' || one || '", "response": "' || other || '"}}' END AS line FROM o),
      p AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
      z AS (SELECT CAST(('0x' || substring(sha256('{SEED}'), 1, 16))::UBIGINT::HUGEINT % sum(strlen(line) + 1)::HUGEINT AS BIGINT) AS z FROM l),
      a AS (SELECT p.*, row_number() OVER (PARTITION BY k, one, other ORDER BY start) AS nth FROM p, z WHERE start > z OR z = 0),
      j AS (SELECT start, CASE WHEN k = 0 THEN 'invalid_json' WHEN k IN (1, 2) THEN 'invalid_record' WHEN k = 4 THEN 'empty_text' WHEN k = 3 THEN 'copied_answer' WHEN k = 6 THEN 'over_context' WHEN nth > 1 THEN 'exact_duplicate' ELSE 'accepted' END AS reason,
        CAST(length(one) - length(replace(one, 'a', '')) + length(other) - length(replace(other, 'a', '')) AS BIGINT) AS n FROM a),
      t AS (SELECT start, reason, CASE WHEN reason = 'accepted' THEN n END AS size, CAST(coalesce(sum(n) FILTER (reason = 'accepted') OVER (ORDER BY start), 0) AS BIGINT) AS total FROM j)
      SELECT * FROM t WHERE total - coalesce(size, 0) < {TARGET}""",
}

QUERIES = {f.__name__: f for f in (published_splits, binary_rows, seeded_scan)}
