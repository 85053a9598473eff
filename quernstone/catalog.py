"""Named queries of the library and their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts, finalize, gates, ordered, orders, protection, relations, sequences
from .functions import text as text_functions
from .operators import graph, selection, similarity
from .plans import queries as plans
from .plans.dialect import Duck, Spark
from .plans.tables import stored


def _planned(plan):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = plan(Spark)
        tables = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by split: kept, copies, and those that share a 12-gram with held-out items."""
    found = queries()
    split, copies, shared = (found[n](spark, sf_dir) for n in ("split_assign", "exact_dedup_first_wins", "decontaminate_12gram"))
    rows = split.join(copies.select("doc_id", "kept"), "doc_id").join(shared.select("doc_id", "contaminated"), "doc_id")
    return rows.groupBy("split", "kept", "contaminated").count()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def near_dup_matches(spark: SparkSession, sf_dir: str) -> DataFrame:  # LEX-1..6
    return similarity.near_matches(_documents(spark, sf_dir))


def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:  # CLU-1..3, SPL-2, SPL-4
    """Families of lexical matches and equal texts; each family falls in one split."""
    docs = _documents(spark, sf_dir)
    # Digests stand for texts: they tell equal ones and make the family's key.
    digests = stored(docs.select("doc_id", F.sha2(F.array_join(text_functions.words(F.col("text")), " "), 256).alias("digest")), "family-digests")
    pairs = similarity.family_links(docs).select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = graph.identity_edges(digests, "doc_id", ["digest"])
    families = graph.components(pairs.unionByName(same))
    rows = digests.join(families, digests["doc_id"] == families["node"], "left").select("doc_id", "digest", F.coalesce("family", "doc_id").alias("family"))
    keys = rows.groupBy("family").agg(protection.digests_key(F.col("digest")).alias("key"))
    at = text_functions.unit_fraction(F.col("key"), plans.SALT)
    split = F.when(at < 0.9, "train").when(at < 0.95, "validation").otherwise("test")
    return rows.select("doc_id", "family").join(keys.select("family", split.alias("split")), "family").select("doc_id", "family", "split")


def leakage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:  # SPL-3
    return graph.leaks(family_split(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_leaks"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(plans.SEED), F.char(F.lit(0)), F.col("doc_id").cast("string")), 256)
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return _documents(spark, sf_dir).select("doc_id", digest.alias("priority"), n.alias("n"), F.octet_length("text").cast("long").alias("n_bytes"))


def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-5
    return selection.budget_prefix(_sized(spark, sf_dir), "priority", "n", 100_000, "doc_id").select("doc_id", "n", "total")


def byte_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-6, TOK-2
    """The last document is cut to the bytes that are left."""
    rows = selection.budget_prefix(_sized(spark, sf_dir), "priority", "n_bytes", 500_000, "doc_id")
    return rows.select("doc_id", F.least("n_bytes", F.lit(500_000) - F.col("total") + F.col("n_bytes")).alias("n_bytes"))


def greedy_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-7, WIN-8
    """Documents in id order that share no 12-gram with one accepted before."""
    grams = F.explode(text_functions.shingles(text_functions.words(F.col("text")), 12))
    return selection.greedy_disjoint(_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), grams.alias("g")).select("id", F.xxhash64("g").alias("token")))


def next_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-4
    """Turns of a conversation packed to 64 words."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.select("conv_id", "turn", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    return selection.next_fit(turns, "conv_id", "turn", "n", 64)


OPERATORS = {f.__name__: f for f in (
    near_dup_matches, family_split, leakage_violations, token_budget_prefix, byte_budget_prefix, greedy_disjoint, next_fit_packs,
)}

_PREFIX = f"""SELECT doc_id, n, n_bytes, CAST(sum(n) OVER o AS BIGINT) AS total, CAST(sum(n_bytes) OVER o AS BIGINT) AS total_bytes FROM (
  SELECT doc_id, sha256('{plans.SEED}' || chr(0) || CAST(doc_id AS VARCHAR)) AS priority, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n,
         CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents) x WINDOW o AS (ORDER BY priority, doc_id ROWS UNBOUNDED PRECEDING)"""
_GRAMS = r"""WITH RECURSIVE w AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}_'']+'), ' ') AS norm FROM documents),
 s AS (SELECT norm, min(doc_id) AS sid, string_split(norm, ' ') AS w FROM w GROUP BY norm),
 g AS (SELECT sid, unnest(CASE WHEN len(w) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM s),
 n AS (SELECT sid, count(*) AS n FROM g GROUP BY sid),
 k AS (SELECT a.sid AS x, b.sid AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.sid < b.sid GROUP BY ALL),
 m AS (SELECT x, y, k, p.n + q.n - k AS u, least(p.n, q.n) AS l FROM k JOIN n p ON p.sid = x JOIN n q ON q.sid = y WHERE 5 * k >= 4 * least(p.n, q.n))"""
_FAMILIES = _GRAMS + r""",
 e AS (SELECT x AS a, y AS b FROM m UNION ALL SELECT y, x FROM m UNION ALL SELECT w.doc_id, s.sid FROM w JOIN s USING (norm) UNION ALL SELECT s.sid, w.doc_id FROM w JOIN s USING (norm)),
 r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
 f AS (SELECT w.doc_id, w.norm, min(r.c) AS family FROM w JOIN r ON r.d = w.doc_id GROUP BY ALL),
 q AS (SELECT family, CAST(CAST(('0x' || substring(sha256('quern-1' || chr(0) || sum(('0x' || substring(sha256(norm), 1, 15))::HUGEINT) || ':' || count(*)), 1, 16))::UBIGINT AS DECIMAL(20,0)) AS DOUBLE) / 18446744073709551616.0 AS u FROM f GROUP BY family),
 z AS (SELECT f.doc_id, f.family, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split FROM f JOIN q USING (family))"""
_LONGEST = f"SELECT item_id, max(CASE WHEN n_found > 0 THEN n END) AS longest, max(rate) AS best_rate FROM ({plans.ngram_overlap(Duck)}) o GROUP BY item_id"
OPERATORS_SQL = {
    "near_dup_matches": _GRAMS + """ SELECT x AS left_id, y AS right_id, CASE WHEN 5 * k >= 4 * u THEN 'shingle_jaccard' ELSE 'shingle_containment' END AS metric,
      CASE WHEN 5 * k >= 4 * u THEN k / u ELSE k / l END AS score FROM m""",
    "family_split": _FAMILIES + " SELECT doc_id, family, split FROM z",
    "leakage_violations": _FAMILIES + " SELECT count(*) AS n_leaks FROM (SELECT family FROM z GROUP BY family HAVING count(DISTINCT split) > 1) y",
    "token_budget_prefix": f"SELECT doc_id, n, total FROM ({_PREFIX}) y WHERE total - n < 100000",
    "byte_budget_prefix": f"SELECT doc_id, least(n_bytes, 500000 - total_bytes + n_bytes) AS n_bytes FROM ({_PREFIX}) y WHERE total_bytes - n_bytes < 500000",
}


def queries() -> dict:
    return {p.__name__: _planned(p) for p in plans.ALL} | OPERATORS | sequences.QUERIES | relations.QUERIES | gates.QUERIES | orders.QUERIES | ordered.QUERIES | artifacts.QUERIES | protection.QUERIES | finalize.QUERIES


def oracle_sql() -> dict:
    return {p.__name__: plans.__dict__[p.__name__](Duck) for p in plans.ALL} | OPERATORS_SQL | sequences.SQL | relations.SQL | gates.SQL | ordered.SQL | artifacts.SQL | protection.SQL | finalize.SQL | {"longest_overlap": _LONGEST}
