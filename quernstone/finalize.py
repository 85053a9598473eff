"""Generated answers on their way into a dataset: classified, cleaned, gated, criticised, told from copies, and cut to a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records
from .gates import QUOTATIONS, REFUSALS
from .operators import joins
from .operators.ranges import PART, dealt, running
from .plans.tables import stored
from .sequences import WORD

BUDGET = 4000


def with_critiques(candidates: DataFrame, critiques: DataFrame, key: str) -> DataFrame:
    """Candidates with their critique (``key, decision``) as ``criticised`` and ``decision``. A critique without a candidate, or two
    of one candidate, is an error; a candidate without one is not: it waits."""
    per = critiques.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), F.first("decision").alias("decision"))
    if again := per.where("n_ > 1").first():
        raise ValueError(f"{key} {again[key]!r} has {again['n_']} critiques")
    if stray := per.join(candidates, key, "left_anti").first():
        raise ValueError(f"{key} {stray[key]!r} has a critique but is no candidate")
    return candidates.join(per.select(key, "decision", F.lit(True).alias("criticised")), key, "left").withColumn("criticised", F.coalesce("criticised", F.lit(False)))


def response_key(text: Column) -> Column:
    """What makes two answers the same: their words and marks, whatever case and spacing."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def _gated(results: DataFrame, least: int, most: int, shown: Callable[[Column], Column]) -> DataFrame:
    """Results (``request_id, content, finish``) with all that their text alone tells, each fact once and where the text lies:
    its first mark, what is shown of the clean text, reasons, stanzas and, of those without a reason, response and size."""
    told = joins.result_state(F.col("content"), F.col("finish")) == "generated"
    clean = records.without_markdown(F.coalesce("content", F.lit("")))["clean"]
    rows = results.select("request_id", "finish", F.substring(F.trim("content"), 1, 1).alias("mark"), F.when(told, clean).alias("clean"))
    reasons = records.response_reasons(F.col("clean"), F.lit(least), F.lit(most), REFUSALS, QUOTATIONS)
    rows = rows.withColumn("told", reasons).withColumn("stanzas", records.stanza_counts(F.col("clean")))
    passed = lambda c: F.when(F.size("told") == 0, c)
    return rows.select(
        "request_id", "finish", "mark", shown(F.col("clean")).alias("clean"), "told", "stanzas",
        passed(response_key(F.col("clean"))).alias("response"), passed(F.regexp_count("clean", F.lit(WORD)).cast("long")).alias("size"),
    )


def finalized(requests: DataFrame, results: DataFrame, critiques: DataFrame, least: int, most: int, shown: Callable[[Column], Column] = lambda clean: clean) -> DataFrame:
    """``request_id, state, reasons, clean, size`` of every request (``request_id, form``), by its result
    (``request_id, content, finish``) and critique (``request_id, decision``).

    States, the first that applies: ``missing``, ``unusable``, ``truncated``; ``rejected`` with every reason of the
    answer without its markdown; ``waiting`` without a critique; ``duplicate`` of an accepted answer
    with a smaller id; ``accepted``. Only rejected answers have reasons, and only accepted ones a size in words.
    ``clean`` is what ``shown`` makes of the clean text, all of it by default; what it leaves out is not shuffled."""
    rows = joins.classified(with_critiques(requests, critiques, "request_id"), _gated(results, least, most, shown), "request_id", F.col("mark"), F.col("finish"))
    more = F.array_compact(F.array(
        F.when(records.structural_mismatch(F.col("form"), F.col("stanzas")), "structural_mismatch"),
        F.when(F.col("criticised") & ~F.coalesce(F.col("decision") == "accept", F.lit(False)), "critic_rejected"),
    ))
    made = F.col("state") == "generated"
    rows = rows.withColumn("reasons", F.when(made, F.array_join(F.concat("told", more), ",")).otherwise(""))
    state = F.when(~made, F.col("state")).when(F.col("reasons") != "", "rejected").when(~F.col("criticised"), "waiting").otherwise("accepted")
    rows = stored(rows.withColumn("state", state).select("request_id", "state", "reasons", "clean", "response", "size"), "answers")
    # The first of equal answers is found by its own id, so that copies don't meet in one task.
    first = rows.where("state = 'accepted'").groupBy("response").agg(F.min("request_id").alias("request_id")).withColumn("first", F.lit(True))
    accepted = F.col("state") == "accepted"
    rows = rows.join(first, ["request_id", "response"], "left").withColumn("state", F.when(accepted & F.col("first").isNull(), "duplicate").otherwise(F.col("state")))
    return rows.select("request_id", "state", "reasons", "clean", F.when(accepted, F.col("size")).alias("size"))


def assembled(chunks: list[DataFrame], budget: int) -> DataFrame:
    """Accepted answers of finalized chunks by id, without those an earlier one says, up to and with the one that
    brings their sizes to ``budget``: ``request_id, clean, size, total``. An id of two chunks is an error, and so is a shortfall."""
    rows = chunks[0].where("state = 'accepted'")
    for c in chunks[1:]:
        rows = rows.unionByName(c.where("state = 'accepted'"))
    rows = stored(rows.select("request_id", "clean", "size", response_key(F.col("clean")).alias("response")), "assembled")
    if again := rows.groupBy("request_id").count().where("count > 1").first():
        raise ValueError(f"{again['request_id']!r} is in {again['count']} chunks")
    first = rows.groupBy("response").agg(F.min("request_id").alias("request_id"))
    kept = rows.join(first, ["request_id", "response"], "left_semi").drop("response")
    total = running(dealt(kept, [], ["request_id"], "assembled"), [], ["request_id"], "sum", F.col("size"), "total", inclusive=True).drop(PART)
    total = stored(total, "assembled-totals")
    if total.where(F.col("total") >= budget).limit(1).count() == 0:
        raise ValueError(f"the answers don't reach {budget}")
    return total.where(F.col("total") - F.col("size") < budget)


def _answers(spark: SparkSession, sf_dir: str, odd: int | None = None, **shown: Callable[[Column], Column]) -> DataFrame:
    """Documents as answers to the request of their number, some missing, empty or cut; labels are critiques."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(True) if odd is None else F.col("doc_id") % 2 == odd)
    n = F.col("doc_id")
    requests = docs.select(n.alias("request_id"), F.when(n % 9 == 0, "tercets").otherwise("free").alias("form"))
    content = F.when(n % 13 != 0, F.concat(F.lit("*"), F.regexp_replace("text", r"([.,]) ", "$1\n"), F.lit("*")))
    results = docs.where(n % 11 != 0).select(n.alias("request_id"), content.alias("content"), F.when(n % 17 == 0, "length").otherwise("stop").alias("finish"))
    said = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("request_id")).agg(F.when(F.max("toxic") == 0, "accept").otherwise("reject").alias("decision"))
    return finalized(requests, results, said.join(requests, "request_id", "left_semi"), 1, 40, **shown)


def finalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:  # PLN-7, JOIN-11, JOIN-12, FLT-9, FLT-10, WIN-4
    return _answers(spark, sf_dir, shown=lambda clean: F.sha2(clean, 256))


def assembled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:  # PLN-8: two chunks, even and odd requests
    return assembled([_answers(spark, sf_dir, 0), _answers(spark, sf_dir, 1)], BUDGET).select("request_id", "size", F.col("total").cast("long").alias("total"))


_RULE = r"[ \t]*((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})"
_FINAL = rf"""m AS (SELECT doc_id, doc_id % 13 <> 0 AS has, '*' || regexp_replace(text, '([.,]) ', '\1' || chr(10), 'g') || '*' AS t FROM documents),
 r AS (SELECT doc_id, has, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '{_RULE}') THEN '' ELSE x END), chr(10)) AS t FROM m),
 e AS (SELECT doc_id, CASE WHEN has THEN trim(replace(regexp_replace(t, '\*([^*\n]+)\*', '\1', 'g'), '*', '')) ELSE '' END AS t FROM r),
 c AS (SELECT doc_id, t, sha256(trim(regexp_replace(lower(t), '\s+', ' ', 'g'))) AS h, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_'']+')) AS w,
   list_transform(list_filter(string_split_regex(trim(t), '\n\s*\n'), lambda p: trim(p) <> ''), lambda p: len(list_filter(string_split(p, chr(10)), lambda x: trim(x) <> ''))) AS s FROM e),
 k AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 a AS (SELECT c.doc_id, t, h, k.doc_id IS NOT NULL AS said, CASE WHEN c.doc_id % 11 = 0 THEN 'missing' WHEN c.doc_id % 13 = 0 THEN 'unusable' WHEN c.doc_id % 17 = 0 THEN 'truncated' ELSE 'generated' END AS st,
   array_to_string(list_filter([CASE WHEN len(l) NOT BETWEEN 1 AND 40 THEN 'line_count=' || len(l) || '_expected=1-40' END, CASE WHEN w < len(l) OR w > 600 THEN 'word_count=' || w END, CASE WHEN contains(t, '```') THEN 'markdown_fence' END,
     CASE WHEN regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]') THEN 'control_character' END, CASE WHEN regexp_matches(lower(t), 'as an ai|i cannot|idiot') THEN 'refusal_boilerplate' END, CASE WHEN regexp_matches(lower(t), 'to be or not|license') THEN 'disallowed_quotation' END,
     CASE WHEN len(list_filter(l, lambda x: x IN ('---', '***'))) > 1 THEN 'multiple_poem_separator' END, CASE WHEN c.doc_id % 9 = 0 AND s <> [3, 3, 3] THEN 'structural_mismatch' END, CASE WHEN k.doc_id IS NOT NULL AND toxic IS DISTINCT FROM 0 THEN 'critic_rejected' END], lambda x: x IS NOT NULL), ',') AS why
   FROM c LEFT JOIN k ON k.doc_id = c.doc_id),
 b AS (SELECT doc_id, t, h, CASE WHEN st <> 'generated' THEN st WHEN why <> '' THEN 'rejected' WHEN NOT said THEN 'waiting' ELSE 'accepted' END AS state, CASE WHEN st = 'generated' THEN why ELSE '' END AS reasons FROM a),
 f AS (SELECT *, CASE WHEN state = 'accepted' AND doc_id > min(doc_id) FILTER (state = 'accepted') OVER (PARTITION BY h) THEN 'duplicate' ELSE state END AS final, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM b)"""
SQL = {
    "finalized_answers": f"WITH {_FINAL} SELECT doc_id AS request_id, final AS state, reasons, CASE WHEN final IN ('accepted', 'duplicate', 'waiting', 'rejected') THEN sha256(t) END AS clean, CASE WHEN final = 'accepted' THEN n END AS size FROM f",
    "assembled_answers": f"WITH {_FINAL}, o AS (SELECT doc_id AS request_id, n AS size, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS total FROM f WHERE final = 'accepted') SELECT * FROM o WHERE total - size < {BUDGET}",
}

QUERIES = {f.__name__: f for f in (finalized_answers, assembled_answers)}
