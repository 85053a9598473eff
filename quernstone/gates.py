"""Record constructors and gates bound to the given tables, each with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records
from .functions.text import words

REFUSALS, QUOTATIONS = ("as an ai", "i cannot", "idiot"), ("to be or not", "license")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def poem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:  # PRJ-1, PRJ-4, PRJ-6
    rows = _docs(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 12))).withColumn("rights", F.when(F.col("lang") == "de", "licensed").otherwise("unknown"))
    made = records.provenance(F.col("source"), F.format_string("%08d", "doc_id"), F.col("rights"), F.lit(None).cast("string"))
    return rows.select("doc_id", records.slug(F.coalesce("title", F.lit("***"))).alias("document_id"), records.titled_prompt(F.col("title"), F.col("source")).alias("prompt"), made.alias("p")).select("doc_id", "document_id", "prompt", "p.locator", "p.rights")


def web_documents(spark: SparkSession, sf_dir: str) -> DataFrame:  # PRJ-2, GOV-1, GOV-2
    rights = F.element_at(F.array(*map(F.lit, ("denied", "synthetic", "licensed", "unknown", "permission"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _docs(spark, sf_dir).select("doc_id", rights.alias("rights"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("evidence"))
    return rows.select("doc_id", records.rights_fault(F.col("rights"), F.col("evidence"), False).alias("fault")).where("fault IS NOT NULL")


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:  # PRJ-5, XFN-11
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text"))
    return records.paragraphs(rows, "doc_id", "text").select("doc_id", "start_char", "end_char", F.sha2("block", 256).alias("block"))


def block_span_faults(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-29; none must come
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text"))
    return records.misplaced(records.paragraphs(rows, "doc_id", "text"), rows, "doc_id", "text").agg(F.count(F.lit(1)).alias("n_faults"))


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-7
    return _docs(spark, sf_dir).select("doc_id", records.document_hashes(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("h")).select("doc_id", "h.*")


def phrases_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-17, XFN-28
    norm = F.array_join(words(F.col("text")), " ")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("a/b", "../a", "/a", "a/../b", "a//b", "a/.hid"))), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("/x"))
    return _docs(spark, sf_dir).select("doc_id", records.phrase_count(norm, "the").alias("n_phrases"), records.safe_path(path).alias("safe"))


def longest_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-15: of each turn
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", words(F.col("text")).alias("w"))
    return records.longest_repeats(rows, "w", "longest")


def critique_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT-8
    row = {"decision": F.when(F.col("p_size") > 5, "accept").otherwise("reject"), "coherence": F.col("p_size") % 7, "craft": F.col("p_size") % 5, "degeneration": F.col("p_size") == 13, "named_author_imitation": F.col("p_size") == 14, "suspected_quote": F.col("p_partkey") % 10 == 0}
    reasons = records.critique_reasons(row, {"coherence": 3, "craft": 2})
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


def response_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT-9
    rows = _docs(spark, sf_dir)
    reasons = records.response_reasons(F.col("text"), F.lit(2), F.lit(12), REFUSALS, QUOTATIONS)
    return rows.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


def structural_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT-10, XFN-12
    form = F.element_at(F.array(*map(F.lit, ("tercets", "turn", "free"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = _docs(spark, sf_dir).select("doc_id", form.alias("form"), records.stanza_counts(F.regexp_replace("text", r"\. ", ".\n\n")).alias("counts"))
    return rows.select("doc_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), records.structural_mismatch(F.col("form"), F.col("counts")).alias("mismatch"))


def retry_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT-11, PLN-3, XFN-22
    k = F.col("event_id") % 5
    body = F.when(k == 0, '{"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}').when(k == 1, '{"choices": []}').when(k == 2, '{"choices": [{"message": {"content": "  "}}]}').when(k == 3, '{"choices": [{"message": {"content": "ok"}, "finish_reason": "stop"}]}')
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 7 > 0, True).alias("found"), body.alias("body"))
    return rows.select("event_id", records.retry_reason(F.col("found"), F.col("body")).alias("reason")).where("reason IS NOT NULL")


def markdown_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-14, AGG-20
    marked = F.concat(F.lit("***\n"), F.regexp_replace("text", r"(\w+)\. ", "*$1*. * "), F.lit("\n- - -"))
    return _docs(spark, sf_dir).select("doc_id", records.without_markdown(marked).alias("m")).select("doc_id", F.sha2("m.clean", 256).alias("clean"), F.col("m.rules").cast("long").alias("rules"), F.col("m.italics").cast("long").alias("italics"), F.col("m.asterisks").cast("long").alias("asterisks"))


def lineage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:  # GOV-13
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_returnflag").alias("level"), (F.col("l_partkey") % 4).alias("s_data"), (F.col("l_suppkey") % 4).alias("t_data"), (F.col("l_partkey") % 3).alias("s_seed"), (F.col("l_suppkey") % 3).alias("t_seed"),
    )
    return records.lineage_faults(rows.distinct(), F.col("level"), {"A": ["data"]}, {"A": ["seed"], "R": ["data", "seed"]})


def functional_gates(spark: SparkSession, sf_dir: str) -> DataFrame:  # FLT-16, FLT-15
    """Means that lie on a bound turn on the order of addition, so lines are added as they are stored; an order has few.
    An order whose lines all lack a value passes that value's gate."""
    passes = lambda c: F.coalesce(c, F.lit(True))
    checks = {"discount": passes(F.col("d") <= 0.05), "quantity": passes(F.col("q") >= 25), "lines": F.col("n") < 6}
    place = F.struct("_metadata.file_path", "_metadata.row_index", "l_discount", "l_quantity")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(place)).alias("l"), F.count(F.lit(1)).alias("n"))
    rows = lines.select("l_orderkey", records.mean_in_order(F.col("l.l_discount")).alias("d"), records.mean_in_order(F.col("l.l_quantity")).alias("q"), "n")
    return rows.select("l_orderkey", F.array_join(records.gate_reasons(checks), ",").alias("reasons"))


_LIST = "array_to_string(list_filter([{}], lambda r: r IS NOT NULL), ',')"
_BLANK = "regexp_replace(text, '\\. ', '.' || chr(10) || chr(10), 'g')"
SQL = {
    "poem_documents": r"""WITH d AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN substring(text, 1, 12) END AS title FROM documents), s AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '***')), '[^a-z0-9-]+', '-', 'g'), '-') AS g FROM d)
      SELECT doc_id, CASE WHEN g <> '' THEN g ELSE substring(sha256(coalesce(title, '***')), 1, 16) END AS document_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN 'Write a poem called "' || trim(title) || '".' ELSE 'Write a poem in the style of ' || source || '.' END AS prompt,
        source || '#' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS locator, CASE WHEN lang = 'de' THEN 'licensed' ELSE 'unknown' END AS rights FROM s""",
    "web_documents": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'denied' WHEN 1 THEN 'synthetic' ELSE 'no_evidence' END AS fault FROM documents WHERE doc_id % 5 IN (0, 1) OR (doc_id % 5 IN (2, 4) AND doc_id % 2 <> 0)",
    "paragraph_blocks": f"""WITH t AS (SELECT doc_id, string_split({_BLANK}, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM t),
      o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(CASE WHEN trim(line, chr(32) || chr(9)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u)
      SELECT doc_id, CAST(min(pos) AS INT) AS start_char, CAST(max(pos + length(line)) AS INT) AS end_char, sha256(string_agg(line, chr(10) ORDER BY i)) AS block FROM o WHERE trim(line, chr(32) || chr(9)) <> '' GROUP BY doc_id, run""",
    "block_span_faults": "SELECT 0::BIGINT AS n_faults",
    "document_hashes": r"SELECT doc_id, sha256(doc_id || chr(0) || source || chr(0) || text) AS document, sha256(text) AS raw, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS cleaned FROM documents",
    "phrases_and_paths": r"""WITH n AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}_'']+'), ' ') AS t FROM documents)
      SELECT doc_id, CAST(len(string_split(t, 'the')) - 1 AS BIGINT) AS n_phrases, doc_id % 6 IN (0, 5) AS safe FROM n""",
    "longest_repeats": r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}_'']+') AS w FROM conversations), n AS (SELECT *, unnest(range(1, len(w) // 2 + 1)) AS n FROM w),
      g AS (SELECT conv_id, turn, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n) x), r AS (SELECT conv_id, turn, n FROM g GROUP BY ALL HAVING count(DISTINCT g) < count(*))
      SELECT w.conv_id, w.turn, coalesce(max(r.n), 0) AS longest FROM w LEFT JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn GROUP BY ALL""",
    "critique_reasons": "SELECT p_partkey, " + _LIST.format("""CASE WHEN p_size <= 5 THEN 'critic_rejected' END, CASE WHEN p_size % 7 < 3 THEN 'coherence=' || p_size % 7 END, CASE WHEN p_size % 5 < 2 THEN 'craft=' || p_size % 5 END,
      CASE p_size WHEN 13 THEN 'critic_detected_degeneration' END, CASE p_size WHEN 14 THEN 'critic_detected_named_author_imitation' END, CASE WHEN p_partkey % 10 = 0 THEN 'critic_suspected_quote' END""") + " AS reasons FROM part",
    "response_reasons": r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, len(regexp_extract_all(text, '[\p{L}\p{N}_'']+')) AS w FROM documents) SELECT doc_id, """
    + _LIST.format("""CASE WHEN len(l) NOT BETWEEN 2 AND 12 THEN 'line_count=' || len(l) || '_expected=2-12' END, CASE WHEN w < len(l) OR w > 600 THEN 'word_count=' || w END, CASE WHEN contains(text, '```') THEN 'markdown_fence' END,
      CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') THEN 'control_character' END, CASE WHEN regexp_matches(lower(text), 'as an ai|i cannot|idiot') THEN 'refusal_boilerplate' END,
      CASE WHEN regexp_matches(lower(text), 'to be or not|license') THEN 'disallowed_quotation' END, CASE WHEN len(list_filter(l, lambda x: x IN ('---', '***'))) > 1 THEN 'multiple_poem_separator' END""") + " AS reasons FROM l",
    "structural_mismatches": rf"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(trim({_BLANK}), '\n\s*\n'), lambda p: trim(p) <> '') AS s FROM documents), c AS (SELECT doc_id, list_transform(s, lambda p: len(list_filter(string_split(p, chr(10)), lambda x: trim(x) <> ''))) AS c FROM s)
      SELECT doc_id, array_to_string(c, ',') AS counts, CASE doc_id % 3 WHEN 0 THEN c <> [3, 3, 3] WHEN 1 THEN NOT (len(c) = 3 AND c[2] = 1 AND c[1] <> c[3]) ELSE false END AS mismatch FROM c""",
    "retry_reasons": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing_result' WHEN event_id % 5 IN (1, 4) THEN 'invalid_response' WHEN event_id % 5 = 2 THEN 'missing_message_content' ELSE 'completion_limit' END AS reason
      FROM events WHERE event_id % 7 = 0 OR event_id % 5 <> 3""",
    "markdown_cleaned": r"""WITH m AS (SELECT doc_id, '***' || chr(10) || regexp_replace(text, '([0-9A-Za-z_]+)\. ', '*\1*. * ', 'g') || chr(10) || '- - -' AS t FROM documents), l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM m),
      r AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_full_match(x, '[ \t]*((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})'))) AS rules, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '[ \t]*((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})') THEN '' ELSE x END), chr(10)) AS t FROM l),
      i AS (SELECT doc_id, rules, len(regexp_extract_all(t, '\*([^*\n]+)\*')) AS italics, regexp_replace(t, '\*([^*\n]+)\*', '\1', 'g') AS t FROM r)
      SELECT doc_id, sha256(trim(replace(t, '*', ''))) AS clean, CAST(rules AS BIGINT) AS rules, CAST(italics AS BIGINT) AS italics, CAST(len(string_split(t, '*')) - 1 AS BIGINT) AS asterisks FROM i""",
    "lineage_faults": """WITH r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_returnflag AS f, l_partkey % 4 = l_suppkey % 4 AS d, l_partkey % 3 = l_suppkey % 3 AS s, l_partkey % 4 AS a, l_suppkey % 4 AS b, l_partkey % 3 AS c, l_suppkey % 3 AS e FROM lineitem)
      SELECT id, 'data differs' AS fault FROM r WHERE f = 'A' AND NOT d UNION ALL SELECT id, 'seed is shared' FROM r WHERE f IN ('A', 'R') AND s UNION ALL SELECT id, 'data is shared' FROM r WHERE f = 'R' AND d""",
    "functional_gates": "SELECT l_orderkey, " + _LIST.format("CASE WHEN avg(l_discount) > 0.05 THEN 'discount' END, CASE WHEN avg(l_quantity) < 25 THEN 'quantity' END, CASE WHEN count(*) >= 6 THEN 'lines' END") + " AS reasons FROM lineitem GROUP BY l_orderkey",
}

QUERIES = {f.__name__: f for f in (
    poem_documents, web_documents, paragraph_blocks, block_span_faults, document_hashes, phrases_and_paths, longest_repeats, critique_reasons, response_reasons,
    structural_mismatches, retry_reasons, markdown_cleaned, lineage_faults, functional_gates,
)}
