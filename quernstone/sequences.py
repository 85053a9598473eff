"""Encodings, rows, chunks, packs and cursors bound to the given tables, each with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cursor, encoding, stream

WORD = r"[^\x20\x09-\x0D]+"
#: Marks of a tokenizer's first ids; words have ids from 16 on.
MARKS = {"bos": 1, "eos": 2, "prompt": 3, "thought": 4, "poem": 5, "system": 6, "user": 7, "assistant": 8}
WEIGHTS = {"de": 1, "en": 3, "es": 0, "fr": 2}
#: Trained positions and rows of a batch at which a conversation stream may stop.
STOP = (2000, 4)
FIELDS = {"form": 4, "mood": 3, "theme": 5}


def word_ids(text: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 4), 16, 10).cast("int") + 16)


def _shown(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def _bits(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.when(m, "1").otherwise("0")), "")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: their first eight words prompt for the others; toxic ones think their quality."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", word_ids(F.col("text")).alias("w"), "quality", "toxic")
    thought = F.when(F.col("toxic") == 1, F.array(F.col("quality") + 9))
    made = encoding.conditional(F.slice("w", 1, 8), thought, F.expr("slice(w, 9, greatest(size(w) - 8, 0))"), MARKS)
    return rows.select("doc_id", "lang", made.alias("s")).select("doc_id", "lang", "s.ids", "s.mask")


def conditional_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:  # TOK-4
    return _examples(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("n"), _shown(F.col("ids")).alias("ids"), encoding.supervised(F.col("mask")).alias("n_trained"))


def continuation_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:  # TOK-5
    rows = _table(spark, sf_dir, "documents").select("doc_id", encoding.continuation(word_ids(F.col("text")), MARKS).alias("s"))
    return rows.select("doc_id", _shown(F.col("s.ids")).alias("ids"), encoding.supervised(F.col("s.mask")).alias("n_trained"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("w", word_ids(F.col("text")))
    return encoding.chat(turns, "conv_id", "turn", "role", "w", MARKS)


def chat_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:  # TOK-6, TOK-7
    n = F.size("ids").cast("long")
    return _chats(spark, sf_dir).select("conv_id", _shown(F.col("ids")).alias("ids"), _bits(F.col("mask")).alias("mask"), n.alias("n_formatted"), (n - 1).alias("n_input"), encoding.supervised(F.col("mask")).alias("n_trained"))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-2, FLT-13, SNK-5: one line of all conversations in rows of 65
    rows = encoding.trained_rows(encoding.stride_rows(_chats(spark, sf_dir).withColumn("g", F.lit("sft")), "g", "conv_id", 65))
    return rows.select("row", _shown(F.col("ids")).alias("ids"), _bits(F.col("mask")).alias("mask"), "n_trained")


def chat_rows_until(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-2: whole conversations until 2,000 trained positions in batches of 4 rows
    rows = encoding.rows_until(_chats(spark, sf_dir), "conv_id", 65, *STOP)
    return rows.select("row", _shown(F.col("ids")).alias("ids"), _bits(F.col("mask")).alias("mask"), "n_trained")


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-1, WIN-9, SNK-4: each source's documents in rows of 129
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", encoding.continuation(word_ids(F.col("text")), MARKS).alias("s")).select("doc_id", "source", "s.*")
    return encoding.stride_rows(rows, "source", "doc_id", 129).select("source", "row", _shown(F.col("ids")).alias("ids"))


def chunked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-3: target-aware, width 64
    rows = encoding.chunks(_examples(spark, sf_dir), 64)
    return rows.select("doc_id", "chunk", _shown(F.col("ids")).alias("ids"), encoding.supervised(F.col("mask")).alias("n_trained"))


def shifted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-7, PCK-8: padded to the longest of sixteen
    rows = encoding.chunks(_examples(spark, sf_dir), 64).withColumn("batch", F.expr("doc_id div 16"))
    longest = rows.groupBy("batch").agg((F.max(F.size("ids")) - 1).alias("longest"))
    made = rows.join(longest, "batch").select("doc_id", "chunk", encoding.trained_positions(F.col("mask")).alias("at"), encoding.shifted(F.col("ids"), F.col("mask"), F.col("longest"), 0).alias("b"))
    return made.select("doc_id", "chunk", F.array_join(F.col("at").cast("array<string>"), ",").alias("positions"), _shown(F.col("b.inputs")).alias("inputs"), _shown(F.col("b.targets")).alias("targets"), _bits(F.col("b.mask")).alias("mask"))


def pack_faults(spark: SparkSession, sf_dir: str) -> DataFrame:  # PCK-5
    return encoding.pack_faults(_examples(spark, sf_dir).withColumnRenamed("doc_id", "pack_id"), 1000, 65000)


def _batched(spark: SparkSession, sf_dir: str, whole_only: bool) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"))
    return cursor.batches(cursor.epochs(rows, "doc_id", "order-1", 2, F.col("lang")), 16, whole_only)


def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-1, TOP-7, STM-3 (packed streams keep the last batch)
    return cursor.batch_digests(_batched(spark, sf_dir, False), "doc_id")


def whole_batches(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-3 (fixed-width streams drop it)
    return cursor.batch_digests(_batched(spark, sf_dir, True), "doc_id")


#: What else than its rows decides a stream's order.
RULES = {"seed": "order-1", "batch": 16, "weights": sorted(WEIGHTS.items())}


def _scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batched(spark, sf_dir, False)
    sums = rows.groupBy("objective", "epoch", "batch").agg(F.sum("n").alias("n_tokens"))
    return stream.schedule(sums.join(cursor.batch_digests(rows, "doc_id"), ["objective", "epoch", "batch"]), WEIGHTS)


def batch_probe(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-8: three batches after two more than four, nothing moved
    return stream.probe(_scheduled(spark, sf_dir), 4, 2, 3).select("step", "objective", "epoch", "batch", "n_rows", "digest")


def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-1: what is left after seven batches
    scheduled = _scheduled(spark, sf_dir)
    content = stream.content_digest(_table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text")), "doc_id", "lang", "text")
    rest = stream.resume(scheduled, stream.state(scheduled, 7, content, RULES), content, RULES)
    return rest.select("step", "objective", "epoch", "batch", "n_rows", "n_tokens", "digest")


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-1, STM-2: epoch, position and tokens of each objective after seven batches
    saved = stream.state(_scheduled(spark, sf_dir), 7, "", RULES)
    rows = [(o, saved["epochs"][o], saved["positions"][o], saved["tokens"][o]) for o in sorted(saved["epochs"])]
    return spark.createDataFrame(rows, "objective string, epoch int, position int, tokens long")


def fair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:  # STM-2, WIN-10, FLT-12
    return _scheduled(spark, sf_dir).select("step", "objective", "epoch", "batch", F.col("due").cast("long").alias("due"))


def spaced_positions(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-14, GOV-14: five of a row's trained positions, bound by a digest
    rows = _examples(spark, sf_dir).select("doc_id", cursor.evenly_spaced(encoding.trained_positions(F.col("mask")), 5).alias("at"))
    shown = F.array_join(F.col("at").cast("array<string>"), ",")
    return rows.select("doc_id", shown.alias("positions"), F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), shown), 256).alias("commitment"))


def prompt_plan(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-19, PLN-2, PLN-1, XFN-20, TOP-4: a form, mood, theme, lane and brief for every part
    parts = cursor.places(_table(spark, sf_dir, "part").select("p_partkey"), [], ["p_partkey"], "index")
    plan = cursor.planned(parts, FIELDS, "plan-1")
    digest = F.sha2(F.concat_ws(":", F.lit("brief"), F.col("p_partkey").cast("string")), 256)
    return plan.select("*", cursor.lanes(F.col("index"), {"a": 3, "b": 2, "c": 1}).alias("lane"), cursor.hash_choice(digest, 3, ["sea", "hill", "road"]).alias("brief"))


def scaled_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-27, PLN-6
    steps = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.length("text").cast("long"))).alias("steps"))
    return steps.select("conv_id", F.array_join(cursor.exposure_steps(F.col("steps"), 3, 8).cast("array<string>"), ",").alias("steps"))


_IDS = r"list_transform(regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+'), lambda w: ('0x' || substring(sha256(w), 1, 4))::INT + 16)"
_SHOWN = "sha256(array_to_string({}, ','))"
_EXAMPLES = f"""w AS (SELECT d.doc_id, d.lang, {_IDS.format('d.text')} AS w, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
 h AS (SELECT doc_id, lang, w[9:] AS target, [1, 3] || w[1:8] || CASE WHEN toxic = 1 THEN [4, quality + 9] ELSE [] END || [5] AS head FROM w),
 e AS (SELECT doc_id, lang, head || target || [2] AS ids, len(head) AS p, len(head) + len(target) + 1 AS n FROM h)"""
#: Where chunk k of an example starts (0-based) and how long it is.
_CHUNKS = f"""{_EXAMPLES}, k AS (SELECT *, unnest(range(0, CASE WHEN n <= 64 THEN 1 ELSE CAST(ceil((n - p) / 63.0) AS BIGINT) END)) AS chunk FROM e),
 c AS (SELECT doc_id, chunk, ids, p, CASE WHEN n <= 64 THEN 0 ELSE p - 1 + chunk * 63 END AS s, CASE WHEN n <= 64 THEN n ELSE least(n, p - 1 + chunk * 63 + 64) END AS t FROM k)"""
_CHAT = f"""t AS (SELECT conv_id, turn, role, {_IDS.format('text')} AS w, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 ELSE 8 END AS m FROM conversations),
 u AS (SELECT conv_id, flatten(list([m] || w ORDER BY turn)) AS i, string_agg('0' || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, len(w)), '' ORDER BY turn) AS b FROM t GROUP BY conv_id),
 x AS (SELECT conv_id, [1] || i || [2] AS ids, '0' || b || '1' AS mask FROM u)"""
#: A position g of a group's line is in row g // step, and the first of a row is also the last of the one before.
_ROWS = """y AS (SELECT g, o, unnest(ids) AS id, unnest(string_split(mask, '')) AS m, generate_subscripts(ids, 1) AS j FROM {src}),
 z AS (SELECT g, id, m, row_number() OVER (PARTITION BY g ORDER BY o, j) - 1 AS pos FROM y),
 r AS (SELECT g, pos // {step} AS r, pos, id, m FROM z UNION ALL SELECT g, pos // {step} - 1, pos, id, m FROM z WHERE pos % {step} = 0 AND pos > 0),
 f AS (SELECT g, r, list(id ORDER BY pos) AS ids, string_agg(m, '' ORDER BY pos) AS mask FROM r GROUP BY g, r HAVING count(*) = {step} + 1)"""
_BATCH = r"""v AS (SELECT doc_id, lang AS objective, e AS epoch, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, sha256('order-1:' || lang || ':' || e || ':' || doc_id) AS k FROM documents, (SELECT unnest([0, 1]) AS e) q),
 p AS (SELECT *, row_number() OVER (PARTITION BY objective, epoch ORDER BY k, doc_id) - 1 AS place, count(*) OVER (PARTITION BY objective, epoch) AS size FROM v),
 b AS (SELECT *, place // 16 AS batch FROM p)"""
_DIGESTS = "SELECT objective, epoch, batch, count(*) AS n_rows, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY place)) AS digest FROM b {} GROUP BY objective, epoch, batch"
#: One batch after another: the tokens read of each objective decide the next; it ends where that one is not unrolled.
_STREAM = f"""{_BATCH}, g AS ({_DIGESTS.format('')}), s AS (SELECT objective, epoch, batch, CAST(sum(n) AS BIGINT) AS n_tokens FROM b WHERE objective <> 'es' GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY epoch, batch) - 1 AS k FROM s JOIN g USING (objective, epoch, batch)),
 y AS (SELECT CAST(-1 AS BIGINT) AS step, '' AS objective, 0 AS epoch, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_tokens, '' AS digest, CAST(0 AS BIGINT) AS due,
     CAST([0, 0, 0] AS BIGINT[]) AS k, CAST([0, 0, 0] AS BIGINT[]) AS t UNION ALL
   SELECT q.step + 1, n.objective, n.epoch, n.batch, n.n_rows, n.n_tokens, n.digest, q.t[q.c] * [6, 2, 3][q.c],
     list_transform([1, 2, 3], lambda i: q.k[i] + CASE WHEN i = q.c THEN 1 ELSE 0 END), list_transform([1, 2, 3], lambda i: q.t[i] + CASE WHEN i = q.c THEN n.n_tokens ELSE 0 END)
   FROM (SELECT *, CASE WHEN t[1] * 6 <= t[2] * 2 AND t[1] * 6 <= t[3] * 3 THEN 1 WHEN t[2] * 2 <= t[3] * 3 THEN 2 ELSE 3 END AS c FROM y) q JOIN n ON n.objective = ['de', 'en', 'fr'][q.c] AND n.k = q.k[q.c])"""
_MASKED = "len(replace(substring(mask, 2), '0', ''))"

SQL = {
    "conditional_encoding": f"WITH {_EXAMPLES} SELECT doc_id, n, {_SHOWN.format('ids')} AS ids, n - p AS n_trained FROM e",
    "continuation_encoding": f"SELECT doc_id, {_SHOWN.format('[1] || w || [2]')} AS ids, CAST(len(w) + 1 AS BIGINT) AS n_trained FROM (SELECT doc_id, {_IDS.format('text')} AS w FROM documents) x",
    "chat_encoding": f"WITH {_CHAT} SELECT conv_id, {_SHOWN.format('ids')} AS ids, mask, len(ids) AS n_formatted, len(ids) - 1 AS n_input, {_MASKED} AS n_trained FROM x",
    "chat_rows": f"WITH {_CHAT}, s AS (SELECT 1 AS g, conv_id AS o, ids, mask FROM x), {_ROWS.format(src='s', step=64)} SELECT r AS row, {_SHOWN.format('ids')} AS ids, mask, {_MASKED} AS n_trained FROM f WHERE {_MASKED} > 0",
    "chat_rows_until": f"""WITH {_CHAT}, s AS (SELECT 1 AS g, conv_id AS o, ids, mask FROM x), {_ROWS.format(src='s', step=64)}, n AS (SELECT r, ids, mask, {_MASKED} AS n FROM f),
      c AS (SELECT *, sum(n) OVER w AS t, count(*) FILTER (n > 0) OVER w AS k FROM n WINDOW w AS (ORDER BY r)), e AS (SELECT sum(len(ids)) OVER (ORDER BY o) AS t FROM s),
      h AS (SELECT min(r) AS h FROM c WHERE t >= {STOP[0]} AND k % {STOP[1]} = 0 AND r IN (SELECT (t - 1) // 64 - 1 FROM e))
      SELECT r AS row, {_SHOWN.format('ids')} AS ids, mask, n AS n_trained FROM c, h WHERE r <= h AND n > 0""",
    "corpus_rows": f"WITH s AS (SELECT source AS g, doc_id AS o, [1] || {_IDS.format('text')} || [2] AS ids FROM documents), q AS (SELECT g, o, ids, repeat('1', len(ids)) AS mask FROM s), {_ROWS.format(src='q', step=128)} SELECT g AS source, r AS row, {_SHOWN.format('ids')} AS ids FROM f",
    "chunked_examples": f"WITH {_CHUNKS} SELECT doc_id, chunk, {_SHOWN.format('ids[s + 1:t]')} AS ids, CAST(t - greatest(p, s + 1) AS BIGINT) AS n_trained FROM c",
    "shifted_batches": f"""WITH {_CHUNKS}, d AS (SELECT *, max(t - s - 1) OVER (PARTITION BY doc_id // 16) AS m, CASE WHEN chunk = 0 THEN greatest(p - s, 0) ELSE 1 END AS b FROM c)
      SELECT doc_id, chunk, array_to_string(range(b, t - s), ',') AS positions, {_SHOWN.format('ids[s + 1:t - 1] || list_transform(range(0, m - (t - s - 1)), lambda i: 0)')} AS inputs,
        {_SHOWN.format('ids[s + 2:t] || list_transform(range(0, m - (t - s - 1)), lambda i: 0)')} AS targets, repeat('0', b - 1) || repeat('1', t - s - b) || repeat('0', m - (t - s - 1)) AS mask FROM d""",
    "pack_faults": f"WITH {_EXAMPLES} SELECT doc_id AS pack_id, 'too long' AS fault FROM e WHERE n > 1000 UNION ALL SELECT doc_id, 'token beyond vocabulary' FROM e WHERE list_max(ids) >= 65000",
    "epoch_batches": f"WITH {_BATCH} {_DIGESTS.format('')}",
    "whole_batches": f"WITH {_BATCH} {_DIGESTS.format('WHERE batch < size // 16')}",
    "batch_probe": f"WITH RECURSIVE {_STREAM} SELECT step, objective, epoch, batch, n_rows, digest FROM y WHERE step BETWEEN 6 AND 8",
    "resumed_batches": f"WITH RECURSIVE {_STREAM} SELECT step, objective, epoch, batch, n_rows, n_tokens, digest FROM y WHERE step >= 7",
    "stream_states": f"""WITH RECURSIVE {_STREAM}, u AS (SELECT objective, count(*) FILTER (step < 7) AS k, coalesce(sum(n_tokens) FILTER (step < 7), 0) AS tokens FROM y WHERE step >= 0 GROUP BY objective)
      SELECT u.objective, CAST(k // z.many AS INT) AS epoch, CAST(k % z.many AS INT) AS position, CAST(tokens AS BIGINT) AS tokens FROM u JOIN (SELECT objective, count(*) FILTER (epoch = 0) AS many FROM n GROUP BY objective) z USING (objective)""",
    "fair_batches": f"WITH RECURSIVE {_STREAM} SELECT step, objective, epoch, batch, due FROM y WHERE step >= 0",
    "spaced_positions": f"""WITH {_EXAMPLES}, a AS (SELECT doc_id, CASE WHEN n - p <= 5 THEN range(p, n) ELSE list_transform(range(0, 5), lambda i: p + (i * (n - p - 1)) // 4) END AS pos FROM e)
      SELECT doc_id, array_to_string(pos, ',') AS positions, sha256(doc_id || ':' || array_to_string(pos, ',')) AS commitment FROM a""",
    "prompt_plan": """WITH i AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part), d AS (SELECT p_partkey, index, index // 60 AS block, index % 60 AS r FROM i),
      s AS (SELECT *, ('0x' || substring(sha256('plan-1:form:' || block), 1, 7))::BIGINT AS f, ('0x' || substring(sha256('plan-1:mood:' || block), 1, 7))::BIGINT AS m, ('0x' || substring(sha256('plan-1:theme:' || block), 1, 7))::BIGINT AS t FROM d)
      SELECT p_partkey, index, block, CAST((r // 15 + f) % 4 AS INT) AS form, CAST((r % 15 // 5 + m) % 3 AS INT) AS mood, CAST((r % 5 + t) % 5 AS INT) AS theme, ['a', 'a', 'a', 'b', 'b', 'c'][index % 6 + 1] AS lane,
        ['sea', 'hill', 'road'][('0x' || substring(sha256('brief:' || p_partkey), 7, 2))::INT % 3 + 1] AS brief FROM s""",
    "scaled_exposure": "SELECT conv_id, array_to_string(list_sort(list_distinct(list(greatest(1, CAST(round_even(length(text) * 3 / 8.0, 0) AS BIGINT))))), ',') AS steps FROM conversations GROUP BY conv_id",
}

QUERIES = {f.__name__: f for f in (
    conditional_encoding, continuation_encoding, chat_encoding, chat_rows, chat_rows_until, corpus_rows, chunked_examples, shifted_batches, pack_faults,
    epoch_batches, whole_batches, batch_probe, resumed_batches, stream_states, fair_batches, spaced_positions, prompt_plan, scaled_exposure,
)}
