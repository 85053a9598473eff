"""Joins, audits and measures bound to the given tables, each with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import unit_fraction
from .operators import joins, measures
from .plans.tables import stored
from .sequences import word_ids


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(key: Column, salt: str = "rel-1") -> Column:
    at = unit_fraction(key, salt)
    return F.when(at < 0.9, "train").when(at < 0.95, "validation").otherwise("test")


def _poems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as blocks (four a document), labels as prompts (good ones for the whole document), toxic ones as thoughts."""
    kind = F.when(F.col("lang") == "de", "paragraph").when(F.col("lang") == "fr", "stanza").otherwise("poem")
    owner = F.expr("doc_id div 4").alias("document_id")
    blocks = _table(spark, sf_dir, "documents").select(owner, F.col("doc_id").alias("block_id"), F.expr("doc_id % 4").alias("poem_id"), kind.alias("kind"))
    labels = _table(spark, sf_dir, "labels")
    prompts = labels.select(owner, F.col("doc_id").alias("prompt_id"), F.when(F.col("quality") == 0, F.expr("doc_id % 4")).alias("poem_id"))
    return blocks, prompts, labels.where("toxic = 1").select(owner, F.col("doc_id").alias("thought_id"))


def _implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, prompts, thoughts = _poems(spark, sf_dir)
    return joins.with_thoughts(joins.wildcard_prompts(blocks, prompts), thoughts)


def wildcard_examples(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-1, JOIN-2, PRJ-7, PRJ-11
    rows = _implicit(spark, sf_dir)
    return rows.select(joins.example_id(F.col("block_id"), F.col("prompt_id"), F.col("thought_id")).alias("example_id"), "document_id", "block_id", "prompt_id", "thought_id")


def _pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").where("doc_id % 3 = 0")
    thought = F.when(F.col("toxic") == 1, F.col("doc_id")).when(F.expr("doc_id % 5 = 0"), F.lit(-1).cast("long"))
    return rows.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("pairing_id"), F.expr("doc_id - doc_id % 2").alias("target_block_id"), F.col("doc_id").alias("prompt_id"), thought.alias("thought_id"))


def pairing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-3
    blocks, prompts, thoughts = _poems(spark, sf_dir)
    return joins.pairing_faults(_pairings(spark, sf_dir), blocks, prompts, thoughts)


def merged_examples(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-4
    eid = lambda b: joins.example_id(F.col(b), F.col("prompt_id"), F.col("thought_id")).alias("example_id")
    return joins.merged_examples(_implicit(spark, sf_dir).select(eid("block_id")), _pairings(spark, sf_dir).select(eid("target_block_id"), "pairing_id"))


def owned_splits(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-5
    owners = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return joins.owned_splits(rows, owners, _split(F.col("document_id")))


def split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:  # SPL-4
    rows = _table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("document_id"), _split(F.col("doc_id")).alias("split"))
    return joins.split_conflicts(rows)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").where("l_linenumber = 2")
    return rows.select(F.when(F.col("l_quantity") > 45, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("key"), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("content"), F.when(F.col("l_returnflag") == "A", "length").otherwise("stop").alias("finish"))


def request_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-10, SET-2, SET-5
    return joins.coverage(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), _results(spark, sf_dir), "key")


def classified_results(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-12, JOIN-11
    requests = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    results = _results(spark, sf_dir).groupBy("key").agg(F.max("content").alias("content"), F.min("finish").alias("finish"))
    return joins.classified(requests, results, "key", F.col("content"), F.col("finish")).select("key", "state")


def shared_families(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-17
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("family")
    return _table(spark, sf_dir, "documents").groupBy(key).agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_documents")).where("n_sources > 1")


def merged_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-18, SET-1
    of = lambda t, c: _table(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(t).alias("origin"))
    return joins.merged_manifests(of("documents", "doc_id"), of("benchmark", "item_id"), of("pages", "page_id"))


def turn_order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-11: turns whose text isn't longer than the one before
    rows = _table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return joins.order_faults(rows, "turn", "n", "conv_id")


def _protected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", _split(F.col("doc_id")).alias("split"))
    return rows.where("split = 'train'").select("id", "text"), rows.where("split <> 'train'").select("id", "text")


def heldout_matches(spark: SparkSession, sf_dir: str) -> DataFrame:  # JOIN-6, LEX-3, LEX-5, SET-3
    return joins.find_matches(*_protected(spark, sf_dir))


def heldout_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:  # SPL-5, TOP-3: why a training document can't stay
    train, held = _protected(spark, sf_dir)
    best = joins.best_matches(joins.for_every_row(joins.find_matches(train, held), train).withColumnRenamed("id", "query_id"))
    return best.select(F.col("query_id").alias("doc_id"), F.lit("heldout_lexical_family").alias("reason"), "reference_id", "metric", "score", "shared", "denominator")


def contaminated_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:  # DEC-1, DEC-2
    """Conversations with a message, other than the system's, that matches a benchmark item or a held-out document."""
    _, held = _protected(spark, sf_dir)
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark:"), F.col("item_id").cast("string")).alias("id"), "text")
    protected = items.unionByName(held.select(F.concat(F.lit("heldout:"), F.col("id").cast("string")).alias("id"), "text"))
    turns = _table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.struct("conv_id", "turn").alias("id"), "text")
    hits = joins.for_every_row(joins.find_matches(turns, protected), turns)
    return hits.groupBy(F.col("id.conv_id").alias("conv_id")).agg(F.count_distinct("id.turn").alias("n_turns"), F.min("reference_id").alias("first_match"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG-5, AGG-6, AGG-7
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("chunk"), F.when(k % 7 != 0, k).alias("tokens"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("model"))
    return measures.usage_totals(rows, "chunk", "tokens", "model")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    name = F.concat_ws(".", F.lit("net"), F.concat(F.lit("h"), F.col("label").cast("string")), (F.col("vec_id") % 3).cast("string"))
    return rows.join(after, "vec_id").select(name.alias("name"), F.col("label").cast("long").alias("label"), "embedding", "next")


def vector_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG-17, AGG-18
    out = measures.geometry_by_prefix(_vectors(spark, sf_dir), "name", "embedding", "next")
    return out.select("scope", "n", *[F.round(c, 5).alias(c) for c in ("dot", "norm_one", "norm_two", "cosine")])


def anchor_drift(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG-19, XFN-26
    out = measures.drift(_vectors(spark, sf_dir), "label", "embedding", "next")
    return out.select("label", "n_values", *[F.round(c, 6).alias(c) for c in ("mean_squared_error", "cosine_distance", "symmetric_kl", "max_difference")])


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _table(spark, sf_dir, "events").groupBy("user_id", seconds.alias("step")).agg(F.max("value").alias("value"))


def turning(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-12
    out = measures.turning(_snapshots(spark, sf_dir), "user_id", "step", "value")
    return out.select("user_id", F.round("step", 3).alias("step"), *[F.round(c, 8).alias(c) for c in ("velocity", "next_velocity", "acceleration")])


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-13
    out = measures.extrapolated(_snapshots(spark, sf_dir), "user_id", "step", "value", F.col("step") + 3600.0, 2.0)
    return out.select("user_id", F.round("forecast", 6).alias("value_ahead"))


def chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:  # WIN-11, GOV-8
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("event_id * 5 % 9").alias("start"), F.expr("event_id * 7 % 11").alias("stop"))
    return measures.chain_faults(rows, "user_id", "event_id", "start", "stop")


def token_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-23, AGG-15
    ids = stored(_table(spark, sf_dir, "documents").select(word_ids(F.col("text")).alias("w")), "sketch-ids")
    one = measures.count_sketch(ids.select(F.explode("w").alias("v")), "v", 256, 17).withColumn("kind", F.lit("unigram"))
    two = measures.count_sketch(ids.select(F.explode(measures.bigram_values(F.col("w"))).alias("v")), "v", 512, 18).withColumn("kind", F.lit("bigram"))
    return one.unionByName(two)


def byte_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:  # AGG-15
    return measures.byte_counts(_table(spark, sf_dir, "documents"), "text")


def record_features(spark: SparkSession, sf_dir: str) -> DataFrame:  # XFN-24
    rows = _table(spark, sf_dir, "part")
    none = F.lit(None)
    flat = rows.select("p_partkey", F.explode(F.array(
        F.struct(F.lit("recipe.brand").alias("path"), none.cast("double").alias("number"), F.col("p_brand").alias("text")),
        F.struct(F.lit("recipe.size").alias("path"), F.col("p_size").cast("double").alias("number"), none.cast("string").alias("text")),
        F.struct(F.lit("recipe.price").alias("path"), (100 - F.col("p_retailprice")).alias("number"), none.cast("string").alias("text")),
    )).alias("f")).select("p_partkey", "f.*")
    out = measures.hashed_features(flat, "p_partkey", "path", "number", "text", 64, 3107)
    return out.select("p_partkey", "slot", F.round("weight", 9).alias("weight"))


def inventory_graph(spark: SparkSession, sf_dir: str) -> DataFrame:  # PLN-10, XFN-25
    layer = F.regexp_extract("p_name", r"(?:layers|blocks|h)\.(\d+)", 1)
    rows = _table(spark, sf_dir, "part").where("p_partkey <= 60").select("p_partkey", F.when(F.col("p_partkey") % 20 == 0, "embed").otherwise(F.concat(F.lit("h."), (F.col("p_partkey") % 7).cast("string"))).alias("p_name"))
    nodes = rows.select(F.col("p_partkey").alias("idx"), F.when(layer != "", layer.cast("long")).alias("layer"))
    return measures.graph_edges(nodes)


_FRACTION = "CAST(('0x' || substring(sha256('rel-1' || chr(0) || CAST({} AS VARCHAR)), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0"
_SPLIT = "CASE WHEN {0} < 0.9 THEN 'train' WHEN {0} < 0.95 THEN 'validation' ELSE 'test' END"
_SPLIT_DOC = _SPLIT.format(_FRACTION.format("doc_id"))
_POEMS = """b AS (SELECT doc_id // 4 AS document_id, doc_id AS block_id, doc_id % 4 AS poem_id, CASE lang WHEN 'de' THEN 'paragraph' WHEN 'fr' THEN 'stanza' ELSE 'poem' END AS kind FROM documents),
 p AS (SELECT doc_id // 4 AS document_id, doc_id AS prompt_id, CASE WHEN quality = 0 THEN doc_id % 4 END AS poem_id FROM labels),
 t AS (SELECT doc_id // 4 AS document_id, doc_id AS thought_id FROM labels WHERE toxic = 1),
 m AS (SELECT b.document_id, block_id, prompt_id FROM b JOIN p ON p.document_id = b.document_id AND (p.poem_id IS NULL OR p.poem_id = b.poem_id) WHERE kind IN ('poem', 'stanza')),
 x AS (SELECT *, NULL::BIGINT AS thought_id FROM m UNION ALL SELECT m.*, thought_id FROM m JOIN t ON t.document_id = m.document_id),
 g AS (SELECT 'p' || doc_id AS pairing_id, doc_id - doc_id % 2 AS target_block_id, doc_id AS prompt_id, CASE WHEN toxic = 1 THEN doc_id WHEN doc_id % 5 = 0 THEN -1 END AS thought_id FROM labels WHERE doc_id % 3 = 0)"""
_EID = "substring(sha256(CAST({} AS VARCHAR) || chr(0) || CAST(prompt_id AS VARCHAR) || chr(0) || coalesce(CAST(thought_id AS VARCHAR), '')), 1, 24)"
_RESULTS = "r AS (SELECT CASE WHEN l_quantity > 45 THEN -l_orderkey ELSE l_orderkey END AS key, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS content, CASE WHEN l_returnflag = 'A' THEN 'length' ELSE 'stop' END AS finish FROM lineitem WHERE l_linenumber = 2)"
_NORM = r"array_to_string(regexp_extract_all(lower(replace({}, 'ß', 'ss')), '[\p{{L}}\p{{N}}_'']+'), ' ')"
#: Every query against every reference, by shared shingles, without a filter.
_MATCH = f"""qn AS (SELECT id, {_NORM.format('text')} AS norm FROM q), rn AS (SELECT id, {_NORM.format('text')} AS norm FROM r),
 qs AS (SELECT norm, min(id) AS sid, string_split(norm, ' ') AS w FROM qn GROUP BY norm), rs AS (SELECT norm, min(id) AS sid, string_split(norm, ' ') AS w FROM rn GROUP BY norm),
 qg AS (SELECT sid, unnest(CASE WHEN len(w) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM qs),
 rg AS (SELECT sid, unnest(CASE WHEN len(w) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM rs),
 k AS (SELECT qg.sid AS x, rg.sid AS y, count(*) AS k FROM qg JOIN rg ON qg.g = rg.g GROUP BY ALL),
 c AS (SELECT x, y, k, n, l, a.norm = b.norm AS same FROM k JOIN (SELECT sid, count(*) AS n FROM qg GROUP BY sid) u ON u.sid = x JOIN (SELECT sid, count(*) AS l FROM rg GROUP BY sid) v ON v.sid = y JOIN qs a ON a.sid = x JOIN rs b ON b.sid = y),
 m AS (SELECT x AS query_id, y AS reference_id, CASE WHEN same THEN 'normalized_exact' WHEN 5 * k >= 4 * (n + l - k) THEN 'shingle_jaccard' ELSE 'shingle_containment' END AS metric, k AS shared,
   CASE WHEN same THEN k WHEN 5 * k >= 4 * (n + l - k) THEN n + l - k ELSE least(n, l) END AS denominator FROM c WHERE 5 * k >= 4 * least(n, l))"""
_SIDES = f"s AS (SELECT doc_id AS id, text, {_SPLIT_DOC} AS split FROM documents), q AS (SELECT id, text FROM s WHERE split = 'train'), r AS (SELECT id, text FROM s WHERE split <> 'train')"
_VECTORS = "v AS (SELECT 'net.h' || a.label || '.' || (a.vec_id % 3) AS name, CAST(a.label AS BIGINT) AS label, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_SNAPS = "e AS (SELECT user_id, epoch_us(ts) / 1e6 AS step, max(value) AS value FROM events GROUP BY ALL)"
_WRAP = "CASE WHEN ({0}) % 18446744073709551616::HUGEINT >= 9223372036854775808::HUGEINT THEN ({0}) % 18446744073709551616::HUGEINT - 18446744073709551616::HUGEINT ELSE ({0}) % 18446744073709551616::HUGEINT END"
_MOD = "((({}) % 2147483647 + 2147483647) % 2147483647)"


def _sketch_sql(source: str, kind: str, dim: int, seed: int) -> str:
    slot = _MOD.format(_WRAP.format(f"v::HUGEINT * 1103515245 + {seed * 12345}")) + f" % {dim}"
    sign = _MOD.format(_WRAP.format(f"v::HUGEINT * 214013 + {seed * 2531011}")) + " % 2 * 2 - 1"
    return f"SELECT '{kind}' AS kind, CAST(slot AS BIGINT) AS slot, CAST(sum(sign) AS BIGINT) AS total FROM (SELECT {slot} AS slot, {sign} AS sign FROM {source}) z GROUP BY ALL"


SQL = {
    "wildcard_examples": f"WITH {_POEMS} SELECT {_EID.format('block_id')} AS example_id, document_id, block_id, prompt_id, thought_id FROM x",
    "pairing_faults": f"""WITH {_POEMS}, f AS (SELECT pairing_id, unnest([CASE WHEN b.block_id IS NULL THEN 'unknown_block' WHEN kind = 'paragraph' THEN 'not_a_poem' END,
      CASE WHEN g.prompt_id NOT IN (SELECT prompt_id FROM p) THEN 'unknown_prompt' END, CASE WHEN g.thought_id NOT IN (SELECT thought_id FROM t) THEN 'unknown_thought' END]) AS fault FROM g LEFT JOIN b ON b.block_id = g.target_block_id)
      SELECT * FROM f WHERE fault IS NOT NULL""",
    "merged_examples": f"""WITH {_POEMS}, y AS (SELECT {_EID.format('block_id')} AS example_id, NULL AS pairing_id FROM x UNION ALL SELECT {_EID.format('target_block_id')}, pairing_id FROM g)
      SELECT example_id, min(pairing_id) AS pairing_id, count(DISTINCT pairing_id) > 1 AS conflict FROM y GROUP BY example_id""",
    "owned_splits": f"SELECT d.doc_id AS document_id, coalesce(CASE quality WHEN 1 THEN 'train' WHEN 0 THEN 'test' END, {_SPLIT.format(_FRACTION.format('d.doc_id'))}) AS split FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "split_conflicts": f"SELECT doc_id // 8 AS document_id, min({_SPLIT_DOC}) AS one, max({_SPLIT_DOC}) AS other FROM documents GROUP BY 1 HAVING count(DISTINCT {_SPLIT_DOC}) > 1",
    "request_coverage": f"""WITH {_RESULTS} SELECT (SELECT count(*) FROM orders) AS n_requests, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT key FROM r)) AS n_missing,
      (SELECT count(DISTINCT key) FROM r WHERE key NOT IN (SELECT o_orderkey FROM orders)) AS n_unexpected, (SELECT count(*) FROM (SELECT key FROM r GROUP BY key HAVING count(*) > 1) z) AS n_repeated""",
    "classified_results": f"WITH {_RESULTS}, a AS (SELECT key, max(content) AS content, min(finish) AS finish FROM r GROUP BY key) SELECT o_orderkey AS key, CASE WHEN a.key IS NULL THEN 'missing' WHEN content IS NULL THEN 'unusable' WHEN finish = 'length' THEN 'truncated' ELSE 'generated' END AS state FROM orders LEFT JOIN a ON a.key = o_orderkey",
    "shared_families": r"SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS family, count(DISTINCT source) AS n_sources, count(*) AS n_documents FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "merged_manifests": "SELECT id, min(origin) AS origin, count(*) AS n_rows FROM (SELECT doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark UNION ALL SELECT page_id, 'pages' FROM pages) x GROUP BY id",
    "turn_order_faults": "SELECT a.conv_id, a.turn, CAST(length(a.text) AS INT) AS n FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) WHERE length(a.text) <= length(b.text)",
    "heldout_matches": f"WITH {_SIDES}, {_MATCH} SELECT query_id, reference_id, metric, shared, denominator, shared / denominator AS score FROM m",
    "heldout_evidence": f"""WITH {_SIDES}, {_MATCH}, e AS (SELECT qn.id AS doc_id, m.*, row_number() OVER (PARTITION BY qn.id ORDER BY shared / denominator DESC, metric, reference_id) AS rn FROM m JOIN qs ON qs.sid = query_id JOIN qn ON qn.norm = qs.norm)
      SELECT doc_id, 'heldout_lexical_family' AS reason, reference_id, metric, shared / denominator AS score, shared, denominator FROM e WHERE rn = 1""",
    "contaminated_conversations": f"""WITH s AS (SELECT doc_id AS id, text, {_SPLIT_DOC} AS split FROM documents), q AS (SELECT conv_id * 100000 + turn AS id, text FROM conversations WHERE role <> 'system'),
      r AS (SELECT 'benchmark:' || item_id AS id, text FROM benchmark UNION ALL SELECT 'heldout:' || id, text FROM s WHERE split <> 'train'), {_MATCH}
      SELECT qn.id // 100000 AS conv_id, count(DISTINCT qn.id) AS n_turns, min(reference_id) AS first_match FROM m JOIN qs ON qs.sid = query_id JOIN qn ON qn.norm = qs.norm GROUP BY 1""",
    "usage_totals": """WITH u AS (SELECT user_id % 10 AS chunk, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 11 <> 0 THEN event_type END AS model FROM events)
      SELECT chunk, CAST(coalesce(sum(k) FILTER (k % 7 <> 0), 0) AS BIGINT) AS total, count(*) FILTER (k IS NULL OR k % 7 = 0) AS n_missing, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(*) FILTER (model IS NULL) AS n_without_model FROM u GROUP BY chunk""",
    "vector_geometry": f"""WITH {_VECTORS}, s AS (SELECT unnest(['', 'net', string_split(name, '.')[1] || '.' || string_split(name, '.')[2], name]) AS scope, list_dot_product(x, y) AS d, list_dot_product(x, x) AS a, list_dot_product(y, y) AS b FROM v)
      SELECT scope, count(*) AS n, round(sum(d), 5) AS dot, round(sqrt(sum(a)), 5) AS norm_one, round(sqrt(sum(b)), 5) AS norm_two, round(sum(d) / sqrt(sum(a) * sum(b)), 5) AS cosine FROM s GROUP BY scope""",
    "anchor_drift": f"""WITH {_VECTORS}, i AS (SELECT row_number() OVER () AS i, label, x, y, list_sum(list_transform(x, lambda z: exp(z))) AS sx, list_sum(list_transform(y, lambda z: exp(z))) AS sy FROM v),
      u AS (SELECT i, label, sx, sy, unnest(x) AS x, unnest(y) AS y FROM i), w AS (SELECT i, label, x, y, x - ln(sx) AS p, y - ln(sy) AS q FROM u),
      o AS (SELECT label, count(*) AS n_values, sum((y - x) * (y - x)) AS se, max(abs(y - x)) AS top, sum(x * y) AS d, sum(x * x) AS a, sum(y * y) AS b, sum(0.5 * (exp(p) - exp(q)) * (p - q)) / count(DISTINCT i) AS kl FROM w GROUP BY label)
      SELECT label, n_values, round(se / n_values, 6) AS mean_squared_error, round(1 - d / sqrt(a * b), 6) AS cosine_distance, round(kl, 6) AS symmetric_kl, round(top, 6) AS max_difference FROM o""",
    "turning": f"""WITH {_SNAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS i FROM e),
      v AS (SELECT a.user_id, a.step, (b.value - a.value) / (b.step - a.step) AS v1, (c.value - b.value) / (c.step - b.step) AS v2, c.step - a.step AS d FROM n a JOIN n b ON b.user_id = a.user_id AND b.i = a.i + 1 JOIN n c ON c.user_id = a.user_id AND c.i = a.i + 2)
      SELECT user_id, round(step, 3) AS step, round(v1, 8) AS velocity, round(v2, 8) AS next_velocity, round((v2 - v1) / (d / 2), 8) AS acceleration FROM v""",
    "forecast": f"""WITH {_SNAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS i FROM e)
      SELECT b.user_id, round(CASE WHEN 3600.0 <= 2.0 * (b.step - a.step) THEN b.value + (b.value - a.value) * 3600.0 / (b.step - a.step) END, 6) AS value_ahead FROM n b JOIN n a ON a.user_id = b.user_id AND a.i = 2 WHERE b.i = 1""",
    "chain_faults": """WITH l AS (SELECT user_id, event_id, event_id * 5 % 9 AS a, event_id * 7 % 11 AS b FROM events), p AS (SELECT x.*, (SELECT max(y.event_id) FROM l y WHERE y.user_id = x.user_id AND y.event_id < x.event_id) AS prior FROM l x)
      SELECT x.user_id, x.event_id, CASE WHEN x.b <= x.a THEN 'not_increasing' ELSE 'not_connected' END AS fault FROM p x LEFT JOIN l y ON y.event_id = x.prior WHERE x.b <= x.a OR y.b <> x.a""",
    "token_sketch": r"WITH d AS (SELECT list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: ('0x' || substring(sha256(w), 1, 4))::BIGINT + 16) AS w FROM documents), u AS (SELECT unnest(w) AS v FROM d), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] * 2147483647 + w[i + 1])) AS v FROM d) "
    + _sketch_sql("u", "unigram", 256, 17) + " UNION ALL " + _sketch_sql("b", "bigram", 512, 18),
    "byte_frequency": "SELECT byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents) x GROUP BY byte",
    "record_features": """WITH f AS (SELECT p_partkey, sha256('3107:recipe.brand:' || p_brand) AS h, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, sha256('3107:recipe.size:number'), sign(p_size) * ln(1 + abs(p_size)) FROM part
      UNION ALL SELECT p_partkey, sha256('3107:recipe.price:number'), sign(100 - p_retailprice) * ln(1 + abs(100 - p_retailprice)) FROM part),
      s AS (SELECT p_partkey, CAST(('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UBIGINT % 64 AS BIGINT) AS slot, sum(w) AS w FROM f GROUP BY ALL)
      SELECT p_partkey, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 9) AS weight FROM s""",
    "inventory_graph": """WITH n AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 20 <> 0 THEN p_partkey % 7 END AS l FROM part WHERE p_partkey <= 60),
      a AS (SELECT x.i AS s, y.i AS d FROM n x JOIN n y ON (x.l = y.l AND y.i = (SELECT min(i) FROM n z WHERE z.l = x.l AND z.i > x.i)) OR y.l = (SELECT min(l) FROM n z WHERE z.l > x.l) OR (x.l IS NULL AND x.i <> y.i))
      SELECT s AS src, d AS dst FROM a UNION SELECT d, s FROM a""",
}

QUERIES = {f.__name__: f for f in (
    wildcard_examples, pairing_faults, merged_examples, owned_splits, split_conflicts, request_coverage, classified_results, shared_families, merged_manifests, turn_order_faults,
    heldout_matches, heldout_evidence, contaminated_conversations, usage_totals, vector_geometry, anchor_drift, turning, forecast, chain_faults, token_sketch, byte_frequency,
    record_features, inventory_graph,
)}
