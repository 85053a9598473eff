"""Joins whose rules go beyond equal keys: wildcards, precedence, coverage, lexical matches.

What the reference semantics call an error comes back as rows (``*_faults``), so
that a caller decides and nothing is collected to raise it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .similarity import DENOMINATOR, NUMERATOR, counted, meeting, searched, signatures


def example_id(*fields: Column) -> Column:
    """24 hexadecimal digits of the fields, joined by NUL; a null field is empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 24)


def wildcard_prompts(blocks: DataFrame, prompts: DataFrame) -> DataFrame:
    """Blocks with the prompts of their document and poem, and with those of the document
    that name no poem (a null ``poem_id``). Two equi-joins; blocks must be of a kind that poems have."""
    poems = blocks.where(F.col("kind").isin("poem", "stanza"))
    own = poems.join(prompts.where("poem_id IS NOT NULL"), ["document_id", "poem_id"])
    every = poems.join(prompts.where("poem_id IS NULL").drop("poem_id"), "document_id")
    return own.select("document_id", "block_id", "prompt_id").unionByName(every.select("document_id", "block_id", "prompt_id"))


def with_thoughts(rows: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Each row without a thought, and once more with every thought of its document."""
    alone = rows.withColumn("thought_id", F.lit(None).cast(thoughts.schema["thought_id"].dataType))
    return alone.unionByName(rows.join(thoughts.select("document_id", "thought_id"), "document_id").select(*alone.columns))


def pairing_faults(pairings: DataFrame, blocks: DataFrame, prompts: DataFrame, thoughts: DataFrame) -> DataFrame:
    """``pairing_id, fault`` of pairings with a foreign key that leads nowhere, or to a block that is no poem."""
    seen = F.lit(True).alias
    rows = pairings.join(blocks.select(F.col("block_id").alias("target_block_id"), F.col("kind"), seen("b")), "target_block_id", "left")
    rows = rows.join(prompts.select("prompt_id", seen("p")).distinct(), "prompt_id", "left").join(thoughts.select("thought_id", seen("t")).distinct(), "thought_id", "left")
    faults = F.array_compact(F.array(
        F.when(F.col("b").isNull(), "unknown_block"), F.when(F.col("b") & ~F.col("kind").isin("poem", "stanza"), "not_a_poem"),
        F.when(F.col("p").isNull(), "unknown_prompt"), F.when(F.col("thought_id").isNotNull() & F.col("t").isNull(), "unknown_thought"),
    ))
    return rows.select("pairing_id", F.explode(faults).alias("fault"))


def merged_examples(implicit: DataFrame, explicit: DataFrame) -> DataFrame:
    """One row an example id: a pairing wins over the implicit row of the same id;
    ``conflict`` marks ids that two pairings claim."""
    both = implicit.withColumn("pairing_id", F.lit(None).cast(explicit.schema["pairing_id"].dataType)).unionByName(explicit)
    ends = both.groupBy("example_id").agg(F.min("pairing_id").alias("pairing_id"), (F.min("pairing_id") < F.max("pairing_id")).alias("differs"))
    return ends.select("example_id", "pairing_id", F.coalesce("differs", F.lit(False)).alias("conflict"))


def owned_splits(rows: DataFrame, owners: DataFrame, default: Column) -> DataFrame:
    """The split of the document's owner, or ``default`` where nobody owns it."""
    return rows.join(owners.select("document_id", F.col("split").alias("owner")), "document_id", "left").withColumn("split", F.coalesce("owner", default)).drop("owner")


def split_conflicts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("document_id").agg(F.min("split").alias("one"), F.max("split").alias("other")).where("one <> other")


def coverage(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row: how many requests, and how many keys are missing, unexpected or answered twice."""
    asked = requests.groupBy(key).agg(F.count(F.lit(1)).alias("asked"))
    came = results.groupBy(key).agg(F.count(F.lit(1)).alias("came"))
    both = asked.join(came, key, "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(
        F.coalesce(F.sum("asked"), F.lit(0)).cast("long").alias("n_requests"), count(F.col("came").isNull()).alias("n_missing"),
        count(F.col("asked").isNull()).alias("n_unexpected"), count(F.col("came") > 1).alias("n_repeated"),
    )


def result_state(content: Column, finish: Column) -> Column:
    """What a result is: unusable, truncated or generated."""
    return F.when(F.coalesce(F.trim(content), F.lit("")) == "", "unusable").when(finish == "length", "truncated").otherwise("generated")


def classified(requests: DataFrame, results: DataFrame, key: str, content: Column, finish: Column) -> DataFrame:
    """Requests with what became of them: missing, unusable, truncated or generated."""
    rows = requests.join(results.withColumn("came_", F.lit(True)), key, "left")
    return rows.withColumn("state", F.when(F.col("came_").isNull(), "missing").otherwise(result_state(content, finish))).drop("came_")


def merged_manifests(*parts: DataFrame) -> DataFrame:
    """Manifests of ``id, origin`` as one, with ``n_rows`` an id: above one is an error of the merge."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.min("origin").alias("origin"), F.count(F.lit(1)).alias("n_rows"))


def order_faults(rows: DataFrame, order: str, key: str, parts: str) -> DataFrame:
    """Rows whose key is not above the one before within a part; parts are bounded runs."""
    line = Window.partitionBy(parts).orderBy(order)
    return rows.withColumn("before", F.lag(key).over(line)).where(F.col(key) <= F.col("before")).select(parts, order, key)


# -- lexical matches of one table with another ---------------------------------------


def find_matches(queries: DataFrame, references: DataFrame) -> DataFrame:
    """``query_id, reference_id, metric, score, shared, denominator`` for every query text and
    reference text (both ``id, text``) that match: equal after normalising, else by Jaccard of
    word 5-shingles, else by containment, at 4/5. Equal texts of a side share its least id.

    The smaller set of a matching pair has one of its rarest shingles in the larger one, so
    each side's heads meet the other side's sets; counts follow on full sets. Texts are numbered,
    odd ones are references: both sides are dealt by shingle together, and their ids join the matches."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    q, r = (signatures(rows.select("id", text), "id", "text", side) for side, rows in enumerate((queries, references)))
    odd = lambda k: F.col(k) % 2 == 1
    posted, heads, sets = searched(q.select("k", "norm").unionByName(r.select("k", "norm")), "odd > 0 AND odd < df")
    pairs = meeting(heads, posted, odd("a.k") != odd("b.k"))
    rows = counted(pairs, sets.withColumn("sid", F.col("k"))).drop("a", "b")
    rows = rows.select(F.when(odd("x"), F.col("y")).otherwise(F.col("x")).alias("q"), F.when(odd("x"), F.col("x")).otherwise(F.col("y")).alias("r"), F.col("nx").alias("n"), F.col("ny").alias("m"), F.col("c").alias("shared"))
    name = lambda rows, k, out: rows.select(F.col("k").alias(k), F.col("sid").alias(out), F.sha2("norm", 256).alias(f"norm_{k}"))
    rows = rows.join(name(q, "q", "query_id"), "q").join(name(r, "r", "reference_id"), "r")
    union, least = F.col("n") + F.col("m") - F.col("shared"), F.least("n", "m")
    jaccard = DENOMINATOR * F.col("shared") >= NUMERATOR * union
    same = F.col("norm_q") == F.col("norm_r")
    metric = F.when(same, "normalized_exact").when(jaccard, "shingle_jaccard").otherwise("shingle_containment")
    denominator = F.when(same, F.col("shared")).when(jaccard, union).otherwise(least).cast("long")
    rows = rows.select("query_id", "reference_id", metric.alias("metric"), "shared", denominator.alias("denominator"))
    return rows.withColumn("score", F.col("shared") / F.col("denominator"))


def best_matches(matches: DataFrame) -> DataFrame:
    """The match of each query that comes first by score (down), metric and reference."""
    first = F.min(F.struct((-F.col("score")).alias("down"), "metric", "reference_id", "shared", "denominator")).alias("b")
    return matches.groupBy("query_id").agg(first).select("query_id", "b.reference_id", "b.metric", (-F.col("b.down")).alias("score"), "b.shared", "b.denominator")


def for_every_row(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches of signatures carried to each row (``id, text``) whose normalised text it is."""
    norm = rows.select("id", F.sha2(F.array_join(words(F.coalesce(F.col("text"), F.lit(""))), " "), 256).alias("norm"))
    signature = norm.groupBy("norm").agg(F.min("id").alias("query_id"))
    return norm.join(signature, "norm").select("id", "query_id").join(matches, "query_id").drop("query_id")
