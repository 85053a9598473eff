"""Document fingerprints: a threshold-scaled sketch, all in DataFrame functions.

A text's word 5-shingles are hashed; every hash below 1/``SCALE`` of the hash
range is retained. Sketches of any two texts, however unequal, are comparable and
merge by union, and containment and likeness are ratios of retained hashes. A
text with under ``LEAST`` hashes below the threshold keeps its ``LEAST`` least
ones, or all it has, and is compared below the least threshold of the two, so
two texts that keep all their hashes are compared exactly.

A fingerprint is the threshold and the sorted hashes in hexadecimal.

Defined results: a null text is empty. Texts of one to four words have one
shingle; without words the sketch is empty, and two such are alike (1.0). Rows
that repeat doc_id and text are one document with one row. Documents follow one
another by descending doc_id (null last), then by a hash of the text; a single
document follows itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import barrier, cut, read_table, word_array

WIDTH, SCALE, LEAST = 5, 8, 32
_LOWEST, _ALL = -(1 << 63), (1 << 63) - 1


def _hashes(df: DataFrame, text: str, name: str, *keep: str) -> DataFrame:
    """Adds ``name``: the distinct shingle hashes of a text column."""
    keep = tuple(c for c in keep if c != name)
    df = barrier(df, "__w", F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w)), *keep)
    n = F.size("__w") - (WIDTH - 1)
    rows = F.arrays_zip(*[F.slice("__w", j + 1, F.greatest(n, F.lit(0))).alias(f"s{j}") for j in range(WIDTH)])
    few = F.when(F.size("__w") == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.xxhash64("__w")))
    return barrier(df, name, F.when(n >= 1, F.array_distinct(F.transform(rows, lambda s: F.xxhash64(s)))).otherwise(few), *keep)


def _sketch(df: DataFrame, hashes: str, name: str, *keep: str) -> DataFrame:
    """Adds ``name``: struct of threshold (inclusive) and sorted retained hashes."""
    limit = _LOWEST + (1 << 64) // SCALE - 1
    df = barrier(df, "__low", F.filter(hashes, lambda h: h <= limit), *keep, hashes)
    df = barrier(
        df, "__kept", F.when(F.size("__low") >= LEAST, F.sort_array("__low")).otherwise(F.slice(F.sort_array(hashes), 1, LEAST)), *keep, "__low", hashes
    )
    threshold = (
        F.when(F.size("__low") >= LEAST, F.lit(limit)).when(F.size(hashes) <= LEAST, F.lit(_ALL)).otherwise(F.element_at("__kept", -1))
    )
    return df.select(*keep, F.struct(threshold.alias("limit"), F.col("__kept").alias("hashes")).alias(name))


def sketch_text(df: DataFrame, text: str, name: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``name``, the sketch of column ``text``."""
    return _sketch(_hashes(df, text, "__hashes", *keep), "__hashes", name, *keep)


def as_string(sketch: str) -> Column:
    return F.concat_ws(":", F.hex(f"{sketch}.limit"), F.array_join(F.transform(f"{sketch}.hashes", lambda h: F.lpad(F.hex(h), 16, "0")), "."))


def with_likeness(df: DataFrame, one: str, two: str, name: str) -> DataFrame:
    """Adds the estimated Jaccard likeness of two sketch columns."""
    columns = df.columns
    df = df.withColumn("__at", F.least(f"{one}.limit", f"{two}.limit"))
    a = F.filter(f"{one}.hashes", lambda h: h <= F.col("__at"))
    b = F.filter(f"{two}.hashes", lambda h: h <= F.col("__at"))
    df = barrier(df, "__pair", F.struct(a.alias("a"), b.alias("b")), *columns)
    df = df.withColumn("__both", F.size(F.array_intersect("__pair.a", "__pair.b")))
    union = F.size("__pair.a") + F.size("__pair.b") - F.col("__both")
    return df.select(*columns, F.when(union == 0, F.lit(1.0)).otherwise(F.col("__both") / union).alias(name))


def _neighbours(ids: DataFrame) -> DataFrame:
    """``doc_id, text_key, prev_id, prev_key, prev_n``: who comes before each row.

    Rows are range-dealt and only ends of ranges (one row a partition) meet."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_key")]
    dealt = cut(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "print-order")
    me = F.struct("doc_id", "text_key", "n")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = dealt.withColumn("own", F.lag(me).over(inside))
    # Least in this order: null ids last, so they are the greatest.
    place = F.struct(F.col("doc_id").isNull().alias("no"), F.bitwise_not("doc_id").alias("down"), F.col("text_key").alias("key"))
    ends = dealt.groupBy("part").agg(F.max_by(me, place).alias("end"))
    line = Window.orderBy("part")
    last = F.last("end").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("end").over(line), last).alias("before"))
    rows = rows.join(ends, "part").withColumn("prev", F.coalesce("own", "before"))
    return rows.select("doc_id", "text_key", F.col("prev.doc_id").alias("prev_id"), F.col("prev.text_key").alias("prev_key"), F.col("prev.n").alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document and of its edited text, and two likenesses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    ids = cut(rows.select("doc_id", "text_key", F.length("text").alias("n")), "print-ids")
    counted = ids.groupBy("doc_id", "text_key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    if not counted.where("rows > 1").isEmpty():
        rows, ids = rows.dropDuplicates(["doc_id", "text_key"]), counted.drop("rows")
    near = cut(_neighbours(ids), "print-neighbours")

    # Joins compare ids that may be null; a flag and a filled id make the keys plain.
    key = [F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("text_key").alias("k2")]
    back = [F.col("prev_id").isNull().alias("p0"), F.coalesce("prev_id", F.lit(0)).alias("p1"), F.col("prev_key").alias("p2")]
    mine = rows.select("text", *key)  # the same columns on both sides of the last join: one exchange of texts serves both
    sent = mine.join(near.select(*key, *back, "prev_n"), ["k0", "k1", "k2"])
    sent = sent.withColumn("head", F.expr("left(text, cast(floor(prev_n / 3) as int))"))
    sent = sketch_text(sent, "text", "next_sketch", "p0", "p1", "p2", "head")
    sent = sent.withColumnsRenamed({"p0": "k0", "p1": "k1", "p2": "k2"})
    both = mine.join(sent, ["k0", "k1", "k2"])
    both = both.select(F.when(~F.col("k0"), F.col("k1")).alias("doc_id"), "text", "head", "next_sketch")

    both = both.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"), "head")
    both = barrier(both, "edited", edited, "doc_id", "text", "n_chars", "next_sketch")
    both = sketch_text(both, "text", "sketch", "doc_id", "n_chars", "next_sketch", "edited")
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = sketch_text(both, "edited", "edited_sketch", "doc_id", "n_chars", "next_sketch", "sketch", "edited_sha256")
    both = with_likeness(both, "sketch", "edited_sketch", "near_edited")
    both = with_likeness(both, "sketch", "next_sketch", "near_next")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_string("sketch").alias("fingerprint"), as_string("edited_sketch").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def merged(df: DataFrame, one: str, two: str, name: str) -> DataFrame:
    """Adds the sketch of both texts' shingles together: what either retains below the lesser threshold."""
    columns = df.columns
    df = barrier(df.withColumn("m_at", F.least(f"{one}.limit", f"{two}.limit")), "m_all", F.array_union(f"{one}.hashes", f"{two}.hashes"), *columns, "m_at")
    kept = F.sort_array(F.filter("m_all", lambda h: h <= F.col("m_at")))
    return df.select(*columns, F.struct(F.col("m_at").alias("limit"), kept.alias("hashes")).alias(name))


def containment(df: DataFrame, small: str, large: str, name: str) -> DataFrame:
    """Adds the estimated share of ``small``'s shingles that ``large`` has: 1 for a text
    without shingles, null where ``small`` retains no hash below the lesser threshold,
    as then the sketches hold no evidence."""
    at = F.least(f"{small}.limit", f"{large}.limit")
    part = F.filter(f"{small}.hashes", lambda h: h <= at)
    share = F.size(F.array_intersect(part, F.col(f"{large}.hashes"))) / F.size(part)
    return df.withColumn(name, F.when(F.size(f"{small}.hashes") == 0, F.lit(1.0)).when(F.size(part) > 0, share))


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
