"""A long file of JSON lines read from a seeded place on, until enough is found.

The files of a folder, by name, are one stream of bytes. A scan starts at a byte that
follows from a seed, leaves out the line that byte falls in, judges each line after it,
and stops with the line that brings the accepted ones to a target; what lies behind
that line is neither counted nor returned. Files are taken in waves of doubling
number, so a scan that is soon done reads little.

The place of a line comes from the lengths of those before it: along a split within
the task that reads it, and over splits by sums of their lengths, a row a split. So no
text is sorted or moved to find it, and results don't depend on how files are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import PART, dealt, running
from ..plans.tables import stored

_LINE = "file string, block long, within long, line string"


def seeded_start(seed: str, size: int) -> int:
    """A byte of ``size``: the first 64 bits of the seed's digest, modulo the size."""
    return int.from_bytes(sha256(seed.encode()).digest()[:8], "big") % size if size else 0


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files by name with their sizes: a row a file, contents unread."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()
    return sorted((r["path"], r["length"]) for r in rows)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where each line starts within its split; lines come in the order of the file."""
    at: tuple[str, int] | None = None
    total = 0
    for batch in batches:
        files, blocks = batch["file"].to_pylist(), batch["block"].to_pylist()
        sizes = pc.add(pc.binary_length(batch["line"].cast(pa.binary())), 1).to_numpy(zero_copy_only=False)
        starts = np.zeros(len(sizes), dtype=np.int64)
        for i, key in enumerate(zip(files, blocks, strict=True)):
            if key != at:
                at, total = key, 0
            starts[i] = total
            total += int(sizes[i])
        yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(starts), batch["line"]], ["file", "block", "within", "line"])


def lines_at(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``start, line``: every line of the files, which follow one another, and the byte it starts at.
    Lines end at a line feed; the last one of a file may lack it."""
    raw = spark.read.option("lineSep", "\n").text([f for f, _ in files])
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    placed = raw.mapInArrow(_within, _LINE)
    blocks = raw.groupBy("file", "block").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    line = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("ahead"))
    firsts, total = [], 0
    for name, size in files:
        firsts.append((_plain(name), total))
        total += size
    first = spark.createDataFrame(firsts, "name string, first long")
    rows = placed.join(blocks, ["file", "block"]).withColumn("name", _plain_column(F.col("file"))).join(first, "name")
    return rows.select((F.col("first") + F.col("ahead") + F.col("within")).alias("start"), "line")


def _plain(path: str) -> str:
    """A path without the slashes that some file systems put after the scheme."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def _plain_column(path: Column) -> Column:
    return F.regexp_replace(path, r"^([^:]+):/+", "$1:/")


def after(lines: DataFrame, start: int) -> DataFrame:
    """The lines that a reader sees which opens the stream at a byte and drops the rest of the line it is in."""
    return lines if start == 0 else lines.where(F.col("start") > start)


def judged(lines: DataFrame, one: str, other: str, most: int, size: Column) -> DataFrame:
    """``start, reason, one, other, pair, size`` of each line. Reasons, the first that applies:
    ``invalid_json``, ``invalid_record`` (no object, or a field that is no text), ``empty_text``,
    ``copied_answer``, ``over_context`` (``one`` is larger than ``most``), else null. ``size`` reads both columns."""
    value = F.try_parse_json("line")
    rows = lines.select("start", "line", value.alias("v"))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    text = lambda name: F.when(F.schema_of_variant(field(name)) == "STRING", F.trim(F.try_variant_get("v", f"$.{name}", "string")))
    rows = rows.select("start", F.col("v").isNotNull().alias("parsed"), F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("object"), text(one).alias("one"), text(other).alias("other"))
    reason = (
        F.when(~F.col("parsed"), "invalid_json").when(~F.col("object") | F.col("one").isNull() | F.col("other").isNull(), "invalid_record")
        .when((F.col("one") == "") | (F.col("other") == ""), "empty_text").when(F.lower("one") == F.lower("other"), "copied_answer")
        .when(F.regexp_count("one", F.lit(r"[^\x20\x09-\x0D]+")) > most, "over_context")
    )
    pair = F.sha2(F.concat(F.col("one"), F.lit("\0"), F.col("other")), 256)
    return rows.select("start", reason.alias("reason"), "one", "other", pair.alias("pair"), size.cast("long").alias("size"))


def until(rows: DataFrame, target: int) -> tuple[DataFrame, bool]:
    """Marks repeated pairs, and keeps the lines up to the one with which the accepted sizes reach
    ``target``; whether they do. Of equal pairs the first counts."""
    good = rows.where("reason IS NULL")
    first = good.groupBy("pair").agg(F.min("start").alias("first"))
    again = good.join(first, "pair").where(F.col("start") > F.col("first")).select("start", F.lit(True).alias("again"))
    rows = rows.join(again, "start", "left").withColumn("reason", F.when(F.col("again"), "exact_duplicate").otherwise(F.col("reason"))).drop("again")
    worth = F.when(F.col("reason").isNull(), F.col("size")).otherwise(0)
    total = running(dealt(rows, [], ["start"], "scan"), [], ["start"], "sum", worth, "total", inclusive=True).drop(PART)
    total = stored(total, "scan-totals")
    end = total.where(F.col("total") >= target).agg(F.min("start").alias("s")).first()["s"]
    return (total, False) if end is None else (total.where(F.col("start") <= end), True)


def scan(spark: SparkSession, path: str, seed: str, target: int, one: str, other: str, most: int, size: Column) -> DataFrame:
    """Every line of the scan with its reason, from the seeded start to the one that reaches ``target``.
    A stream that ends before is an error."""
    files = file_sizes(spark, path)
    start = seeded_start(seed, sum(n for _, n in files))
    ahead, skipped = 0, []
    while files and ahead + files[0][1] <= start:  # files that end before the start are not opened
        ahead += files[0][1]
        skipped.append(files.pop(0))
    wave = 1
    while True:
        lines = lines_at(spark, files[:wave]).withColumn("start", F.col("start") + ahead)
        found, done = until(judged(after(lines, start), one, other, most, size), target)
        if done:
            return found
        if wave >= len(files):
            raise ValueError(f"the stream ends before {target} is reached")
        wave *= 2


def reason_counts(scanned: DataFrame) -> DataFrame:
    """``reason, n``: lines read by what became of them; accepted ones have the reason ``accepted``."""
    return scanned.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def sample(rows: DataFrame, key: str, seed: str, n: int, size: Column, least: int) -> DataFrame:
    """``n`` rows by the hash of seed and key, of those of at least ``least`` size; fewer are an error."""
    rank = F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(key).cast("string")), 256)
    kept = stored(rows.where(size >= least).withColumn("rank", rank).orderBy("rank", key).limit(n), "sample")
    if (found := kept.count()) < n:
        raise ValueError(f"{found} rows of {n} are there")
    return kept
