"""Overlap of word n-grams with a reference set: rates by width, longest match, contamination.

Grams are hashed inside the row's array, and only the reference's distinct grams
meet the corpus: where they are small Spark sends them to the corpus, else both
sides are dealt by hash. Counts follow on hits alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_hashes, words
from ..plans.tables import stored


def grams(rows: DataFrame, key: str, text: str, widths: tuple[int, ...]) -> DataFrame:
    """``key, n, h, h2``: the n-grams of each text, repeats included; texts are read once for all widths."""
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    base = rows.select(key, F.explode(F.array(hashed)).alias("w"))  # a column of its own: texts are taken apart once
    if len(widths) > 1:
        base = stored(base, "overlap-words")
    out = None
    for n in widths:
        part = base.select(key, F.lit(n).alias("n"), F.explode(ngram_hashes(F.col("w"), n)).alias("g")).select(key, "n", "g.h", "g.h2")
        out = part if out is None else out.unionByName(part)
    return out


def _found(corpus: DataFrame, text: str, wanted: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """``n, h, h2``: the wanted n-grams that the corpus has.

    A run of words is wanted only if its first words are: each width is looked up among
    the places that the width below left, which after two words are few."""
    wanted = stored(wanted, "overlap-wanted")
    hashed = corpus.select(F.explode(F.array(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))).alias("w"))
    most = max(widths)
    runs = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(most)])
    places, out = hashed.select(F.inline(runs)), None
    for n in sorted(widths):
        run = [F.col(f"w{i}") for i in range(n)]
        at = hashed.select(F.explode("w").alias("w0")) if n == 1 else places
        whole = at.where(f"w{n - 1} IS NOT NULL").withColumn("h", F.xxhash64(*run)).withColumn("h2", F.xxhash64(F.lit(n), *run))
        hits = whole.join(wanted.where(F.col("n") == n).select("h", "h2"), ["h", "h2"], "left_semi")
        part = hits.select(F.lit(n).alias("n"), "h", "h2").distinct()
        out = part if out is None else out.unionByName(part)
        if 1 < n < most:
            places = stored(hits.drop("h", "h2").distinct(), "overlap-places")
    return out


def overlap_rates(items: DataFrame, key: str, corpus: DataFrame, text: str, widths: tuple[int, ...] = tuple(range(1, 13))) -> DataFrame:
    """``key, n, n_grams, n_found, rate``: how many of an item's n-grams the corpus has."""
    mine = stored(grams(items, key, text, widths).distinct(), "overlap-items")
    found = _found(corpus, text, mine.select("n", "h", "h2").distinct(), widths)
    rows = mine.join(found.withColumn("hit", F.lit(1)), ["n", "h", "h2"], "left").groupBy(key, "n").agg(F.count(F.lit(1)).alias("n_grams"), F.count("hit").alias("n_found"))
    return rows.withColumn("rate", F.col("n_found") / F.col("n_grams"))


def contaminated(corpus: DataFrame, key: str, items: DataFrame, text: str, width: int = 12) -> DataFrame:
    """``key, n_shared, contaminated`` for every row of the corpus."""
    held = grams(items.select(F.lit(0).alias("any"), text), "any", text, (width,)).select("h", "h2").distinct()
    hits = grams(corpus, key, text, (width,)).join(held, ["h", "h2"], "left_semi").groupBy(key).agg(F.count_distinct("h", "h2").alias("n_shared"))
    rows = corpus.select(key).distinct().join(hits, key, "left")
    return rows.select(key, F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.col("n_shared").isNotNull().alias("contaminated"))
