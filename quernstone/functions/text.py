"""Column functions on text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def words(col: Column) -> Column:
    """Lower-case words of letters, digits, underscores and apostrophes."""
    return F.regexp_extract_all(F.lower(F.replace(col, F.lit("ß"), F.lit("ss"))), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def shingles(words_column: Column, width: int) -> Column:
    """Distinct runs of ``width`` words; shorter texts have one of all their words."""
    n = F.size(words_column) - (width - 1)
    zipped = F.arrays_zip(*[F.slice(words_column, i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(width)])
    runs = F.transform(zipped, lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(width)]))
    return F.when(n >= 1, F.array_distinct(runs)).otherwise(F.array(F.array_join(words_column, " ")))


def ngram_hashes(word_hashes: Column, width: int) -> Column:
    """Runs of ``width`` entries of an array of word hashes, each as two 64-bit hashes.
    Neighbours are zipped from slices of the whole array, so the work is linear in its
    length; repeats are left in, as structs would be compared pair by pair to drop them."""
    n = F.greatest(F.size(word_hashes) - (width - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(word_hashes, i + 1, n).alias(f"w{i}") for i in range(width)])
    run = lambda s: [s[f"w{i}"] for i in range(width)]
    return F.transform(zipped, lambda s: F.struct(F.xxhash64(*run(s)).alias("h"), F.xxhash64(F.lit(width), *run(s)).alias("h2")))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC with line breaks as LF, trimmed; Spark has no such function of its own."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).strip())


def without_controls(col: Column) -> Column:
    return F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")


def unit_fraction(key: Column, salt: str) -> Column:
    """Uniform in [0, 1): the first 8 bytes of SHA-256 over salt, NUL and key."""
    digest = F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
