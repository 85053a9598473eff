"""Spelling variants by full neighbourhood generation.

Two words are near if one inserted, deleted or replaced letter turns one into the
other. Each word emits all of its neighbours over the observed alphabet: every
deletion, replacement and insertion. Those that are words are found by a hash join
with the vocabulary, so no distance is ever computed.

A word of ten letters has about a thousand neighbours, and nearly all of them are no
words. They are therefore made as 64-bit polynomial hashes, by array arithmetic from
the hashes of the word's beginnings and ends, and screened by a bitmap of the
vocabulary's hashes. What passes is written out as text, and joined by equality with
the vocabulary: the bitmap loses no neighbour, and one it lets through wrongly finds
no partner. The bitmap is built by bitmap aggregates from ``FILTER_WORDS`` words at
most, and so is what the driver sends; a larger vocabulary is split by hash, with a
pass over the words for each part.

A word's form is its near word that occurs most, if that is often enough more; forms
are followed to the last by pointer doubling. Counts at least double from a word to
its form, so there is no ring, and chains are short.

Defined results: null and empty texts have no words; a null id never misspells.
Equal counts: the first form in code-point order. Repeated rows count each for
itself. A vocabulary without words gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, mix64, read_table
from .merkle_manifest import CRC_TABLE_SQL, crc_sql

#: Runs of letters, after A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: Words a bitmap holds at most, and its bits a word: 32 MB in all.
FILTER_WORDS, BITS_A_WORD = 4_000_000, 64
#: Words of a task, and neighbours made at once within one.
TASK_WORDS, AT_ONCE = 20_000, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_STEP = np.uint64(_BASE)
_ONE, _THREE, _SEVEN, _HALF = np.uint64(1), np.uint64(3), np.uint64(7), np.uint64(32)


# -- words ------------------------------------------------------------------------


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of a column ``word`` of all occurrences."""
    counted = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def misspelt(docs: DataFrame, every: int) -> DataFrame:
    """``word`` of every run of letters; one in ``every``, by a hash of id and run, lacks a letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    chance = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (chance % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    return runs.select(F.when(chance % every == 0, shorter).otherwise(F.col("run")).alias("word"))


# -- hashes of words and of their neighbours ----------------------------------------


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_ONE], np.full(n, _STEP)]), dtype=np.uint64)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) * _STEP + _ONE)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix64(sums + np.uint64(length * int(_BACK) % 2**64))


def _by_length(words: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Words of one length, in lists of ``most`` letters or so."""
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, same in groups.items():
        few = max(1, most // (length + 1))
        for i in range(0, len(same), few):
            yield length, same[i : i + few]


def hashes_of(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The words, grouped by length, and their hashes."""
    order, found = [], []
    for length, same in _by_length(words, AT_ONCE):
        order += same
        found.append(_finished((_values(_codes(same)) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length))
    return order, np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _screen(hashes: np.ndarray, bitmap: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which of the hashes the bitmap may hold: two bits each, the second looked up for what the first lets pass."""
    mask = np.uint64(len(bitmap) * 8 - 1)
    at = hashes & mask
    kept = np.flatnonzero(bitmap[at >> _THREE] >> (at & _SEVEN).astype(np.uint8) & 1)
    at = (hashes[kept] >> _HALF) & mask
    kept = kept[(bitmap[at >> _THREE] >> (at & _SEVEN).astype(np.uint8) & 1).astype(bool)]
    return kept if parts == 1 else kept[_part(hashes[kept], parts) == part]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) % np.uint64(parts)).astype(np.int64)


def neighbours(words: list[str], alphabet: str, passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[str, str]]:
    """Word and neighbour, for each neighbour whose hash ``passes``; repeats are left in."""
    letters = _values(np.array([ord(c) for c in alphabet], dtype=np.uint32))
    for length, same in _by_length(words, max(1, AT_ONCE // max(1, len(alphabet)))):
        power = _powers(length + 1)
        values = _values(_codes(same))
        ahead = np.zeros((len(same), length + 1), dtype=np.uint64)
        np.cumsum(values * power[:length], axis=1, out=ahead[:, 1:])
        rest = ahead[:, -1:] - ahead  # what follows the first i letters, in its place

        shorter = ahead[:, :-1] + rest[:, 1:] * _BACK
        for k in passes(_finished(shorter, length - 1).ravel()):
            w, i = divmod(int(k), length)
            yield same[w], same[w][:i] + same[w][i + 1 :]

        placed = letters * power[: length + 1, None]  # position by letter
        other = (ahead[:, :-1] + rest[:, 1:])[:, :, None] + placed[:length]
        for k in passes(_finished(other, length).ravel()):
            w, i, a = np.unravel_index(k, other.shape)
            if same[w][i] != alphabet[a]:
                yield same[w], same[w][:i] + alphabet[a] + same[w][i + 1 :]

        longer = (ahead + rest * _STEP)[:, :, None] + placed
        for k in passes(_finished(longer, length + 1).ravel()):
            w, i, a = np.unravel_index(k, longer.shape)
            yield same[w], same[w][:i] + alphabet[a] + same[w][i:]


# -- tables -------------------------------------------------------------------------


def _with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, hashes = hashes_of(batch["word"].to_pylist())
        yield pa.RecordBatch.from_pydict({"word": words, "h": hashes.view(np.int64)})


def _bitmap(hashes: DataFrame, bits: int, part: int, parts: int) -> bytes:
    """Both bits of the hashes of a part. Pieces of 4 KB come to the driver, ``bits`` in all."""
    own = hashes if parts == 1 else hashes.where(F.shiftrightunsigned("h", 48) % parts == part)
    low = lambda h: h.bitwiseAND(F.lit(bits - 1)) + 1
    both = own.select(F.explode(F.array(low(F.col("h")), low(F.shiftrightunsigned("h", 32)))).alias("at"))
    pieces = both.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("set"))
    whole = bytearray(max(bits // 8, 4096))
    for r in pieces.toLocalIterator():
        whole[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = r["set"]
    return bytes(whole)


def near_words(words: DataFrame, n_words: int, filter_words: int = FILTER_WORDS) -> DataFrame:
    """``word, near, near_n`` of all near pairs, both ways, of a vocabulary ``word, n`` that is stored."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.toLocalIterator()))  # at most all letters there are
    parts = -(-n_words // filter_words) or 1
    bits = 1 << max(15, (BITS_A_WORD * -(-n_words // parts)).bit_length())
    hashes = words.select("word").mapInArrow(_with_hashes, "word string, h long")
    if parts > 1:
        hashes = cut(hashes, "spelling-hashes")
    found = None
    for part in range(parts):
        sent = spark.sparkContext.broadcast(_bitmap(hashes, bits, part, parts))

        def emit(batches: Iterator[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            bitmap = np.frombuffer(sent.value, dtype=np.uint8)
            for batch in batches:
                given = batch["word"].to_pylist()
                for i in range(0, len(given), 2000):
                    pairs = set(neighbours(given[i : i + 2000], alphabet, lambda h: _screen(h, bitmap, part, parts)))
                    if pairs:
                        yield pa.RecordBatch.from_pydict(dict(zip(("word", "near"), map(list, zip(*pairs, strict=True)), strict=True)))

        # A task's work is the neighbours of its words, whatever the size of the files they came from.
        dealt = words.select("word").repartition(max(spark.sparkContext.defaultParallelism, n_words // TASK_WORDS), "word")
        emitted = cut(dealt.mapInArrow(emit, "word string, near string"), "spelling-candidates")
        found = emitted if found is None else found.unionByName(emitted)
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, by pointer doubling: at most log2 log2 of the largest count rounds."""
    pointers = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while pointers.where("open").limit(1).count():
        after = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = pointers.where("open").join(after, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        pointers = cut(pointers.where("NOT open").unionByName(moved), "spelling-roots")
    return pointers.drop("open")


def variants(words: DataFrame, times: int = TIMES, filter_words: int = FILTER_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary ``word, n``."""
    words = cut(words.select("word", "n"), "spelling-words")
    best = near_words(words, words.count(), filter_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best")
    )
    often = -F.col("best.down") >= times * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.down")).alias("form_n"),
    )
    rows = cut(rows, "spelling-forms")
    formed = rows.where("form IS NOT NULL")
    rows = rows.join(_roots(formed), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(misspelt(read_table(spark, sf_dir, "documents"), 97)))


OP13_SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL},
 r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{RUN}')) AS run FROM documents) q GROUP BY ALL),
 h AS (SELECT run, c, {crc_sql("doc_id || ':' || run")} AS h FROM r, crc),
 w AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
 v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
 p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
 l AS (SELECT word, n, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM p),
 s AS (SELECT DISTINCT l.word AS x, v.word AS y FROM l JOIN v ON v.word = l.a || l.b),
 e AS (SELECT x, y FROM s UNION ALL SELECT y, x FROM s UNION ALL SELECT l.word, m.word FROM l JOIN l m ON m.i = l.i AND m.a = l.a AND m.b = l.b AND m.word <> l.word),
 g AS (SELECT x, y, v.n AS m, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS k, count(*) OVER (PARTITION BY x) AS n_near FROM e JOIN v ON v.word = y),
 f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN g ON x = word AND k = 1),
 t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f z ON z.word = t.at WHERE z.form IS NULL"""
