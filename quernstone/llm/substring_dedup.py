"""Substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats.

Seed. Every run of ``ANCHOR`` words has a hash; a window of ``span`` words is
anchored at the least hash inside it (the last of equals), so equal windows have
equal anchors at equal places. Neighbouring windows with one anchor form a
stretch: the anchor with the text that reaches both ways to the furthest window
it owns. Stretches, about one for twenty words, are all that is shuffled.

Extend. Stretches meet on their anchor. Equal stretches match over their whole
reach at once and are pre-aggregated to the least doc_id. Where stretches of one
anchor differ (a passage ends, a word was edited), one of each kind goes back to
its text, and its windows are matched one by one, anchor and window hash
together. No pair of documents is ever formed, so a passage in a third of all
documents costs one group of equal rows, combined before the shuffle.

Keep. Matched windows of a document merge to maximal spans of at least ``span``
words; a word is removed if a span with an earlier copy covers it.

Anchor, stretch and window are compared by two independent 64-bit hashes.

Defined results: null and blank texts have no words and the digest of the empty
text. A copy counts as earlier only under a strictly smaller doc_id: repeats
inside one document, or between rows that share a doc_id, stay. Rows with a null
doc_id are returned unchanged and make no copy earlier. Rows are matched to
their spans by doc_id and a text hash. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, cut, mix64, read_table, word_hashes

SPAN, ANCHOR = 50, 10
#: Documents hashed at a time: arrays stay small beside the Arrow batch.
SLICE = 256

STRETCHES = "doc_id long, text_key long, anchor long, content long, start int, windows int"
WINDOWS = "doc_id long, text_key long, anchor long, window long, start int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours, the last of equals."""
    best, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        one, two = best[: len(best) - step], best[step:]
        best = np.where(values[two] <= values[one], two, one)
        reach += step
    return best


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for first in range(0, batch.num_rows, SLICE):
        part = batch.slice(first, SLICE)
        texts = part.column(at).cast(pa.binary()).to_pylist()
        yield part, [t.split() if t else [] for t in texts]


def _stretches(span: int, anchor: int) -> Callable:
    grams, reach = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "anchor", "content", "start", "windows"]
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, docs in _slices(batch, 2):
                    sizes = np.array([len(d) for d in docs], dtype=np.int64)
                    total = int(sizes.sum())
                    if total < span:
                        continue
                    hashes = word_hashes([w for d in docs for w in d])
                    owner = np.repeat(np.arange(len(docs)), sizes)
                    p = grams.prefix(hashes)
                    at = np.arange(total - anchor + 1)
                    keys = grams.of(p, at, at + anchor)
                    place = _least(keys, span - anchor + 1)  # by first word of the window
                    whole = np.flatnonzero(owner[: total - span + 1] == owner[span - 1 :])
                    if not len(whole):
                        continue
                    place = place[whole]
                    new = np.empty(len(whole), dtype=bool)
                    new[0] = True
                    new[1:] = (place[1:] != place[:-1]) | (np.diff(whole) != 1) | (owner[whole[1:]] != owner[whole[:-1]])
                    first = np.flatnonzero(new)
                    windows = np.diff(np.append(first, len(whole)))
                    start = whole[first]
                    p = reach.prefix(hashes)
                    content = reach.of(p, start, start + windows + span - 1)
                    who = owner[start]
                    begins = np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)),
                        pa.array(keys[place[first]].view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array((start - begins[who]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                    ], names=names)

    return find


def _single_windows(span: int) -> Callable:
    one = Rolling(0x165667B19E3779F9)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "anchor", "window", "start"]
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, docs in _slices(batch, 2):
                    wanted = part.column(3)
                    for i, words in enumerate(docs):
                        rows = wanted[i].values
                        start = rows.field("start").to_numpy().astype(np.int64)
                        windows = rows.field("windows").to_numpy().astype(np.int64)
                        anchor = rows.field("anchor").to_numpy()
                        p = one.prefix(word_hashes(words))
                        n = int(windows.sum())
                        which = np.repeat(np.arange(len(start)), windows)
                        at = start[which] + np.arange(n) - np.repeat(np.cumsum(windows) - windows, windows)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, part.column(0)[i].as_py(), dtype=np.int64)),
                            pa.array(np.full(n, part.column(1)[i].as_py(), dtype=np.int64)),
                            pa.array(anchor[which]), pa.array(one.of(p, at, at + span).view(np.int64)),
                            pa.array(at.astype(np.int32)),
                        ], names=names)

    return find


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal spans that overlapping or touching ones form, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


def _removed(with_text: bool) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, docs in _slices(batch, 1):
                ids, found = part.column(0), part.column(2)
                n_words, n_removed, digests, spans, texts = [], [], [], [], []
                for i, words in enumerate(docs):
                    n_words.append(len(words))
                    kept, mine = words, []
                    if found[i].is_valid and len(found[i]):
                        rows = found[i].values
                        first = rows.field("start").to_numpy().astype(np.int64)
                        begin, stop = merge_spans(first, first + rows.field("length").to_numpy())
                        mine = list(zip(begin.tolist(), stop.tolist(), strict=True))
                        kept, last = [], 0
                        for a, b in mine:
                            kept += words[last:a]
                            last = b
                        kept += words[last:]
                    n_removed.append(len(words) - len(kept))
                    text = b" ".join(kept)
                    digests.append(hashlib.sha256(text).hexdigest())
                    spans.append([{"start": a, "end": b} for a, b in mine])
                    texts.append(text.decode())
                columns = {
                    "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
                if with_text:
                    columns["kept_text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return apply


def repeated_windows(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, text_key, start, length``: runs of words with an earlier copy elsewhere."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    stretches = cut(rows.mapInArrow(_stretches(span, anchor), STRETCHES), "repeat-stretches")
    kinds = stretches.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    anchors = kinds.groupBy("anchor").agg(
        F.min("first").alias("least"), F.max("last").alias("most"), F.max("first").alias("latest")
    ).where("least < most").select("anchor", (F.col("least") < F.col("latest")).alias("differs"))
    shared = kinds.join(anchors, "anchor").select("anchor", "content", "first", "differs").where("first < last OR differs")
    met = cut(stretches.join(shared, ["anchor", "content"]), "repeat-met")

    whole = met.where("doc_id > first").select("doc_id", "text_key", "start", (F.col("windows") + (span - 1)).alias("length"))

    asked = met.where("doc_id = first AND differs").groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "windows", "anchor")).alias("wanted")
    )
    texts = rows.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "wanted")
    windows = cut(texts.mapInArrow(_single_windows(span), WINDOWS), "repeat-windows")
    earliest = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    single = windows.join(earliest, ["anchor", "window"]).where("doc_id > first")
    single = single.select("doc_id", "text_key", "start", F.lit(span).alias("length"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` (and ``kept_text``) for every row."""
    runs = repeated_windows(docs, span, anchor)
    spans = runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "length")).alias("found"))
    spans = cut(spans, "repeat-spans")
    rows = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    joined = rows.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_removed(with_text), schema + (", kept_text string" if with_text else ""))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS d FROM g GROUP BY h),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 50)) AS i FROM g JOIN m USING (h) WHERE g.doc_id > m.d),
k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
