"""Exact dedup: static binary-fuse filters of a snapshot screen incoming digests.

The snapshot (documents taken in earlier) is immutable. Its distinct digests are
dealt into buckets by their leading bits, and each bucket gets one 3-wise binary
fuse filter, written once to the shared folder. Digests of a new batch meet only
their bucket's filter; those it lets through join the exact digests, and their
texts are compared byte by byte. Duplicates inside the batch are grouped apart.

Defined results: a null text counts as empty, and equals an empty one. Null
doc_ids never win while another id of the group exists. Rows that repeat both
doc_id and text are one document: each is marked kept where that id stays.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, nested, read_table

#: Digests a filter holds on average; a filter takes about 2.3 bytes for each.
BUCKET_KEYS = 1 << 15

FILTER_SCHEMA = "bucket long, seed long, segment long, segments long, slots binary"


# -- the filter ----------------------------------------------------------------


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments, and a 16-bit fingerprint, for each key."""
    with np.errstate(over="ignore"):
        h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        g = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
    first = (h >> np.uint64(32)) % np.uint64(segments)
    mask = np.uint64(segment - 1)
    parts = [(g >> np.uint64(s)) & mask for s in (0, 21, 42)]
    slots = np.stack([(first + np.uint64(i)) * np.uint64(segment) + parts[i] for i in range(3)]).astype(np.int64)
    return slots, (h & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> dict:
    """Peels keys in rounds of slots that hold one key, then fills slots backwards."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(2, len(keys))
    segment = min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += 1 + segments // 8
        size = (segments + 2) * segment
        slots, prints = _places(keys, seed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)
        index = np.arange(len(keys), dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, index)
        left, rounds = len(keys), []
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(held[single], return_index=True)
            rounds.append((key, single[at]))
            left -= len(key)
            for row in slots:
                np.subtract.at(count, row[key], 1)
                np.bitwise_xor.at(held, row[key], key)
            touched = np.unique(slots[:, key])
            single = touched[count[touched] == 1]
        if left == 0:
            table = np.zeros(size, dtype=np.uint16)
            for key, at in reversed(rounds):
                value = prints[key].copy()
                for row in slots:
                    value ^= np.where(row[key] == at, np.uint16(0), table[row[key]])
                table[at] = value
            return {"seed": seed, "segment": segment, "segments": segments, "slots": table.tobytes()}
    raise RuntimeError("no seed makes the filter peel")


def may_hold(keys: np.ndarray, seed: int, segment: int, segments: int, slots: bytes) -> np.ndarray:
    at, prints = _places(keys.astype(np.uint64), seed, segment, segments)
    table = np.frombuffer(slots, dtype=np.uint16)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    raw = b"".join(bytes(x[8:16]) for x in digests)
    return np.frombuffer(raw, dtype="<u8")


# -- the operator ---------------------------------------------------------------


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return groups.withColumn("bucket", lead % F.lit(buckets))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket over the snapshot's distinct digests."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(_keys(part["digest"]))
        return pd.DataFrame([{"bucket": int(part["bucket"].iloc[0]), **made}])

    return _bucketed(groups, buckets).select("bucket", "digest").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's digest groups with ``hit``: whether the snapshot may hold them."""

    def test(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "hit": []})
        hit = np.zeros(len(part), dtype=bool)
        for row in held.itertuples(index=False):
            hit |= may_hold(_keys(part["digest"]), row.seed, row.segment, row.segments, row.slots)
        return part.assign(hit=hit)[["digest", "keep_id", "group_size", "hit"]].astype({"keep_id": "Int64"})

    batch = _bucketed(groups, buckets).groupBy("bucket")
    return batch.cogroup(filters.groupBy("bucket")).applyInPandas(
        test, "digest binary, keep_id long, group_size long, hit boolean"
    )


def duplicate_groups(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size`` over snapshot and batch (both ``doc_id, digest``)."""
    held = cut(_groups(snapshot), "dedup-snapshot")
    new = _groups(batch)
    buckets = max(1, 1 << math.ceil(math.log2(max(1, held.count() / BUCKET_KEYS))))
    filters = cut(snapshot_filters(held, buckets), "dedup-filters")
    screened = cut(screen(new, filters, buckets), "dedup-screened")
    hits, fresh = screened.where("hit").drop("hit"), screened.where("NOT hit").drop("hit")
    old = held.select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    # Null ids lose: greatest() skips them.
    merged = hits.join(old, "digest", "left").select(
        "digest",
        F.greatest("keep_id", "old_id").alias("keep_id"),
        (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"),
    )
    return merged.unionByName(fresh).unionByName(held.join(hits, "digest", "left_anti"))


def byte_mismatches(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of groups of several whose text differs from the text that stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    several = groups.where("group_size > 1").select("digest", "keep_id")
    members = cut(rows.join(several, "digest").select("doc_id", "digest", "text", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays")), "dedup-members")
    # Equal texts have equal least and greatest ones; both combine before the shuffle, so a large group meets as a few rows.
    ends = members.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    odd = ends.where("least <> most").select("digest")
    stays = members.where("stays").join(odd, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("stay"))
    return members.join(stays, "digest").where("text <> stay").select("doc_id", "digest", F.md5("text").alias("variant"))


def exact_dedup(docs: DataFrame, in_snapshot: F.Column | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``in_snapshot`` marks the rows of the earlier snapshot (null: not in it); by
    default every second document by a hash of its id."""
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = cut(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
            F.coalesce(in_snapshot, F.lit(False)).alias("old"),
        ),
        "dedup-rows",
    )
    groups = cut(duplicate_groups(rows.where("old").drop("old"), rows.where("NOT old").drop("old")), "dedup-groups")
    rows, keys = rows.drop("old"), ["digest"]
    wrong = byte_mismatches(docs, groups)
    if not wrong.isEmpty():  # two texts under one SHA-256: group by both digests
        keys = ["digest", "variant"]
        rows = rows.join(wrong.distinct(), ["doc_id", "digest"], "left").fillna("", ["variant"])
        groups = rows.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, keys).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one row a text."""
    kept = exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    kept = cut(kept.agg(F.count(F.lit(1)).alias("n")), "dedup-kept")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = nested(docs, F.col("doc_id").alias("row_id"), sha.alias("row_sha"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_sha") == F.col("sha"))
    once = rows.join(kept.where("n = 1"), same, "left_semi")
    again = rows.join(kept.where("n > 1"), same, "left_semi").dropDuplicates(["row_id", "row_sha"])
    return once.unionByName(again).select("row.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
