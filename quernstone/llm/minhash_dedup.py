"""Near-duplicates: one-permutation MinHash, banded buckets, star-shaped edges.

Each text's set of word shingles is hashed once (one permutation) into
``SLOTS`` bins that keep their minimum; empty bins copy a filled one chosen by
random probes (optimal densification). ``ROWS`` bins a band give bucket keys. In
a bucket one set, chosen by a hash, meets the others (a star), so a bucket of n
proposes n-1 pairs, and sets that share several buckets meet several centres.
Size and odd sketches, which never miss a link, must allow the threshold; what
they leave is confirmed on full sets, and components of the links follow.

A star can miss a link between two leaves that both fail with its centre. Buckets
that still hold several components are therefore searched whole, once, by a prefix
filter over their sets, which is exact: two sets that link share one of the rarest
shingles of both. Groups of near copies are one component by then, edits that each
copy has for itself meet nothing, and sketches part the rest, so few pairs of
different components come out, however large a group is.

Sets that are equal are one node from the start, so copies never form pairs.

Defined results: null or blank texts have an empty set and link with nothing.
Texts with fewer words than a shingle have one of all their words. Rows that share a
doc_id are one node. A null doc_id gets no component unless an equal set has an
id; a row is kept where its id is its component's. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, cut, mix64, nested, read_table, word_hashes
from .components import connected_components

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: What op10 is defined by: words of a shingle, and links need 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 3, 85
#: The same for ``keep_one``, which no query defines: the reference's lexical families.
KEEP_WIDTH, KEEP_PERCENT = 5, 80
#: Longs of 64 bits in an odd sketch: which of so many buckets hold an odd number of a
#: set's shingles. Sketches of two sets differ in at most as many bits as the sets do.
ODD = 32
#: Turns of stars before what they leave apart is searched whole.
TURNS = 1

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - 7)

SIGNATURES = "doc_id long, n_shingles long, low long, high long, odd array<long>, bands array<long>"
SETS = "id long, shingles array<long>"


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else 0, dtype=np.uint64)
    for j in range(min(width, len(h))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _probes() -> np.ndarray:
    """For bin i, an endless-enough sequence of random bins to borrow from."""
    tries = np.arange(4096, dtype=np.uint64)[None, :] + np.uint64(1)
    bins = np.arange(SLOTS, dtype=np.uint64)[:, None]
    return (mix64(bins * np.uint64(0x9E3779B97F4A7C15) + tries * np.uint64(0xC2B2AE3D27D4EB4F)) >> _SHIFT).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS minima for each set; an empty set has a row of ones."""
    out = np.full((len(sets), SLOTS), _EMPTY, dtype=np.uint64)
    for row, hashes in zip(out, sets, strict=True):
        bins = (hashes >> _SHIFT).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        row[bins[first]] = hashes[first]
    filled = out != _EMPTY
    some = filled.any(axis=1)
    source = out.copy()
    open_rows, open_bins = np.nonzero(~filled & some[:, None])
    probes = _probes()
    for k in range(probes.shape[1]):
        if not len(open_rows):
            break
        lender = probes[open_bins, k]
        ready = filled[open_rows, lender]
        # A borrowed minimum is marked by the try, so that lender and borrower differ alike everywhere.
        out[open_rows[ready], open_bins[ready]] = source[open_rows[ready], lender[ready]]
        open_rows, open_bins = open_rows[~ready], open_bins[~ready]
    return out


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
        ("odd", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ])
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t, width) for t in part.column(1).cast(pa.binary()).to_pylist()]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                rows = signatures(sets)
                low = np.array([np.bitwise_xor.reduce(mix64(s)) if len(s) else 0 for s in sets], dtype=np.uint64)
                high = np.array([np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], dtype=np.uint64)
                odd = np.array([np.bincount((s & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1 for s in sets], dtype=np.uint8)
                odd = np.packbits(odd.reshape(-1, 64 * ODD), axis=1).view(np.int64)
                odd_ends = np.arange(0, ODD * len(sets) + 1, ODD, dtype=np.int32)
                keys = np.zeros((len(sets), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, j::ROWS])
                ends = np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(odd_ends), pa.array(odd.ravel())), bands], schema=schema)


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t, width) for t in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)


def _sketches_fit(percent: int) -> Column:
    """Whether sizes ``n_a, n_b`` and odd sketches ``odd_a, odd_b`` allow the threshold; true for every link."""
    both = F.col("n_a") + F.col("n_b")
    bits = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & ((100 + percent) * bits <= (100 - percent) * both)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = barrier(both, "p", F.struct(F.size(F.array_intersect("set_a", "set_b")).alias("k"), (F.size("set_a") + F.size("set_b")).alias("n")), "a", "b")
    return both.where(100 * F.col("p.k") >= percent * (F.col("p.n") - F.col("p.k"))).select("a", "b")


def _mixed(entries: DataFrame, key: str) -> DataFrame:
    """The keys whose entries are of more than one component."""
    ends = entries.groupBy(key).agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    return ends.where("c0 < c1").select(key)


def _star_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """``a, b``: in each bucket of several components, one entry against those of other components.

    The centre is the least by a hash of id, bucket and turn, so sets that share several
    buckets meet several centres, and other ones at each turn: n - 1 pairs a bucket at most."""
    order = F.xxhash64("id", "bucket", F.lit(turn))
    pick = F.min(F.struct(order.alias("o"), "id", "component"))
    centre = entries.groupBy("bucket").agg(pick.alias("c"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    pairs = entries.join(centre.select("bucket", F.col("c.id").alias("centre"), F.col("c.component").alias("of")), "bucket").where("component <> of")
    return pairs.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()


def _described(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    one = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("odd").alias("odd_a"))
    two = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("odd").alias("odd_b"))
    return pairs.join(one, "a").join(two, "b")


def _rest_pairs(entries: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: every pair of different components that can still link, among the sets of mixed buckets.

    Prefix filter: of a set of n shingles in one order for all, the first n - ceil(J * n) + 1
    hold one of any set it links with. The order is by how many of these sets have a
    shingle, so edits come first and what a group shares comes last."""
    live = entries.join(_mixed(entries, "bucket"), "bucket", "left_semi").select("id", "component").distinct()
    held = sets.join(live, "id").select("id", "component", F.explode("shingles").alias("shingle"))
    held = cut(held, "near-held")
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    common = held.join(common.where("df > 1"), "shingle")
    found = common.groupBy("id", "component").agg(F.sort_array(F.collect_list(F.struct("df", "shingle", (F.col("c0") < F.col("c1")).alias("mixed")))).alias("g"))
    found = found.join(nodes.select("id", "n_shingles", "odd"), "id")
    n = F.col("n_shingles").cast("int")
    # A shingle that no other set has comes first and meets nothing.
    reach = n - F.ceil(n * percent / 100).cast("int") + 1 - (n - F.size("g"))
    heads = found.select("id", "component", "n_shingles", "odd", F.explode(F.slice("g", F.lit(1), F.greatest(reach, F.lit(0)))).alias("h"))
    heads = cut(heads.where("h.mixed").select("id", "component", "n_shingles", "odd", "h.shingle"), "near-heads")
    one = heads.select(F.col("shingle").alias("of_a"), F.col("id").alias("a"), F.col("component").alias("x"), F.col("n_shingles").alias("n_a"), F.col("odd").alias("odd_a"))
    two = heads.select(F.col("shingle").alias("of_b"), F.col("id").alias("b"), F.col("component").alias("y"), F.col("n_shingles").alias("n_b"), F.col("odd").alias("odd_b"))
    return one.join(two, (F.col("of_a") == F.col("of_b")) & (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & _sketches_fit(percent)).select("a", "b").distinct()


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links with each end replaced by its component so far; a node without one is its own."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    both = links.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after ``more``, labels of its components and of nodes new to it, joined some of them."""
    root = more.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = labels.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return old.unionByName(more.join(labels.select("node"), "node", "left_anti"))


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = cut(docs.select("doc_id", "text").mapInArrow(lambda batches: _describe(batches, width), SIGNATURES), "near-signatures")
    node = ["n_shingles", "low", "high"]
    full = rows.where("n_shingles > 0")
    nodes = full.groupBy(*node).agg(
        F.min("doc_id").alias("id"), F.first("odd").alias("odd"), F.first("bands").alias("bands")
    )
    nodes = cut(nodes, "near-nodes")
    entries = nodes.where("id IS NOT NULL").select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    entries = cut(entries.join(shared.select("bucket"), "bucket", "left_semi"), "near-entries")

    # An id may stand for rows of several sets only if doc_ids repeat; those are one node anyway.
    wanted = entries.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL").join(wanted, "id", "left_semi")
    sets = cut(texts.mapInArrow(lambda batches: _full_sets(batches, width), SETS), "near-sets")
    about = nodes.where("id IS NOT NULL").select("id", "n_shingles", "odd")

    def labelled(labels: DataFrame) -> DataFrame:
        found = entries.join(labels.withColumnRenamed("node", "id"), "id", "left")
        return cut(found.select("id", "bucket", F.coalesce("component", "id").alias("component")), "near-labelled")

    labels = None
    for turn in range(TURNS + 1):
        state = entries.withColumn("component", F.col("id")) if labels is None else labelled(labels)
        if turn < TURNS:
            pairs = _described(_star_pairs(state, turn), about).where(_sketches_fit(percent)).select("a", "b")
        else:
            pairs = _rest_pairs(state, about, sets, percent)
        links = cut(_linked(pairs, sets, percent), "near-links")
        if labels is None:
            labels = connected_components(links, "a", "b")
        elif not links.isEmpty():
            labels = _merged(labels, connected_components(_between(links, labels), "a", "b"))

    components = nodes.select(*node, "id").join(labels, F.col("id") == F.col("node"), "left").select(*node, F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", *node).join(components, node, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, width: int = KEEP_WIDTH, percent: int = KEEP_PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns."""
    gone = near_components(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("id")).distinct()
    rows = nested(docs, F.col("doc_id").alias("row_id"))
    return rows.join(gone, F.col("row_id").eqNullSafe(F.col("id")), "left_anti").select("row.*")


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"), WIDTH, PERCENT)


OP10_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""
