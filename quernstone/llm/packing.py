"""Packing by cutting stock: column generation over the histogram of lengths.

Documents are tokenised once. Whole runs of ``CONTEXT`` tokens from a document's
start are sequences of their own; what remains is its tail, of a length below
``CONTEXT``. Tail lengths are rounded up to ``GRID`` tokens, which gives a
histogram of at most CONTEXT / GRID classes however large the corpus. The linear
program that covers the histogram with the fewest sequences is solved by column
generation: a dynamic program (unbounded knapsack) over the dual prices finds the
pattern that is worth most, until none gains. Pattern counts are rounded down.
Tails are ranked within their class, and the ranks are dealt to the patterns'
places by arithmetic, so assignment is a join with a table of patterns.

Rounding down leaves tails for less than one sequence a pattern in the basis, and
ill-filled patterns of few uses are left too: a number bounded by the classes
times ``FEW``, not by the corpus. They are laid end to
end and cut every ``CONTEXT`` tokens; the last sequence is cut at powers of two,
so only the rounding to ``GRID`` is padded.

Defined results: a null text is empty and has the end id alone. Rows that repeat
a doc_id are packed each for itself. Rows are told apart by doc_id, a hash of
their text and a running number among equal ones. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table

CONTEXT, GRID, END_ID = 2048, 8, 1
#: Column generation ends this near the least number of sequences that could hold all tokens.
GAP = 2e-4
#: Steps of the simplex at most.
MOST_STEPS = 200
#: A pattern that pads over a hundredth is only used more often than this.
FEW = 64
#: Chunks a worker remembers; the memory is emptied beyond it.
REMEMBERED = 800_000
#: Left-over tails whose cuts are broadcast.
MOST_SENT = 20_000
#: Ranks within a class are counted in parallel parts of about so many rows, and so many parts at least.
PART_ROWS, PARTS = 100_000, 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# -- token ids -------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across the start of a word: a single space
    before a non-space always opens a pre-token. Texts are split there, and the
    ids of each chunk are remembered. New chunks of a batch are encoded in one
    call, one to a line; a line break is a token of its own between them. They go
    through tiktoken, with ranks made from the same file's vocabulary, as it costs
    a third of the other library's time; texts with other spacing, and files that
    aren't such a vocabulary, are encoded by tokenizers itself. So are texts with the
    string of an added token, which is that token's id."""

    def __init__(self, path: str, limit: int = REMEMBERED) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.inner, self.first = limit, {}, {}
        self.line = self.tokenizer.token_to_id("\u010a")
        self.fast = _ranked_bpe(self.tokenizer)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, memory: dict, chunks: set[str], lead: str) -> None:
        new = chunks.difference(memory)
        # Single line breaks between words are tokens of their own, too.
        lines = {c: c.split("\n") for c in new if "\n" in c}
        if lines:
            new.difference_update(lines)
            whole = {c: p for c, p in lines.items() if all(x and x.strip() is x for x in p)}
            self._learn(memory, {p[0] for p in whole.values()}, lead)
            self._learn(self.first, {x for p in whole.values() for x in p[1:]}, "")
            brk = array("I", [self.line]).tobytes()
            memory.update((c, memory[p[0]] + b"".join([brk + self.first[x] for x in p[1:]])) for c, p in whole.items())
            new = new.difference(memory)  # difference_update would walk the whole memory
            lines = [c for c in lines if c not in whole]
        plain = [c for c in new if c.strip() is c and c] if self.fast else []
        if plain:
            ids = np.array(self.fast(lead + f"\n{lead}".join(plain)), dtype="<u4")
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(plain) - 1:
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                memory.update(zip(plain, [raw[x:y] for x, y in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)], strict=True))
                new.difference_update(plain)
        odd = [*new, *lines]
        # A space before white space, or at the end, joins a longer run: no ids of its own.
        torn = {c for c in odd if lead and (not c or c[0].isspace())}
        memory.update(dict.fromkeys(torn))
        odd = [c for c in odd if c not in torn]
        made = self.tokenizer.encode_batch_fast([lead + c for c in odd], add_special_tokens=False)
        memory.update(zip(odd, (array("I", e.ids).tobytes() for e in made), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > self.limit:
            self.inner.clear()
        if len(self.first) > self.limit // 2:
            self.first.clear()
        whole = {t for t in texts if any(a in t for a in self.added)}
        split = [(t if t not in whole else "").split(" ") for t in texts]
        self._learn(self.first, {c[0] for c in split}, "")
        new = set()
        for chunks in split:
            new |= set(chunks).difference(self.inner)
        self._learn(self.inner, new, " ")
        out, get = [], self.inner.__getitem__
        for text, chunks in zip(texts, split, strict=True):
            if text in whole:
                out.append(array("I", self._ids(text)).tobytes())
                continue
            first = self.first[chunks[0]]
            del chunks[0]
            try:
                out.append(first + b"".join(map(get, chunks)))
            except TypeError:
                out.append(array("I", self._ids(text)).tobytes())
        return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder: it and what it remembers outlive a task."""
    return Encoder(path)


def _ranked_bpe(tokenizer) -> Callable | None:
    """A tiktoken encoder of a byte-level vocabulary, if it agrees on a probe."""
    import tiktoken

    # Printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    probe = "It's 12 o'clock -- caf\u00e9 \u00fcber\n na\u00efve  words,\n\nend 12345"
    try:
        ranks = {bytes(letters[c] for c in t): i for t, i in tokenizer.get_vocab().items() if t not in special}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        return encode if encode(probe) == tokenizer.encode(probe, add_special_tokens=False).ids else None
    except (KeyError, ValueError):
        return None


def _tokenise(path: str, context: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), array("I", [end_id]).tobytes()
        names = ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                columns: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, key, raw in zip(ids, keys, encoder.encode([t or "" for t in part.column(2).to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, context):
                        piece = raw[4 * start : 4 * (start + context)]
                        for column, value in zip(columns, (doc, key, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _retokenise(path: str, end_id: int) -> Callable:
    """Checksums of the cuts asked for in ``cuts`` (start, length, sequence, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), array("I", [end_id]).tobytes()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                raw = encoder.encode([row["text"] or ""])[0] + end
                for c in row["cuts"]:
                    crc = zlib.crc32(raw[4 * c["start"] : 4 * (c["start"] + c["length"])])
                    rows.append({**c, "doc_id": row["doc_id"], "ids_crc32": crc, "doc_tokens": len(raw) // 4})
            schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


# -- the linear program ------------------------------------------------------------


def _knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes 1..len(prices) within ``capacity`` that is worth most."""
    n = len(prices)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = min(c, n)
        worth = prices[:k] + best[c - 1 :: -1][:k]
        i = int(worth.argmax())
        if worth[i] > best[c - 1] + 1e-12:
            best[c], took[c] = worth[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(n, dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan in plain array arithmetic: threaded BLAS can hang in a driver
    that has forked, and a basis of a few hundred columns doesn't need it."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        if pivot != i:
            work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        others = np.flatnonzero(work[:, i])
        others = others[others != i]
        work[others] -= work[others, i][:, None] * work[i]
    return work[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def _first_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """Columns of a feasible basis: the fullest pattern of the sizes still needed,
    large ones preferred, is used until a size runs out. Each column uses up at
    least one size, so the columns are independent; unit columns fill the rest."""
    m, left, columns = len(sizes), need.copy(), []
    alive = np.ones(m, dtype=bool)
    while alive.any():
        prices = np.zeros(capacity)
        prices[sizes[alive] - 1] = sizes[alive] * (1 + 0.001 * sizes[alive] / capacity)
        column = _knapsack(prices, capacity)[sizes - 1].astype(float)
        held = column > 0
        times = (left[held] / column[held]).min()
        left[held] -= times * column[held]
        spent = np.flatnonzero(alive & (left <= 1e-9 * need))
        columns.append(column)
        for extra in spent[held[spent].nonzero()[0]][1:]:
            columns.append(np.eye(m)[extra])
        alive[spent] = False
    return np.array(columns[:m]).T


def solve_patterns(demand: np.ndarray, capacity: int, gap: float = GAP, most_steps: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) over sizes 1..n and their fractional counts, by a revised
    simplex whose columns the knapsack prices. It ends at the optimum, within
    ``gap`` of the bound that the tokens themselves set, or after ``most_steps``:
    each step's basis is a valid packing, only the padding differs."""
    sizes = np.flatnonzero(demand > 0) + 1
    need = demand[sizes - 1].astype(float)
    m, bound = len(sizes), float((sizes * need).sum()) / capacity
    if not m:
        return np.zeros((0, len(demand)), dtype=np.int64), np.zeros(0)
    columns = _first_basis(sizes, need, capacity)
    inverse = _inverse(columns)
    for step in range(1, most_steps + 1):
        x, dual = _times(inverse, need), inverse.sum(axis=0)  # every pattern costs one sequence
        if x.sum() <= bound * (1 + gap):
            break
        prices = np.zeros(len(demand))
        prices[sizes - 1] = np.maximum(dual, 0)
        entering = _knapsack(prices, capacity)[sizes - 1].astype(float)
        if (entering * np.maximum(dual, 0)).sum() <= 1 + 1e-9:
            break
        direction = _times(inverse, entering)
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        columns[:, leave] = entering
        if step % 64 == 0:
            inverse = _inverse(columns)
        else:
            pivot = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, pivot)
            inverse[leave] = pivot
    x = np.maximum(_times(_inverse(columns), need), 0)
    patterns = np.zeros((m, len(demand)), dtype=np.int64)
    patterns[:, sizes - 1] = np.rint(columns.T).astype(np.int64)
    return patterns, x


def rounded_places(demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``(size, first rank, last rank + 1, first sequence, a sequence's share)`` rows
    that deal ranks of a size to sequences, and the number of sequences."""
    patterns, x = solve_patterns(demand, capacity)
    rows, sequence, used = [], 0, np.zeros(len(demand), dtype=np.int64)
    for pattern, count in zip(patterns, np.floor(x + 1e-9).astype(np.int64), strict=True):
        held = np.flatnonzero(pattern)
        room = ((demand - used)[held] // pattern[held]).min() if len(held) else 0
        count = int(min(count, room))
        fill = int((pattern * np.arange(1, len(pattern) + 1)).sum())
        if count <= 0 or (count <= FEW and fill < 0.99 * capacity):
            continue  # left over: laid end to end without padding
        for size in held:
            share = int(pattern[size])
            rows.append((int(size) + 1, int(used[size]), int(used[size]) + count * share, sequence, share))
        used[held] += count * pattern[held]
        sequence += count
    return rows, sequence


# -- dealing ------------------------------------------------------------------------


def ranked(rows: DataFrame, group: str, order: list[str], parts: int = PARTS) -> DataFrame:
    """Adds ``rank`` (from 0) within ``group``, counted in parallel parts: rows of a
    group that holds a third of the table are spread over ``parts`` tasks."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(group, "part").orderBy(*order)
    rows = rows.withColumn("own", F.row_number().over(inside) - 1)
    return rows.join(counts, [group, "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("part", "before", "own")


def pack(docs: DataFrame, tokenizer: str | None = None, context: int = CONTEXT, grid: int = GRID, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    pieces = cut(rows.mapInArrow(_tokenise(path, context, end_id), "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long"), "pack-pieces")
    key = ["doc_id", "text_key"]
    sized = pieces.withColumn("size", F.ceil(F.col("length") / grid).cast("int"))
    whole, tails = sized.where(F.col("length") == context), sized.where(F.col("length") < context)
    counted = sized.groupBy("size", (F.col("length") == context).alias("full")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most context / grid + 1 rows
    demand = np.zeros(context // grid, dtype=np.int64)
    for r in counted:
        if not r["full"]:
            demand[r["size"] - 1] = r["n"]
    places, sequences = rounded_places(demand, context // grid)
    parts = max(PARTS, sum(r["n"] for r in counted) // PART_ROWS)

    # Sequences of one whole piece have odd ids, the others even ones, both without gaps and whatever the files' splits.
    order = ["doc_id", "text_key", "start"]
    whole = ranked(whole, "size", order, parts).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    # A row a class and pattern: at most (context / grid) ** 2 by the basis' size.
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 1)], "place_size int, low long, high long, sequence long, share long")
    dealt = ranked(tails, "size", order, parts)
    dealt = dealt.join(
        F.broadcast(table), (F.col("size") == F.col("place_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left"
    )
    dealt = dealt.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("share")))
    dealt = cut(dealt.select(*key, "start", "length", "ids_crc32", "doc_tokens", "rank", "size", "sequence_id"), "pack-dealt")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "text_key", "rank")
    placed = dealt.where("sequence_id IS NOT NULL").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence_id") * 2).alias("sequence_id"),
        (F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
    )
    return whole.unionByName(placed).unionByName(_leftovers(docs, dealt.where("sequence_id IS NULL"), path, context, end_id, sequences))


def _leftovers(docs: DataFrame, left: DataFrame, path: str, context: int, end_id: int, sequences: int) -> DataFrame:
    """Tails that rounding left over, end to end; fewer than classes * context / grid."""
    key = ["doc_id", "text_key"]
    line = Window.orderBy("doc_id", "text_key", "start", "rank")
    spots = left.withColumn("stop", F.sum("length").over(line)).withColumn("from", F.col("stop") - F.col("length"))
    spots = cut(spots.select(*key, "start", "length", "from", "stop"), "pack-left")
    total = spots.agg(F.max("stop")).first()[0] or 0
    full = total // context * context
    ends = list(range(context, full + 1, context))
    at, bit = full, context
    while bit:  # the last, shorter sequence is cut at powers of two
        if (total - full) & bit:
            ends.append(at := at + bit)
        bit >>= 1
    bounds = docs.sparkSession.createDataFrame(
        [(2 * (sequences + i), a, b) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))] or [(0, -1, -1)],
        "sequence_id long, low long, high long",
    )
    slot = F.explode(F.sequence(F.floor(F.col("from") / context), F.floor((F.col("stop") - 1) / context))).alias("slot")
    bounds = bounds.withColumn("slot", F.floor(F.col("low") / context))
    parts = spots.select("*", slot).join(F.broadcast(bounds), "slot").where("from < high AND stop > low")
    first, last = F.greatest("from", "low"), F.least("stop", "high")
    parts = parts.select(*key, (F.col("start") + first - F.col("from")).alias("start"), (last - first).alias("length"), "sequence_id", (first - F.col("low")).alias("offset"))
    cuts = parts.groupBy(*key).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    cuts = cuts.withColumnsRenamed({"doc_id": "cut_id", "text_key": "cut_key"})
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key"))
    if spots.count() <= MOST_SENT:  # a checked size; the shuffle is for settings with more classes
        cuts = F.broadcast(cuts)
    texts = texts.join(cuts, same).dropDuplicates(key).select("doc_id", "text", "cuts")  # repeated rows share a list of cuts
    return texts.mapInArrow(_retokenise(path, end_id), PIECES + ", sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
