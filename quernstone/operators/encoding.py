"""Token sequences: encodings with loss masks, stride rows, target-aware chunks, packs, batches.

Sequences are arrays ``ids`` (ints) and ``mask`` (booleans: positions that are
trained). Which function turns text into ids is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored
from .ranges import PART, dealt, running


def _many(value: Column | bool, n: Column) -> Column:
    return F.array_repeat(F.lit(value) if isinstance(value, bool) else value, n)


def conditional(prompt: Column, thought: Column, target: Column, marks: dict[str, int], only_target: bool = True) -> Column:
    """``bos prompt P.. [thought T..] poem target.. eos``; the target and eos are trained,
    everything is where ``only_target`` is off (the first position never is). A null thought has no mark."""
    one = lambda name: F.array(F.lit(marks[name]))
    head = F.concat(one("bos"), one("prompt"), prompt, F.when(thought.isNull(), F.array().cast("array<int>")).otherwise(F.concat(one("thought"), thought)), one("poem"))
    lead = F.size(head) if only_target else F.lit(1)
    ids = F.concat(head, target, one("eos"))
    return F.struct(ids.alias("ids"), F.concat(_many(False, lead), _many(True, F.size(ids) - lead)).alias("mask"))


def continuation(text: Column, marks: dict[str, int]) -> Column:
    """``bos text.. eos``; all but the first position are trained."""
    ids = F.concat(F.array(F.lit(marks["bos"])), text, F.array(F.lit(marks["eos"])))
    return F.struct(ids.alias("ids"), F.concat(_many(False, F.lit(1)), _many(True, F.size(ids) - 1)).alias("mask"))


def chat(turns: DataFrame, key: str, order: str, role: str, ids: str, marks: dict[str, int]) -> DataFrame:
    """A row a conversation: its turns in order, each after its role's mark; what the
    assistant says and the mark that ends the conversation are trained."""
    mark = F.element_at(F.create_map(*[F.lit(x) for r in ("system", "user", "assistant") for x in (r, marks[r])]), F.col(role))
    spoken = F.col(role) == "assistant"
    part = F.struct(F.col(order).alias("o"), F.concat(F.array(mark), ids).alias("i"), F.concat(_many(False, F.lit(1)), _many(spoken, F.size(ids))).alias("m"))
    parts = turns.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    whole = lambda field: F.flatten(F.transform("parts", lambda p: p[field]))
    return parts.select(
        key,
        F.concat(F.array(F.lit(marks["bos"])), whole("i"), F.array(F.lit(marks["eos"]))).alias("ids"),
        F.concat(F.array(F.lit(False)), whole("m"), F.array(F.lit(True))).alias("mask"),
    )


def supervised(mask: Column) -> Column:
    """How many positions after the first are trained: each is predicted from the one before."""
    return F.size(F.filter(F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0))), lambda m: m)).cast("long")


def stride_rows(sequences: DataFrame, group: str, order: str, width: int) -> DataFrame:
    """``group, row, ids, mask``: each group's sequences in order as one line, cut to rows
    of ``width`` that share one position with the next; an unfilled last row goes.

    Offsets come from sums of sizes by ranges of the order, so no task sees a whole
    group and no token is sorted; a sequence sends each row the slice it holds."""
    step = width - 1
    kept = sequences.select(group, order, "ids", "mask", F.size("ids").cast("long").alias("size"), F.monotonically_increasing_id().alias("key_"))
    kept = stored(kept.where("size > 0"), "sequences")
    at = with_offsets(kept.select(group, order, "size", "key_"), group, order, "size", "at", ("key_",))
    sized = kept.join(at.select("key_", "at"), "key_")
    first, last = F.expr(f"greatest(at - 1, 0) div {step}"), F.expr(f"(at + size - 1) div {step}")
    spans = sized.withColumn("row", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("row") * step, F.col("at")), F.least(F.col("row") * step + width, F.col("at") + F.col("size"))
    cut = lambda c: F.slice(c, (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    parts = spans.where(low < high).select(group, "row", F.struct((low - F.col("row") * step).alias("o"), cut("ids").alias("i"), cut("mask").alias("m")).alias("p"))
    rows = parts.groupBy(group, "row").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    whole = lambda field: F.flatten(F.transform("parts", lambda p: p[field]))
    return rows.select(group, "row", whole("i").alias("ids"), whole("m").alias("mask")).where(F.size("ids") == width)


def with_offsets(rows: DataFrame, group: str, order: str, value: str, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of ``value`` over the rows before in the group, by ``order`` and
    ``ties``: ranges are summed apart, so a group that is most of the table is spread over tasks."""
    keys = [order, *ties]
    summed = running(dealt(rows, [group], keys, "offsets"), [group], keys, "sum", F.col(value), out)
    return summed.withColumn(out, F.col(out).cast("long")).drop(PART)


def trained_rows(rows: DataFrame) -> DataFrame:
    """The rows with a position to train, and how many they have."""
    return rows.withColumn("n_trained", supervised(F.col("mask"))).where("n_trained > 0")


def rows_until(sequences: DataFrame, order: str, width: int, target: int, batch: int) -> DataFrame:
    """``row, ids, mask, n_trained`` as a writer leaves them that appends whole sequences to one line,
    writes each row that is full and has a position to train, and stops after the sequence with
    which the trained positions reach ``target`` and the rows written are a multiple of
    ``batch``. A line that ends before is an error."""
    step = width - 1
    line = sequences.select(F.lit(0).alias("g_"), F.col(order), "ids", "mask")
    rows = stride_rows(line, "g_", order, width).select("row", "ids", "mask", supervised(F.col("mask")).alias("n_trained"))
    rows = stored(rows, "until-rows")
    sums = dealt(rows.select("row", "n_trained"), [], ["row"], "until-sums")
    sums = running(sums, [], ["row"], "sum", F.col("n_trained"), "trained", inclusive=True)
    sums = running(sums, [], ["row"], "sum", (F.col("n_trained") > 0).cast("long"), "written", inclusive=True).select("row", "trained", "written")
    ends = with_offsets(line.select("g_", order, F.size("ids").cast("long").alias("size")), "g_", order, "size", "at")
    ends = ends.select(F.expr(f"(at + size - 1) div {step} - 1").alias("row")).distinct()
    stop = ends.join(sums, "row").where((F.col("trained") >= target) & (F.col("written") % batch == 0)).agg(F.min("row").alias("row")).first()["row"]
    if stop is None:
        raise ValueError(f"the line ends before {target} trained positions and whole batches are reached")
    return rows.where((F.col("row") <= stop) & (F.col("n_trained") > 0))


def first_rows(rows: DataFrame, group: str, target: int) -> DataFrame:
    """Each group's first ``target`` stride rows; a group that has fewer is an error."""
    short = rows.groupBy(group).agg(F.count_if(F.col("row") < target).alias("n")).where(F.col("n") < target).first()
    if short:
        raise ValueError(f"{group} {short[group]!r} has {short['n']} rows of {target}")
    return rows.where(F.col("row") < target)


def chunks(sequences: DataFrame, width: int) -> DataFrame:
    """Adds ``chunk`` and replaces ``ids, mask``: sequences that fit stay whole. In longer
    ones, whose trained positions are one run from p on, chunk i starts at p - 1 + i * (width - 1):
    each trained position is in one chunk with one position before it, and a long untrained
    beginning keeps its last position only."""
    n, p = F.size("ids"), F.greatest(F.array_position("mask", True).cast("int") - 1, F.lit(1))
    count = F.when(n <= width, 1).otherwise(F.ceil((n - p) / (width - 1)))
    spread = sequences.withColumn("from_", F.when(n <= width, 0).otherwise(p - 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
    at = F.col("from_") + F.col("chunk") * (width - 1) + 1
    at = at.cast("int")
    ids, mask = F.slice("ids", at, width), F.slice("mask", at, width)
    # The position a chunk starts with was trained in the one before, or is not trained.
    mask = F.when(F.col("chunk") > 0, F.concat(F.array(F.lit(False)), F.slice(mask, 2, width - 1))).otherwise(mask)
    return spread.withColumn("ids", ids).withColumn("mask", mask).drop("from_")


def shifted(ids: Column, mask: Column, length: Column, pad: int) -> Column:
    """Inputs, targets and mask of a row, padded on the right to ``length`` positions."""
    n = F.size(ids) - 1
    fill = F.greatest(length - n, F.lit(0))
    return F.struct(
        F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad), fill)).alias("inputs"),
        F.concat(F.slice(ids, 2, n), F.array_repeat(F.lit(pad), fill)).alias("targets"),
        F.concat(F.slice(mask, 2, n), _many(False, fill)).alias("mask"),
    )


def trained_positions(mask: Column) -> Column:
    """0-based positions that are trained."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def pack_faults(packs: DataFrame, width: int, vocabulary: int) -> DataFrame:
    """``pack_id, fault`` of packs that break the contract of training rows."""
    checks = {
        "lengths differ": F.size("ids") != F.size("mask"), "too long": F.size("ids") > width,
        "nothing to train": supervised(F.col("mask")) == 0, "token beyond vocabulary": F.array_max("ids") >= vocabulary,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return packs.select("pack_id", F.explode(found).alias("fault"))


def number_faults(packs: DataFrame) -> DataFrame:
    """``pack_id, fault`` of packs whose numbers, sorted, are not 0, 1, 2, ..: where one is missing before it, or it comes again."""
    ranged = dealt(packs.select("pack_id"), [], ["pack_id"], "pack-numbers")
    rows = running(ranged, [], ["pack_id"], "last", F.struct("pack_id"), "before").drop(PART)
    last = F.coalesce(F.col("before.pack_id"), F.lit(-1))
    fault = F.when(F.col("pack_id").isNull(), "no number").when(F.col("pack_id") == last, "repeated").when(F.col("pack_id") != last + 1, "not contiguous")
    return rows.select("pack_id", fault.alias("fault")).where("fault IS NOT NULL")
