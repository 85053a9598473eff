"""One stream of batches over several objectives and epochs, with a state to go on from.

The next batch is that of the objective which is furthest behind its share: least
tokens read over weight, ties by name. Tokens before a batch only grow along an
objective, so the stream is the batches of all objectives sorted by tokens before
over weight: a sum by ranges and a sort, without a step-by-step walk. Epochs follow
one another without end; of those that are unrolled here, the stream is exact up to
the first batch that it would take from an epoch beyond them, and stops there.

A state holds the epoch and position of every objective, the tokens read of each,
and digests of the rules, of all rows and of the batches read. Going on with a state
is refused where any of them differs.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import sha256
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored
from .ranges import PART, dealt, places, running


def factors(weights: dict[str, object]) -> dict[str, int]:
    """Tokens times an objective's factor are in the order of tokens over weight, exactly.
    Weights are read as decimals; an objective whose weight is 0 is left out."""
    exact = {k: Fraction(str(w)) for k, w in weights.items() if Fraction(str(w)) > 0}
    if not exact:
        raise ValueError("no objective has a weight")
    common = lcm(*(w.numerator for w in exact.values()))
    found = {k: common // w.numerator * w.denominator for k, w in exact.items()}
    shared = gcd(*found.values())
    return {k: f // shared for k, f in found.items()}


def _sum_of_hashes(*fields: str) -> Column:
    """A digest of rows in any order: the sum of 60 bits of each row's hash, and their number."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.coalesce(F.sum(bits), F.lit(0)).cast("string"), F.count(F.lit(1)).cast("string"))


def content_digest(rows: DataFrame, *fields: str) -> str:
    """What a stream is made of, whatever the order: every field of every row."""
    return rows.agg(_sum_of_hashes(*fields).alias("d")).first()["d"]


def schedule(batches: DataFrame, weights: dict[str, object]) -> DataFrame:
    """Batches ``objective, epoch, batch, n_tokens`` with ``due`` (tokens before, times the
    objective's factor) and ``step`` from 0. An objective with weight but no batch is an error."""
    exact = factors(weights)
    factor = F.element_at(F.create_map(*[F.lit(x) for k, f in exact.items() for x in (k, f)]), F.col("objective"))
    used = batches.where(F.col("objective").isin(list(exact)))
    ranged = dealt(used, ["objective"], ["epoch", "batch"], "stream-batches")
    ends = ranged.groupBy("objective").agg((F.sum("n_tokens") * factor).cast("decimal(38,0)").alias("end")).collect()  # a row an objective
    if missing := sorted(set(exact) - {r["objective"] for r in ends}):
        raise ValueError(f"no batch of {missing}")
    end, last = min((r["end"], r["objective"]) for r in ends)
    due = running(ranged, ["objective"], ["epoch", "batch"], "sum", F.col("n_tokens"), "due").drop(PART)
    due = due.withColumn("due", (F.col("due") * factor).cast("decimal(38,0)"))
    within = due.where((F.col("due") < end) | ((F.col("due") == end) & (F.col("objective") <= last)))
    return stored(places(within, [], ["due", "objective", "epoch", "batch"], "step"), "stream-schedule")


def _read(scheduled: DataFrame, steps: int) -> dict:
    """Epoch, position and tokens of each objective after so many steps: rows of objectives, not of batches."""
    done = F.col("step") < steps
    rows = scheduled.groupBy("objective").agg(
        F.max(F.when(F.col("epoch") == 0, F.col("batch"))).alias("last"),
        F.max(F.when(done, F.struct("epoch", "batch"))).alias("at"), F.coalesce(F.sum(F.when(done, F.col("n_tokens"))), F.lit(0)).alias("tokens"),
    ).collect()
    found = {"epochs": {}, "positions": {}, "tokens": {}}
    for r in rows:
        epoch, batch = (0, 0) if r["at"] is None else (r["at"]["epoch"], r["at"]["batch"] + 1)
        if r["last"] is not None and batch > r["last"]:
            epoch, batch = epoch + 1, 0
        found["epochs"][r["objective"]], found["positions"][r["objective"]], found["tokens"][r["objective"]] = epoch, batch, int(r["tokens"])
    return found


def state(scheduled: DataFrame, steps: int, content: str, rules: dict) -> dict:
    """Where the stream stands after ``steps`` batches; ``rules`` are its seed, sizes and weights."""
    length = scheduled.count()
    if not 0 <= steps <= length:
        raise ValueError(f"the unrolled epochs hold {length} batches, not {steps}")
    order = scheduled.where(F.col("step") < steps).agg(_sum_of_hashes("step", "objective", "epoch", "batch", "digest").alias("d")).first()["d"]
    shown = "\n".join(f"{k}={rules[k]}" for k in sorted(rules))
    return {"version": 1, "steps": steps, "content": content, "rules": sha256(shown.encode()).hexdigest(), "order": order, **_read(scheduled, steps)}


def resume(scheduled: DataFrame, saved: dict, content: str, rules: dict) -> DataFrame:
    """The batches that a saved state has not read yet, in the stream's order by ``step``."""
    steps = saved.get("steps")
    if not isinstance(steps, int) or isinstance(steps, bool):
        raise ValueError("not a state of a stream")
    now = state(scheduled, steps, content, rules)
    if differs := sorted(k for k in now.keys() | saved.keys() if now.get(k) != saved.get(k)):
        raise ValueError(f"the stream differs from the one that was saved: {', '.join(differs)}")
    return scheduled.where(F.col("step") >= steps)


def probe(scheduled: DataFrame, steps: int, skip: int, read: int) -> DataFrame:
    """``read`` batches after ``skip`` more, from ``steps`` on; nothing moves."""
    first = steps + skip
    return scheduled.where((F.col("step") >= first) & (F.col("step") < first + read))


def skipped(scheduled: DataFrame, steps: int, skip: int) -> dict:
    """How many batches and tokens skipping passes over."""
    if isinstance(skip, bool) or not isinstance(skip, int) or skip < 0:
        raise ValueError("a skip is a whole number of batches")
    r = probe(scheduled, steps, 0, skip).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    return {"batches": r["n"], "tokens": int(r["t"])}
