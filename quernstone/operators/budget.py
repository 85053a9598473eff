"""Greedy choices within a budget, as rounds over ranges of rank.

Owners have components 0, 1, 2, .. and offer one at a time, the next after the one
before was taken; the offer of most gain a cost goes first. Where a component ranks
above its predecessor it can only be taken right after it, so its effective rank is
the least of its prefix, and all offers are one sorted list. Of that list everything
is taken up to the first component that the budget no longer holds. That one is
dropped, and with it the rest of its owner; then the next round takes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored
from .ranges import PART, dealt, running


def offers(items: DataFrame, owner: str, index: str, gain: str, cost: str, again: bool) -> DataFrame:
    """``owner, index, cost, rank`` (least first) of the components that can be taken at all.

    Components after a gap in the numbers can't. With ``again`` a component is offered once
    its predecessor is taken, whatever its gain. Without, a list sorted by gain a cost is
    gone through once, so a component that comes before its predecessor is lost, and its followers are."""
    rows = items.select(F.col(owner).alias("owner"), F.col(index).cast("long").alias("index"), F.col(cost).cast("long").alias("cost"), (-(F.col(gain) / F.greatest(F.col(cost), F.lit(1)))).alias("down"))
    ranged = running(dealt(rows, ["owner"], ["index"], "offers"), ["owner"], ["index"], "sum", F.lit(1).cast("long"), "nth")
    ranged = ranged.where(F.col("nth") == F.col("index")).drop("nth")
    if again:
        ranged = running(ranged, ["owner"], ["index"], "max", F.col("down"), "rank", inclusive=True)
        return ranged.select("owner", "index", "cost", "rank")
    worst = running(ranged, ["owner"], ["index"], "max", F.col("down"), "worst")
    early = F.coalesce(F.col("down") < F.col("worst"), F.lit(False)).cast("int")
    lost = running(worst.withColumn("early", early), ["owner"], ["index"], "max", F.col("early"), "lost", inclusive=True)
    return lost.where("lost = 0").select("owner", "index", "cost", F.col("down").alias("rank"))


def taken(offered: DataFrame, budget: int) -> DataFrame:
    """``owner, index`` of what the budget takes. Each round takes at least one component and
    drops those that cost more than is left; costs are not negative."""
    order, left, found = ["rank", "owner", "index"], budget, None
    rest = stored(offered, "budget-offers")
    while True:
        dear = rest.where(F.col("cost") > left).groupBy("owner").agg(F.min("index").alias("__end"))
        live = rest.join(dear, "owner", "left").where(F.col("__end").isNull() | (F.col("index") < F.col("__end"))).drop("__end")
        summed = stored(running(dealt(live, [], order, "budget"), [], order, "sum", F.col("cost"), "__total", inclusive=True).drop(PART), "budget-totals")
        fits = summed.where(F.col("__total") <= left)
        found = fits.select("owner", "index") if found is None else found.unionByName(fits.select("owner", "index"))
        spent = summed.agg(F.max(F.when(F.col("__total") <= left, F.col("__total"))).alias("spent"), F.count_if(F.col("__total") > left).alias("open")).first()
        if not spent["open"]:
            return found
        rest = summed.where(F.col("__total") > left).drop("__total")
        left -= int(spent["spent"] or 0)
