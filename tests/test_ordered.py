"""Runs, merges, budgets, open splits and repeats against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import records
from quernstone.operators import blind, budget, ranges, runs, selection

pytestmark = pytest.mark.usefixtures("several_ranges")


def test_books_equal_a_walk_over_the_lines(spark):
    rng = random.Random(2)
    keys = [k for k in [rng.choice([1, 2, 3, None]) for _ in range(40)] for _ in range(rng.choice((1, 2, 9)))]
    keys += [9] * (len(keys) // 2)  # a book of a third of all lines
    lines = [(i, k, rng.choice(["a", "* edited", "", None])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(lines, "i long, k int, line string").repartition(6)
    want, seen = [], set()
    for i, k, line in lines:
        if not want or want[-1][1] != k:
            want.append([len(want), k, i, i, 0, [], k in seen])
        seen.add(k)
        want[-1][3], want[-1][4] = i, want[-1][4] + 1
        want[-1][5] += [line] if line is not None and not line.startswith("*") else []
    got = sorted(runs.books(df, ["i"], "k", "line", F.col("line").startswith("*")).collect(), key=lambda r: r["run"])
    assert [[r[c] for c in ("run", "key", "first", "last", "n_lines")] for r in got] == [w[:5] for w in want]
    assert [r["text"] for r in got] == ["\n".join(w[5]) for w in want] and [r["n_kept"] for r in got] == [len(w[5]) for w in want]
    assert [r["fault"] for r in got] == ["reappears" if w[6] else None if w[5] else "empty" for w in want]
    assert runs.numbered(df, ["i"], "k").where("k = 9").select(ranges.PART).distinct().count() > 1
    assert runs.books(df.limit(0), ["i"], "k", "line", F.lit(False)).count() == 0


def test_merged_manifests_name_their_faults(spark):
    rng = random.Random(3)
    rows = [(o, i, rng.choice([None, *"abcdefgh"]) if rng.random() < 0.2 else f"{i:03d}{o[0]}" if i % 5 else f"{i:03d}") for o in ("one", "two") for i in range(60)]
    df = spark.createDataFrame(rows, "origin string, at long, id string")
    late = set()
    for o in ("one", "two"):
        mine = [r for r in rows if r[0] == o]
        late |= {b[:2] for a, b in zip(mine, mine[1:], strict=False) if a[2] is not None and b[2] is not None and b[2] <= a[2]}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0], r[1]))
    want = []
    for p, r in enumerate(order):
        again = p > 0 and r[2] is not None and order[p - 1][2] == r[2]
        want.append((*r, p, "not_ordered" if r[:2] in late else "repeated" if again else None))
    got = [tuple(r[c] for c in ("origin", "at", "id", "place", "fault")) for r in runs.merged(df).orderBy("place").collect()]
    assert got == want and {g[4] for g in got} == {None, "not_ordered", "repeated"}


def _heap(items, limit):
    """Pops the best offer; the next of its owner comes once it was taken."""
    by, chosen, left = {}, set(), limit
    for o, i, gain, cost in items:
        by.setdefault(o, {})[i] = (gain, cost)
    heap = [(-(by[o][0][0] / max(1, by[o][0][1])), o, 0) for o in by if 0 in by[o]]
    heapq.heapify(heap)
    while heap:
        _, o, i = heapq.heappop(heap)
        cost = by[o][i][1]
        if cost > left:
            continue
        left -= cost
        chosen.add((o, i))
        if i + 1 in by[o]:
            heapq.heappush(heap, (-(by[o][i + 1][0] / max(1, by[o][i + 1][1])), o, i + 1))
    return chosen


def _once(items, limit):
    """Goes through the sorted list once."""
    next_of, left, chosen = {}, limit, set()
    for o, i, _, cost in sorted(items, key=lambda x: (-(x[2] / max(1, x[3])), x[0], x[1])):
        if cost <= left and i == next_of.get(o, 0):
            next_of[o] = i + 1
            left -= cost
            chosen.add((o, i))
    return chosen


def test_budgets_equal_a_heap_and_a_list(spark):
    rng = random.Random(4)
    for limit in (0, 7, 60, 400, 10**6):
        items = [(f"o{o}", i, float(rng.choice((1, 2, 5, 5, 100))), rng.choice((0, 1, 3, 10, 10, 40))) for o in range(8) for i in range(rng.randrange(1, 7)) if rng.random() < 0.95]
        df = spark.createDataFrame(items, "o string, i int, gain double, cost int").repartition(3)
        for again, plain in ((True, _heap), (False, _once)):
            got = {(r["owner"], r["index"]) for r in budget.taken(budget.offers(df, "o", "i", "gain", "cost", again), limit).collect()}
            assert got == plain(items, limit), (limit, again)


def test_a_component_better_than_its_predecessor_is_taken_after_it(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 10), ("a", 1, 100.0, 10), ("b", 0, 5.0, 10)], "o string, i int, g double, c int")
    got = {(r["owner"], r["index"]) for r in budget.taken(budget.offers(df, "o", "i", "g", "c", True), 30).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0)}


def test_greedy_disjoint_equals_a_walk(spark):
    rng = random.Random(5)
    rows = {i: {rng.randrange(60) for _ in range(rng.randrange(1, 5))} for i in range(80)}
    taken, want = set(), {}
    for i in sorted(rows):
        want[i] = not rows[i] & taken
        taken |= rows[i] if want[i] else set()
    df = spark.createDataFrame([(i, t) for i, ts in rows.items() for t in ts], "id long, token long")
    assert {r["id"]: r["accepted"] for r in selection.greedy_disjoint(df).collect()} == want
    assert selection.greedy_disjoint(df.limit(0)).count() == 0


def test_open_splits_equal_a_walk(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(i, rng.choice("abcd"), rng.randrange(0, 9), [f"u{rng.randrange(70)}", f"c{rng.randrange(50)}"] if rng.random() < 0.95 else []) for i in range(150)]
        budgets = {"a": 20, "b": 45, "c": 10**6}
        seen, size, want = set(), dict.fromkeys("abcd", 0), []
        for i, s, n, keys in rows:
            if (s not in budgets or size[s] < budgets[s]) and not seen & set(keys):
                seen |= set(keys)
                size[s] += n
                want.append((i, s, size[s]))
        got, closed = selection.open_dedup(spark.createDataFrame(rows, "id long, split string, size int, keys array<string>").repartition(4), budgets)
        assert sorted((r["id"], r["split"], r["total"]) for r in got.collect()) == want
        assert set(closed) == {s for s in budgets if size[s] >= budgets[s]}


def _longest(w):
    found = [n for n in range(1, len(w) // 2 + 1) if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1]
    return max(found, default=0)


def test_longest_repeats_have_no_cap(spark):
    rng = random.Random(6)
    texts = [rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(0, 40)) for _ in range(200)]
    assert [records.longest_run(w) for w in texts] == [_longest(w) for w in texts]
    long = [str(rng.randrange(3000)) for _ in range(20_000)]
    long[12_000:19_000] = long[1_000:8_000]
    df = spark.createDataFrame([(1, long), (2, None), (3, []), (4, ["a", "a"])], "i int, w array<string>")
    assert {r["i"]: r["longest"] for r in records.longest_repeats(df, "w", "longest").collect()} == {1: 7000, 2: None, 3: 0, 4: 1}


def test_colliding_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(records, "_SPREAD", np.uint64(0))  # every run has the same hash
    assert records.longest_run(list("abcabd")) == 2 and records.longest_run(list("abcdef")) == 0


def test_first_rows_by_id_as_text(spark):
    got = runs.canonical_first(spark.range(30).withColumnRenamed("id", "pack"), "pack", 12).orderBy("place").collect()
    assert [r["pack"] for r in got] == [int(x) for x in sorted(map(str, range(30)))[:12]]


@pytest.mark.parametrize("kind", ["sum", "min", "max", "last"])
def test_running_values_of_nothing(spark, kind):
    df = ranges.dealt(spark.createDataFrame([], "g string, i long, v long"), ["g"], ["i"])
    assert ranges.running(df, ["g"], ["i"], kind, F.col("v"), "x").count() == 0


def test_blind_comparisons_and_their_tallies(spark):
    import hashlib

    ids = [f"r{i}" for i in range(40)]
    requests = spark.createDataFrame([(r, i // 3, i % 3, "evaluation" if i % 4 else "development") for i, r in enumerate(ids)], "request_id string, case_id long, seed int, partition string")
    picked = [r for i, r in enumerate(ids) if i % 4]
    a, b = (spark.createDataFrame([(r, f"{x} {r}") for r in picked], "request_id string, text string") for x in "ab")
    rows, key = blind.compared(requests, a, b, 5, "evaluation", ("one", "two"))
    names = {r["comparison_id"]: (r["A"], r["B"]) for r in key.collect()}
    got = {r["request_id"]: r for r in rows.collect()}
    for r in picked:
        swapped = hashlib.sha256(f"5\0{r}".encode()).digest()[0] % 2 == 1
        pair = (f"b {r}", f"a {r}") if swapped else (f"a {r}", f"b {r}")
        cid = hashlib.sha256(f"5\0{r}\0{pair[0]}\0{pair[1]}".encode()).hexdigest()[:24]
        assert (got[r]["comparison_id"], got[r]["first"], got[r]["second"]) == (cid, *pair) and names[cid] == (("two", "one") if swapped else ("one", "two"))
    rng = random.Random(1)
    judged = [(c, rng.choice("AB"), rng.choice(["A", "B", "tie"])) for c in sorted(names)]
    df = spark.createDataFrame(judged, "comparison_id string, x string, y string")
    tally = {r["criterion"]: (r["wins_a"], r["wins_b"], r["ties"]) for r in blind.tallied(key, df, ["x", "y"], ("one", "two")).collect()}
    for k, c in ((1, "x"), (2, "y")):
        won = [None if j[k] == "tie" else names[j[0]]["AB".index(j[k])] for j in judged]
        assert tally[c] == (won.count("one"), won.count("two"), won.count(None))
    for bad in (df.limit(5), df.unionByName(df.limit(1))):
        with pytest.raises(ValueError, match="cover the comparisons"):
            blind.tallied(key, bad, ["x", "y"], ("one", "two"))
    with pytest.raises(ValueError, match="none of"):
        blind.tallied(key, df.withColumn("y", F.lit("both")), ["x", "y"], ("one", "two"))
    for wrong in (b.limit(3), b.unionByName(b.limit(1)), b.unionByName(spark.createDataFrame([("r0", "x")], b.schema))):
        with pytest.raises(ValueError, match="cover the requests"):
            blind.compared(requests, a, wrong, 5, "evaluation", ("one", "two"))
    with pytest.raises(ValueError, match="there is none"):
        blind.compared(requests, a.limit(0), b.limit(0), 5, "nothing", ("one", "two"))
