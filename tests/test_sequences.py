"""Operators on token sequences, cursors and records against plain Python."""

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quernstone.functions import records, tokens
from quernstone.operators import cursor, encoding, joins, measures, ranges, stream

pytestmark = pytest.mark.usefixtures("several_ranges")


def test_chunks_train_each_target_once(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        n = rng.randrange(2, 160)
        p = rng.randrange(1, n)
        rows.append((i, list(range(n)), [j >= p for j in range(n)]))
    df = spark.createDataFrame(rows, "i int, ids array<int>, mask array<boolean>")
    for width in (2, 7, 40):
        seen = {}
        for r in encoding.chunks(df, width).collect():
            assert len(r["ids"]) == len(r["mask"]) <= width and r["ids"] == list(range(r["ids"][0], r["ids"][0] + len(r["ids"])))
            for t, m in list(zip(r["ids"], r["mask"], strict=True))[1:]:
                seen.setdefault(r["i"], []).extend([t] if m else [])
        assert {i: sorted(seen[i]) for i in seen} == {i: [j for j in ids if m[j]] for i, ids, m in rows}


def test_stride_rows_equal_slices_of_the_line(spark):
    rng = random.Random(3)
    rows = [("g", i, rng.choices(range(99), k=rng.choice((0, 1, 5, 200)))) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, o long, ids array<int>").withColumn("mask", F.transform("ids", lambda x: x > 50))
    line = [x for _, _, ids in rows for x in ids]
    want = [line[k * 7 : k * 7 + 8] for k in range((len(line) - 1) // 7)]
    got = sorted((r["row"], r["ids"], r["mask"]) for r in encoding.stride_rows(df, "g", "o", 8).collect())
    assert [g[1] for g in got] == want and all(g[2] == [x > 50 for x in g[1]] for g in got)
    assert encoding.stride_rows(df.limit(0), "g", "o", 8).count() == 0


def _stream(spark, sizes, weights, epochs=3, batch=4, seed="s"):
    """Scheduled batches of documents ``objective, tokens``, and the same walked one by one."""
    rows = [(i, o, n, f"text {i}") for i, (o, n) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc long, o string, n long, text string")
    batched = cursor.batches(cursor.epochs(df, "doc", seed, epochs, F.col("o")), batch, whole_only=False)
    sums = batched.groupBy("objective", "epoch", "batch").agg(F.sum("n").alias("n_tokens"))
    scheduled = stream.schedule(sums.join(cursor.batch_digests(batched, "doc"), ["objective", "epoch", "batch"]), weights)
    exact = {k: Fraction(str(w)) for k, w in weights.items() if Fraction(str(w)) > 0}
    order = {(o, e): sorted((hashlib.sha256(f"{seed}:{o}:{e}:{i}".encode()).hexdigest(), i, n) for i, p, n, _ in rows if p == o) for o in exact for e in range(epochs)}
    at, read, walked = {o: (0, 0) for o in exact}, dict.fromkeys(exact, 0), []
    while True:
        o = min(exact, key=lambda k: (read[k] / exact[k], k))
        e, b = at[o]
        if e == epochs:
            break
        part = order[o, e][b * batch : (b + 1) * batch]
        walked.append((o, e, b, [i for _, i, _ in part]))
        read[o] += sum(n for _, _, n in part)
        at[o] = (e, b + 1) if (b + 1) * batch < len(order[o, e]) else (e + 1, 0)
    return df, batched, scheduled, walked


def _walk(scheduled):
    return [(r["objective"], r["epoch"], r["batch"]) for r in scheduled.orderBy("step").collect()]


def _written(sequences, width, target, batch):
    """A writer that appends sequence after sequence."""
    ids, mask, rows, trained, at = [], [], [], 0, 0
    for i, m in sequences:
        ids, mask = ids + i, mask + m
        while len(ids) >= width:
            n = sum(mask[1:width])
            if n:
                rows.append((at, ids[:width], n))
                trained += n
            ids, mask, at = ids[width - 1 :], mask[width - 1 :], at + 1
        if trained >= target and len(rows) % batch == 0:
            return rows
    return None


def test_rows_until_equal_a_writer(spark):
    for seed in range(6):
        rng = random.Random(seed)
        made = [(k, rng.choices(range(99), k=n), [rng.random() < 0.2 for _ in range(n)] if rng.random() < 0.6 else [False] * n) for k, n in enumerate(rng.choices((1, 4, 30), k=60))]
        df = spark.createDataFrame(made, "o long, ids array<int>, mask array<boolean>").repartition(3)
        want = _written([r[1:] for r in made], 8, 25, 3)
        if want is None:
            with pytest.raises(ValueError, match="ends before"):
                encoding.rows_until(df, "o", 8, 25, 3)
        else:
            assert [(r["row"], r["ids"], r["n_trained"]) for r in encoding.rows_until(df, "o", 8, 25, 3).orderBy("row").collect()] == want
    rows = encoding.stride_rows(df.withColumn("g", F.lit("g")), "g", "o", 8)
    assert encoding.first_rows(rows, "g", 5).count() == 5
    with pytest.raises(ValueError, match="'g' has"):
        encoding.first_rows(rows, "g", 10**6)


def test_numbers_of_packs(spark):
    packs = spark.createDataFrame([(0,), (1,), (1,), (4,), (5,), (None,)], "pack_id long")
    assert sorted((str(r["pack_id"]), r["fault"]) for r in encoding.number_faults(packs).collect()) == [("1", "repeated"), ("4", "not contiguous"), ("None", "no number")]
    assert encoding.number_faults(spark.range(9).withColumnRenamed("id", "pack_id")).count() == 0


def test_ids_of_a_tokenizer(spark):
    texts = ["The cat sat.", "", None, "é ß 日本 \n\n x", "<|endoftext|> is text here", "word " * 3000]
    df = spark.createDataFrame([(i, t, (t or "")[::-1]) for i, t in enumerate(texts)], "i int, t string, u string")
    plain = tokens.loaded(tokens.default_tokenizer())
    got = {r["i"]: (r["a"], r["b"]) for r in tokens.encode(df, {"t": "a", "u": "b"}).collect()}
    assert got == {i: (None if t is None else plain.encode(t, add_special_tokens=False).ids, plain.encode((t or "")[::-1], add_special_tokens=False).ids) for i, t in enumerate(texts)}
    marks = tokens.marks(tokens.default_tokenizer())
    assert min(marks.values()) == plain.get_vocab_size() and tokens.reserved(tokens.default_tokenizer()) == {50256}
    made = tokens.encode(df, {"t": "a", "u": "b"}).where("a IS NOT NULL").select("i", encoding.conditional(F.col("b"), F.lit(None).cast("array<int>"), F.col("a"), marks).alias("s")).select("i", "s.*")
    for r in made.collect():
        a, b = got[r["i"]]
        assert r["ids"] == [marks["bos"], marks["prompt"], *b, marks["poem"], *a, marks["eos"]]
        # Whole, as input, and trained: p + r + 4, p + r + 3 and r + 1.
        assert (len(r["ids"]), len(r["ids"]) - 1, sum(r["mask"])) == (len(a) + len(b) + 4, len(a) + len(b) + 3, len(a) + 1)
    assert tokens.vocabulary_faults(made, "ids", "i").count() == 0
    bad = spark.createDataFrame([(1, [5, 50256]), (2, [99_999]), (3, [7])], "i int, ids array<int>")
    assert {tuple(r) for r in tokens.vocabulary_faults(bad, "ids", "i").collect()} == {(1, "reserved"), (2, "beyond_vocabulary")}
    assert tokens.encode(df.limit(0), {"t": "a"}).count() == 0


def test_stream_equals_a_walk_of_batch_after_batch(spark):
    rng = random.Random(9)
    for weights in ({"a": "0.1", "b": 0.7, "c": 1}, {"a": 3, "b": 1, "c": 0}, {"a": 1, "b": 1, "c": "2.5"}):
        sizes = [(rng.choice("aabc"), rng.choice((0, 1, 5, 40))) for _ in range(60)]
        _, batched, scheduled, walked = _stream(spark, sizes, weights)
        assert _walk(scheduled) == [w[:3] for w in walked]
        assert [r["step"] for r in scheduled.orderBy("step").collect()] == list(range(len(walked)))
        ids = {(r["objective"], r["epoch"], r["batch"]): r["ids"] for r in batched.groupBy("objective", "epoch", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc"))), lambda s: s["doc"]).alias("ids")).collect()}
        assert all(ids[w[:3]] == w[3] for w in walked)


def test_stream_resumes_anywhere_and_refuses_what_differs(spark):
    rng = random.Random(10)
    sizes = [(rng.choice("ab"), rng.randrange(1, 30)) for _ in range(40)]
    df, _, scheduled, walked = _stream(spark, sizes, {"a": 1, "b": 2})
    rules = {"seed": "s", "weights": "a1b2"}
    content = stream.content_digest(df, "doc", "o", "n", "text")
    for k in (0, 1, 7, len(walked) - 1, len(walked)):
        saved = stream.state(scheduled, k, content, rules)
        assert _walk(stream.resume(scheduled, saved, content, rules)) == [w[:3] for w in walked[k:]]
        assert _walk(stream.probe(scheduled, k, 2, 3)) == [w[:3] for w in walked[k + 2 : k + 5]]
        passed = [sizes[i][1] for w in walked[k : k + 4] for i in w[3]]
        assert stream.skipped(scheduled, k, 4) == {"batches": len(walked[k : k + 4]), "tokens": sum(passed)}
        for o in "ab":
            mine = [w for w in walked[:k] if w[0] == o]
            many = max(w[2] for w in walked if w[0] == o) + 1
            assert (saved["epochs"][o], saved["positions"][o]) == divmod(len(mine), many)
            assert saved["tokens"][o] == sum(sizes[i][1] for w in mine for i in w[3])
    saved = stream.state(scheduled, 7, content, rules)
    changed = stream.content_digest(df.withColumn("text", F.when(F.col("doc") == 3, "other").otherwise(F.col("text"))), "doc", "o", "n", "text")
    with pytest.raises(ValueError, match="content"):
        stream.resume(scheduled, saved, changed, rules)
    with pytest.raises(ValueError, match="rules"):
        stream.resume(scheduled, saved, content, {**rules, "seed": "t"})
    with pytest.raises(ValueError, match="order"):
        stream.resume(_stream(spark, sizes, {"a": 1, "b": 2}, seed="t")[2], saved, content, rules)
    with pytest.raises(ValueError, match="positions"):
        stream.resume(scheduled, {**saved, "positions": {"a": 0, "b": 0}}, content, rules)
    with pytest.raises(ValueError, match="state"):
        stream.resume(scheduled, {"steps": True}, content, rules)
    with pytest.raises(ValueError, match="whole number"):
        stream.skipped(scheduled, 0, -1)
    with pytest.raises(ValueError, match="no batch"):
        _stream(spark, sizes, {"a": 1, "gone": 2}, epochs=1)
    with pytest.raises(ValueError, match="weight"):
        stream.factors({"a": 0})


def test_small_decimal_weights_keep_their_ratio():
    assert stream.factors({"a": 0.1, "b": "0.30", "c": 0}) == {"a": 3, "b": 1}


def test_offsets_keep_null_extreme_and_equal_keys(spark):
    rng = random.Random(11)
    keys = [None, None, -(2**63), 2**63 - 1, *(rng.randrange(4) for _ in range(60))]
    rows = [(rng.choice(["g", None]), k, i, rng.randrange(5)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g string, o long, tie long, n long").repartition(7)
    got = {r["tie"]: r["at"] for r in encoding.with_offsets(df, "g", "o", "n", "at", ("tie",)).collect()}
    want, totals = {}, {}
    for g, _, i, n in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        want[i] = totals.get(g, 0)
        totals[g] = want[i] + n
    assert got == want
    lines = encoding.stride_rows(spark.createDataFrame([("g", 1, [1, 2, 3]), ("g", None, [8, 9])], "g string, o long, ids array<int>").withColumn("mask", F.transform("ids", lambda x: x > 0)), "g", "o", 3)
    assert sorted((r["row"], r["ids"]) for r in lines.collect()) == [(0, [8, 9, 1]), (1, [1, 2, 3])]


def test_running_values(spark):
    rng = random.Random(12)
    rows = [(rng.choice("xy"), i, rng.choice([None, 1, 2, 3])) for i in range(200)]
    df = ranges.dealt(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"])
    assert df.select(ranges.PART).distinct().count() > 1
    low = {r["i"]: r["m"] for r in ranges.running(df, ["g"], ["i"], "min", F.col("v"), "m", inclusive=True).collect()}
    top = {r["i"]: r["m"] for r in ranges.running(df, ["g"], ["i"], "max", F.col("v"), "m").collect()}
    last = {r["i"]: r["p"] and (r["p"]["i"], r["p"]["v"]) for r in ranges.before(df, ["g"], ["i"], ["i", "v"], "p").collect()}
    for g, i, _ in rows:
        mine = [(j, v) for h, j, v in rows if h == g and j < i]
        assert top[i] == max((v for _, v in mine if v), default=None)
        assert low[i] == min((v for h, j, v in rows if h == g and j <= i and v), default=None)
        assert last[i] == (mine[-1] if mine else None)
    assert sorted(r["p"] for r in ranges.places(df, [], ["i"], "p").collect()) == list(range(200))


def test_prompt_plan_is_balanced_and_free_of_collisions(spark):
    sizes = {"a": 4, "b": 3, "c": 5}
    rows = [tuple(r)[2:] for r in cursor.mixed_radix(spark, 60, 120, sizes, "s").collect()]
    assert len(set(rows)) == 60 and all(sum(r[0] == v for r in rows) == 15 for v in range(4))


def test_a_plan_without_repeats_has_an_end(spark):
    rows = spark.range(60).select((F.col("id") * 7).alias("part"))
    got = cursor.planned_once(rows, "part", {"a": 4, "b": 3, "c": 5}, "s").collect()
    assert len({(r["a"], r["b"], r["c"]) for r in got}) == 60
    with pytest.raises(ValueError, match="only 59"):
        cursor.planned_once(rows, "part", {"a": 59}, "s")


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda: [str(rng.randrange(25)) for _ in range(rng.randrange(0, 70))]
    refs = [text() for _ in range(30)]
    asks = [text() for _ in range(10)] + [w[: len(w) // 2] for w in refs[:8]] + [["x", *w[1:]] for w in refs[8:16]] + [list(w) for w in refs[16:20]]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    want = set()
    for i, a in enumerate(asks):
        for j, b in enumerate(refs):
            k, n, m = len(sets(a) & sets(b)), len(sets(a)), len(sets(b))
            first = (asks.index(a) == i) and (refs.index(b) == j)
            if first and 5 * k >= 4 * min(n, m):
                want.add((i, j, "normalized_exact" if a == b else "shingle_jaccard" if 5 * k >= 4 * (n + m - k) else "shingle_containment", k))
    make = lambda rows: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "id long, text string")
    got = {(r["query_id"], r["reference_id"], r["metric"], r["shared"]) for r in joins.find_matches(make(asks), make(refs)).collect()}
    assert got == want


def test_wrong_spans_are_found(spark):
    blocks = [("a b\nc", 0, 3, "a b"), ("a b\nc", 4, 5, "x"), ("a b\nc", 1, 3, "a b")]
    df = spark.createDataFrame(blocks, "t string, start_char int, end_char int, block string")
    assert [r["block"] for r in records.span_faults(df, "t").orderBy("block").collect()] == ["a b", "x"]


def test_sketch_hash_wraps_like_int64(spark):
    values = [0, 1, -7, 65_000, 65_000 * (2**31 - 1) + 12, 2**62]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    want = [(wrap(v * 1103515245 + 17 * 12345) % (2**31 - 1) % 256, (wrap(v * 214013 + 17 * 2531011) % (2**31 - 1) & 1) * 2 - 1) for v in values]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long").orderBy("i").select(measures.sketch_slot(F.col("v"), 256, 17).alias("s")).select("s.*")
    assert [tuple(r) for r in got.collect()] == want


def test_records(spark):
    df = spark.createDataFrame([(0, "a\n\nb c\nd\n \n e", "--A b!!"), (1, "", "ä"), (2, "x", "ok-1")], "i int, t string, n string")
    got = {(r["i"], r["start_char"], r["end_char"], r["block"]) for r in records.paragraphs(df, "i", "t").collect()}
    assert got == {(0, 0, 1, "a"), (0, 3, 8, "b c\nd"), (0, 11, 13, " e"), (2, 0, 1, "x")}
    names = [r[0] for r in df.orderBy("i").select(records.slug(F.col("n"))).collect()]
    assert names[0] == "a-b" and len(names[1]) == 16 and names[2] == "ok-1"
