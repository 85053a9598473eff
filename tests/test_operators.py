import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quernstone import catalog
from quernstone.functions import text
from quernstone.operators import graph, selection, similarity
from quernstone.sources import tables
from quernstone.streaming import windows


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["family"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_greedy_disjoint_equals_sequential(spark):
    rng = random.Random(5)
    items = [(i, t) for i in range(60) for t in rng.sample(range(90), 3)]
    seen, want = set(), {}
    for i in range(60):
        mine = {t for j, t in items if j == i}
        want[i] = not mine & seen
        seen |= mine if want[i] else set()
    got = {r["id"]: r["accepted"] for r in selection.greedy_disjoint(spark.createDataFrame(items, "id long, token long")).collect()}
    assert got == want


def test_next_fit(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.randrange(1, 40)) for g in "ab" for i in range(25)]
    want = {}
    for g in "ab":
        at = used = 0
        for _, i, n in [r for r in rows if r[0] == g]:
            if used and used + n > 50:
                at, used = at + 1, 0
            used += n
            want[g, i] = at
    got = selection.next_fit(spark.createDataFrame(rows, "g string, i long, n long"), "g", "i", "n", 50)
    assert {(r["g"], r["i"]): r["bin"] for r in got.collect()} == want


def test_near_matches_equal_brute_force(spark):
    rng = random.Random(11)
    docs = []
    for i in range(40):
        w = [str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: len(w) - 1] if i % 3 else ["x", *w[1:], "y"]))]
    sets = {}
    for d, t in docs:
        w = t.split()
        sets.setdefault(t, (d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}))
    rows = list(sets.values())
    want = {(a, b) for a, x in rows for b, y in rows if a < b and 5 * len(x & y) >= 4 * min(len(x), len(y))}
    got = {(r[0], r[1]) for r in similarity.near_matches(spark.createDataFrame(docs, "doc_id long, text string")).select("left_id", "right_id").collect()}
    assert got == want


def test_line_runs_of_a_long_conversation(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"a{t}") for t in range(1500)] + [(2, t, ("user", "assistant")[t // 2 % 2], f"b{t}") for t in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    runs = [list(g) for _, g in groupby(rows, key=lambda r: (r[0], r[2]))]
    want = [(g[0][2], len(g), hashlib.sha256("\n".join(r[3] for r in g).encode()).hexdigest()) for g in runs]
    got = catalog.queries()["line_runs"](spark, str(tmp_path)).collect()
    assert sorted((r["role"], r["n_lines"], r["joined"]) for r in got) == sorted(want)


def test_text_functions(spark):
    df = spark.createDataFrame([("é\r\nx ", "Große It's")], "a string, b string")
    got = df.select(text.nfc("a"), text.words(F.col("b"))).first()
    assert got[0] == "é\nx" and got[1] == ["grosse", "it's"]


def test_readers(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/labels.parquet"
    assert tables.read_parquet(spark, path, ["doc_id", "quality", "toxic"], row_index=True).columns[-1] == "row_index"
    with pytest.raises(tables.SchemaMismatch):
        tables.read_parquet(spark, path, ["doc_id"])
    (tmp_path / "x.jsonl").write_text('{"id": 1}\nnope\n\n{"id": 2}\n')
    good, bad = tables.read_tolerant_jsonl(spark, str(tmp_path / "x.jsonl"), "id long" and spark.createDataFrame([], "id long").schema)
    assert sorted(r[0] for r in good.collect()) == [1, 2] and [r[0] for r in bad.collect()] == ["nope"]
    tables.write_canonical_jsonl(spark.createDataFrame([(2, "b"), (1, None)], "id long, a string"), str(tmp_path / "out"), "id")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":null,"id":1}', '{"a":"b","id":2}']


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.windowed_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("totals").agg(F.sum("n")).first()[0] == events.count()
