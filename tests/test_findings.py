import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quernstone import finalize, gates, protection
from quernstone.functions import records
from quernstone.functions.text import words
from quernstone.operators import joins, measures, overlap, selection, similarity


def test_prompts_tie_to_sources_not_to_each_other(spark):  # F1
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    said = " ".join(f"w{i}" for i in range(40))
    prompts = [(i, f"write a poem about the sea and the hill in spring number {i}") for i in range(50)] + [(60, said), (61, said), (62, None)]
    links, asked = similarity.sided_links(frame(prompts), frame([(7, said + " more"), (8, "of another kind altogether it is"), (9, said)]))
    assert {r["id"] for r in asked.collect()} == {60}
    nodes = {x for r in links.collect() for x in r}
    assert nodes == {7, 9, 60}


def test_shingles_of_the_same_texts_are_one_list(spark):  # F3, F4, F5
    words = [[f"{p}x{i}" for i in range(200)] for p in range(10)]
    docs = [(2 * p + k, " ".join(w[k:])) for p, w in enumerate(words) for k in (0, 1)]
    posted, heads, _ = similarity._searched(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert posted.count() == len(docs) and heads.count() == len(docs)


def test_shingles_of_one_side_go_no_further(spark):  # F8, F9, F10, F15
    frame = lambda rows: similarity.signatures(spark.createDataFrame(rows, "id long, text string"), "id", "text", len(rows) - 2)
    same = " ".join(map(str, range(30)))
    signed = frame([(1, "a b c d e f g"), (2, same)]).unionByName(frame([(1, same + " y"), (2, "k l m n o"), (3, "k l m n o p")]))
    posted, _, sets = similarity.searched(signed, "odd > 0 AND odd < df")
    assert posted.count() == 2 and [len(r["set"]) for r in sets.collect()] == [26, 26]


def test_means_are_added_in_the_order_of_lines(spark, tmp_path):  # F2
    rng, rows = random.Random(2), []
    while len({r[0] for r in rows}) < 30:
        d = [rng.randrange(11) / 100 for _ in range(8)]
        at = [0.0, 0.0, 0.0]
        for i, x in enumerate(d):
            at[0] += x
            at[1 + i // 4] += x
        if (at[0] / 8 > 0.05) != ((at[1] + at[2]) / 8 > 0.05):
            rows += [(len(rows) // 8, x, 1.0, i, at[0] / 8 > 0.05) for i, x in enumerate(d)]
    frame = pd.DataFrame(rows, columns=["l_orderkey", "l_discount", "l_quantity", "i", "high"])
    (tmp_path / "lineitem.parquet").mkdir()
    for k in (0, 1):
        frame[frame.i // 4 == k].drop(columns=["i", "high"]).to_parquet(tmp_path / "lineitem.parquet" / f"{k}.parquet")
    got = {r["l_orderkey"]: "discount" in r["reasons"] for r in gates.functional_gates(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_gates_of_missing_values_equal_the_sql(spark, tmp_path):  # round 4: F1
    rows = [(1, None, None), (1, None, None), (2, None, 1.0), (3, 0.09, None), (4, None, 30.0), (4, 0.02, None), (None, 0.06, None)] + [(5, None, 60.0)] * 6
    pd.DataFrame(rows, columns=["l_orderkey", "l_discount", "l_quantity"]).astype({"l_orderkey": "Int64"}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = {r["l_orderkey"]: r["reasons"] for r in gates.functional_gates(spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(gates.SQL["functional_gates"]).fetchall()) == {1: "", 2: "quantity", 3: "discount", 4: "", 5: "lines", None: "discount"}


def test_documents_are_normalised_once_and_missing_ones_tie_nothing(spark, tmp_path, monkeypatch):  # round 4: F2
    kept = []
    put = lambda df, tag, put=protection.stored: kept.append((tag, df)) or put(df, tag)
    monkeypatch.setattr(protection, "stored", put)
    monkeypatch.setattr(similarity, "stored", put)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))) for _ in range(90)] + [None] * 40 + ["", " ", "A b", "a B"]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    rows.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = protection.family_sides(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT doc_id, family, split FROM ({protection.SQL['family_sides']}) x").fetchall())
    plans = {tag: df._jdf.queryExecution().optimizedPlan().toString() for tag, df in [*kept, ("got", got)]}
    assert {tag for tag, p in plans.items() if r"\p{L}\p{N}_']+" in p} == {"family-texts"}
    # A prompt that is a document's text is no signature of its own.
    norms = [r["norm"] for tag, df in kept if tag == "lex-signatures" for r in df.select("norm").collect()]
    assert len(norms) == len(set(norms))


def test_normal_texts_are_their_words(spark):  # round 4: F2
    texts = [None, "", " ", "'", "_", "Straße ẞ\tÄÖ-x", "\n a..b \n", "it's  10\u00a0%", "İI\u0301 é\u3000漢字、ー\U00020000\U0001f600z", "a\u0000b\u200dc", "٣½²ª"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(similarity.normal(F.col("t")), F.array_join(words(F.col("t")), " ")).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] and rows[5][0] == "strasse ß äö x"


def test_overlap_rates_equal_brute_force(spark):  # F6, F12
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    items, corpus = [text(12) for _ in range(5)], [text(rng.randrange(0, 60)) for _ in range(20)]
    make = lambda rows: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "id long, text string")
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    widths = (1, 2, 3, 5)
    want = {(i, n): (len(grams(w, n)), len(grams(w, n) & {g for c in corpus for g in grams(c, n)})) for i, w in enumerate(items) for n in widths}
    got = {(r["id"], r["n"]): (r["n_grams"], r["n_found"]) for r in overlap.overlap_rates(make(items), "id", make(corpus), "text", widths).collect()}
    assert got == want
    wanted = overlap.grams(make(items), "id", "text", widths).select("n", "h", "h2").distinct()
    assert overlap._found(make(corpus), "text", wanted, widths).count() == sum(len({g for w in items for g in grams(w, n)} & {g for c in corpus for g in grams(c, n)}) for n in widths)


def test_tokens_of_one_row_take_no_part_in_rounds(spark, monkeypatch):  # F7
    kept = []
    monkeypatch.setattr(selection, "stored", lambda df, tag, put=selection.stored: kept.append((tag, put(df, tag))) or kept[-1][1])
    items = [(i, 1000 * i + t) for i in range(20) for t in range(50)] + [(i, 10**6 + t) for i in (3, 5) for t in range(50)]
    got = {r["id"]: r["accepted"] for r in selection.greedy_disjoint(spark.createDataFrame(items, "id long, token long")).collect()}
    assert got == {i: i != 5 for i in range(20)}
    assert next(df for tag, df in kept if tag == "greedy-items").count() == 2


def test_misplaced_blocks_are_found_by_document(spark):  # F11
    docs = spark.createDataFrame([(1, "ä b\nc"), (2, None), (3, "x")], "k long, t string")
    blocks = spark.createDataFrame([(1, 0, 3, "ä b"), (1, 4, 5, "x"), (1, 1, 3, "ä b"), (3, 0, 1, "x"), (2, 0, 1, "x")], "k long, start_char int, end_char int, block string")
    assert sorted(r["block"] for r in records.misplaced(blocks, docs, "k", "t").collect()) == ["x", "ä b"]


def test_a_sketch_deals_slots_only(spark):  # F13
    plan = measures.count_sketch(spark.range(1000).repartition(3).selectExpr("id * 7 as v"), "v", 16, 17)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(v" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_drift_of_far_values(spark):  # F16
    rows = spark.createDataFrame([(0, [900.0, 899.0], [1.0, 2.0]), (0, [0.0, 0.0], [0.0, 0.0])], "g int, a array<float>, b array<float>")
    p, q = 1 / (1 + 2.718281828459045**-1), 1 / (1 + 2.718281828459045)
    got = measures.drift(rows, "g", "a", "b").first()
    assert abs(got["symmetric_kl"] - (p - q) / 2) < 1e-9 and got["n_values"] == 4


def test_answers_are_read_once_where_they_lie(spark, monkeypatch):  # F14
    kept = []
    monkeypatch.setattr(finalize, "stored", lambda df, tag, put=finalize.stored: kept.append(df) or put(df, tag))
    results = spark.createDataFrame([(1, "a\nb", "stop"), (2, "A\n b", "stop"), (3, "a\n" * 9, "stop"), (5, " ", "stop")], "request_id long, content string, finish string")
    requests, critiques = results.select("request_id", F.lit("free").alias("form")).unionByName(spark.createDataFrame([(4, "free")], "request_id long, form string")), results.selectExpr("request_id", "'accept' AS decision")
    got = finalize.finalized(requests, results, critiques, 1, 4)
    want = [(1, "accepted", "", "a\nb", 2), (2, "duplicate", "", "A\n b", None), (3, "rejected", "line_count=9_expected=1-4", "a\n" * 9, None), (4, "missing", "", None, None), (5, "unusable", "", None, None)]
    assert sorted(map(tuple, got.collect())) == want
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (*kept, got)]
    assert sum(p.count(r"[\p{L}\p{N}_']+") for p in plans) == 1
    got = finalize.finalized(requests, results, critiques, 1, 4, F.length)
    assert sorted(map(tuple, got.collect())) == [(i, state, why, clean and len(clean), n) for i, state, why, clean, n in want]


def test_odd_line_ends_and_long_rules(spark):  # F14
    ends = ["\n", "\r", "\r\n", *map(chr, (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029, 0x1F, 0x84, 0x86, 0x2027, 0x202A, 0x1F600, 0x09, 0xA0))]
    texts = [f"a{e} {e}---{e}b {e} *** {e}{e}-- -{e}---c" for e in ends] + ["", " ", "---", "---\n---", " --- \r\n***", "----\n---", "x---\n---"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["r"] for r in rows.select("i", records.response_reasons(F.col("t"), F.lit(99), F.lit(99), (), ()).alias("r")).collect()}
    for i, t in enumerate(texts):
        lines = [x.strip(" ") for x in t.splitlines() if x.strip(" ")]
        assert got[i][0] == f"line_count={len(lines)}_expected=99-99" and ("multiple_poem_separator" in got[i]) == (sum(x in ("---", "***") for x in lines) > 1)
    rules = [("-" * 50000, 1, ""), ("* " * 50000 + "\na", 1, "a"), ("_\t" * 50000 + "a", 0, "_\t" * 50000 + "a")]
    made = spark.createDataFrame(rules, "t string, n int, left string").select("n", "left", records.without_markdown(F.col("t")).alias("m")).collect()
    assert all(r["m"]["rules"] == r["n"] and r["m"]["clean"].strip() == r["left"].strip() for r in made)
