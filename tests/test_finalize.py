"""Answers on their way into a dataset: states, reasons, errors."""

import pytest
from pyspark.sql import functions as F

from quernstone import finalize

POEM = "one line here\ntwo lines here\nthree lines here"


def tables(spark, answers, critiques):
    requests = spark.createDataFrame([(i, f) for i, f, *_ in answers], "request_id long, form string")
    results = spark.createDataFrame([(i, c, e) for i, _, c, e in answers if e], "request_id long, content string, finish string")
    return requests, results, spark.createDataFrame(critiques, "request_id long, decision string")


def test_states_of_answers(spark):
    answers = [
        (1, "free", None, None), (2, "free", None, "stop"), (3, "free", "  ", "stop"), (4, "free", POEM, "length"), (5, "free", POEM, "stop"), (6, "free", f"***\n*{POEM}*\n- - -".upper(), "stop"),
        (7, "free", POEM + "\nas an ai", "stop"), (8, "tercets", POEM, "stop"), (9, "free", "a fine poem of mine", "stop"), (10, "free", "another fine poem\nof mine", "stop"), (11, "free", POEM + " now", "stop"),
    ]
    critiques = [(i, "accept") for i in (4, 5, 6, 7, 8, 11)] + [(10, "reject")]
    got = {r["request_id"]: (r["state"], r["reasons"]) for r in finalize.finalized(*tables(spark, answers, critiques), 1, 4).collect()}
    assert got == {
        1: ("missing", ""), 2: ("unusable", ""), 3: ("unusable", ""), 4: ("truncated", ""), 5: ("accepted", ""), 6: ("duplicate", ""), 7: ("rejected", "refusal_boilerplate"),
        8: ("rejected", "structural_mismatch"), 9: ("waiting", ""), 10: ("rejected", "critic_rejected"), 11: ("accepted", ""),
    }


def test_critiques_must_fit(spark):
    answers = [(1, "free", POEM, "stop")]
    for critiques, said in (([(1, "accept"), (1, "reject")], "2 critiques"), ([(2, "accept")], "no candidate")):
        with pytest.raises(ValueError, match=said):
            finalize.finalized(*tables(spark, answers, critiques), 1, 4)


def test_assembling_refuses_repeats_and_shortfalls(spark):
    chunk = spark.createDataFrame([(1, "accepted", "a b", 2), (3, "accepted", "c d e", 3), (4, "waiting", "x", None)], "request_id long, state string, clean string, size long")
    other = spark.createDataFrame([(2, "accepted", "A  b", 2), (5, "accepted", "f", 1)], chunk.schema)
    assert [(r["request_id"], r["total"]) for r in finalize.assembled([chunk, other], 5).orderBy("request_id").collect()] == [(1, 2), (3, 5)]
    assert [r["request_id"] for r in finalize.assembled([chunk, other], 6).orderBy("request_id").collect()] == [1, 3, 5]
    with pytest.raises(ValueError, match="reach 7"):
        finalize.assembled([chunk, other], 7)
    with pytest.raises(ValueError, match="in 3 chunks"):
        finalize.assembled([chunk, other.withColumn("request_id", F.lit(1).cast("long"))], 2)
