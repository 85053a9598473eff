"""Keyed state on streams against sequential simulations."""

import pytest
from pyspark.sql import functions as F

from quernstone.streaming import keyed, windows


@pytest.fixture(scope="module")
def store(spark):
    old = spark.conf.get(*keyed.STORE[:1], None)
    spark.conf.set(*keyed.STORE)
    yield spark
    spark.conf.set(keyed.STORE[0], old) if old else spark.conf.unset(keyed.STORE[0])


def run(stream, tmp_path, name):
    """Rows of a stream that takes one file a micro-batch."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and len([p for p in query.recentProgress if p["numInputRows"]]) > 1
    return stream.sparkSession.table(name).collect()


def source(spark, rows, tmp_path, files=3):
    """Rows in files by time, oldest first."""
    import os

    rows = rows.orderBy("at", "id").collect()
    step = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], rows_schema := "key string, id long, at double, tokens long, refund boolean")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in os.listdir(f"{tmp_path}/in/{i}"):
            os.utime(f"{tmp_path}/in/{i}/{f}", (1_000_000 + 1000 * i,) * 2)
    return spark.readStream.schema(rows_schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def simulated(rows, requests, tokens):
    """Buckets a key, one row after another."""
    held, found = {}, []
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        q, t, since = held.get(r["key"], (float(requests), float(tokens), r["at"]))
        now = max(since, r["at"])
        q, t = min(requests, q + (now - since) * requests / 60), min(tokens, t + (now - since) * tokens / 60)
        if r["refund"]:
            held[r["key"]] = (q, min(tokens, t + r["tokens"]), now)
            continue
        if not 1 <= r["tokens"] <= tokens:
            found.append((r["id"], None, "beyond_capacity"))
            held[r["key"]] = (q, t, now)
            continue
        wait = max(max(0, 1 - q) * 60 / requests, max(0, r["tokens"] - t) * 60 / tokens)
        q, t = min(requests, q + wait * requests / 60), min(tokens, t + wait * tokens / 60)
        held[r["key"]] = (q - 1, t - r["tokens"], now + wait)
        found.append((r["id"], round(now + wait, 6), None))
    return sorted(found, key=lambda f: f[0])


def test_rate_limits_equal_a_simulation(store, sf_dir, tmp_path):
    events = store.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").limit(400)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(3))
    # Time runs three hundred times faster, so that buckets empty.
    rows = events.select((F.col("user_id") % 5).cast("string").alias("key"), F.col("event_id").alias("id"), (at / 300).alias("at"), (k * 7 % 130).alias("tokens"), (F.col("event_id") % 9 == 0).alias("refund"))
    got = run(keyed.rate_limited(source(store, rows, tmp_path), 4, 120), tmp_path, "limited")
    want = simulated([r.asDict() for r in rows.collect()], 4, 120)
    assert [(r["id"], r["fault"]) for r in sorted(got, key=lambda r: r["id"])] == [(i, f) for i, _, f in want]
    for r, (_, granted, _) in zip(sorted(got, key=lambda r: r["id"]), want, strict=True):
        assert granted is None and r["granted"] is None or abs(r["granted"] - granted) < 1e-3
    assert any(g for _, g, f in want) and any(f for _, _, f in want)
    assert any(r["granted"] and r["granted"] > r["at"] + 1 for r in got)
    with pytest.raises(ValueError, match="positive"):
        keyed.Buckets(0, 5)


def test_a_key_is_recorded_once(store, tmp_path):
    rows = store.range(60).select((F.col("id") * 7 % 23).cast("string").alias("key"), "id", F.col("id").cast("double").alias("at"), F.lit(1).cast("long").alias("tokens"), F.lit(False).alias("refund"))
    got = run(keyed.recorded(source(store, rows, tmp_path)), tmp_path, "recorded")
    first = {}
    for i in range(60):
        first.setdefault(str(i * 7 % 23), i)
    assert sorted((r["id"], r["first"], r["repeated"]) for r in got) == [(i, first[str(i * 7 % 23)], first[str(i * 7 % 23)] != i) for i in range(60)]


def test_a_ledger_refuses_what_it_has(spark, tmp_path):
    ledger = keyed.Ledger(spark, f"{tmp_path}/ledger", ["example", "pass"])
    rows = spark.createDataFrame([("a", 0, 1.5), ("b", 0, 2.5)], "example string, pass int, loss double")
    ledger.append(rows)
    ledger.append(rows.withColumn("pass", F.lit(1)))
    for bad in (rows.where("example = 'a'"), rows.withColumn("pass", F.lit(2)).unionByName(rows.withColumn("pass", F.lit(2)))):
        with pytest.raises(ValueError, match="already recorded"):
            ledger.append(bad)
    with pytest.raises(ValueError, match="without a key"):
        ledger.append(rows.withColumn("example", F.lit(None).cast("string")))
    assert ledger.read(rows.schema).count() == 4


def test_windows_on_a_table(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    assert windows.windowed_totals(events).agg(F.sum("n")).first()[0] == n
    assert windows.sessions(events).agg(F.sum("n")).first()[0] == n
