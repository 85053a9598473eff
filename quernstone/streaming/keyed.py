"""Operators with a state a key, on streams: rate limits with refunds, and append-only records.

State lives in the stream's state store, so a restarted stream goes on where it was. Rows of
a key within a micro-batch are taken by time and id, and micro-batches in their order. The
store must keep values of several kinds a key: set ``STORE`` on the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
GRANTED = "key string, id long, at double, tokens long, granted double, fault string"


def refilled(requests: float, tokens: float, since: float, now: float, per_minute: tuple[int, int]) -> tuple[float, float]:
    """Both buckets after the time since they were last looked at; they never hold more than a minute's worth."""
    passed = max(0.0, now - since) / 60.0
    return min(float(per_minute[0]), requests + passed * per_minute[0]), min(float(per_minute[1]), tokens + passed * per_minute[1])


class Buckets(StatefulProcessor):
    """A bucket of requests and one of tokens a key. A request waits until both hold enough,
    and those behind it wait with it. A refund returns tokens at its time."""

    def __init__(self, requests_per_minute: int, tokens_per_minute: int) -> None:
        for n in (requests_per_minute, tokens_per_minute):
            if isinstance(n, bool) or not isinstance(n, int) or n < 1:
                raise ValueError("rates are positive whole numbers")
        self.rates = (requests_per_minute, tokens_per_minute)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", T.StructType([T.StructField(n, T.DoubleType()) for n in ("requests", "tokens", "since")]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.level.get() if self.level.exists() else None
        ordered = sorted(rows, key=lambda r: (r["at"], r["id"]))
        requests, tokens, since = (held[0], held[1], held[2]) if held else (float(self.rates[0]), float(self.rates[1]), ordered[0]["at"])
        for r in ordered:
            now = max(r["at"], since)
            requests, tokens = refilled(requests, tokens, since, now, self.rates)
            since = now
            if r["refund"]:
                tokens = min(float(self.rates[1]), tokens + max(0, r["tokens"]))
                continue
            if r["tokens"] < 1 or r["tokens"] > self.rates[1]:
                yield Row(key=key[0], id=r["id"], at=r["at"], tokens=r["tokens"], granted=None, fault="beyond_capacity")
                continue
            wait = max(max(0.0, 1.0 - requests) * 60.0 / self.rates[0], max(0.0, r["tokens"] - tokens) * 60.0 / self.rates[1])
            if wait:
                # What was waited for is there to the full, whatever rounding says.
                requests, tokens = refilled(requests, tokens, now, now + wait, self.rates)
                requests, tokens, since = max(requests, 1.0), max(tokens, float(r["tokens"])), now + wait
            requests, tokens = requests - 1.0, tokens - r["tokens"]
            yield Row(key=key[0], id=r["id"], at=r["at"], tokens=r["tokens"], granted=since, fault=None)
        self.level.update((requests, tokens, since))

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, requests_per_minute: int, tokens_per_minute: int) -> DataFrame:
    """When each request of a stream ``key, id, at, tokens, refund`` is let through; ``at`` in seconds."""
    grouped = requests.select(F.col("key").cast("string"), "id", "at", "tokens", "refund").groupBy("key")
    return grouped.transformWithState(Buckets(requests_per_minute, tokens_per_minute), GRANTED, "Append", "None")


class Records(StatefulProcessor):
    """Remembers of each key whether it was recorded."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("id", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.seen.get()[0] if self.seen.exists() else None
        for r in sorted(rows, key=lambda r: r["id"]):
            if held is None:
                held = r["id"]
                self.seen.update((held,))
                yield Row(key=key[0], id=r["id"], first=held, repeated=False)
            else:
                yield Row(key=key[0], id=r["id"], first=held, repeated=True)

    def close(self) -> None:
        pass


def recorded(records: DataFrame) -> DataFrame:
    """``key, id, first, repeated`` of a stream ``key, id``: a record whose key has one already is marked, with the id of that one."""
    return records.select(F.col("key").cast("string"), "id").groupBy("key").transformWithState(Records(), "key string, id long, first long, repeated boolean", "Append", "None")


class Ledger:
    """An append-only table with one record a key: appending a key again is an error, and then nothing is written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def read(self, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def append(self, records: DataFrame) -> None:
        if records.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).limit(1).count():
            raise ValueError("a record without a key")
        old = self.read(records.schema).select(*self.keys, F.lit(1).alias("old"), F.lit(0).alias("new"))
        every = old.unionByName(records.select(*self.keys, F.lit(0).alias("old"), F.lit(1).alias("new")))
        again = every.groupBy(*self.keys).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).where("new > 1 OR (old > 0 AND new > 0)").first()
        if again:
            raise ValueError(f"already recorded: {tuple(again[k] for k in self.keys)}")
        records.write.mode("append").parquet(self.path)
