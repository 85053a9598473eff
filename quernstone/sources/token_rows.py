"""Rows of token ids as binary files: little-endian 16-bit ids, and a plane of one byte a position.

A folder holds pairs of files ``part-N.tokens.bin`` and ``part-N.loss.bin`` and a
``metadata.json`` with the width of a row, and rows and digests of each pair. Every
file is a whole number of rows, so a reader's tasks take any run of rows of a file
by its offset. Tasks write to a hidden folder; the commit names the files by the
order of the rows, writes the metadata and renames the folder.

Files are reached through pyarrow's file systems, by a local path or a URI that every
executor can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT, VERSION, METADATA = "token_rows", 1, "metadata.json"
SCHEMA = "row long, ids array<int>, mask array<boolean>"
#: Rows of a reader's task, and of one batch of it.
SPLIT_ROWS, BATCH_ROWS = 200_000, 4096


class Damaged(ValueError):
    """Sizes or digests are not what the metadata says."""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_metadata(path: str) -> dict:
    store, base = _opened(path)
    if store.get_file_info(f"{base}/{METADATA}").type == fs.FileType.NotFound:
        raise Damaged(f"{path} has no metadata")
    with store.open_input_stream(f"{base}/{METADATA}") as f:
        found = json.loads(f.read())
    if found.get("version") != VERSION or found.get("format") != FORMAT or not isinstance(found.get("width"), int) or found["width"] < 2:
        raise Damaged(f"{path} is no folder of token rows")
    if sum(p["rows"] for p in found["parts"]) != found["rows"]:
        raise Damaged("the parts don't add up to the rows")
    return found


def _sizes(path: str, said: dict) -> None:
    """Each file must hold its rows, no more and no less."""
    store, base = _opened(path)
    for part in said["parts"]:
        for suffix, size in (("tokens", 2), ("loss", 1)):
            info = store.get_file_info(f"{base}/{part['name']}.{suffix}.bin")
            if info.size != part["rows"] * said["width"] * size:
                raise Damaged(f"{part['name']}.{suffix}.bin has {info.size} bytes")


@dataclass
class _Run(InputPartition):
    name: str
    first: int  # row within the file
    rows: int
    row: int  # of all rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split_rows", SPLIT_ROWS))
        self.said = read_metadata(self.path)
        _sizes(self.path, self.said)

    def partitions(self) -> list[_Run]:
        runs, row = [], 0
        for part in self.said["parts"]:
            for first in range(0, part["rows"], self.split):
                runs.append(_Run(part["name"], first, min(self.split, part["rows"] - first), row + first))
            row += part["rows"]
        return runs or [_Run("", 0, 0, 0)]

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        width = self.said["width"]
        if not run.rows:
            return
        store, base = _opened(self.path)
        with store.open_input_file(f"{base}/{run.name}.tokens.bin") as tokens, store.open_input_file(f"{base}/{run.name}.loss.bin") as losses:
            for at in range(0, run.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, run.rows - at)
                ids = np.frombuffer(tokens.read_at(n * width * 2, (run.first + at) * width * 2), dtype="<u2")
                mask = np.frombuffer(losses.read_at(n * width, (run.first + at) * width), dtype=np.uint8)
                ends = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(run.row + at, run.row + at + n)), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(mask.astype(bool)))],
                    ["row", "ids", "mask"],
                )


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    tokens_sha256: str
    losses_sha256: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"].rstrip("/"), int(options["width"])
        store, base = _opened(self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.File or (info.type == fs.FileType.Directory and store.get_file_info(fs.FileSelector(base))):
            raise FileExistsError(f"{self.path} is not empty")
        parent, _, name = self.path.rpartition("/")
        self.stage = f"{parent}/.{name}.preparing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        store, base = _opened(self.stage)
        store.create_dir(base, recursive=True)
        name, n = uuid.uuid4().hex, 0
        digests = sha256(), sha256()
        with store.open_output_stream(f"{base}/{name}.tokens.bin") as tokens, store.open_output_stream(f"{base}/{name}.loss.bin") as losses:
            for row in rows:
                if row["ids"] is None or row["mask"] is None or not len(row["ids"]) == len(row["mask"]) == self.width:
                    raise ValueError(f"a row is not {self.width} ids and as many marks")
                ids = np.array(row["ids"], dtype=np.int64)
                if ((ids < 0) | (ids > 0xFFFF)).any():
                    raise ValueError("an id does not fit 16 bits")
                for out, digest, data in zip((tokens, losses), digests, (ids.astype("<u2").tobytes(), np.array(row["mask"], dtype=np.uint8).tobytes()), strict=True):
                    out.write(data)
                    digest.update(data)
                n += 1
        return _Written(TaskContext.get().partitionId(), name, n, *(d.hexdigest() for d in digests))

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = _opened(self.stage)
        store.create_dir(base, recursive=True)
        parts = []
        kept = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for m in kept:
            if not m.rows:
                for suffix in ("tokens", "loss"):
                    store.delete_file(f"{base}/{m.name}.{suffix}.bin")
                continue
            name = f"part-{len(parts):06d}"
            for suffix in ("tokens", "loss"):
                store.move(f"{base}/{m.name}.{suffix}.bin", f"{base}/{name}.{suffix}.bin")
            parts.append({"name": name, "rows": m.rows, "tokens_sha256": m.tokens_sha256, "losses_sha256": m.losses_sha256})
        # What a failed attempt of a task left behind is no part.
        named = {f"{p['name']}.{s}.bin" for p in parts for s in ("tokens", "loss")}
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.base_name not in named:
                store.delete_file(info.path)
        whole = sha256("\0".join(p["tokens_sha256"] + p["losses_sha256"] for p in parts).encode()).hexdigest()
        said = {"format": FORMAT, "version": VERSION, "dtype": "uint16_le", "width": self.width, "rows": sum(p["rows"] for p in parts), "parts": parts, "data_sha256": whole}
        with store.open_output_stream(f"{base}/{METADATA}") as f:
            f.write(json.dumps(said, sort_keys=True, indent=1).encode())
        _sizes(self.stage, said)
        target = _opened(self.path)[1]
        if store.get_file_info(target).type == fs.FileType.Directory:
            store.delete_dir(target)  # an empty one
        store.move(base, target)

    def abort(self, messages: list[_Written | None]) -> None:
        store, base = _opened(self.stage)
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)


class TokenRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write(rows: DataFrame, path: str, width: int, order: list[str]) -> dict:
    """Writes ``ids, mask`` in the order of the columns ``order``; returns the metadata."""
    rows.sparkSession.dataSource.register(TokenRows)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("ids", "mask").write.format(FORMAT).option("path", path).option("width", str(width)).mode("append").save()
    return read_metadata(path)


def read(spark: SparkSession, path: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``row, ids, mask``, in tasks of at most ``split_rows`` rows; sizes are checked."""
    spark.dataSource.register(TokenRows)
    return spark.read.format(FORMAT).option("path", path).option("split_rows", str(split_rows)).load()


def verify(spark: SparkSession, path: str) -> dict:
    """Reads every file once, on the executors, and raises where a digest differs."""
    said = read_metadata(path)
    _sizes(path, said)
    expected = [(f"{p['name']}.{s}.bin", p[k]) for p in said["parts"] for s, k in (("tokens", "tokens_sha256"), ("loss", "losses_sha256"))]
    if sha256("\0".join(p["tokens_sha256"] + p["losses_sha256"] for p in said["parts"]).encode()).hexdigest() != said["data_sha256"]:
        raise Damaged("the digest of the data differs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(path)
        for batch in batches:
            bad = []
            for name, want in zip(batch["name"].to_pylist(), batch["want"].to_pylist(), strict=True):
                digest = sha256()
                with store.open_input_stream(f"{base}/{name}") as f:
                    while data := f.read(1 << 20):
                        digest.update(data)
                if digest.hexdigest() != want:
                    bad.append(name)
            yield pa.RecordBatch.from_pydict({"name": pa.array(bad, pa.string())})

    files = spark.createDataFrame(expected, "name string, want string").repartition(max(1, min(len(expected), 1000)))
    if bad := [r["name"] for r in files.mapInArrow(check, "name string").limit(5).collect()]:
        raise Damaged(f"digests differ: {bad}")
    return said
