"""Tables published all at once, with a receipt, and checked when they are loaded.

Everything is written to a hidden folder beside the target. What came out is read
again and counted, the files are listed with size and digest, and only a folder that
passes the same checks as any later load is renamed to the target. A run that ends
before leaves nothing at the target. All file work goes through the session's own
file systems, so the target may be any store that renames folders whole.

A receipt is small: rows and a digest of the rows of each table, and a digest of the
list of files, which is a table itself. Digests of rows don't depend on their order.
"""

from __future__ import annotations

import json
import re
import uuid
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, RECEIPT, FILES = 1, "_receipt.json", "_files"
_FILE_SCHEMA = "file string, size long, sha256 string"


class Mismatch(ValueError):
    """What is stored is not what its receipt says."""


class Folder:
    """A path on one of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._jvm = spark._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def beside(self, name: str) -> Folder:
        return Folder(self._spark, f"{self.path.getParent().toString()}/{name}")

    @property
    def name(self) -> str:
        return self.path.getName()

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path)) if self.system.exists(self.path) else []

    def write(self, name: str, text: str) -> None:
        out = self.system.create(self._jvm.org.apache.hadoop.fs.Path(self.path, name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.system.open(self._jvm.org.apache.hadoop.fs.Path(self.path, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self) -> None:
        self.system.delete(self.path, True)

    def __str__(self) -> str:
        return self.path.toString()


def rows_digest(df: DataFrame) -> list[Column]:
    """``rows`` and ``digest``: their number, and the sum of their hashes."""
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, sha256`` of every file below a folder but hidden ones; the path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = Folder(spark, path)
    root = base.system.makeQualified(base.path).toUri().getPath()
    name = F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), re.escape(root) + "/", 2), -1)
    return files.select(name.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _sealed(receipt: dict) -> str:
    return sha256(json.dumps({k: v for k, v in receipt.items() if k != "seal"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, about: dict | None = None) -> dict:
    """Writes the tables below ``path`` and returns the receipt. A target that holds
    anything is an error; ``about`` (of JSON values) is kept in the receipt."""
    if bad := [n for n in tables if not re.fullmatch(r"[a-z][a-z0-9_]*", n)]:
        raise ValueError(f"not a name of a table: {bad}")
    target = Folder(spark, path)
    if target.names():
        raise FileExistsError(f"{path} is not empty")
    stage = target.beside(f".{target.name}.preparing-{uuid.uuid4().hex}")
    try:
        counted = {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, *rows_digest(df)).write.parquet(f"{stage}/{name}")
            counted[name] = {**seen.get, "schema": json.loads(df.schema.json())}
        files = file_list(spark, str(stage))
        files.write.parquet(f"{stage}/{FILES}")
        stored = spark.read.schema(_FILE_SCHEMA).parquet(f"{stage}/{FILES}")
        receipt = {"version": VERSION, "tables": counted, "files": stored.agg(*rows_digest(stored)).first().asDict(), "about": about or {}}
        receipt["seal"] = _sealed(receipt)
        stage.write(RECEIPT, json.dumps(receipt, sort_keys=True, indent=1))
        load(spark, str(stage))
        if target.system.exists(target.path):
            target.system.delete(target.path, False)
        if not stage.system.rename(stage.path, target.path):
            raise OSError(f"{path} could not be put in place")
    except BaseException:
        stage.delete()
        raise
    return receipt


def read_receipt(spark: SparkSession, path: str) -> dict:
    folder = Folder(spark, path)
    if RECEIPT not in folder.names():
        raise Mismatch(f"{path} has no receipt")
    receipt = json.loads(folder.read(RECEIPT))
    if receipt.get("version") != VERSION or receipt.get("seal") != _sealed(receipt):
        raise Mismatch("the receipt was changed")
    return receipt


def load(spark: SparkSession, path: str, recount: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """The published tables and their receipt. Files that differ from the list by name,
    size or bytes are an error, and with ``recount`` so are rows that differ in number or content."""
    receipt = read_receipt(spark, path)
    folder = Folder(spark, path)
    if extra := set(folder.names()) ^ {*receipt["tables"], RECEIPT, FILES}:
        raise Mismatch(f"the set of files differs: {sorted(extra)}")
    listed = spark.read.schema(_FILE_SCHEMA).parquet(f"{folder}/{FILES}")
    if listed.agg(*rows_digest(listed)).first().asDict() != receipt["files"]:
        raise Mismatch("the list of files was changed")
    found = file_list(spark, str(folder)).select(F.col("file"), F.col("size").alias("found_size"), F.col("sha256").alias("found_sha256"))
    differs = ~(F.col("size").eqNullSafe(F.col("found_size")) & F.col("sha256").eqNullSafe(F.col("found_sha256")))
    if bad := [r["file"] for r in listed.join(found, "file", "full_outer").where(differs).select("file").limit(5).collect()]:
        raise Mismatch(f"files differ from the list: {bad}")
    tables = {}
    for name, said in receipt["tables"].items():
        df = spark.read.schema(T.StructType.fromJson(said["schema"])).parquet(f"{folder}/{name}")
        if recount and df.agg(*rows_digest(df)).first().asDict() != {"rows": said["rows"], "digest": said["digest"]}:
            raise Mismatch(f"the rows of {name} differ from the receipt")
        tables[name] = df
    return tables, receipt


# -- canonical lines ----------------------------------------------------------------


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields by name, whatever their depth; maps go by key."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        made = F.struct(*[_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.array_sort(F.map_entries(value)) if not isinstance(kind.valueType, T.MapType) else F.map_entries(value)
        return F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"], _sorted_fields(e["value"], kind.valueType))))
    return value


def canonical_line(df: DataFrame) -> Column:
    """A row as JSON without spaces, keys by name at every level, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def write_lines(df: DataFrame, path: str, id_column: str) -> None:
    """Canonical lines by id. Files hold ranges of ids, so one after another in the order
    of their names they are one sorted file. Ids that are null or repeat are an error, and so is a target that exists."""
    bad = df.groupBy(id_column).count().where((F.col("count") > 1) | F.col(id_column).isNull()).first()
    if bad:
        raise ValueError(f"{id_column} {bad[0]!r} is null or repeats")
    ordered = df.repartitionByRange(id_column).sortWithinPartitions(id_column)
    ordered.select(canonical_line(df).alias("value")).write.mode("errorifexists").text(path)


def write_manifest(df: DataFrame, path: str, id_column: str, fault: Column) -> None:
    """``write_lines`` for rows that may be passed on: a row with a ``fault`` (of its rights, say) is an error."""
    bad = df.select(F.col(id_column).alias("id"), fault.alias("fault")).where("fault IS NOT NULL").first()
    if bad:
        raise ValueError(f"{id_column} {bad['id']!r}: {bad['fault']}")
    write_lines(df, path, id_column)
