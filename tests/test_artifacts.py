"""Publishing, binary rows and scans: round trips, refusals, and equality with plain readers."""

import glob
import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quernstone.functions import records
from quernstone.sources import publish, scan, token_rows

SCHEMA = "id long, text string, tags array<string>, more struct<b:int,a:string>, m map<string,int>"


@pytest.fixture
def rows(spark):
    made = [(i, f"t{i}" if i % 5 else None, ["x"] * (i % 3), (i, "é") if i % 4 else None, {"k": i, "a": 1} if i % 2 else None) for i in range(60)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def test_published_tables_come_back(spark, rows, tmp_path):
    path = f"{tmp_path}/a set+b/out"
    receipt = publish.publish(spark, {"all": rows, "none": rows.limit(0)}, path, {"seed": 3})
    tables, again = publish.load(spark, path)
    assert again == receipt and receipt["tables"]["all"]["rows"] == 60 and receipt["about"] == {"seed": 3}
    assert sorted(map(str, tables["all"].collect())) == sorted(map(str, rows.collect())) and tables["none"].count() == 0
    assert tables["all"].schema == rows.schema and os.listdir(f"{tmp_path}/a set+b") == ["out"]
    with pytest.raises(FileExistsError):
        publish.publish(spark, {"all": rows}, path)


def test_an_interrupted_publication_leaves_nothing(spark, rows, tmp_path):
    bad = rows.withColumn("text", F.when(F.col("id") == 40, F.raise_error(F.lit("stop"))).otherwise(F.col("text")).cast("string"))
    with pytest.raises(PySparkException):
        publish.publish(spark, {"all": rows, "bad": bad}, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="name"):
        publish.publish(spark, {"../x": rows}, f"{tmp_path}/out")
    os.makedirs(f"{tmp_path}/out")
    publish.publish(spark, {"all": rows}, f"{tmp_path}/out")
    assert publish.load(spark, f"{tmp_path}/out")[0]["all"].count() == 60


def _crc(path):
    """A local store checks sums of its own; without them a change goes through to our checks."""
    for f in glob.glob(f"{path}/**/.*.crc", recursive=True):
        os.remove(f)


def test_what_was_changed_is_refused(spark, rows, tmp_path):
    def fresh(name):
        publish.publish(spark, {"all": rows, "more": rows.where("id < 9")}, f"{tmp_path}/{name}")
        _crc(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    path = fresh("bytes")
    part = glob.glob(f"{path}/all/*.parquet")[0]
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 1
    open(part, "wb").write(data)
    with pytest.raises(publish.Mismatch, match="files differ"):
        publish.load(spark, path)
    path = fresh("gone")
    os.remove(glob.glob(f"{path}/all/*.parquet")[0])
    with pytest.raises(publish.Mismatch, match="files differ"):
        publish.load(spark, path)
    path = fresh("extra")
    os.makedirs(f"{path}/other")
    with pytest.raises(publish.Mismatch, match="set of files"):
        publish.load(spark, path)
    path = fresh("receipt")
    said = json.load(open(f"{path}/_receipt.json"))
    said["tables"]["all"]["rows"] += 1
    json.dump(said, open(f"{path}/_receipt.json", "w"))
    with pytest.raises(publish.Mismatch, match="receipt was changed"):
        publish.load(spark, path)
    said["seal"] = publish._sealed(said)
    json.dump(said, open(f"{path}/_receipt.json", "w"))
    with pytest.raises(publish.Mismatch, match="rows of all"):
        publish.load(spark, path)
    os.remove(f"{path}/_receipt.json")
    with pytest.raises(publish.Mismatch, match="no receipt"):
        publish.load(spark, path)


def test_canonical_lines(spark, rows, tmp_path):
    publish.write_lines(rows, f"{tmp_path}/lines", "id")
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/lines/part-*")))
    made = [json.loads(x) for x in text.splitlines()]
    assert [r["id"] for r in made] == list(range(60))
    assert text == "".join(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n" for r in made)
    assert made[1] == {"id": 1, "text": "t1", "tags": ["x"], "more": {"b": 1, "a": "é"}, "m": {"k": 1, "a": 1}} and made[0]["more"] is None
    with pytest.raises(ValueError, match="repeats"):
        publish.write_lines(rows.unionByName(rows.where("id = 3")), f"{tmp_path}/again", "id")
    fault = records.rights_fault(F.when(F.col("id") == 7, "denied").otherwise("unknown"), F.lit(None).cast("string"), False)
    with pytest.raises(ValueError, match="7"):
        publish.write_manifest(rows, f"{tmp_path}/denied", "id", fault)
    publish.write_manifest(rows.where("id <> 7"), f"{tmp_path}/passed", "id", fault)
    assert spark.read.text(f"{tmp_path}/passed").count() == 59


@pytest.mark.parametrize("split", [1, 7, 10**6])
def test_token_rows_come_back(spark, tmp_path, split):
    rng = random.Random(3)
    made = [(i, [rng.choice((0, 1, 300, 65535)) for _ in range(9)], [rng.random() < 0.5 for _ in range(9)]) for i in range(50)]
    df = spark.createDataFrame(made, "o long, ids array<int>, mask array<boolean>").repartition(5)
    path = f"{tmp_path}/rows"
    said = token_rows.write(df, path, 9, ["o"])
    assert said["rows"] == 50 and os.listdir(tmp_path) == ["rows"]
    whole = b"".join(open(f"{path}/{p['name']}.tokens.bin", "rb").read() for p in said["parts"])
    assert whole == b"".join(t.to_bytes(2, "little") for _, ids, _ in made for t in ids)
    back = token_rows.read(spark, path, split)
    assert [(r["row"], r["ids"], r["mask"]) for r in back.orderBy("row").collect()] == made
    assert token_rows.verify(spark, path) == said
    with pytest.raises(Exception, match="not empty"):
        token_rows.write(df, path, 9, ["o"])


def test_damaged_token_rows_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, [i, 1, 2], [True, False, True]) for i in range(20)], "o long, ids array<int>, mask array<boolean>")
    for name, bad in (("wide", F.array(F.lit(1))), ("large", F.array(F.lit(1), F.lit(65536), F.lit(2))), ("null", F.lit(None).cast("array<int>"))):
        with pytest.raises(Exception, match="3 ids|16 bits"):
            token_rows.write(df.withColumn("ids", F.when(F.col("o") == 7, bad).otherwise(F.col("ids"))), f"{tmp_path}/{name}", 3, ["o"])
    assert os.listdir(tmp_path) == []
    said = token_rows.write(df, f"{tmp_path}/rows", 3, ["o"])
    file = f"{tmp_path}/rows/{said['parts'][0]['name']}.tokens.bin"
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-1] + bytes([data[-1] ^ 1]))
    assert token_rows.read(spark, f"{tmp_path}/rows").count() == 20
    with pytest.raises(token_rows.Damaged, match="digests"):
        token_rows.verify(spark, f"{tmp_path}/rows")
    open(file, "wb").write(data + b"x")
    with pytest.raises(Exception, match="bytes"):
        token_rows.read(spark, f"{tmp_path}/rows").count()
    os.remove(f"{tmp_path}/rows/metadata.json")
    with pytest.raises(token_rows.Damaged, match="metadata"):
        token_rows.verify(spark, f"{tmp_path}/rows")
    empty = token_rows.write(df.limit(0), f"{tmp_path}/empty", 3, ["o"])
    assert empty["rows"] == 0 and token_rows.read(spark, f"{tmp_path}/empty").count() == 0


def _plain_scan(data, start, target, most):
    """One line after another, as a reader that opens the bytes at ``start``."""
    at = 0 if start == 0 else data.index(b"\n", start) + 1
    seen, total, found = set(), 0, []
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line, here, at = data[at:end], at, end + 1
        try:
            value = json.loads(line)
        except ValueError:
            found.append((here, "invalid_json"))
            continue
        one, other = (value.get("q"), value.get("a")) if isinstance(value, dict) else (None, None)
        if not isinstance(one, str) or not isinstance(other, str):
            reason = "invalid_record"
        elif not (one := one.strip(" ")) or not (other := other.strip(" ")):
            reason = "empty_text"
        elif one.lower() == other.lower():
            reason = "copied_answer"
        elif len(one.split()) > most:
            reason = "over_context"
        elif (one, other) in seen:
            reason = "exact_duplicate"
        else:
            seen.add((one, other))
            total += len(one) + len(other)
            found.append((here, None))
            if total >= target:
                return found
            continue
        found.append((here, reason))
    return None


@pytest.mark.parametrize("block", ["64b", "1k", "128m"])
def test_scan_equals_a_plain_reader(spark, tmp_path, block):
    rng = random.Random(7)
    lines = []
    for _ in range(400):
        q, a = (" ".join(rng.choices(["aé", "b", "c", ""], k=rng.randrange(0, 5))) for _ in range(2))
        lines.append(rng.choice([json.dumps({"q": q, "a": a}), json.dumps({"q": q, "a": a}, ensure_ascii=False), json.dumps({"a": a, "q": "X" + a}), '{"q": "x', "[]", "3", "", json.dumps({"q": q, "a": 4}), json.dumps({"q": "Bb", "a": "bB"})]))
    data = "\n".join(lines).encode()  # the last line has no end
    cuts = sorted(rng.sample([i + 1 for i, c in enumerate(data) if c == 10], 3))
    os.makedirs(f"{tmp_path}/f")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
        open(f"{tmp_path}/f/part-{i}.json", "wb").write(data[a:b])
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        files = scan.file_sizes(spark, f"{tmp_path}/f")
        assert sum(n for _, n in files) == len(data)
        starts = [r["start"] for r in scan.lines_at(spark, files).orderBy("start").collect()]
        assert starts == [0, *(i + 1 for i, c in enumerate(data) if c == 10)]
        size = F.length("one") + F.length("other")
        for seed, target in (("s1", 60), ("s2", 150)):
            start = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big") % len(data)
            want = _plain_scan(data, start, target, 3)
            if want is None:
                with pytest.raises(ValueError, match="ends before"):
                    scan.scan(spark, f"{tmp_path}/f", seed, target, "q", "a", 3, size)
                continue
            got = scan.scan(spark, f"{tmp_path}/f", seed, target, "q", "a", 3, size)
            assert sorted((r["start"], r["reason"]) for r in got.collect()) == want
            assert sum(r["n"] for r in scan.reason_counts(got).collect()) == len(want)
        with pytest.raises(ValueError, match="ends before"):
            scan.scan(spark, f"{tmp_path}/f", "s1", 10**6, "q", "a", 3, size)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_start_at_a_line_drops_it(spark):
    lines = spark.createDataFrame([(0, "a"), (2, "b"), (4, "c")], "start long, line string")
    assert [r["start"] for r in scan.after(lines, 2).collect()] == [4] and scan.after(lines, 0).count() == 3


def test_a_sample_short_of_its_size_is_an_error(spark):
    rows = spark.range(30).select("id", F.lit(3).alias("n"))
    assert scan.sample(rows, "id", "s", 30, F.col("n"), 2).count() == 30
    with pytest.raises(ValueError, match="30 rows of 31"):
        scan.sample(rows, "id", "s", 31, F.col("n"), 2)
