"""The Merkle manifest against a plain tree."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, node string, tree int"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 63, 64, 65, 200, 513])
def test_paths_of_a_block(n):
    leaves = [mm.hashed(str(i)) for i in range(n)]
    for levels in (mm.height(n), mm.height(n) + 2):
        root = mm.block_root(leaves, levels)
        walk = mm.Traversal(leaves, levels)
        held = 0
        for leaf, steps in zip(leaves, walk, strict=True):
            assert mm.folded(leaf, steps) == root
            held = max(held, max((sum(map(len, t.rows)) for t in [*walk.existing, *walk.desired]), default=0))
        assert held <= 2 ** (mm.LAYER + 1)


def plain(rows):
    """Root, and each row's (leaf, subroot, siblings)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: mm.hashed("".join(map(field, (r[0], r[1], r[2], r[3], r[4]))))

    def tree(nodes):
        paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            for i in range(len(nodes)):
                if i ^ 1 < len(nodes):
                    for k in spans[i]:
                        paths[k].append(nodes[i ^ 1])
            nodes = [mm.hashed(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            spans = [sum(spans[i : i + 2], []) for i in range(0, len(spans), 2)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in names}
    root, tops = tree([made[g][0] for g in names])
    found = []
    for g, top in zip(names, tops, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), made[g][1], strict=True):
            found.append((r[0], leaf(r), made[g][0], root, path + top))
    return found


def test_manifest_equals_a_plain_tree(spark):
    rng = random.Random(5)
    langs = ["en", "ß", "", None, "a"]
    rows = [(i, rng.choice(["s", None]), "en" if i % 3 else rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "é" * i]), "x", 1) for i in range(150)]
    rows += [(7, None, "en", 1, "again", "x", 1), (7, None, "en", 1, "again", "x", 1), (None, "s", None, 2, "no id", "x", 1), (2**62 + 1, "s", "en", 0, "big", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mm.manifest(docs, block=3).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [s[1:] for s in r["proof"] if s != "."]) for r in got), key=key)
    assert got == sorted(plain(rows), key=key)
    seen = F.when(F.col("doc_id") == 5, F.lit("other")).otherwise(mm.leaf_hash())
    checked = mm.audit(docs, seen, block=2).collect()
    assert {r["doc_id"] for r in checked if not r["verified"]} == {5} and all(r["verified"] == (r["folded_root"] == r["root"]) for r in checked)


@pytest.mark.parametrize("rows", [[], [(3, None, None, None, None, "x", 1)]], ids=["none", "one"])
def test_small_tables(spark, rows):
    got = mm.audit(spark.createDataFrame(rows, SCHEMA), mm.leaf_hash()).collect()
    assert len(got) == len(rows) and all(r["verified"] and r["root"] == r["subroot"] == r["leaf"] and r["proof_sha256"] == mm.hashed() for r in got)
