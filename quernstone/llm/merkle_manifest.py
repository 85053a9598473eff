"""A Merkle manifest of a dataset, its authentication paths made by fractal traversal.

Each row is a leaf. The leaves of a group (a language), by id, make a tree: every
two consecutive nodes become one, a last one alone becomes the hash of itself. The
roots of the groups, by name, make the tree above in the same way. Leaves get their
places by ranges: counts by range are summed, and rows are numbered within one.

Trees are cut into aligned blocks of ``2 ** BLOCK`` nodes. Upwards, a block is one
row of the next level, so a level is smaller by that factor and few levels are
needed whatever the corpus. Downwards, ``Traversal`` walks a block from left to
right. For each of the block's stacked layers it keeps an existing subtree, from
which the current path is read, and a desired one, the next to the right, which
grows by one leaf a step: so a path costs a constant number of hashes, and beside
the block's leaves only two subtrees a layer are held. The path above the block,
which all its leaves share, comes from the walk of the level above and is appended.

Defined results: a null field is hashed as ``-``. Rows are ordered by id (null
first), then by their leaf, so rows that repeat an id each have a leaf of their own;
equal rows are interchangeable. An empty table has no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table

#: Levels of a block, and of a subtree within it.
BLOCK, LAYER = 12, 3
#: Rows a range holds about, and ranges at least.
RANGE_ROWS, RANGES = 50_000, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- hashing and paths of one block ---------------------------------------------


def hashed(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def folded(node: str, steps: list[str]) -> str:
    """The root that a node and its path give. A step is ``<`` and the sibling on the
    left, ``>`` and the one on the right, or ``.`` where there is none."""
    for step in steps:
        node = hashed(step[1:], node) if step[0] == "<" else hashed(node, step[1:])
    return node


def block_root(leaves: list[str], levels: int) -> str:
    for _ in range(levels):
        leaves = [hashed(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0]


class Subtree:
    """The nodes of heights ``low`` to ``low + LAYER - 1`` over a run of leaves fed one by
    one. Below ``low`` only one waiting node a height is kept."""

    def __init__(self, low: int) -> None:
        self.low, self.top, self.fed = low, low + LAYER, 0
        self.rows: list[list[str]] = [[] for _ in range(LAYER)]
        self.waiting: list[str | None] = [None] * self.top

    def _raise(self, node: str, at: int) -> None:
        """Puts a node at a height; a right one joins the left one that waits there."""
        while at < self.top:
            if at >= self.low:
                self.rows[at - self.low].append(node)
            left, self.waiting[at] = self.waiting[at], node
            if left is None:
                return
            self.waiting[at] = None
            node, at = hashed(left, node), at + 1

    def feed(self, leaf: str) -> None:
        self.fed += 1
        self._raise(leaf, 0)

    def close(self) -> Subtree:
        """No leaf follows: nodes that still wait are hashed alone."""
        for at in range(self.top - 1):
            alone, self.waiting[at] = self.waiting[at], None
            if alone is not None:
                self._raise(hashed(alone), at + 1)
        return self


class Traversal:
    """Successive authentication paths within a block."""

    def __init__(self, leaves: list[str], levels: int) -> None:
        self.leaves, self.levels = leaves, levels
        lows = range(0, levels, LAYER)
        self.existing = [self._grown(low, 0, 1 << (low + LAYER)) for low in lows]
        self.desired = [Subtree(low) for low in lows]

    def _grown(self, low: int, start: int, stop: int) -> Subtree:
        tree = Subtree(low)
        for leaf in self.leaves[start:stop]:
            tree.feed(leaf)
        return tree.close()

    def _steps(self, at: int) -> list[str]:
        found = []
        for r in range(self.levels):
            tree = self.existing[r // LAYER]
            row = tree.rows[r - tree.low]
            beside = (at >> r ^ 1) & ((1 << (tree.top - r)) - 1)
            found.append(("<" if at >> r & 1 else ">") + row[beside] if beside < len(row) else ".")
        return found

    def __iter__(self) -> Iterator[list[str]]:
        for at in range(len(self.leaves)):
            yield self._steps(at)
            for k, tree in enumerate(self.existing):
                width = 1 << tree.top
                if at + width < len(self.leaves):
                    self.desired[k].feed(self.leaves[at + width])
                if (at + 1) % width == 0:
                    self.existing[k], self.desired[k] = self.desired[k].close(), Subtree(tree.low)


# -- levels as tables -----------------------------------------------------------


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def placed(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """Adds ``i``, a row's place in its ``tree`` by ``order`` from 0, and ``n``, the tree's size."""
    parts = max(RANGES, n_rows // RANGE_ROWS)
    ranged = cut(rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    line = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("tree", "part", F.coalesce(F.sum("c").over(line), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(counts, ["tree", "part"]).withColumn("i", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("i", block))


def _block_rows(rows: pd.DataFrame, block: int) -> tuple[pd.DataFrame, list[str], int]:
    rows = rows.sort_values("i", kind="stable")
    return rows, list(rows["node"]), min(block, height(int(rows["n"].iloc[0])))


def _raised(nodes: DataFrame, block: int) -> DataFrame:
    """The next level: ``tree, i, n, node``, a row a block."""

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        _, leaves, levels = _block_rows(rows, block)
        blocks = (int(first["n"]) + (1 << block) - 1) >> block
        return pd.DataFrame({"tree": [first["tree"]], "i": [int(first["block"])], "n": [blocks], "node": [block_root(leaves, levels)]})

    needed = _blocked(nodes, block).select("tree", "i", "n", "node", "block")
    return needed.groupBy("tree", "block").applyInPandas(of_block, "tree string, i long, n long, node string")


def levels_of(nodes: DataFrame, largest: int, block: int) -> list[DataFrame]:
    """Levels from ``nodes`` to one node a tree; ``largest`` is the size of the largest tree."""
    found = [nodes]
    while largest > 1:
        found.append(cut(_raised(found[-1], block), "merkle-level"))
        largest = (largest + (1 << block) - 1) >> block
    return found


def _walked(nodes: DataFrame, above: DataFrame, of_path, columns: str, block: int) -> DataFrame:
    """Applies ``of_path(rows, paths, above)`` to each block, whose row of the level above
    (``tree, i, steps`` and what else there is) has the shared end of its paths."""

    def of_block(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows, leaves, levels = _block_rows(rows, block)
        shared = upper.iloc[0]
        rest = list(shared["steps"])
        return of_path(rows, (steps + rest for steps in Traversal(leaves, levels)), shared)

    keyed = above.withColumnRenamed("i", "block")
    return _blocked(nodes, block).groupBy("tree", "block").cogroup(keyed.groupBy("tree", "block")).applyInPandas(of_block, columns)


def _with_steps(rows: pd.DataFrame, paths: Iterator[list[str]], shared: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tree": rows["tree"], "i": rows["i"], "node": rows["node"], "steps": list(paths), "subroot": shared["subroot"], "root": shared["root"]})


def _checked(rows: pd.DataFrame, paths: Iterator[list[str]], shared: pd.Series) -> pd.DataFrame:
    out = rows[["doc_id", "node"]].rename(columns={"node": "leaf"})
    proofs, roots = [], []
    for steps, seen in zip(paths, rows["seen"], strict=True):
        proofs.append(hashed(*[s[1:] for s in steps]))
        roots.append(folded(seen, steps))
    return out.assign(subroot=shared["subroot"], root=shared["root"], proof_sha256=proofs, folded_root=roots, verified=[r == shared["root"] for r in roots])


def _listed(rows: pd.DataFrame, paths: Iterator[list[str]], shared: pd.Series) -> pd.DataFrame:
    return rows[["doc_id", "node"]].rename(columns={"node": "leaf"}).assign(proof=list(paths), subroot=shared["subroot"], root=shared["root"])


_STEPS = "tree string, i long, node string, steps array<string>, subroot string, root string"


def _manifest(docs: DataFrame, seen: Column, of_path, columns: str, block: int) -> DataFrame:
    """Leaves, levels and the walk down; ``seen`` is the leaf that is checked against the path."""
    # Names of trees: null sorts first, the others by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree")
    leaves = cut(docs.select("doc_id", tree, leaf_hash().alias("node"), seen.alias("seen")), "merkle-leaves")
    sizes = leaves.groupBy("tree").count()
    totals = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("trees")).first()
    nodes = placed(leaves, ["doc_id", "node", "seen"], totals["rows"])
    nodes = cut(nodes.withColumn("doc_id", F.col("doc_id").cast("string")), "merkle-nodes")
    levels = levels_of(nodes, totals["largest"], block)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    tops = levels_of(cut(placed(subroots, ["name"], totals["trees"]), "merkle-subroots"), totals["trees"], block)
    nothing = F.expr("cast(array() as array<string>)").alias("steps")
    above = tops[-1].select("tree", "i", nothing, F.lit("").alias("subroot"), F.col("node").alias("root"))
    for level in reversed(tops[:-1]):
        above = cut(_walked(level, above, _with_steps, _STEPS, block), "merkle-paths").select("tree", "i", "steps", "subroot", "root")
    named = tops[0].select(F.col("i").alias("at"), F.col("name").alias("tree"), F.col("node").alias("subroot"))
    above = above.drop("tree", "subroot").withColumnRenamed("i", "at").join(named, "at").select("tree", F.lit(0).cast("long").alias("i"), "steps", "subroot", "root")
    for level in reversed(levels[1:-1]):
        above = cut(_walked(level, above, _with_steps, _STEPS, block), "merkle-paths").select("tree", "i", "steps", "subroot", "root")
    return _walked(nodes, above, of_path, columns, block).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, leaf, proof, subroot, root``: every row's path, as ``folded`` reads it."""
    return _manifest(docs, leaf_hash(), _listed, "doc_id string, leaf string, proof array<string>, subroot string, root string", block)


def audit(docs: DataFrame, seen: Column, block: int = BLOCK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: whether the leaf
    ``seen``, on the path of the row it stands for, still gives the root."""
    return _manifest(docs, seen, _checked, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", block)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return audit(docs, F.when(chosen, leaf_hash(n_chars=more)).otherwise(leaf_hash()))


_H = "sha256(string_agg(h, '' ORDER BY i))"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


#: CRC-32 of a string: a table of 256 remainders, then a step a byte.
CRC_TABLE_SQL = """b0 AS (SELECT j, 0 AS k, j AS v FROM range(256) t(j)), b1 AS (SELECT j, v FROM (SELECT j, list_reduce([v] || range(8), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM b0) q),
 crc AS (SELECT list(v ORDER BY j) AS tab FROM b1)"""


def crc_sql(text: str) -> str:
    """An expression; ``tab`` of the table ``crc`` must be in scope."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP12_SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL},
 d AS (SELECT doc_id, lang, sha256({' || '.join(map(_field_sql, FIELDS))}) AS leaf,
   sha256({' || '.join(_field_sql('(n_chars + 1)' if c == 'n_chars' else c) for c in FIELDS)}) AS changed, {crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 AS chosen FROM documents, crc),
 p AS (SELECT *, CASE WHEN chosen THEN changed ELSE leaf END AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
 v AS (SELECT lang, i, n, 0 AS r, leaf AS h FROM p UNION ALL SELECT lang, i // 2, (n + 1) // 2, r + 1, {_H} FROM v WHERE n > 1 GROUP BY lang, i // 2, n, r),
 s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM v WHERE n = 1),
 t AS (SELECT i, n, 0 AS r, subroot AS h FROM s UNION ALL SELECT i // 2, (n + 1) // 2, r + 1, {_H} FROM t WHERE n > 1 GROUP BY i // 2, n, r),
 f AS (SELECT doc_id, leaf, lang, i, n, 0 AS r, seen AS h, '' AS proof FROM p UNION ALL
   SELECT doc_id, leaf, f.lang, f.i // 2, (f.n + 1) // 2, f.r + 1, sha256(CASE WHEN v.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN v.h || f.h ELSE f.h || v.h END), proof || coalesce(v.h, '')
   FROM f LEFT JOIN v ON v.lang IS NOT DISTINCT FROM f.lang AND v.r = f.r AND v.i = xor(f.i, 1) WHERE f.n > 1),
 g AS (SELECT doc_id, leaf, subroot, s.i, s.n, 0 AS r, h, proof FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1 UNION ALL
   SELECT doc_id, leaf, subroot, g.i // 2, (g.n + 1) // 2, g.r + 1, sha256(CASE WHEN t.h IS NULL THEN g.h WHEN g.i % 2 = 1 THEN t.h || g.h ELSE g.h || t.h END), proof || coalesce(t.h, '')
   FROM g LEFT JOIN t ON t.r = g.r AND t.i = xor(g.i, 1) WHERE g.n > 1)
 SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = t.h AS verified FROM g, t WHERE g.n = 1 AND t.n = 1"""
