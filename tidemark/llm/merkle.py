"""Merkle manifest of a table: one tree for each group of rows and one over the groups' roots.

Three consecutive nodes become one; a last run may be shorter, even one node. Only every ``LEVELS``-th level is stored.
Nodes that share a stored ancestor form an aligned subtree of at most 3 ** LEVELS nodes: whatever lies between two
stored levels is computed again from the lower one where it is needed, and forgotten. Proofs come from the top down:
a stored node's path to the root is what its own subtree adds, followed by the path of its stored ancestor. So a proof reads
one row a stored level, a leaf's subtree is one small group, and neither a large group nor a level ever meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.common import ship, stored

ARITY = 3
LEVELS = 4  # levels from one stored level to the next: subtrees of 81 nodes


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hash of the values in turn, each as its UTF-8 byte count, a colon and itself; null is a dash."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return found


def path(tree: list[list[str]], place: int) -> list[str]:
    """For each level but the last: the place in the run (0 to 2) followed by the siblings, from left to right."""
    steps = []
    for level in tree[:-1]:
        first = place - place % ARITY
        run = level[first:first + ARITY]
        steps.append(str(place - first) + "".join(run[:place - first] + run[place - first + 1:]))
        place //= ARITY
    return steps


def siblings(steps: list[str]) -> str:
    return "".join(s[1:] for s in steps)


def fold(node: str, steps: list[str]) -> str:
    """The root that a node and its path give."""
    for step in steps:
        before = 1 + 64 * int(step[0])
        node = digest([step[1:before], node, step[before:]])
    return node


def placed(spark: SparkSession, rows: DataFrame, tree: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``place``, from 0, in their tree; (tree, n, height)), without a window over a whole tree.

    Rows are sorted in ranges of (tree, order); places inside a range are counted as the rows stream by, and only the
    number of rows of each tree in each range is summed up. Rows equal in all of ``order`` must be interchangeable, and
    names of trees not null.
    """
    at = rows.columns.index(tree)

    def number(batches):
        last, n = None, 0
        for batch in batches:
            places = []
            for name in batch.column(at).to_pylist():
                n = n + 1 if name == last else 0
                last = name
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_place"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    ranges = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(number, f"{kinds}, _place long")
    ranges = stored(spark, ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    counted = ranges.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # A row for each range that a tree reaches, so as many as there are ranges at most.
    before = F.sum("_n").over(W.partitionBy(tree).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counted.select(tree, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    found = ranges.join(starts, [tree, "_range"]).select(*rows.columns, (F.col("_place") + F.col("_start")).alias("place"))
    sizes = counted.groupBy(tree).agg(F.sum("_n").alias("n")).withColumn("height", _height(F.col("n")))
    return stored(spark, found, "placed"), stored(spark, sizes, "sizes")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: the least h with 3 ** h >= n."""
    steps = F.sequence(F.lit(1), F.lit(40))
    return F.aggregate(steps, F.lit(0), lambda h, k: F.when(F.pow(F.lit(float(ARITY)), k - 1) < n.cast("double"), k).otherwise(h))


def _parents(batches):
    for batch in batches:
        names, blocks, ups, groups = (c.to_pylist() for c in batch.columns)
        tops = [climb([r["node"] for r in rows], up)[-1][0] for up, rows in zip(ups, groups)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(tops, pa.string())], ["tree", "place", "node"])


def _paths(batches):
    for batch in batches:
        for name, up, rows, end in zip(*(c.to_pylist() for c in batch.columns)):
            tree = climb([r["node"] for r in rows], up)
            first = rows[0]["place"]
            steps = [path(tree, r["place"] - first) + end for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), pa.array([r["place"] for r in rows], pa.int64()), pa.array(steps, pa.list_(pa.string()))],
                ["tree", "place", "steps"])


class Forest:
    """Trees over stored leaves (tree, place, node, ...), of which every ``LEVELS``-th level is stored.

    ``sizes`` has (tree, n, height) of every tree. A tree of one leaf is that leaf.
    """

    def __init__(self, spark: SparkSession, leaves: DataFrame, sizes: DataFrame):
        self.spark, self.sizes, self.levels = spark, sizes, [leaves]
        tallest = sizes.agg(F.max("height")).first()[0] or 0
        for _ in range(0, tallest, LEVELS):
            above = self._subtrees(len(self.levels) - 1).filter("up > 0").select("tree", "block", "up", "rows")
            self.levels.append(stored(spark, above.mapInArrow(_parents, "tree string, place long, node string"), "level"))

    def _subtrees(self, k: int, columns: Sequence[str] = ("node",)) -> DataFrame:
        """Aligned subtrees over stored level k: (tree, block, up, rows), up being the levels to the stored ancestor."""
        up = F.least(F.lit(LEVELS), F.col("height") - k * LEVELS)
        return (self.levels[k].join(self.sizes, "tree").withColumn("block", F.floor(F.col("place") / ARITY ** LEVELS))
                .groupBy("tree", "block").agg(F.first(up).alias("up"), F.array_sort(F.collect_list(F.struct("place", *columns))).alias("rows")))

    def _tops(self, k: int) -> DataFrame:
        """The trees whose root is on stored level k."""
        return self.sizes.filter(F.ceil(F.col("height") / LEVELS) == k).select("tree")

    def roots(self) -> DataFrame:
        """(tree, node): the root of each tree."""
        found = [nodes.select("tree", "node").join(self._tops(k), "tree", "left_semi") for k, nodes in enumerate(self.levels)]
        whole = found[0]
        for more in found[1:]:
            whole = whole.union(more)
        return whole

    def leaf_subtrees(self, ends: DataFrame, columns: Sequence[str] = ("node",)) -> DataFrame:
        """(tree, up, rows, steps) of the lowest subtrees; steps lead from their ancestor to the root and through ``ends`` (tree, steps)."""
        place = F.lit(0).cast("long").alias("place")
        paths = None
        for k in range(len(self.levels) - 1, 0, -1):
            here = self._tops(k).join(ends, "tree").select("tree", place, "steps")
            if paths is not None:
                below = self._subtrees(k).filter("up > 0").join(paths.withColumnRenamed("place", "block"), ["tree", "block"])
                here = here.union(below.select("tree", "up", "rows", "steps").mapInArrow(_paths, "tree string, place long, steps array<string>"))
            paths = stored(self.spark, here, "paths")
        lone = self._tops(0).join(ends, "tree").select("tree", place, "steps")
        paths = lone if paths is None else paths.union(lone)
        return self._subtrees(0, columns).join(paths.withColumnRenamed("place", "block"), ["tree", "block"]).select("tree", "up", "rows", "steps")


def _proved(batches):
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for up, rows, end, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
            tree = climb([r["node"] for r in rows], up)
            first = rows[0]["place"]
            for r in rows:
                steps = path(tree, r["place"] - first) + end
                seen = fold(r["seen"] or r["node"], steps)
                for column, value in zip(out, (r["doc_id"], r["node"], subroot, root, siblings(steps), seen)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], names)


def prove_documents(spark: SparkSession, docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof (digests of its siblings, from leaf to root), folded_root, verified.

    A leaf hashes doc_id, source, lang, n_chars and text. Leaves of a source ascend by doc_id, null first, then by their
    digest, so repeated doc_ids have a fixed place; equal rows have equal leaves. Sources ascend by their bytes, null first.
    ``seen_text`` is the text a reader holds (by default the recorded one): ``folded_root`` follows from it and the recorded
    siblings, and ``verified`` says whether that is the root. A lone document's proof is empty, and a lone source adds nothing to it.
    Null and empty texts differ. Other columns are not read. An empty table gives an empty one.
    """
    ship(spark)
    text = F.col("text").cast("string")
    fields = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    seen = text if seen_text is None else seen_text
    # Named so that a null source comes first: "-" sorts before ":".
    name = F.when(fields[1].isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), fields[1]))
    leaves = docs.select(name.alias("tree"), fields[0].alias("doc_id"), leaf_digest([*fields, text]).alias("node"),
                         F.when(~seen.eqNullSafe(text), leaf_digest([*fields, seen])).alias("seen"))
    rows, sizes = placed(spark, stored(spark, leaves, "leaves"), "tree", ["doc_id", "node", "seen"])
    forest = Forest(spark, rows, sizes)
    subroots = stored(spark, forest.roots(), "subroots")

    # The tree over the sources; its one name is a column, as a literal would turn joins into products.
    whole = F.substring("tree", 1, 0)
    tops, size = placed(spark, subroots.select(whole.alias("tree"), F.col("tree").alias("source"), "node"), "tree", ["source"])
    top = Forest(spark, tops, size)
    start = size.select("tree", F.expr("cast(array() as array<string>)").alias("steps"))
    paths = top.leaf_subtrees(start).mapInArrow(_paths, "tree string, place long, steps array<string>")
    root = top.roots().withColumnRenamed("node", "root")
    ends = (tops.withColumnRenamed("node", "subroot").join(paths, ["tree", "place"]).join(root, "tree")
            .select(F.col("source").alias("tree"), "steps", "subroot", "root"))
    ends = stored(spark, ends, "ends")

    below = forest.leaf_subtrees(ends.select("tree", "steps"), ("node", "doc_id", "seen"))
    found = below.join(ends.select("tree", "subroot", "root"), "tree").select("up", "rows", "steps", "subroot", "root").mapInArrow(
        _proved, "doc_id long, leaf string, subroot string, root string, proof string, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
