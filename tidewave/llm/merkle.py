"""A Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups, and every row's authentication path.

Rows are numbered within their group by one sort over all of them, and blocks of 16^3 consecutive rows are aligned with the tree. A block is traversed leaf by leaf:
beside the runs of siblings that stand on the present leaf's path, a treehash stack for each level hashes the run that comes next, one leaf at each step, so that it is
ready when the traversal gets there; besides its leaves, a block needs a few runs for each level. The blocks' roots are leaves of the next
tier, whose blocks are traversed alike; the paths of a tier's nodes are shared by all that lies below and appended there. See "Merkle Tree
Traversal in Log Space and Time" (Szydlo, 2004).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewave.llm.store import byte_batches, counted, discard, keyed_join, written

#: Nodes that are hashed into one, as a power of two, and levels of a block.
BITS, LEVELS = 4, 3
#: Leaves whose paths are sent on together.
ROWS = 256
_PATH = "array<struct<left:string,right:string>>"


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Hashes leaves into nodes of some height as they come: of each level below it holds the nodes of one run, which become a node once they are complete."""

    def __init__(self, height: int):
        self.levels: list[list[str]] = [[] for _ in range(height)]
        self.nodes: list[str] = []
        self.height = height

    def _add(self, node: str, level: int) -> list[tuple[int, str]]:
        """Nodes that are made: (level, node), the given one first."""
        made = [(level, node)]
        while level < self.height:
            run = self.levels[level]
            run.append(node)
            if len(run) < 1 << BITS:
                return made
            level, node = level + 1, _hash(run)
            run.clear()
            made.append((level, node))
        self.nodes.append(node)
        return made

    def push(self, leaf: str) -> list[tuple[int, str]]:
        return self._add(leaf, 0)

    def end(self) -> list[tuple[int, str]]:
        """Nodes of the last runs, which may be shorter."""
        made = []
        for level in range(self.height):
            if self.levels[level]:
                run, self.levels[level] = self.levels[level], []
                made += self._add(_hash(run), level + 1)
        return made


def block_root(leaves: list[str], levels: int) -> str:
    stack = Treehash(levels)
    for leaf in leaves:
        stack.push(leaf)
    stack.end()
    return stack.nodes[0]


def traversed(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn: for each level the hex digests left and right of the path's node in its run."""
    runs: list[list[str]] = [[] for _ in range(levels + 1)]
    stack = Treehash(levels)
    for leaf in [*leaves, None]:
        for level, node in stack.end() if leaf is None else stack.push(leaf):
            if len(runs[level]) < 1 << BITS:
                runs[level].append(node)
    ahead = [Treehash(level) for level in range(levels - 1)]  # the last level has one run
    path = [("", "")] * levels
    for i in range(len(leaves)):
        for level in range(levels):
            if i & (1 << BITS * level) - 1 == 0:
                place = i >> BITS * level & (1 << BITS) - 1
                path[level] = "".join(runs[level][:place]), "".join(runs[level][place + 1 :])
        yield list(path)
        for level, next_ in enumerate(ahead):
            span = 1 << BITS * (level + 1)
            if i + span < len(leaves):
                next_.push(leaves[i + span])
            if (i + 1) % span == 0:
                next_.end()
                runs[level], ahead[level] = next_.nodes, Treehash(level)


def row_hash(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of columns: of each `-` if it is null, else its number of bytes as text, a colon, and the text."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def path_hash(path: Column) -> Column:
    """SHA-256 (lowercase hex) of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with index (from 0, in order within the group) and n (the group's rows): all are sorted by ranges, and each range's rows counted by group."""
    part = F.shiftright("_at", 33).alias("_part")  # the number of the range
    placed = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts, some = counted(counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n")))
    found = keyed_join(placed.withColumn("_part", part), starts, [group, "_part"], "inner", some)
    return found.withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _levels(n: int) -> int:
    """Levels of a block of a tree of n nodes."""
    return min(LEVELS, -(-(n - 1).bit_length() // BITS))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(key, block, n, root, items) for each block of nodes (key, index, n, digest, own): its root, and its nodes in any order."""
    place = F.shiftright("index", BITS * LEVELS).alias("block")
    gathered = nodes.groupBy("key", place).agg(F.first("n").alias("n"), F.collect_list(F.struct("index", "digest", "own")).alias("items"))
    schema = StructType([*gathered.schema.fields, StructField("root", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for k, n in enumerate(batch.column("n").to_pylist()):
                roots.append(block_root(_ordered(batch.column("items")[k].values).field("digest").to_pylist(), _levels(n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    return written(gathered.mapInArrow(run, schema))


def _ordered(items: pa.StructArray) -> pa.StructArray:
    return items.take(pa.array(np.argsort(np.asarray(items.field("index")), kind="stable")))


def _walked(blocks: DataFrame, roots: list[str]) -> DataFrame:
    """(key, index, digest, own, path, roots) of each node of blocks (key, n, items, upper, roots): the path in its block, then what stands above that."""
    struct = blocks.schema["items"].dataType.elementType
    schema = f"key string, index long, digest string, own {struct['own'].dataType.simpleString()}, path {_PATH}, " + ", ".join(f"{x} string" for x in roots)
    sides = pa.struct([("left", pa.string()), ("right", pa.string())])

    def emitted(block: dict, items: pa.StructArray, paths: list[list[tuple[str, str]]]) -> pa.RecordBatch:
        flat, ends = [x for path in paths for x in path], np.append(0, np.cumsum([len(path) for path in paths])).astype(np.int32)
        both = pa.StructArray.from_arrays([pa.array([x[side] for x in flat], pa.string()) for side in (0, 1)], fields=list(sides))
        columns = {x: pa.repeat(block[x], len(items)) for x in ["key", *roots]} | {x: items.field(x) for x in ("index", "digest", "own")} | {"path": pa.ListArray.from_arrays(pa.array(ends), both)}
        names = ["key", "index", "digest", "own", "path", *roots]
        return pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = {x: batch.column(x)[k] for x in ["key", *roots]}
                items, upper, paths = _ordered(batch.column("items")[k].values), [(x["left"], x["right"]) for x in batch.column("upper")[k].as_py()], []
                for i, path in enumerate(traversed(items.field("digest").to_pylist(), _levels(batch.column("n")[k].as_py())), 1):
                    paths.append(path + upper)
                    if len(paths) == ROWS or i == len(items):
                        yield emitted(block, items.slice(i - len(paths), len(paths)), paths)
                        paths = []

    return blocks.select("key", "n", "items", "upper", *roots).mapInArrow(run, schema)


def _above(blocks: DataFrame) -> DataFrame:
    """(key, block, upper, root): of each block of a tree, the path from its root to the tree's, and that."""
    span = 1 << BITS * LEVELS
    alone = blocks.filter(F.col("n") <= span).select("key", "block", F.array().cast(_PATH).alias("upper"), "root")
    more = blocks.filter(F.col("n") > span)
    if more.isEmpty():
        return alone
    nodes = more.select("key", F.col("block").alias("index"), F.ceil(F.col("n") / span).cast("long").alias("n"), F.col("root").alias("digest"), F.lit(0).alias("own"))
    return alone.union(_paths(nodes).select("key", F.col("index").alias("block"), F.col("path").alias("upper"), "root"))


def _paths(nodes: DataFrame) -> DataFrame:
    """(key, index, digest, own, path, root) of nodes (key, index, n, digest, own) of trees of n nodes."""
    blocks = _blocks(nodes)
    return _walked(_joined(blocks.drop("root"), _above(blocks)), ["root"])


def _joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """blocks with what stands above them, which is sent to all tasks only if it is a few megabytes."""
    above, some = counted(above)
    return blocks.join(F.broadcast(above) if some <= 1_000 else above, ["key", "block"])


def manifest(rows: DataFrame, leaf: str, group: str, order: str) -> DataFrame:
    """rows with subroot, root and path: for each row the root of its group's tree, that of the tree over all groups, and for each level, from the row's leaf up, the hex
    digests of its siblings left and right of it. Columns of these names are replaced; all others stay.

    Nodes are hex digests; while several remain, every 16 consecutive ones (the last run: fewer, even one) become the SHA-256 of their texts. A
    group's leaves ascend by order, null first, and those of equal order by digest, so that repeated rows give one tree in every run; a lone leaf is its own root. Groups ascend
    by the UTF-8 bytes of their text, null first; their roots are the leaves of the last tree. No rows give none. Leaves must not be null.
    """
    byte_batches(rows.sparkSession)
    rows = rows.drop("subroot", "root", "path")
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # sorts as the group does
    leaves = written(rows.select(key.alias("key"), F.col(order).alias("_order"), F.col(leaf).alias("digest"), F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("own")))
    blocks = _blocks(numbered(leaves, "key", ["_order", "digest", "_row"]))
    above = written(_above(blocks))
    discard(leaves)
    groups = above.groupBy("key").agg(F.first("root").alias("digest")).withColumn("all", F.lit(""))
    top = _paths(numbered(groups, "all", ["key"]).select(F.col("all").alias("key"), "index", "n", "digest", F.col("key").alias("own")))
    ends = top.select(F.col("own").alias("key"), F.col("digest").alias("subroot"), F.col("path").alias("_top"), "root")
    upper = above.select("key", "block", "upper").join(ends, "key").select("key", "block", F.concat("upper", "_top").alias("upper"), "subroot", "root")
    return _walked(_joined(blocks.drop("root"), upper), ["subroot", "root"]).select("own.*", "subroot", "root", "path")
