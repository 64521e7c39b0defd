"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Each document's set of shingles is summed up by minwise tokens. In each of several independent trees a document chooses its path by the
tokens of coordinates selected for that tree; documents with the same path share a node. Nodes with few members are compared
exhaustively. Large nodes are first compared in blocks that share some pivots, which joins what is much alike; then a node in which
all but a few are joined compares those few with all, and any other branches by further tokens. A pair is looked at in the first small
node that it shares. Every link is confirmed on the full sets. Since the answer is a partition, members that are
joined already are not compared. See "Scalable and Robust Set Similarity Join" (Christiani, Pagh and Sivertsen, 2018).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewave.llm.blocks import whole_groups
from tidewave.llm.graph import components
from tidewave.llm.store import byte_batches, counted, discard, keyed_join, small_batches, written
from tidewave.llm.words import hashed, mix, randoms

#: Minwise tokens of a set. Each tree chooses its paths by LEVELS of its own; nodes below choose among all.
COORDINATES, LEVELS = 128, 2
#: A node is small, and compared exhaustively, with so many members at most, whose sets have so many shingles (or are few).
MEMBERS, SHINGLES, FEW = 2_048, 1 << 22, 16
#: Members of a large node that stand in each of its blocks.
PIVOTS = 8
#: Tokens that agree may be so many standard deviations fewer than the threshold says, before a pair is passed over.
DEVIATIONS = 5.5
#: After so many turns of likeliest pairs, those left are confirmed all at once.
TURNS = 4
#: Pairs whose tokens are compared at once.
TOKENS = 1 << 14
#: Shingles looked up at once; columns of a matrix at once; how many multiplications cost as much as a lookup; rows of a group that a matrix may have.
LOOKUPS, WIDTH, LOOKUP, SQUARE = 1 << 19, 2_048, 500, 4_096

_ODD, _PLACE = randoms(2, 12) | np.uint64(1), randoms(64, 13) | np.uint64(1)
_MUL, _ADD = (randoms(COORDINATES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (randoms(COORDINATES, 14) >> np.uint64(32)).astype(np.uint32)


def trees(threshold: float, recall: float) -> int:
    """How many trees find a pair at the threshold with probability recall, if it meets in a small node."""
    return min(COORDINATES // LEVELS, 32, math.ceil(math.log(1 - recall) / math.log(1 - threshold**LEVELS)))


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text in turn the sorted hashes of its distinct runs of so many words; of fewer words, that of the whole; of none, nothing."""
    for _, hashes, ends in hashed(texts):
        many = len(hashes) - words + 1
        runs = mix(sum(hashes[k : k + many] * _PLACE[k] for k in range(words))) if many > 0 else hashes[:0]
        for a, b in zip(ends[:-1], ends[1:]):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[32 + b - a : 33 + b - a])
            else:
                yield hashes[:0]


def signature(found: np.ndarray) -> np.ndarray:
    """COORDINATES tokens of 16 bits: each of the least value of a set under one hash."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    found = found.astype(np.uint32)
    for at in range(0, len(found), 1024):
        x = found[at : at + 1024, None] * _MUL
        x += _ADD
        np.minimum(low, x.min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(found).sum()), int(mix(found ^ _ODD[0]).sum())


def _digests(found: list[np.ndarray]) -> list[pa.Array]:
    k = np.array([digest(x) for x in found], np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array([len(x) for x in found], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, k1, k2, sig): the size of each document's set, a 128-bit digest of it, and its tokens (null if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingles(batch.column("text"), words))
            sig = pa.array([signature(x).tobytes() if len(x) else None for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_digests(found), sig], ["doc_id", "n", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary")


def sets(docs: DataFrame, wanted: DataFrame, rows: int, words: int) -> DataFrame:
    """(v, found) of the written classes wanted (v, doc_id, n, k1, k2), so many rows: the full sets, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingles(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_digests(found), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "n", "k1", "k2", "found"])

    texts = keyed_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted.select("doc_id").distinct(), ["doc_id"], "left_semi", rows)
    found = texts.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, found binary")
    return keyed_join(found, wanted, ["doc_id", "n", "k1", "k2"], "inner", rows).select("v", "found").dropDuplicates(["v"])


def _tokens(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(-1, COORDINATES)


def paths(classes: DataFrame, count: int) -> DataFrame:
    """(node, tree, v, n): each class's node of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = randoms(count, 15)
        for batch in batches:
            sig = _tokens(batch.column("sig")).astype(np.uint64)
            node = np.broadcast_to(salts, (len(sig), count))
            for level in range(LEVELS):
                node = mix(node * _ODD[1] + sig[:, level : LEVELS * count : LEVELS] + np.uint64(1))
            tree = np.tile(np.arange(count, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64).ravel()), pa.array(tree), *(pa.array(np.repeat(np.asarray(batch.column(c)), count)) for c in ("v", "n"))], ["node", "tree", "v", "n"])

    return classes.select("v", "n", "sig").mapInArrow(run, "node long, tree int, v long, n long")


def children(members: DataFrame, level: int) -> DataFrame:
    """(node, tree, v, n) a level below the nodes of members (node, v, n, sig): each goes on by the token of one coordinate, at every other node by
    that of a second one too. A pair that is alike thus has more than one child in common on average, and one that is less than 2/3 alike less than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, node = _tokens(batch.column("sig")), np.asarray(batch.column("node")).view(np.uint64)
            code = mix(node + np.uint64(level))
            at, second = np.arange(len(node)), np.flatnonzero(code >> np.uint64(63))
            at, salt = np.append(at, second), np.append(np.zeros(len(at), np.uint64), np.ones(len(second), np.uint64))
            where = (mix(code[at] + salt) % np.uint64(COORDINATES)).astype(np.int64)
            below = mix(mix(code[at] + salt) + sig[at, where].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), *(batch.column(c).take(pa.array(at)) for c in ("tree", "v", "n"))], ["node", "tree", "v", "n"])

    return members.select("node", "tree", "v", "n", "sig").mapInArrow(run, "node long, tree int, v long, n long")


def shared(nodes: DataFrame) -> DataFrame:
    """(node, tree, v, n, blocks) of the nodes that have two members or more; blocks: how many a large node is dealt into, else null."""
    size = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).filter("m > 1")
    large = (F.col("m") > MEMBERS) | ((F.col("shingles") > SHINGLES) & (F.col("m") > FEW))
    blocks = F.when(large, F.ceil(F.greatest(2 * F.col("m") / MEMBERS, 2 * F.col("shingles") / SHINGLES)).cast("int"))
    return nodes.join(size.select("node", blocks.alias("blocks")), "node")


def _groups(table: pa.Table, cuts: np.ndarray, floor: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, agree): rows of one group that may be alike, are not joined yet and have not met in a small node of an earlier tree."""
    sig = _tokens(table.column("sig"))
    n, tree, label, met = (np.asarray(table.column(c)) for c in ("n", "tree", "label", "met"))
    last = np.repeat(cuts[1:], np.diff(cuts)) - 1
    at, d = np.flatnonzero(last > np.arange(len(last))), 0
    count = trees_of(met)
    while len(at):
        d += 1
        at = at[at + d <= last[at]]
        apart = at[(label[at] != label[at + d]) & (np.minimum(n[at], n[at + d]) >= threshold * np.maximum(n[at], n[at + d]) * (1 - 1e-9))]
        for a in np.array_split(apart, len(apart) // TOKENS + 1):
            same = sig[a] == sig[a + d]
            agree = np.count_nonzero(same, axis=1)
            keep = np.flatnonzero(agree >= floor)
            if len(keep) and count:
                both = same[keep, : LEVELS * count].reshape(-1, count, LEVELS).all(axis=2)
                small = (met[a[keep], None] >> np.arange(count)) & 1 == 1
                keep = keep[~(both & small & (np.arange(count) < tree[a[keep], None])).any(axis=1)]
            if len(keep):
                yield a[keep], a[keep] + d, agree[keep]


def trees_of(met: np.ndarray) -> int:
    """Trees that any of the masks has."""
    return int(np.bitwise_or.reduce(met)).bit_length() if len(met) else 0


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining those of a with those of b: the least place of each component."""
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def links(rows: DataFrame, found: Callable[[DataFrame, int], DataFrame], threshold: float) -> DataFrame:
    """(a, b), written: links that join what is alike in each block of rows (node, block, tree, v, n, sig, label, met).

    A first pass over the tokens finds the rows that have anything to compare; only theirs are the full sets that found(ids, rows) gives,
    and moved to the block.
    """
    floor = COORDINATES * threshold - DEVIATIONS * math.sqrt(COORDINATES * threshold * (1 - threshold))
    percent = round(100 * threshold)

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["node", "block"]):
            some = np.zeros(len(table), bool)
            for a, b, _ in _groups(table, cuts, floor, threshold):
                some[a] = some[b] = True
            table = table.filter(pa.array(some)).combine_chunks()
            yield from table.to_batches()
            del table

    def linked(table: pa.Table, cuts: np.ndarray) -> list[pa.Array]:
        v, full = np.asarray(table.column("v")), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("found").chunk(0)] if len(table) else []
        pairs = [np.concatenate(x) for x in zip(*_groups(table, cuts, floor, threshold))]
        out_a, out_b = [], []
        if pairs:
            _, label = np.unique(np.stack([np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.asarray(table.column("label"))]), axis=1, return_inverse=True)
            first = np.full(label.max() + 1, len(table))
            np.minimum.at(first, label.ravel(), np.arange(len(table)))
            label = first[label.ravel()]
            order = np.argsort(-pairs[2], kind="stable")
            a, b, turn = pairs[0][order], pairs[1][order], 0
            while len(a):
                if turn == TURNS:  # what is left is mostly not alike: all of it at once
                    true = alike_by_group(full, a, b, cuts, percent)
                    a, b = a[true], b[true]
                # the likeliest pair that each row has left
                pick = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
                true = np.array([turn >= TURNS or _alike(full[i], full[j], percent) for i, j in zip(a[pick], b[pick])], bool)
                turn += 1
                x, y = a[pick][true], b[pick][true]
                out_a.append(v[x])
                out_b.append(v[y])
                label = _joined(label, x, y)
                left = label[a] != label[b]
                left[pick] = False
                a, b = a[left], b[left]
        return [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (out_a, out_b)]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["node", "block"]):
            ends = linked(table, cuts)
            del table  # before the next one is gathered
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    kind = rows.select("node", "block", "tree", "v", "n", "sig", "label", "met").schema
    placed = rows.select(*kind.names).repartition("node", "block").sortWithinPartitions("node", "block", "v")
    some, count = counted(placed.mapInArrow(open_rows, kind))
    full = some.join(found(some.select("v").distinct(), count), "v")
    out = written(full.repartition("node", "block").sortWithinPartitions("node", "block", "v").mapInArrow(confirm, "a long, b long"))
    discard(some)
    return out


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if len(x) < len(y):
        x, y = y, x
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int(np.count_nonzero(x[at] == y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def alike_by_group(full: list[np.ndarray], a: np.ndarray, b: np.ndarray, cuts: np.ndarray, percent: int) -> np.ndarray:
    """_alike of many pairs of rows, each within a group; those of a group are counted by a product of matrices, if that is less work than lookups."""
    group, out = np.searchsorted(cuts, a, side="right") - 1, np.zeros(len(a), bool)
    order = np.argsort(group, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(a) else []:
        rows, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        x, y, sets = *np.split(place.ravel(), 2), [full[i] for i in rows]
        size = np.array([len(s) for s in sets])
        _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shingle = shingle.astype(np.int32)
        square = len(rows) <= SQUARE and len(rows) ** 2 * np.count_nonzero(times > 1) <= LOOKUP * np.minimum(size[x], size[y]).sum()
        both = (_by_product if square else _by_lookup)(shingle, times, size, x, y)
        out[at] = 100 * both >= percent * (size[x] + size[y] - both)
    return out


def _by_lookup(shingle: np.ndarray, times: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbered shingles that rows x and y have in common: the smaller set's are looked up in the larger one, some LOOKUPS at once."""
    keys = np.repeat(np.arange(len(size)) * len(times), size) + shingle  # ascending, as rows and sets are
    start, swap, out = np.cumsum(size) - size, size[x] > size[y], []
    small, large = np.where(swap, y, x), np.where(swap, x, y)
    slices = np.flatnonzero(np.diff(np.cumsum(size[small]) // LOOKUPS)) + 1
    for few, many in zip(np.split(small, slices), np.split(large, slices)):
        n = size[few]
        pair = np.repeat(np.arange(len(few)), n)
        want = many[pair] * len(times) + shingle[np.arange(len(pair)) + np.repeat(start[few] - np.cumsum(n) + n, n)]
        found = np.searchsorted(keys, want)
        found[found == len(keys)] = 0
        out.append(np.bincount(pair[keys[found] == want], minlength=len(few)))
    return np.concatenate(out)


def _by_product(shingle: np.ndarray, times: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same from a product of 0-1 matrices, WIDTH shingles at once; a shingle of one row is in no intersection. Counts stay below 2^24, so they are exact."""
    use = times[shingle] > 1
    row, column, width = np.repeat(np.arange(len(size), dtype=np.int32), size)[use], (np.cumsum(times > 1, dtype=np.int32) - 1)[shingle[use]], int(np.count_nonzero(times > 1))
    both = np.zeros((len(size), len(size)), np.float32)
    for first in range(0, width, WIDTH):
        some = (column >= first) & (column < first + WIDTH)
        has = np.zeros((len(size), min(WIDTH, width - first)), np.float32)
        has[row[some], column[some] - first] = 1
        both += has @ has.T
    return both[x, y].astype(np.int64)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9999999) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included), kept (doc_id =
    component_id).

    Null texts and texts without words have no shingles and link with nothing; texts with fewer words than a shingle are one
    shingle. Documents with equal sets are one class, of the least doc_id. Rows that repeat a doc_id each get a row, the one of their
    own text's class. A null doc_id gets its class's component (null if no id is in it), and is not kept. Other columns are
    ignored; no documents give no rows. A pair at the threshold is found with probability recall in small nodes, of which nodes of many members
    have fewer; a pair far above it, or with other ways between its ends, is missed less.
    """
    small_batches(docs.sparkSession)
    byte_batches(docs.sparkSession)
    base = written(signatures(docs, words))
    same = base.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")).filter("doc_id is not null")
    classes = written(same.withColumn("v", F.monotonically_increasing_id()))
    tokens = classes.select("v", "sig")

    def found(ids: DataFrame, rows: int) -> DataFrame:
        wanted = written(keyed_join(classes.select("v", "doc_id", "n", "k1", "k2"), ids, ["v"], "left_semi", rows))
        return sets(docs, wanted, rows, words)

    count = trees(threshold, recall)
    spots, some = counted(shared(paths(classes, count)), F.col("blocks").isNotNull())
    met = F.lit((1 << count) - 1).cast("long")
    if some:  # trees in which a class's node is large are not those it has met its pairs in
        own = spots.filter("blocks is not null").groupBy("v").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("wide"))
        masks = own.select("v", met.bitwiseXOR(F.col("wide")).alias("met"))
        spots = written(spots.join(masks, "v", "left").withColumn("met", F.coalesce("met", met)))
    else:
        spots = spots.withColumn("met", met)
    ready = dealt(spots).join(tokens, "v").withColumn("label", F.col("v"))
    joined = links(ready, found, threshold)
    label = components(joined)
    wide, level = spots.filter("blocks is not null"), 0
    while some:
        level += 1
        known = written(wide.drop("label").join(label.select(F.col("id").alias("v"), F.col("component").alias("label")), "v", "left").withColumn("label", F.coalesce("label", "v")).withColumn("tree", F.lit(count)))
        state = _state(known)
        few = known.join(state.filter("few and minor > 0").select("node", "most"), "node")
        below, masks = known.join(state.filter("not few").select("node"), "node", "left_semi").join(tokens, "v"), known.select("v", "met", "label").distinct()
        nodes, some = counted(shared(children(below, level)).join(masks, "v"), F.col("blocks").isNotNull())
        columns = ["node", "block", "tree", "v", "n", "met", "label"]
        ready = minor_and_rest(few).select(*columns).union(dealt(nodes).select(*columns)).join(tokens, "v")
        joined = joined.union(links(ready, found, threshold))
        label = components(joined)
        wide = nodes.filter("blocks is not null")

    # the least doc_id of each component
    members = written(classes.select("v", "doc_id").join(label.withColumnRenamed("id", "v"), "v"))
    least = members.groupBy("component").agg(F.min("doc_id").alias("id"))
    named = classes.select("v", "doc_id", "n", "k1", "k2").join(members.join(least, "component").select("v", "id"), "v", "left").select("n", "k1", "k2", F.coalesce("id", "doc_id").alias("id"))
    full = base.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    component = F.coalesce("id", "doc_id")
    return full.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def dealt(spots: DataFrame) -> DataFrame:
    """spots with their blocks: a small node is one, a large one's members are dealt by hash, and PIVOTS of them stand in every block."""
    small = spots.withColumn("block", F.lit(0))
    if spots.filter("blocks is not null").isEmpty():
        return small
    large = spots.filter("blocks is not null").withColumn("order", F.xxhash64("v", "node"))
    pivots = large.groupBy("node", F.pmod("order", F.lit(PIVOTS)).alias("part")).agg(F.min_by("v", "order").alias("v")).select("node", "v", F.lit(True).alias("pivot"))
    block = F.pmod(F.shiftright("order", 8), F.col("blocks")).cast("int")
    every = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    spread = large.join(pivots, ["node", "v"], "left").withColumn("block", F.explode(every))
    return small.filter("blocks is null").unionByName(spread.select(*small.columns))


def _state(known: DataFrame) -> DataFrame:
    """(node, most, minor, few): of each node the largest component, how many members are outside it, and whether those go into one block."""
    each = known.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    node = each.groupBy("node").agg(F.sum("c").alias("m"), F.sum("shingles").alias("all"), F.max(F.struct("c", "label", "shingles")).alias("top"))
    minor, rest = F.col("m") - F.col("top.c"), F.col("all") - F.col("top.shingles")
    return written(node.select("node", F.col("top.label").alias("most"), minor.alias("minor"), ((minor <= MEMBERS // 2) & ((rest <= SHINGLES // 2) | (minor <= FEW))).alias("few")))


def minor_and_rest(few: DataFrame) -> DataFrame:
    """few (members of nodes, with their largest component, most) in blocks: the largest component is dealt by hash, the others stand in every block."""
    block = F.pmod(F.xxhash64("v", "node"), F.col("blocks")).cast("int")
    return few.withColumn("block", F.explode(F.when(F.col("label") == F.col("most"), F.array(block)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
