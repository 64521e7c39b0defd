"""Exact nearest binary codes by incremental multi-index hashing.

Codes are cut into m segments, and each segment's value is an index under which a code is found. In round r a query that is still open looks up the values exactly r away
from its own, one segment after the other, and verifies what it finds by the full Hamming distance. A code that none of the first a + 1 segments has within r, nor
the others within r - 1, differs in more than m * r + a bits, so a query needs no further segment once that reaches the bound on its kth distance, which falls
with what is found; most rounds end in the middle of the segments. All queries are answered by the index alone, however many codes there are.

A cell holds the codes of one segment whose values agree in all but the last LOW bits. Queries are sent to the cells whose bits are within r of their own, and there
look up the values of the last bits, in a table of offsets; a cell of many codes, or queries, is cut into parts. Codes and queries meet by a shuffle. See
"Fast Exact Search in Hamming Space with Multi-Index Hashing" (Norouzi, Punjani and Fleet, 2014).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewave.llm.store import counted, discard, keyed_join, written

#: Segments are as wide as gives each value about so many codes.
BUCKET = 32
#: Last bits of a segment, whose values are looked up within a cell.
LOW = 8
#: Codes of a part of a cell, and queries that look into it together.
PART = ASKED = 1 << 13
#: Codes that give every query a first bound on its kth distance. They are sent to all tasks; their number is fixed.
FIRST = 1 << 8
#: Parts that the rows of one code are first ranked in.
SALTS = 16
#: Pairs that are compared at once.
_PAIRS = 1 << 19


def sign_codes(embedding: Column) -> Column:
    """Codes of as many bits as an array has numbers, in words of 64: a bit for each that is positive, the first one the highest of the first
    word; the last word is filled up with zeros. Null without numbers, or if one is null or not finite."""
    word = lambda i: F.aggregate(F.transform(F.slice(padded, i * 64 + 1, F.lit(64)), lambda x: (x > 0).cast("long")), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
    padded = F.concat(embedding.cast("array<double>"), F.array_repeat(F.lit(0.0), F.pmod(-F.size(embedding), F.lit(64)).cast("int")))
    usable = (F.size(embedding) > 0) & F.forall(embedding.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(F.sequence(F.lit(0), F.floor((F.size(embedding) - 1) / 64).cast("int")), word))


def width(n: int) -> int:
    """Bits of a segment at most, for n codes."""
    return min(24, max(4, round(math.log2(n / BUCKET)))) if n > BUCKET else 4


def cuts(bits: int, n: int) -> list[int]:
    """Where segments of codes of so many bits begin, and the end, for n codes."""
    m = -(-bits // width(n))
    return [bits * k // m for k in range(m + 1)]


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, words) uint64; shorter codes are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(size), max(1, int(size.max(initial=1)))), np.uint64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(column.flatten()).view(np.uint64)
    return out


def _values(words: np.ndarray, at: list[int]) -> list[np.ndarray]:
    """The value of each segment of codes."""
    bits = np.unpackbits(words.byteswap().view(np.uint8), axis=1)
    return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)[::-1]) for a, b in itertools.pairwise(at)]


@functools.cache
def _masks(bits: int, r: int) -> np.ndarray:
    """All values of so many bits of which r are set."""
    return np.array([sum(1 << k for k in c) for c in itertools.combinations(range(bits), r)], np.int64)


def _cell(n_words: int, segment: int, high: np.ndarray) -> np.ndarray:
    """The number of a cell: codes have up to 2^15 words, and segments (at least four bits wide) up to 2^20; the last bits are the segment's first ones."""
    return (np.int64(n_words) << np.int64(48)) + (np.int64(segment) << np.int64(24)) + high


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The codes of each length of a batch, some at a time, and their words."""
    size = np.diff(np.asarray(batch.column("code").offsets))
    for length in np.unique(size):
        part = batch.take(pa.array(np.flatnonzero(size == length)))
        for at in range(0, len(part), 256):
            yield part.slice(at, 256), _words(part.slice(at, 256).column("code"))


def indexed(codes: DataFrame, n: int) -> DataFrame:
    """codes (code, first, weight) once for each of their segments, with its cell and low, its last bits; for n codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _by_length(batch):
                at = cuts(64 * words.shape[1], n)
                for s, value in enumerate(_values(words, at)):
                    low = min(LOW, at[s + 1] - at[s])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_cell(words.shape[1], s, value >> low)), pa.array((value & (1 << low) - 1).astype(np.int32))], names)

    names = ["code", "first", "weight", "cell", "low"]
    return codes.select(*names[:3]).mapInArrow(run, "code array<long>, first long, weight int, cell long, low int")


def asked(queries: DataFrame, n: int, r: int) -> DataFrame:
    """queries (code, bound) once for each cell that they look into in round r: in each segment that they need, those whose bits are j <= r away from their own, where the
    last bits must be r - j away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _by_length(batch):
                at, bound = cuts(64 * words.shape[1], n), np.asarray(part.column("bound"))
                m = len(at) - 1
                for s, value in enumerate(_values(words, at)):
                    low = min(LOW, at[s + 1] - at[s])
                    needs = np.flatnonzero(bound >= m * r + s)
                    for j in range(max(0, r - low), min(r, at[s + 1] - at[s] - low) + 1):
                        cells = (value[needs] >> low)[:, None] ^ _masks(at[s + 1] - at[s] - low, j)
                        rows = np.repeat(needs, cells.shape[1])
                        some = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(_cell(words.shape[1], s, cells.ravel())), pa.array((value[rows] & (1 << low) - 1).astype(np.int32)), pa.array(np.full(len(rows), r - j, np.int32))], names)

    names = ["code", "bound", "cell", "low", "away"]
    return queries.select(*names[:2]).mapInArrow(run, "code array<long>, bound int, cell long, low int, away int")


def bounded(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """queries (code) with bound: no less than the distance that k ids of rows are within, by a few codes that are sent to all tasks."""
    sent = queries.sparkSession.sparkContext.broadcast([(np.array(x.code, np.int64).view(np.uint64), x.weight) for x in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sorted({len(c) for c, _ in sent.value})
        known = {n: (np.array([c for c, _ in sent.value if len(c) == n]), np.array([w for c, w in sent.value if len(c) == n])) for n in lengths}
        for batch in batches:
            size = np.diff(np.asarray(batch.column("code").offsets))
            bound = 64 * size
            for n in lengths:
                codes, weight = known[n]
                for i in np.flatnonzero(size == n):
                    distance = np.bitwise_count(codes ^ np.asarray(batch.column("code")[int(i)].values).view(np.uint64)).sum(axis=1)
                    order = np.argsort(distance, kind="stable")
                    last = np.searchsorted(np.cumsum(weight[order]), k)
                    bound[i] = distance[order[last]] if last < len(order) else 64 * n
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(bound, pa.int32())], ["code", "bound"])

    return queries.mapInArrow(run, "code array<long>, bound int")


def _best(q: np.ndarray, code: np.ndarray, distance: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k codes of least (distance, first) of each q; a code that was found by several keys counts once."""
    order = np.lexsort((code, first, distance, q))
    order = order[np.append(True, (np.diff(q[order]) != 0) | (np.diff(code[order]) != 0))]
    begins = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


FOUND = "query array<long>, code array<long>, first long, weight int, distance int"


def meet(rows: DataFrame, k: int) -> DataFrame:
    """FOUND: of rows (cell, part, block, side, low, code, first, weight, bound, away) the codes (side 0) whose last bits are away from a query's (side 1) in its cell's part, and that are within its
    bound. A task holds the codes of the present part, and of each query that it sees no more than the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, n = None, [], 0

        def out() -> pa.RecordBatch:
            x = pa.concat_tables(kept).combine_chunks()
            q, code = (np.unique(_words(x.column(c)), axis=0, return_inverse=True)[1].ravel() for c in ("query", "code"))
            best = x.take(pa.array(_best(q, code, np.asarray(x.column("distance")), np.asarray(x.column("first")), k)))
            return best.combine_chunks()

        for batch in batches:
            table = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks()
            if not len(table):
                continue
            key, side, low, away = np.stack([np.asarray(table.column(c)) for c in ("cell", "part", "block")]), *(np.asarray(table.column(c)).astype(np.int64) for c in ("side", "low", "away"))
            begins = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            codes = np.add.reduceat((side == 0).astype(np.int64), begins)
            held = table.slice(int(begins[-1]), int(codes[-1])).combine_chunks().to_batches()
            held = held[0] if held else None
            words, bound = _words(table.column("code")), np.asarray(table.column("bound"))
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(table))))
            place = group * (1 << LOW) + low  # codes ascend by it, those of a part side by side
            of_codes = np.flatnonzero(side == 0)
            sorted_ = place[of_codes]
            for r in np.unique(away[side == 1]):
                queries, masks = np.flatnonzero((side == 1) & (away == r)), _masks(LOW, int(r))
                for some in np.array_split(queries, -(-len(queries) * len(masks) // _PAIRS)):
                    looked = (place[some][:, None] ^ masks).ravel()
                    first, last = np.searchsorted(sorted_, looked), np.searchsorted(sorted_, looked, side="right")
                    hit = np.flatnonzero(last > first)
                    many = np.cumsum((last - first)[hit])
                    for part in np.split(hit, np.searchsorted(many, np.arange(_PAIRS, many[-1], _PAIRS))) if len(hit) else ():
                        each = (last - first)[part]
                        a = np.repeat(some[part // len(masks)], each)
                        b = of_codes[np.repeat(first[part] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                        distance = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int32)
                        near = np.flatnonzero(distance <= bound[a])
                        if len(near):
                            at = pa.array(b[near])
                            kept.append(pa.table([table.column("code").take(pa.array(a[near])), *(table.column(c).take(at) for c in ("code", "first", "weight")), pa.array(distance[near])], names=["query", "code", "first", "weight", "distance"]))
                            n += len(near)
                        if n > 1 << 18:
                            kept = [out()]
                            n = len(kept[0])
        if kept:
            yield from out().to_batches()

    placed = rows.select("cell", "part", "block", "side", "low", "code", "first", "weight", "bound", "away").repartition("cell", "part", "block").sortWithinPartitions("cell", "part", "block", "side", "low")
    return placed.mapInArrow(run, FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, trace: list | None = None) -> DataFrame:
    """(query_id, rank, id, distance): of each of queries (id, code) the k rows (id, code) of least Hamming distance, ties by id; the row of
    the query's own id is left out.

    code: a long, or an array of longs (2^15 at most); only codes of as many words are compared. Rows and queries with a null id or code take no part. Equal
    codes are searched once and stand for all their ids. Repeated rows are one. Fewer than k rows give as many as there are; no rows or
    queries give none. Other columns are ignored. trace, if given, gets (radius, open queries, cells looked into) of each round.
    """
    array = lambda x: F.col("code") if x.schema["code"].dataType.typeName() == "array" else F.array("code")
    rows = rows.filter("id is not null and code is not null").select("id", array(rows).cast("array<long>").alias("code")).distinct()
    queries = queries.filter("id is not null and code is not null").select(F.col("id").alias("query_id"), array(queries).cast("array<long>").alias("code")).distinct()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    best = lambda x, *by: x.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("n") <= k + 1).drop("n")
    classes, n = counted(best(best(rows, "code", "salt"), "code").groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    codes = classes.select("code", F.col("ids")[0].cast("long").alias("first"), F.size("ids").alias("weight"))
    sample = codes.orderBy(F.xxhash64("code"), "code").limit(FIRST).select("code", "weight").collect()
    there = codes.groupBy(F.size("code").alias("words")).agg(F.count(F.lit(1)).alias("codes"))
    # with the codes of its length, which are all that a query can find
    open_, left = counted(bounded(queries.select("code").distinct(), sample, k + 1).withColumn("words", F.size("code")).join(there, "words"))
    found, r, index = queries.sparkSession.createDataFrame([], FOUND), 0, None
    if left:
        index = indexed(codes, n)
        sizes = index.groupBy("cell").count().select("cell", F.ceil(F.col("count") / PART).cast("int").alias("parts")).filter("parts > 1")
        sizes, many = counted(sizes)
        split = lambda x, part: keyed_join(x, sizes, ["cell"], "left", many).withColumn("part", F.coalesce(part, F.lit(0))).drop("parts")
        index = written(split(index, F.pmod(F.xxhash64("code"), "parts").cast("int")))
    while left:
        looks, cells = counted(asked(open_, n, r))
        if trace is not None:
            trace.append((r, left, cells))
        crowds, busy = counted(looks.groupBy("cell").count().select("cell", F.ceil(F.col("count") / ASKED).cast("int").alias("blocks")).filter("blocks > 1"))
        spread = lambda x, n, into: x.withColumn(into, F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))).drop(n)
        own = spread(keyed_join(index, crowds, ["cell"], "left", busy), "blocks", "block")
        hash_ = F.pmod(F.xxhash64("code", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int")
        looking = spread(keyed_join(keyed_join(looks, crowds, ["cell"], "left", busy).withColumn("block", hash_), sizes, ["cell"], "left", many), "parts", "part")
        both = own.select("cell", "part", "block", F.lit(0).alias("side"), "low", "code", "first", "weight", F.lit(0).alias("bound"), F.lit(0).alias("away"))
        both = both.union(looking.select("cell", "part", "block", F.lit(1), "low", "code", F.lit(0).cast("long"), F.lit(0), "bound", "away"))
        every = found.union(meet(both, k + 1)).repartition("query").dropDuplicates(["query", "code"])
        place = Window.partitionBy("query").orderBy("distance", "first")
        ranked = every.withColumn("_n", F.row_number().over(place)).withColumn("_w", F.sum("weight").over(place.rowsBetween(Window.unboundedPreceding, 0)))
        now = written(ranked.filter(F.col("_n") <= k + 1).drop("_n"))
        known = now.groupBy(F.col("query").alias("code")).agg(F.min(F.when(F.col("_w") > k, F.col("distance"))).alias("kth"), F.count(F.lit(1)).alias("got"))
        r += 1
        needs = (F.col("bound") >= F.ceil(F.col("words") * 64 / width(n)) * r) & (F.coalesce("got", F.lit(0)) < F.col("codes"))
        above, (open_, left) = open_, counted(open_.join(known, "code", "left").withColumn("bound", F.least("bound", "kth")).filter(needs).drop("kth", "got"))
        discard(looks, crowds, found, above)
        found = now.drop("_w")
        found._written_at = now._written_at
    discard(index)
    near = queries.join(found.select(F.col("query").alias("code"), F.col("code").alias("near"), "distance"), "code")
    ids = near.select("query_id", "near", "distance").join(classes.withColumnRenamed("code", "near"), "near").select("query_id", "distance", F.explode("ids").alias("id")).filter("id <> query_id")
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
