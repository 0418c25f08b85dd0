"""Best-two-fit packing of token sequences into as few training sequences as it can.

Lengths run from 1 to the capacity, so the whole corpus is described by one histogram of at most ``capacity``
numbers, whatever its size. The driver packs that histogram: a bin is opened with the longest length left, filled
greedily with the longest that fits, then its smallest piece is replaced by two unpacked pieces that fit the expanded
gap more tightly, if there are such. Small pieces fill the gaps last. Each bin shape is used as often as the histogram allows, so there are a few
thousand shapes at most. Pieces then find their places by their rank among the pieces of their length: counts of
(partition, length), a running sum of these, and a lookup of the rank in the plan, which is broadcast and bounded by
the number of shapes. No group of pieces is ever gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidetrace.llm.common import prepare, spare
from sidetrace.llm.tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: one if they fit, else full pieces after a first one that takes the rest."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A null or empty text is the end id alone. Repeated doc_ids are packed as they come, each row for itself; columns
    other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    arrow_ids = [("ids", pa.binary())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *arrow_ids])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode.ids(batch["text"]), strict=True):
                ids += end
                start = 0
                for k, n in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    for column, value in zip(rows, (doc, k, start, n, zlib.crc32(part), part), strict=False):
                        column.append(value)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, PIECES + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin in order, number of such bins) that pack the histogram {length: pieces} best-two-fit.

    Pieces under a sixth of the capacity fill the gaps after the others, as the method was published; also tried are a
    tenth and no such rule, and replacing only where the two fill the bin; the plan of fewest bins is taken.
    """
    tries = [_plan(histogram, capacity, least, full) for least in (-(-capacity // 6), -(-capacity // 10), 1) for full in (False, True)]
    return min(tries, key=lambda shapes: sum(n for _, n in shapes))


def _plan(histogram: dict[int, int], capacity: int, least: int, full: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit for pieces of ``least`` and more, then greedy filling with the smaller ones, each bin shape used as often as it can."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n

    def largest(limit: int, low: int) -> int:
        at = np.flatnonzero(left[low : limit + 1])
        return int(at[-1]) + low if len(at) else 0

    def take(shape: list[int], gap: int, low: int) -> int:
        while gap >= low and (x := largest(gap, low)):
            n = min(int(left[x]), gap // x)
            shape += [x] * n
            left[x] -= n
            gap -= n * x
        return gap

    def repeat(shape: list[int], most: int | None = None) -> int:
        """How many bins take this shape, the first included."""
        sizes, times = np.unique(shape, return_counts=True) if shape else (np.zeros(0, np.int64),) * 2
        more = int((left[sizes] // times).min()) if shape else 0
        more = more if most is None else min(more, most - 1) if shape else most - 1
        left[sizes] -= more * times
        return more + 1

    bins: list[tuple[list[int], int]] = []
    while a := largest(capacity, least):
        shape = [a]
        left[a] -= 1
        gap = take(shape, capacity - a, least)
        if gap and len(shape) > 1:
            smallest = min(shape[1:])
            room = gap + smallest
            best = (room - 1 if full else smallest, 0, 0)
            for x in np.flatnonzero(left[least : room // 2 + 1]) + least:
                left[x] -= 1
                y = largest(room - int(x), least)
                left[x] += 1
                if y and x + y > best[0]:
                    best = (int(x) + y, y, int(x))
            if best[1]:
                shape.remove(smallest)
                left[smallest] += 1
                for x in best[1:]:
                    shape.append(x)
                    left[x] -= 1
        bins.append((shape, repeat(shape)))
    shapes: list[tuple[tuple[int, ...], int]] = []
    for shape, n in bins:  # the smaller pieces, into the gaps
        while n:
            extra: list[int] = []
            take(extra, capacity - sum(shape), 1)
            k = repeat(extra, n)
            shapes.append((tuple(sorted(shape + extra, reverse=True)), k))
            n -= k
    while a := largest(capacity, 1):
        shape = [a]
        left[a] -= 1
        take(shape, capacity - a, 1)
        shapes.append((tuple(sorted(shape, reverse=True)), repeat(shape)))
    return shapes


def places(shapes: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, list[np.ndarray]]:
    """For each length its ranges of ranks: ends of the ranges, first sequence, slots a bin, and the first slot's offset.

    A bin holds its pieces from the longest to the shortest, so the slots of one length stand side by side.
    """
    out: dict[int, list[list]] = {}
    first = 0
    for shape, n in shapes:
        at = 0
        sizes, times = np.unique(shape, return_counts=True)
        for x, slots in zip(sizes[::-1].tolist(), times[::-1].tolist(), strict=True):
            ranges = out.setdefault(x, [[0], [], [], []])
            ranges[0].append(ranges[0][-1] + n * slots)
            ranges[1].append(first)
            ranges[2].append(slots)
            ranges[3].append(at)
            at += x * slots
        first += n
    return {x: [np.array(column, np.int64) for column in r] for x, r in out.items()}


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to capacity); clashing columns are replaced.

    Equal lengths go to places in the order of partition, doc_id and piece. No pieces give no sequences.
    """
    spark = prepare(pieces.sparkSession)
    kept = [f for f in pieces.schema if f.name.lower() not in ("sequence_id", "offset")]
    part, n, base, rank = (spare(x, pieces.columns) for x in ("part", "n", "base", "rank"))
    pieces = pieces.select(*(F.col(f"`{f.name}`") for f in kept)).withColumn(part, F.spark_partition_id()).checkpoint()
    counts = pieces.groupBy("length", part).agg(F.count("*").alias(n)).checkpoint()
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum(n)).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = counts.select("length", part, (F.sum(n).over(Window.partitionBy("length").orderBy(part)) - F.col(n)).alias(base))
    own = F.row_number().over(Window.partitionBy(part, "length").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn(rank, own).join(before, [part, "length"]).withColumn(rank, F.col(base) + F.col(rank) - 1)
    order = [f.name for f in kept]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            length, at_rank = batch["length"].to_numpy(), batch[rank].to_numpy()
            sequence, offset = np.zeros(len(at_rank), np.int64), np.zeros(len(at_rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                ends, first, slots, base_at = table[int(x)]
                k = np.searchsorted(ends, at_rank[at], "right") - 1
                bin_, slot = np.divmod(at_rank[at] - ends[k], slots[k])
                sequence[at] = first[k] + bin_
                offset[at] = base_at[k] + slot * x
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in order), pa.array(sequence), pa.array(offset)], names=[*order, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.select(*(f"`{c}`" for c in order), rank).mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs documents (doc_id, text); see tokenized_pieces and pack."""
    return pack(tokenized_pieces(docs, capacity, end_id, tokenizer, with_ids), capacity)
