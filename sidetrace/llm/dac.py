"""Token ids in directly addressable codes: any token is read by its number, without decoding a block.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunks of all ids that have one, in order,
one byte each, beside a bitmap that says which of them continue on level k + 1, and a rank directory with the number
of continuing chunks before each 512. The chunk of an id on level k + 1 stands at the rank of its bit on level k.

Segment file, little-endian: b"DAC1", u32 documents, u32 of them, the first, without a doc_id, u64 ids, u32 levels, i64 doc_ids, u64 first id of each document (one
more at the end), then for each level u64 chunks, the chunks, the bitmap (lowest bit first), u32 ranks.
Segments are rows of a Parquet folder, written by Spark's committer, so that a lost executor or a repeated task leaves
no half-written file; a segment's bytes are stored uncompressed. A document longer than a segment has segments of its own, each a
piece of it, numbered in the row.

Texts are tokenized where they are read, so that what is shuffled is ids, of two bytes each where that is enough, and the
tasks that write hold no tokenizer.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sidetrace.llm.common import checkpoint_dir, prepare
from sidetrace.llm.tokens import default_tokenizer, encoder

BLOCK = 512
#: Ids after which a segment ends, and at most in a segment of a piece.
SEGMENT_IDS = 1 << 18
SEGMENTS = "part int, segment int, piece int, pieces int, n_docs long, n_ids long, data binary"
#: Rows sampled for each part.
SAMPLE = 100
#: Bytes that the Parquet writer holds before it writes a row group.
ROW_GROUP = 8 << 20


def level(rest: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The parts of one level of ids, and what the next one holds."""
    more = rest > 255
    padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
    padded[: len(rest)] = more
    ranks = np.zeros(len(padded) // BLOCK + 1, "<u4")
    np.cumsum(padded.reshape(-1, BLOCK).sum(axis=1), out=ranks[1:])
    parts = [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), np.packbits(padded, bitorder="little").tobytes(), ranks.tobytes()]
    return parts, rest[more] >> np.uint32(8)


def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """The segment file of documents with so many ids each; the first ``nulls`` have no doc_id."""
    starts = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    parts, rest = level(np.asarray(ids, np.uint32))
    while len(rest):
        more, rest = level(rest)
        parts += more
    return b"".join([b"DAC1", struct.pack("<IIQI", len(doc_ids), nulls, len(ids), len(parts) // 4), np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), *parts])


class Segment:
    """A segment file opened for random access."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        docs, self.nulls, self.n_ids, levels = struct.unpack_from("<IIQI", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs)
        at += 8 * docs + 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at + 8 + n + blocks * BLOCK // 8)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + blocks * BLOCK // 8 + 4 * (blocks + 1)

    def token(self, i: int) -> int:
        """The i-th id: a byte, a bit and a rank on each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(inside.sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)
            low = chunks.astype(np.uint32)
            low[more] |= value << np.uint32(8)
            value = low
        return value


def crc32_combine(a: int, b: int, n: int) -> int:
    """The CRC-32 of two byte strings in a row from the CRC-32 of each and the length of the second.

    n zero bytes act on a CRC as a linear map over GF(2), made by squaring that of one zero bit.
    """

    def times(matrix: list[int], x: int) -> int:
        out = 0
        for k in range(32):
            if x >> k & 1:
                out ^= matrix[k]
        return out

    matrix, bits = [0xEDB88320, *(1 << k for k in range(31))], 8 * n
    while bits:
        if bits & 1:
            a = times(matrix, a)
        matrix = [times(matrix, row) for row in matrix]
        bits >>= 1
    return a ^ b


Key = tuple[bool, int, int, int]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tie, row, text): tie is a hash of the text and row a number of the input row; together with doc_id they order all rows."""
    return docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")


def ranges(rows: DataFrame, parts: int) -> list[Key]:
    """Keys that cut the order of rows (doc_id, tie, row) into parts, from a hash sample of about SAMPLE rows a part; it decides the parts' sizes only."""
    n = max(1, rows.count())
    share = min(1 << 20, -(-SAMPLE * parts * (1 << 20) // n))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < share).select("doc_id", "tie", "row").collect()
    keys = sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in sample)
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def tokenized(rows: DataFrame, end_id: int, tokenizer: str, segment_ids: int, cuts: list[Key]) -> DataFrame:
    """Rows (part, doc_id, tie, row, piece, pieces, wide, ids): each document's ids, of two or (wide) four bytes, in pieces of a segment at most, and the part they fall into."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, tie, row, data in zip(*(batch[c].to_pylist() for c in ("doc_id", "tie", "row")), coder.ids(batch["text"]), strict=True):
                key = (bisect_right(cuts, (doc is not None, doc or 0, tie, row)), doc, tie, row)
                ids = np.append(np.frombuffer(data, "<u4"), np.uint32(end_id))
                n = -(-len(ids) // segment_ids)
                for k in range(n):
                    part = ids[k * segment_ids : (k + 1) * segment_ids]
                    wide = int(part.max()) > 0xFFFF
                    rows.append((*key, k, n, wide, part.astype("<u4" if wide else "<u2").tobytes()))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 64], strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(make, "part int, doc_id long, tie long, row long, piece int, pieces int, wide boolean, ids binary")


def write(docs: DataFrame, path: str, end_id: int = 0, tokenizer: str | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of docs (doc_id, text), each document closed by end_id, as segments in ascending doc_id order.

    Rows are dealt by ranges and sorted, so parts, and segments in a part, are in order. Rows without a doc_id come first;
    rows that share one are in the order of a hash of their texts, and however many they are, they spread over the ranges.
    Null and empty texts are the end id alone. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = 0, 0
        docs_in: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close(piece: int = 0, pieces: int = 1) -> pa.RecordBatch:
            nonlocal docs_in, held, size, segment
            data = encode(np.array([d or 0 for d in docs_in]), np.array([len(x) for x in held]), np.concatenate(held), sum(d is None for d in docs_in))
            values = (part, segment, piece, pieces, len(docs_in), size, data)
            docs_in, held, size, segment = [], [], 0, segment + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for to, doc, piece, pieces, wide, ids in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "piece", "pieces", "wide", "ids")), strict=True):
                if held and (pieces > 1 or to != part):
                    yield close()
                if to != part:
                    part, segment = to, 0
                docs_in.append(doc)
                held.append(np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.uint32))
                size += len(held[-1])
                if pieces > 1 or size >= segment_ids:
                    yield close(piece, pieces)
        if docs_in:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    ids = tokenized(rows, end_id, tokenizer or default_tokenizer(), segment_ids, ranges(rows, parts))
    ordered = ids.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "tie", "row", "piece").select("part", "doc_id", "piece", "pieces", "wide", "ids")
    out = ordered.mapInArrow(make, SEGMENTS).write.option("compression", "none").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false")
    out.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for."""
    prepare(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    each = segments.select("part", "segment", "n_ids")
    parts = each.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each part of the file
    inner = each.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("inside"))
    bases = inner.join(parts, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))
    more = [("ids", pa.binary())] if with_ids else []
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *more])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, data in zip(*(batch[c].to_pylist() for c in ("part", "segment", "piece", "pieces")), batch["data"], strict=True):
                s = Segment(data.as_py())
                ids = s.all().astype("<u4").tobytes()
                at = s.starts.astype(np.int64)
                found = [ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                known = [np.full(len(found), k, np.int32) for k in key]
                columns = [*known, pa.array(s.doc_ids, mask=np.arange(len(found)) < s.nulls), at[:-1], np.diff(at), [zlib.crc32(x) for x in found], *([found] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = "part int, segment int, piece int, pieces int, doc_id long, inner long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = segments.select("part", "segment", "piece", "pieces", "data").mapInArrow(make, kinds).join(bases, ["part", "segment"]).withColumn("start", F.col("base") + F.col("inner"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    if segments.where("pieces > 1").isEmpty():
        return rows.select(*names)
    # the pieces of a long document, one short row for each segment that it fills
    whole = rows.where("pieces > 1").groupBy("part", (F.col("segment") - F.col("piece")).alias("first")).agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("piece", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])))).alias("p"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, start, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "p")), strict=True):
                crc = 0
                for x in found:
                    crc = crc32_combine(crc, x["ids_crc32"], 4 * x["n_tokens"])
                values = [doc, start, sum(x["n_tokens"] for x in found), crc, *([b"".join(x["ids"] for x in found)] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 4 + [pa.binary()] * with_ids, strict=True)], names=names)

    together = whole.select("doc_id", "start", "p").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return rows.where("pieces = 1").select(*names).union(together)


def round_trip(docs: DataFrame, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to a new folder below the shared one and reads them back."""
    spark = prepare(docs.sparkSession)
    path = f"{checkpoint_dir(spark).rstrip('/')}/dac-{uuid.uuid4().hex}"
    write(docs, path, end_id, tokenizer)
    return read(spark, path)
