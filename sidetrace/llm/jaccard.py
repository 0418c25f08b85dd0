"""Exact n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct n-gram sets. Two sets x, y of Jaccard similarity t or more differ in at most
(|x| + |y|) (1 - t) / (1 + t) n-grams. Sizes fall into classes such that linked sets lie in one class or in neighbouring
ones; in each class the n-gram space is cut by hash into more blocks of columns than the largest such difference, so
linked sets agree on all columns of some blocks. Rows that share the content of a block are candidates. (Blocks that are
empty, or hold nothing but n-grams of passages that very many documents share, say little, so there are a few blocks to
spare; a row with more such blocks is cut once more by another hash, and again, before they count as content. Which
n-grams are so common is told by a sample; it decides how much work there is, not what is found.)
Candidates form groups; the incidence of a group is multiplied with its transpose, block of columns by block of columns,
the overlap counts accumulate, and pairs below the bound that their sizes set are discarded. Large groups are cut into
tiles, and each pair of tiles is one product, so no group meets in one task. Copies of a set are one row throughout.

No link is lost: the blocks are a pigeonhole argument, not a sketch. Sets are held as 64-bit n-gram hashes.

Block keys are most of what is shuffled. They travel as packed runs of a bucket of the key space, 40 bits of the key and 40
of the set's name each: two keys or names that fall together add candidates and take none. Texts of candidates are
shuffled in rounds of a bounded number of rows, and what a round has shuffled goes before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidetrace.llm import textvec
from sidetrace.llm.common import BROADCAST_ROWS, components, prepare, release, runs, small_or_shuffled

#: N-grams of a tile of candidate sets; its product is done in memory.
TILE_GRAMS = 500_000
#: Rows of a tile of candidate sets, for the same reason.
TILE_ROWS = 800
#: Columns of a product at once.
COLUMNS = 2048
#: Documents, about, of the sample that tells common n-grams, and in how many of them such an n-gram is.
SAMPLE, COMMON = 16_000, 5
#: Block keys that a task combines before they are shuffled.
COMBINED = 1 << 19
#: N-grams, about, whose keys one bucket of the key space gets; a bucket is joined in memory.
BUCKET_GRAMS = 1 << 20
#: Bits of a set's signature that name it among the candidates.
NAME = (1 << 40) - 1
#: Cuttings of the n-gram space before empty blocks and common ones count as content.
CUTS = 5


def sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text."""
    for row, count, data, offsets in textvec.blocks(column):
        grams, at = textvec.ngrams(*textvec.words(data, offsets), n)
        for i in range(count):
            yield row + i, np.unique(grams[at[i] : at[i + 1]])


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = textvec.mix(grams).sum(dtype=np.uint64), textvec.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    both = textvec.mix(np.array([a, b], np.uint64) + np.uint64(len(grams)))
    return int(both.view(np.int64)[0]), int(both.view(np.int64)[1])


class Blocks:
    """Size classes and block keys for the threshold percent / 100."""

    def __init__(self, percent: int, common: np.ndarray | None = None) -> None:
        self.common = np.zeros(0, np.uint64) if common is None else common
        if not 0 < percent <= 100:
            raise ValueError("percent must lie in 1..100")
        self.percent = percent
        self.tops = [0]
        self.blocks: dict[int, tuple[int, int]] = {}

    def level(self, size: int) -> int:
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * 100 // self.percent))
        return int(np.searchsorted(self.tops, size))

    def number(self, level: int) -> tuple[int, int]:
        """Blocks of a level, and how many of them may be empty in a row whose other blocks still suffice.

        More blocks to spare cost keys, fewer send more rows to another cutting; the cheaper number by a Poisson count of
        empty blocks is taken. Either way no link is lost.
        """
        if level not in self.blocks:
            self.level(self.tops[min(level, len(self.tops) - 1)] + 1)
            low, top = self.tops[level - 1] + 1, self.tops[level]
            most = (top + self.tops[level + 1]) * (100 - self.percent) // (100 + self.percent)
            size, best = low + 0.25 * (top - low), (math.inf, 0)
            for spare in range(0 if most else 1, 8 + most // 2 if most else 1):
                k = most + 1 + spare
                mean = k * math.exp(-size / k)
                term = math.exp(-mean)
                more = 1 - term
                for i in range(1, spare + 1):
                    term *= mean / i
                    more -= term
                best = min(best, ((k - mean) / (1 - min(0.99, max(0.0, more))), spare))
            self.blocks[level] = (most + 1 + best[1], best[1])
        return self.blocks[level]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The block keys of a set, for its own class (with the next) and for the one below (with its own).

        A block is weak if it is empty or all its columns are common; equal blocks are both weak or both not. Two linked rows
        differ in at most blocks - 1 - spare columns, so more than ``spare`` blocks agree; if a row has no more than
        ``spare`` weak blocks, it agrees with the other in one that isn't.
        """
        own = self.level(len(grams))
        out = []
        common = np.zeros(len(grams), bool)
        if len(self.common):
            common = self.common[np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)] == grams
        for level in (own, own - 1) if own > 1 else (own,):
            k, spare = self.number(level)
            for cutting in range(CUTS):
                h, usual = grams, common
                if cutting:
                    h = textvec.mix(grams + np.uint64(cutting))
                    order = np.argsort(h)
                    h, usual = h[order], common[order]
                block = ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                at = np.searchsorted(block, np.arange(k + 1))
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(textvec.mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
                content = total[at[1:]] - total[at[:-1]]
                place = np.arange(k, dtype=np.uint64) + np.uint64((level * CUTS + cutting) << 32)
                key = textvec.mix(content + textvec.mix(place))
                strong = np.bincount(block[~usual], minlength=k) > 0
                enough = k - int(strong.sum()) <= spare
                out.append(key if not enough and cutting == CUTS - 1 else key[strong])
                if enough:
                    break
        return np.concatenate(out)


def linked(counts: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which overlap counts reach the threshold, for set sizes a (rows) and b (columns)."""
    return 100 * counts >= percent * (a[:, None] + b[None, :] - counts)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all left with all right sets: products of incidence blocks, accumulated."""
    n = len(left)
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.empty(len(every), bool)
    if len(every):
        new[0] = True
        new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    width = int(column[-1]) + 1 if len(every) else 0
    in_left, in_right = np.zeros(width, bool), np.zeros(width, bool)
    in_left[column[owner < n]] = True
    in_right[column[owner >= n]] = True
    use = in_left & in_right
    renamed = np.cumsum(use) - 1
    keep = use[column]
    column, owner = renamed[column[keep]], owner[keep]
    width = int(use.sum())
    counts = np.zeros((n, len(right)))
    cuts = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    for k in range(len(cuts) - 1):
        c, o = column[cuts[k] : cuts[k + 1]] - k * COLUMNS, owner[cuts[k] : cuts[k + 1]]
        block = np.zeros((n + len(right), min(COLUMNS, width - k * COLUMNS)), np.float32)
        block[o, c] = 1
        counts += block[:n] @ block[n:].T
    return counts.astype(np.int64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is joined with by the edges a, b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, sig, sig2), checkpointed; the size and name of each text's n-gram set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(g), *signature(g)) for _, g in sets(batch["text"], n)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], names=["doc_id", "n_shingles", "sig", "sig2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, n_shingles long, sig long, sig2 long").checkpoint()


def common_grams(docs: DataFrame, rows: int, n: int) -> np.ndarray:
    """Sorted hashes of the n-grams that at least COMMON documents of a hash sample of about SAMPLE of the rows hold.

    They are at most the sample's n-grams over COMMON, which bounds what is broadcast.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams in sets(batch["text"], n):
                yield pa.RecordBatch.from_arrays([pa.array(textvec.signed(grams))], names=["gram"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, (SAMPLE << 30) // max(1, rows))).select("text")
    found = sample.mapInArrow(make, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("gram").toArrow()
    return np.sort(found["gram"].to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def combined(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, name) rows that join the same names as all given ones, with each key once.

    The least name of a key stays with it; each other one is tied to that name under a key of their own, once however many
    keys they share. So of a key that very many rows have, few rows meet, and the ties spread.
    """
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = names[first][np.cumsum(first) - 1]
    a, b = least[~first], names[~first]
    if not len(a):
        return keys, names
    pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    tie = textvec.signed(textvec.mix(textvec.mix(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64)))
    return np.concatenate([keys[first], tie, tie]), np.concatenate([names[first], pairs[:, 0], pairs[:, 1]])


def packed(keys: np.ndarray, names: np.ndarray) -> bytes:
    """The low 40 bits of sorted keys and of their names, byte by byte of all, the highest first."""
    return b"".join(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes() for x in (keys, names))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and names of packed()."""
    planes = np.frombuffer(data, np.uint8).reshape(2, 5, -1)
    out = np.zeros((2, planes.shape[2], 8), np.uint8)
    out[:, :, 3:] = planes.transpose(0, 2, 1)
    keys, names = out.view(">u8")[:, :, 0].astype(np.int64)
    return keys, names


def candidates(docs: DataFrame, n: int, percent: int, common: np.ndarray | None = None, buckets: int = 1) -> DataFrame:
    """Edges (a, b) between names (the NAME bits of signatures) of different sets that agree on a block."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Blocks(percent, shared.value), set()
        keys, names, size = [], [], 0

        def flush() -> pa.RecordBatch:
            k, s = combined(np.concatenate(keys), np.concatenate(names))
            k = k.view(np.uint64)
            order = np.argsort(k)
            k, s = k[order], s[order]
            bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            low = k & np.uint64(NAME)
            rows = []
            for i, j in zip(at, [*at[1:], len(k)], strict=True):
                order = np.argsort(low[i:j])
                rows.append(packed(low[i:j][order], s[i:j][order]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(rows, pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for _, grams in sets(batch["text"], n):
                if not len(grams):
                    continue
                sig = signature(grams)[0]
                if sig in seen:  # a copy; its keys are out already
                    continue
                if len(seen) < 200_000:
                    seen.add(sig)
                keys.append(textvec.signed(cut.keys(grams)))
                names.append(np.full(len(keys[-1]), sig & NAME, np.int64))
                size += len(keys[-1])
                if size >= COMBINED:
                    yield flush()
                    keys, names, size = [], [], 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["bucket"]):
            both = [unpacked(x) for x in part["packed"].to_pylist()]
            keys, names = (np.concatenate([b[i] for b in both]) for i in (0, 1))
            order = np.lexsort((names, keys))
            keys, names = keys[order], names[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            least = names[first][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([least, names], axis=1)[least != names], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = docs.select("text").mapInArrow(make, "bucket long, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def links(docs: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (doc_id, root, links) for documents (doc_id, text) in groups (doc_id, community, i, j, side).

    In tile i, j of its community a document is linked with ``links`` others and its smallest link or itself is ``root``.
    """
    narrow = small_or_shuffled(groups)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(narrow, "doc_id").select("community", "i", "j", "side", "doc_id", "text")
    dealt = rows.repartition("community", "i", "j").sortWithinPartitions("community", "i", "j")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["community", "i", "j"]):
            part = part.combine_chunks()
            ids = part["doc_id"].to_numpy()
            grams = [g for _, g in sets(part["text"], n)]
            size = np.array([len(g) for g in grams])
            side = part["side"].to_numpy()
            two = part["i"][0].as_py() != part["j"][0].as_py()
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(ids)),) * 2
            if not len(left) or not len(right):  # an empty tile
                continue
            hit = linked(overlaps([grams[k] for k in left], [grams[k] for k in right]), size[left], size[right], percent)
            a, b = np.nonzero(hit)
            a, b = left[a], right[b]
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            count = np.bincount(a, minlength=len(ids)) + (np.bincount(b, minlength=len(ids)) if two else 0)
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            root = ids[order][roots(len(ids), rank[a], rank[b])[rank]] if len(a) else ids
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(count)], names=["doc_id", "root", "links"])

    return dealt.mapInArrow(make, "doc_id long, root long, links long")


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_shingles, component_id, class_id, n_links.

    Words are runs of bytes other than space and \\x09-\\x0D with A-Z lower-cased; fewer than n of them are one n-gram, none
    are an empty set, linked with nothing. component_id is the smallest doc_id reachable by links, class_id the smallest
    with the same set, n_links the number of other sets linked with. Rows that repeat a doc_id are each answered for their
    own text, and sets with the same smallest doc_id count as one; a row without doc_id is returned without ids and links
    nothing. An empty table gives no rows. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    base = profiles(docs, n)
    solid = base.where("n_shingles > 0 and doc_id is not null")
    classes = solid.groupBy("sig", "sig2").agg(F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n")).checkpoint()
    known = docs.where("doc_id is not null")
    rows, total = solid.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(total // BUCKET_GRAMS, min(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    near = components(candidates(known, n, percent, common_grams(known, rows, n), buckets)).select(F.col("node").alias("name"), F.col("component").alias("community"))
    release(spark)
    # different sets of one name make no edge, so they are a community at least
    classes = classes.withColumn("name", F.col("sig").bitwiseAND(F.lit(NAME)))
    twins = classes.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.col("name").alias("community")).join(near, "name", "left_anti")
    members = classes.join(near.union(twins), "name").select(F.col("class_id").alias("doc_id"), "community", "n")
    tiles = members.groupBy("community").agg(F.greatest(F.ceil(F.sum("n") / TILE_GRAMS), F.ceil(F.count("*") / TILE_ROWS)).cast("int").alias("tiles"))
    # only communities of several tiles are looked up, so that the rows of a large one stay where they are
    placed = members.join(small_or_shuffled(tiles.where("tiles > 1")), "community", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("doc_id", "community", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), (F.col("tile") > F.col("with")).cast("int").alias("side")).distinct().checkpoint()
    rows = placed.count()
    rounds = -(-2 * rows // BROADCAST_ROWS) if rows > BROADCAST_ROWS else 1
    found = None
    for k in range(rounds):
        part = placed if rounds == 1 else placed.where(F.pmod(F.xxhash64("community", "i", "j"), F.lit(rounds)) == k)
        more = links(docs, part, n, percent).checkpoint()
        found = more if found is None else found.union(more)
        if k + 1 < rounds:
            release(spark)
    joined = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    named = counts.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.col("doc_id").alias("class_id"), "n_links", "component")
    whole = base.join(classes.select("sig", "sig2", "class_id"), ["sig", "sig2"], "left").join(named, "class_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")))
    return whole.select("doc_id", "n_shingles", own.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
