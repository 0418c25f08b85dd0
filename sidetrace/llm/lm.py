"""Cross-entropy difference of matched target and background bigram models.

Both models count all documents of their kind, whole texts, over one shared vocabulary: every word of the whole corpus, and
one unknown word that none of them is. A token's probability interpolates its bigram with its unigram, both smoothed alike.
The score of a document is the mean over its tokens of the target's loss less the background's, in nats: the lower, the
closer to the target.

The counts are sharded by hash and no task or driver holds them all. A task sums the words and bigrams of a block of
documents and asks the shard of each for its counts over the corpus; a shard answers each block in the block's own order,
so answers carry no keys. A block's documents travel with its questions as word numbers, and texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidetrace.llm import textvec
from sidetrace.llm.common import prepare, runs, small_or_shuffled

#: Weight of the bigram against the unigram, and counts added to each word.
BIGRAM, ADDED = 0.7, 0.5
#: Tokens of a block, reached or passed by its last text.
BLOCK_TOKENS = 1 << 21
#: Bytes of text for each shard of the counts, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "block long, shard long, data binary"
_ZSTD = pa.Codec("zstd", 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 in their narrowest types, byte by byte of each, compressed."""
    head, body = [], []
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or int(a.max()) < 1 << 8 * w)
        head += [len(a), width]
        body.append(np.ascontiguousarray(a.astype(f"<u{width}")).view(np.uint8).reshape(len(a), width).T.tobytes())
    plain = np.array([len(arrays), *head], "<i8").tobytes() + b"".join(body)
    return len(plain).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    plain = np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    n = int(plain[:8].view("<i8")[0])
    head, at, out = plain[8 : 8 + 16 * n].view("<i8").reshape(n, 2), 8 + 16 * n, []
    for size, width in head.tolist():
        part = plain[at : at + size * width].reshape(width, size).T
        out.append(np.ascontiguousarray(part).view(f"<u{width}").reshape(size).astype(np.uint64 if width == 8 else np.int64))
        at += size * width
    return out


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by shard, and where each shard begins in it (one more at the end)."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _pairs(w: np.ndarray, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, second word) of each distinct bigram in texts of so many words, and for each bigram in order its number and the place of its second word."""
    text = np.repeat(np.arange(len(size)), size)
    place = np.flatnonzero(text[1:] == text[:-1]) + 1
    code, number = np.unique(w[place - 1] * len(words) + w[place], return_inverse=True)
    a, b = np.divmod(code, max(1, len(words)))
    return textvec.mix(words[a] * _PAIR + words[b]), a, b, number, place


def _questions(block: int, ids: pa.Array, flags: np.ndarray, size: np.ndarray, h: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row for each shard with a block's words and bigrams and its counts of them (target, background), and one with its documents."""
    words, w = np.unique(h, return_inverse=True)
    rank = np.argsort(np.argsort(-np.bincount(w, minlength=len(words)), kind="stable"), kind="stable")  # frequent words get small numbers
    words, w = words[np.argsort(rank)], rank[w]
    flag = np.repeat(flags, size)
    keys, a, _, number, place = _pairs(w, size, words)

    def counts(n: int, of: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both, t = np.bincount(of, minlength=n), np.bincount(of[target], minlength=n)
        return t, both - t

    two = counts(len(keys), number, flag[place])
    one = (*counts(len(words), w, flag), *counts(len(words), w[place - 1], flag[place]))
    order1, at1 = _by_shard(words, shards)
    order2, at2 = _by_shard(keys, shards)
    data = []
    for s in range(shards):
        p, q = order1[at1[s] : at1[s + 1]], order2[at2[s] : at2[s + 1]]
        data.append(_pack(words[p], *(c[p] for c in one), keys[q], *(c[q] for c in two)))
    valid = np.asarray(ids.is_valid())
    data.append(_pack(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), valid.astype(np.int64), size, words, w))
    names = [*range(shards), -1 - block]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["block", "shard", "data"])


def ask(docs: DataFrame, shards: int, known: np.ndarray | None) -> DataFrame:
    """Rows (block, shard, data) for docs (doc_id, text, target); with ``known``, sorted hashes, all other words are one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, flags, sizes, hashes, held = [], [], [], [], 0

        def done() -> pa.RecordBatch:
            return _questions(block, pa.concat_arrays(ids), np.concatenate(flags), np.concatenate(sizes), np.concatenate(hashes), shards)

        for batch in batches:
            flag = batch["target"].to_numpy(zero_copy_only=False).astype(bool)
            for row, count, data, offsets in textvec.blocks(batch["text"]):
                h, first = textvec.words(data, offsets)
                if known is not None:
                    h = np.where(np.isin(h, known), h, np.uint64(0))
                ids.append(batch["doc_id"].slice(row, count))
                flags.append(flag[row : row + count])
                sizes.append(np.diff(first))
                hashes.append(h)
                held += len(h)
                if held >= BLOCK_TOKENS:
                    yield done()
                    block += 1
                    ids, flags, sizes, hashes, held = [], [], [], [], 0
        if ids:
            yield done()

    return docs.select("doc_id", "text", "target").mapInArrow(make, _ROWS)


def answer(questions: DataFrame) -> DataFrame:
    """The rows of ask with each shard's counts over the corpus in place of the block's own; the blocks' documents as they are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["shard"]):
            if part["shard"][0].as_py() < 0:
                yield from part.combine_chunks().to_batches()
                continue
            asked = [_unpack(d) for d in part["data"].to_pylist()]

            def sums(first: int, n: int, asked=asked) -> tuple[list[np.ndarray], np.ndarray]:
                keys, inverse = np.unique(np.concatenate([a[first] for a in asked]).astype(np.uint64), return_inverse=True)
                total = [np.bincount(inverse, np.concatenate([a[first + 1 + k] for a in asked]), len(keys)).astype(np.int64) for k in range(n)]
                return total, inverse

            (one, of1), (two, of2) = sums(0, 4), sums(5, 2)
            whole = np.array([len(one[0]), one[0].sum(), one[1].sum()])
            end1, end2 = np.cumsum([len(a[0]) for a in asked]), np.cumsum([len(a[5]) for a in asked])
            for block, a, e1, e2 in zip(part["block"].to_pylist(), asked, end1, end2, strict=True):
                p, q = of1[e1 - len(a[0]) : e1], of2[e2 - len(a[5]) : e2]
                data = _pack(whole, *(c[p] for c in one), *(c[q] for c in two))
                yield pa.RecordBatch.from_arrays([pa.array([block]), part["shard"].chunk(0)[:1], pa.array([data], pa.binary())], names=["block", "shard", "data"])

    return questions.repartition("shard").sortWithinPartitions("shard").mapInArrow(make, _ROWS)


def differences(one: list[np.ndarray], two: list[np.ndarray], a: np.ndarray, b: np.ndarray, totals: tuple[float, float], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss of the target less that of the background, for first words and for bigrams of the words a and b.

    one has target, background, and both again for words that another follows; two has target and background.
    """
    first, after = np.zeros(len(one[0])), np.zeros(len(a))
    for sign, k in ((-1, 0), (1, 1)):
        p = (one[k] + ADDED) / (totals[k] + ADDED * size)
        before = one[2 + k][a]
        share = np.divide(two[k], before, out=np.zeros(len(a)), where=before > 0)
        first += sign * np.log(p)
        after += sign * np.log(np.where(before > 0, BIGRAM * share + (1 - BIGRAM) * p[b], p[b]))  # after a word without a successor the unigram speaks alone
    return first, after


def score(answers: DataFrame, shards: int, size: int | None) -> DataFrame:
    """Rows (doc_id, n_tokens, cross_entropy_difference) of the blocks' documents; size is the vocabulary's if not all words count."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["block"]):
            data = dict(zip(part["shard"].to_pylist(), part["data"].to_pylist(), strict=True))
            ids, valid, n, words, w = _unpack(data.pop(min(data)))
            words, w = words.astype(np.uint64), w.astype(np.int64)
            keys, a, b, number, place = _pairs(w, n, words)
            got = [_unpack(data[s]) for s in range(shards)]
            back1, back2 = _by_shard(words, shards)[0], _by_shard(keys, shards)[0]

            def restored(k: int, back: np.ndarray, got=got) -> np.ndarray:
                out = np.empty(len(back), np.int64)
                out[back] = np.concatenate([g[k] for g in got])
                return out

            distinct, target, background = np.sum([g[0] for g in got], axis=0).tolist()
            first, after = differences([restored(k, back1) for k in (1, 2, 3, 4)], [restored(k, back2) for k in (5, 6)], a, b, (target, background), distinct + 1 if size is None else size)
            loss = first[w]
            loss[place] = after[number]
            text = np.repeat(np.arange(len(n)), n)
            mean = np.bincount(text, loss, len(n)) / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.uint64).view(np.int64), mask=valid == 0), pa.array(n), pa.array(mean.round(6))], names=["doc_id", "n_tokens", "cross_entropy_difference"])

    return answers.repartition("block").sortWithinPartitions("block").mapInArrow(make, "doc_id long, n_tokens long, cross_entropy_difference double")


def most_frequent(docs: DataFrame, vocabulary: int) -> np.ndarray:
    """Sorted hashes of the most frequent words; ties go to the smaller hash."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in textvec.blocks(batch["text"]):
                k, n = np.unique(textvec.words(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(textvec.signed(k)), pa.array(n)], names=["key", "n"])

    counts = docs.select("text").mapInArrow(make, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(vocabulary).collect()], np.int64).view(np.uint64))


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """Scores docs (doc_id, text) with models of the target documents, named by targets (doc_id), and of all others.

    Targets that are no documents, repeated or null are ignored. Null and empty texts have no tokens and a difference of 0;
    repeated rows are answered each. With ``vocabulary`` only so many of the most frequent words are told apart, the rest being
    the unknown word.
    """
    prepare(docs.sparkSession)
    known = None if vocabulary is None else most_frequent(docs, vocabulary)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    ids = targets.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct().withColumn("target", F.lit(True))
    flagged = docs.select(F.col("doc_id").cast("long"), "text").join(small_or_shuffled(ids), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    return score(answer(ask(flagged, shards, known)), shards, None if known is None else len(known) + 1)
