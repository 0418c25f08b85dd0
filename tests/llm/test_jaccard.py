import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sidetrace.llm import jaccard as J
from sidetrace.llm.common import components
from tests.llm.helpers import HARD, documents, prose


def brute(texts, n, percent):
    def grams(t):
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    s = [grams(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            i = len(s[a] & s[b])
            if s[a] and s[b] and 100 * i >= percent * (len(s[a]) + len(s[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(g), find(i)) for i, g in enumerate(s)]


def edited(seed, text, changes):
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        k = r.randrange(len(w))
        w[k : k + r.choice([0, 1])] = [r.choice(["new", "word", "zz"])] * r.choice([0, 1])
    return " ".join(w)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_equal_brute_force(spark, n, percent):
    base = [prose(i, k) for i, k in enumerate((3, 8, 15, 40, 90, 250, 600))]
    texts = [*HARD, *base]
    passage = prose(77, 60)
    for i in range(150):
        b = base[i % 7]
        texts.append(edited(i, b, i // 12) if b.split() else b)
        if i % 10 == 0:
            texts.append(passage + " " + prose(1000 + i, 20 + i))
    texts += [base[3].upper(), base[3] + " ", "one two three", "one  two\tthree"]
    docs = documents(spark, texts).withColumn("component_id", F.lit("clash")).repartition(7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(docs, n, percent).collect())
    assert got == brute(texts, n, percent)


def test_common_passages_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "COMMON", 2)
    passage = prose(5, 40)
    texts = [passage + " " + edited(i, prose(i % 12, 90), i % 7) for i in range(70)] + [passage, passage + " end", edited(1, passage, 1)] + [edited(i, prose(99, 30), i % 3) for i in range(20)]
    for percent in (60, 80, 85):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(documents(spark, texts), 4, percent).collect())
        assert got == brute(texts, 4, percent)


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_ROWS", 7)
    texts = [edited(i, prose(1, 120), i % 9) for i in range(60)] + [prose(2, 50)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(documents(spark, texts), 4, 85).collect())
    assert got == brute(texts, 4, 85)


def test_odd_rows(spark):
    docs = documents(spark, [(7, "a b c d e"), (7, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, None), (None, None)])
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_join(docs, 4, 85).collect())
    assert rows == [("3", 2, "3"), ("4", 0, "4"), ("7", 2, "3"), ("7", 2, "3"), ("None", 0, "None"), ("None", 2, "None")]
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_blocks_are_a_pigeonhole():
    r = np.random.default_rng(2)
    every = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    for percent, common in [(p, c) for p in (50, 80, 85, 95, 100) for c in (None, every)]:
        cut = J.Blocks(percent, common)
        for _ in range(400):
            size = int(r.integers(1, 300))
            x = np.unique(np.concatenate([r.integers(0, 2**63, size).astype(np.uint64), r.choice(every, int(r.integers(0, size + 1)))]))
            drop = int(r.integers(0, len(x)))
            y = np.unique(np.concatenate([x[drop * (100 - percent) // 100 :], r.integers(0, 2**63, int(r.integers(0, 1 + size * (100 - percent) // 100))).astype(np.uint64)]))
            i = len(np.intersect1d(x, y))
            if len(y) and 100 * i >= percent * (len(x) + len(y) - i):
                assert len(np.intersect1d(cut.keys(x), cut.keys(y)))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_with_an_empty_tile_count_once(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_GRAMS", 60)
    texts = [t for i in range(12) for t in (prose(i, 60), prose(i, 60) + " end")]
    rows = J.jaccard_join(documents(spark, texts)).collect()
    assert [r.n_links for r in rows] == [1] * 24 and all(r.component_id == r.doc_id - r.doc_id % 2 for r in rows)


def test_combined_keys_join_the_same_names():
    r = np.random.default_rng(4)
    keys, names = r.integers(0, 60, 400), r.integers(0, 90, 400)
    k, s = J.combined(keys, names)

    def groups(keys, names):
        root = J.roots(1000, names, keys + 500) if len(keys) else []
        return {tuple(sorted(x for x in set(names.tolist()) if root[x] == c)) for c in set(root[names].tolist())}

    _, small = np.unique(k, return_inverse=True)
    assert groups(keys, names) == groups(small, s)
    assert np.bincount(small).max() <= 2 and len(J.combined(keys[:0], names[:0])[0]) == 0


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_block_keys_are_shuffled_narrow(spark):
    texts = [prose(i, 400) for i in range(400)]
    keys = sum(len(J.Blocks(80).keys(g)) for _, g in J.sets(pa.array(texts), 5))
    docs, before = documents(spark, texts), shuffled(spark)
    assert J.candidates(docs, 5, 80, np.zeros(0, np.uint64)).collect() == []
    assert shuffled(spark) - before < 13 * keys


def test_rounds_lose_nothing_and_shuffle_candidates_only(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 400, raising=False)
    monkeypatch.setattr(J.small_or_shuffled, "__defaults__", (400,))
    monkeypatch.setattr(J, "TILE_ROWS", 7)
    texts = [edited(i, prose(1, 120), i % 9) for i in range(60)] + [edited(i, prose(2 + i // 3, 60), i % 3) for i in range(30)]
    alone = [prose(100 + i, 20) + " " + "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=40_000)) for i in range(40)]
    docs, before = documents(spark, texts + alone), shuffled(spark)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(docs, 4, 85).collect())
    assert got == brute(texts + alone, 4, 85)
    assert shuffled(spark) - before < sum(map(len, alone)) // 2


def test_sets_of_one_name_are_compared(spark, monkeypatch):
    monkeypatch.setattr(J, "NAME", 0, raising=False)
    texts = [edited(i, prose(i % 5, 80), i % 3) for i in range(20)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(documents(spark, texts), 4, 85).collect())
    assert got == brute(texts, 4, 85)


def test_packed_keys_come_back():
    r = np.random.default_rng(6)
    keys, names = np.sort(r.integers(0, 1 << 40, 500).astype(np.uint64)), r.integers(0, 1 << 40, 500)
    k, s = J.unpacked(J.packed(keys, names))
    assert (k == keys.astype(np.int64)).all() and (s == names).all()
