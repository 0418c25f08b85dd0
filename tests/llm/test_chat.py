import hashlib

from pyspark.sql import functions as F

from sidetrace.llm import chat
from sidetrace.llm import queries as Q

MESSAGE = "tree long, id long, parent long, role string, text string, score double"


def paths(spark, rows, top=1):
    return sorted(tuple(r) for r in chat.paths(spark.createDataFrame(rows, MESSAGE), top).select("tree", "rank", "depth", "id").collect())


def test_branches_are_ranked_by_mean_score(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 0.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 20.0), (1, 5, 3, "user", "d", None)]
    assert paths(spark, rows) == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 4)]
    assert paths(spark, rows, 9) == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 4), (1, 2, 0, 1), (1, 2, 1, 3), (1, 2, 2, 5)]


def test_ties_cycles_orphans_repeats_nulls(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "b", 1.0),
        (2, 1, 2, "user", "x", 1.0), (2, 2, 1, "user", "y", 1.0), (3, 5, 99, "user", "z", 1.0), (4, 6, 6, "user", "self", 1.0), (None, 1, None, "user", "q", 1.0), (5, None, None, "user", "q", 1.0),
    ]
    assert paths(spark, rows) == [(1, 1, 0, 1), (1, 1, 1, 2), (3, 1, 0, 5), (4, 1, 0, 6)]
    assert paths(spark, rows[:0]) == []
    long = [(1, i, i - 1 if i else None, "user", "t", 0.0) for i in range(70)]
    assert [r[3] for r in paths(spark, long)] == list(range(70))


def test_escapes_are_undone(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<\\/s>", "a<s></s>\\n\n", "<<s>>[[INST]]", "", None, "é日本\\", "[/INST"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in (r.e or "") for c in chat.CONTROLS)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        learn = "".join(t or "" for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learn), hashlib.sha256(learn.encode()).hexdigest())
    return out


def test_conversations_read_back(spark, tmp_path):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST]\\ yes\n"), (1, 2, None, None), (2, 5, "assistant", None), (2, 1, "system", "é"), (3, 0, "user", "x" * 50000), (3, 0, "user", "x" * 50000), (3, 1, "assistant", "日本</s>")]
    rows += [(None, 1, "assistant", "none"), (None, 0, "user", "of them")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.op1_chat(spark, str(tmp_path)).collect()}
    assert got == expected(rows + [(-1, 0, "user", Q.CONTROL_TEXT), (-1, 1, "assistant", Q.CONTROL_TEXT)])
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in Q.op1_chat(spark, f"{tmp_path}/none").collect()] == [-1]
