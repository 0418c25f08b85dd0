from pyspark.sql import functions as F

import corpus_pipeline
from sidetrace.llm import queries
from tests.llm.helpers import HARD, documents, prose
from tests.llm.test_scoring import BAD


def test_stages_decide(spark, tmp_path):
    d = str(tmp_path)
    item = prose(9999, 30)
    texts = [prose(i, 60) + (" " + " ".join(BAD) if i % 5 == 0 else "") for i in range(200)] + [prose(1, 60), prose(2, 60) + " end", prose(777, 90), "Some words. " + item + ". " + prose(778, 40), *HARD]
    docs = documents(spark, texts)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(0, 200)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    bad = {i for i in range(0, 200, 5)}
    same_as_before = {200, 201, 203} | {204 + 9}  # copies of 1 and 2, the leak, the second of two equal texts
    assert left == set(range(len(texts))) - bad - same_as_before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "packing"]


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    d = str(tmp_path)
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, None)])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


def test_rows_without_an_id_or_that_share_one_are_judged_by_their_texts(spark, tmp_path):
    d = str(tmp_path)
    item = prose(9999, 30)
    toxic = prose(5, 60) + " " + " ".join(BAD * 3)
    texts = [(i, prose(i, 60) + (" " + " ".join(BAD) if i % 5 == 0 else "")) for i in range(200)]
    odd = [(None, toxic), (None, prose(900, 50)), (None, prose(901, 50)), (None, prose(901, 50)), (None, "Words. " + item), (1, prose(902, 50)), (1, toxic), (2, "Words. " + item)]
    docs = documents(spark, texts + odd).withColumn("row", F.lit("clash")).repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, d).write.parquet(f"{d}/{stage.__name__}")
        left = spark.read.parquet(f"{d}/{stage.__name__}")
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(i), t) for i, t in texts + [odd[1], odd[2], odd[5]] if i is None or i % 5 or i == 1)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
