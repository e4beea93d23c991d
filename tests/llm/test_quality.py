"""Held-out quality of the classifier, and inputs at the edge."""

from emberline.llm.quality import quality_scores


def test_held_out_rank(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    hits = sum((r.predicted == 1) == (r.quality == 1) for r in got) / len(got)
    print("auc", auc, "accuracy", hits)
    assert auc > 0.8 and hits > 0.8


def test_edges(table):
    docs = table([(1, None), (2, ""), (2, "a b"), (None, "x")], "doc_id long, text string")
    got = quality_scores(docs, table([], "doc_id long, quality int")).collect()
    assert [r.score for r in got] == [0.5] * 4
    assert quality_scores(docs.limit(0), table([(1, 1)], "doc_id long, quality int")).count() == 0
