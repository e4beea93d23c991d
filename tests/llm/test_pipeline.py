"""Each stage against a plain version over the small tables; the stages in a row."""

import corpus_pipeline as cp
from emberline.llm import pii, quality
from emberline.llm.common import table as read
from tests.llm.test_jaccard import plain


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.collect()
    stages = [f for _, f in cp.STAGES]
    good = stages[0](spark, docs, sf_dir)
    assert good.columns == docs.columns
    score = {r.doc_id: r.score for r in quality.quality_scores(docs, read(spark, sf_dir, "labels")).collect()}
    kept = sorted(good.collect())
    assert kept == sorted(r for r in rows if score[r.doc_id] >= 0.5)
    single = sorted(stages[1](spark, good, sf_dir).collect())
    assert sorted(str(r.doc_id) for r in single) == sorted(i for i, _, c in plain([(r.doc_id, r.text) for r in kept]) if i == c)
    one = spark.createDataFrame(single, docs.schema)
    clean = stages[2](spark, one, sf_dir)
    items = {tuple(w[i : i + 10]) for r in read(spark, sf_dir, "benchmark").collect() for w in [words(r.text)] for i in range(len(w) - 9)}
    left = {r.doc_id: r for r in clean.collect()}
    for r in single:
        w = words(r.text)
        hit = any(tuple(w[i : i + 10]) in items for i in range(len(w) - 9))
        if not hit:
            assert left[r.doc_id].text == r.text
        elif r.doc_id in left:
            assert left[r.doc_id].text != r.text
    redacted = stages[3](spark, clean, sf_dir).collect()
    assert sorted(r.doc_id for r in redacted) == sorted(left)
    for r in redacted:
        spans = pii.find_spans([left[r.doc_id].text], pii.tagger())[0][1]
        assert (r.text == left[r.doc_id].text) == (not spans)
    final = cp.run(spark, sf_dir).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in redacted}
    assert {r.doc_id: r.size for r in final} == size and all(r.taken <= 2 * r.size for r in final)


def words(text):
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
