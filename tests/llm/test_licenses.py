"""Licence scan against a plain loop."""

import re

from emberline.llm.licenses import license_scan, template_bigrams


def brute(text):
    found = []
    for line in (text or "").split("\n"):
        words = re.findall("[0-9a-z]+", line.lower())
        own = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        scores = [(2 * len(own & set(b)) / (len(own) + len(b)), name) for name, b in template_bigrams()]
        if max(scores)[0] >= 0.8:
            found.append(max(scores))
    return len(found), max(found)[1] if found else None, max(found)[0] if found else 0.0


def test_scan(spark, table):
    rows = [(1, None, 1), (2, "", 1), (2, "x\nReleased under the  MIT licence.", 1), (3, "a\nreleased under the MIT LICENSE", 1), (None, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0", 1), (5, "license " * 5000, 1)]
    got = license_scan(table(rows, "doc_id long, text string, dice int")).collect()
    assert [(r.n_units, r.license, round(r.dice, 9)) for r in got] == [(n, x, round(d, 9)) for n, x, d in (brute(t) for _, t, _ in rows)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert all((got[i].n_units, got[i].license) == want[i][:2] for i in want) and any(w[0] for w in want.values())
    assert license_scan(docs.limit(0)).count() == 0
