"""Licence scans: each line of a text against notices, by Dice over word bigrams.

DataFrame functions only, no shuffle. Dice >= t needs sizes within t / (2 - t) of each other,
so a unit's bigrams are compared only with templates of fitting size, and units outside the
bounds of all templates are dropped before any bigram is made.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import narrow

THRESHOLD = 0.8
#: Notices by licence (fixed values); a licence may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
)


def template_bigrams() -> list[tuple[str, list[str]]]:
    out = []
    for name, text in TEMPLATES:
        words = re.findall("[0-9a-z]+", text.lower())
        out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))))
    return out


def license_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_units, license, dice`` for each row: the best template (ties: last name)
    that a line matches at the threshold; null and 0 where none does, so
    also for null and empty texts. ``n_units`` counts matching lines; repeated rows give a
    row each, other columns are ignored."""
    templates = template_bigrams()
    ratio = threshold / (2 - threshold)
    least = min(len(b) for _, b in templates) * ratio
    most = max(len(b) for _, b in templates) / ratio
    every = sorted({x for _, b in templates for x in b})
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    # A repeated bigram counts once, so words have only the lower bound; length bounds the work.
    units = F.filter(lines, lambda u: F.length(u) >= least + 1)
    words = F.transform(units, lambda u: F.filter(F.split(F.lower(u), "[^0-9a-z]+"), lambda w: w != ""))
    fitting = F.filter(words, lambda w: F.size(w) >= least + 1)
    known = F.array(*map(F.lit, every))
    bigrams = F.transform(fitting, lambda w: F.array_distinct(F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    sized = F.filter(bigrams, lambda b: (F.size(b) >= least) & (F.size(b) <= most) & F.arrays_overlap(b, known))

    def best(b):
        found = []
        for name, want in templates:
            dice = 2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, want)))) / (F.size(b) + len(want))
            near = (F.size(b) >= ratio * len(want)) & (F.size(b) <= len(want) / ratio)
            found.append(F.struct(F.when(near, dice).otherwise(0.0).alias("dice"), F.lit(name).alias("license")))
        return F.array_max(F.filter(F.array(*found), lambda x: x["dice"] >= threshold))

    hits = F.filter(F.transform(sized, best), lambda x: x.isNotNull())
    top = F.array_max(F.col("hits"))
    return narrow(docs, "doc_id", "text").select("doc_id", hits.alias("hits")).select(
        "doc_id", F.size("hits").cast("long").alias("n_units"), top["license"].alias("license"),
        F.coalesce(top["dice"], F.lit(0.0)).alias("dice"))
