import re

from sieveline.llm import licenses
from sieveline.llm.signatures import RULES

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = ["CC-BY and cc by, CC  BY", "The GNU Lesser General Public License, version 2.1 applies. All rights reserved.",
         "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0", "cc cc by by cc by",
         "Licensed under CC BY-NC 4.0.", "general public licenses", "all rights\nreserved all rights reserved"]


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_match_brute_force(spark, documents):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(TEXTS))]
    got = licenses.scan(documents(*rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) \
        == sorted(((d, *base(t)) for d, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(documents().limit(0)).collect() == []


def test_priority_and_containment():
    detect = licenses.Scanner().detect
    labels = [f[2] for f in detect(TEXTS[1].lower())]
    assert labels == ["lgpl-2.1", "reserved"]
    assert [f[2] for f in detect(TEXTS[2].lower())] == ["apache-2.0", "apache-2.0"]
    assert [f[2] for f in detect("cc-by-sa 4.0 text")] == ["cc-by-sa-4.0"]


def test_suppression_matches_brute_force():
    text = " ".join(TEXTS).lower()
    found = sorted((-r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.confidence)
                   for r in RULES for m in re.finditer(r.pattern, text))
    kept = []
    for f in found:
        if not any(k[2] <= f[2] and k[3] >= f[3] for k in kept):
            kept.append(f)
    assert licenses.Scanner().detect(text) == sorted(f[2:] for f in kept)


def test_rules_are_many_and_each_is_gated_soundly():
    assert len(RULES) >= 200
    for r in RULES:                                            # the keyword stands in the pattern, plainly spelt
        plain = r.pattern.replace("\\", "").replace("(?:", "").replace(" ?", " ")
        assert r.keyword in plain, r


def test_very_many_places(documents):
    """Places are numbered in one walk over the text."""
    [row] = licenses.scan(documents("cc by x " * 200_000), with_spans=False).collect()
    assert (row.n_base, row.first_word, row.last_word) == (200_000, 0, 599_997)
