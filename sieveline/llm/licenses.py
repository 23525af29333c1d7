"""License scans by ordered signature rules.

Each text is lower-cased; a rule's pattern is tried only where the text holds
the rule's keyword. Detections are taken by priority, then length: one that
lies inside an interval already taken is suppressed, so ``GNU Lesser General
Public License v2.1`` isn't also a plain GPL notice.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER_BYTES, WORD_BYTES, map_texts, read, utf8
from .registry import query
from .signatures import RULES

# The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
BASE_CONFIDENCE = 0.6


class Scanner:
    def __init__(self, rules=tuple(RULES)):
        self.by_keyword: dict[str, list] = {}
        for rule in rules:
            self.by_keyword.setdefault(rule.keyword, []).append((rule, re.compile(rule.pattern)))

    def detect(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, confidence) of the detections that stand, in order of place."""
        found = []
        for keyword, rules in self.by_keyword.items():
            if keyword in text:
                found += [(-r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.confidence)
                          for r, p in rules for m in p.finditer(text) if m.end() > m.start()]
        found.sort()
        starts = sorted({f[2] for f in found})
        reach = [0] * (len(starts) + 1)                        # a prefix-maximum tree: the furthest end by start
        taken = []
        for _, _, a, b, label, sure in found:
            i, end = bisect_right(starts, a), 0
            while i:
                end, i = max(end, reach[i]), i & (i - 1)
            if end >= b:
                continue
            taken.append((a, b, label, sure))
            i = bisect_right(starts, a)
            while i <= len(starts):
                reach[i] = max(reach[i], b)
                i += i & -i
        return sorted(taken)


def scan(docs: DataFrame, with_spans: bool = True) -> DataFrame:
    """Counts, labels and detections of each row of ``docs``.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` and ``detections`` (character spans in the lower-cased text). A
    null text is empty: no words, no labels, a score of 0. Ties between rules
    go by place, then label; repeated rows are scanned each.
    """
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
    names = [f.split()[0] for f in schema.split(", ")]
    if with_spans:
        schema += ", detections array<struct<start:int,end:int,label:string,confidence:double>>"
    phrases = [(f" {p} ".encode(), label) for p, label in BASE]
    box: list[Scanner] = []
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()),
                               ("confidence", pa.float64())]))

    def row(doc_id, raw: bytes) -> dict:
        words = raw.translate(WORD_BYTES).split()
        flat = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in phrases:
            at, last, word = flat.find(phrase), 0, 0
            while at >= 0:
                word += flat.count(b" ", last, at)             # blanks since the place before: all places in one walk
                places.append(word)
                base.add(label)
                last, at = at, flat.find(phrase, at + 1)
        found = box[0].detect(raw.translate(LOWER_BYTES).decode())
        doubt = (1 - BASE_CONFIDENCE) ** len(base)
        for _, sure in sorted({f[2:] for f in found}):
            doubt *= 1 - sure
        return {"doc_id": doc_id, "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
                "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(base | {f[2] for f in found})), "score": 1 - doubt,
                "detections": [dict(zip(("start", "end", "label", "confidence"), f)) for f in found]}

    def step(batch):
        if not box:
            box.append(Scanner())
        rows = [row(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")))]
        made = {n: [r[n] for r in rows] for n in names}
        kinds = {"doc_id": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        out = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in made.items()}
        if with_spans:
            out["detections"] = pa.array([r["detections"] for r in rows], kind)
        return out

    return map_texts(docs, ["doc_id", "text"], schema, step)


@query("op6_licenses")
def op6(spark, sf):
    return scan(read(spark, sf, "documents"), with_spans=False)
