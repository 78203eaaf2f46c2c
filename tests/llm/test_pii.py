"""The term half of operator 1 against a plain version: scores, terms and spans of every text."""

import math
import os
import re
from collections import Counter, defaultdict

import pytest

from designlake.llm import pii

SF = "/root/testdata/sf0.01"
WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_terms(texts):
    """Spans of telling terms by text number."""
    rows_with, near, contexts, places, words = Counter(), Counter(), defaultdict(set), [], 0
    meet = defaultdict(set)
    for t in texts:
        t = t or ""
        w = [(m.start(), m.end(), m[0]) for m in WORD.finditer(lowered(t))]
        places.append(w)
        words += len(t.split())
        rows_with.update({x for _, _, x in w})
        spans, here = pii.base_spans(t), set()
        touched = {i for i, (s, e, _) in enumerate(w) for _, a, b in spans if s < b and e > a}
        for kind, a, b in spans:
            before = [i for i, (_, e, _) in enumerate(w) if e <= a]
            after = [i for i, (s, _, _) in enumerate(w) if s >= b]
            mark = tuple(w[i][2] for i in before[-3:] + after[:3])
            name = pii.entity(kind, t[a:b])
            contexts[name].add(mark)
            for i in before[-pii.NEAR :] + after[: pii.NEAR]:
                if i not in touched and len(w[i][2].encode()) >= pii.LEAST_CHARS:
                    meet[name, w[i][2]].add(mark)
                    here.add((name, w[i][2]))
        near.update(here)
    total = sum(map(len, contexts.values()))
    told = {}
    for (name, x), marks in meet.items():
        n_e, n_t, n_te, k = len(contexts[name]), rows_with[x], near[name, x], min(20, len(marks))
        score = 1 + math.log2(n_te / max(n_t, n_te)) / -math.log2(n_e / max(total, n_e + 1))
        expected = n_t * n_e * 2 * pii.NEAR / words
        if expected < 1 and expected**k / math.factorial(k) <= pii.RISK and score >= pii.GENERALISE:
            told[x] = max(told.get(x, 0), score)
    out = []
    for t, w in zip(texts, places):
        spans = pii.base_spans(t)
        out.append([(s, e) for s, e, x in w if x in told and not any(s < b and a < e for _, a, b in spans)])
    return out, told


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_terms_match_plain_version(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, told = plain_terms([d.text for d in docs])
    assert len(told) > 20
    got = {r.doc_id: re.findall(r"term:(\d+):(\d+)", r.spans) for r in pii.op1_pii_sanitisation(spark, SF).collect()}
    for d, spans in zip(docs, want):
        assert [(int(a), int(b)) for a, b in got[d.doc_id]] == spans
    scan = pii.scanned(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    scores = sorted(r.told for r in pii.telling(scan, spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert scores == pytest.approx(sorted(told.values()))


def test_names_next_to_entities_of_a_large_group(spark):
    """Two thirds of the rows are copies of one text with an entity; a rare word near another entity is still told."""
    rows = [(i, "write to boss@corp.org about common things every day", 1, 1) for i in range(400)]
    rows += [(1000 + i, " ".join(f"filler{(i * 37 + j) % 5000}" for j in range(900)), 1, 1) for i in range(400)]
    rows += [(5000, "and Marwick uses 10.1.2.3 daily", 1, 1), (None, None, 1, 1), (5001, "", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks int, of_doc int")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Marwick" not in out[5000] and "10.1.2.3" not in out[5000] and out[None] is None and out[5001] == ""
    assert out[3].startswith("write to [EMAIL]") and all(out[1000 + i] == rows[400 + i][1] for i in range(400))
