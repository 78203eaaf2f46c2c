"""Operator 12 against all pairs of words."""

import binascii
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from designlake.llm import variants

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n int"


def plain_counts(rows):
    n = Counter()
    for d, t in rows:
        for m in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
            h = binascii.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = plain_counts(rows)
    near = {w: [] for w in n}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [o for k in (-1, 0, 1) for o in by_size.get(len(w) + k, ()) if one_edit(w, o)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in variants.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def made(rng, words, texts, most):
    return [(rng.choice([i, i, None]), " ".join(w if rng.random() > 0.2 else w[:3] + rng.choice("xyé") + w[3 + rng.randint(0, 1) :] for w in rng.choices(words, k=rng.randint(0, most)))) for i in range(texts)]


def test_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(300)]
    words += ["Größen", "GRÖSSEN", "größen", "×××÷÷÷", "naïveté", "wordwordword", "wordwordworx", "q" * 300, "q" * 301, "q" * 299 + "z"] * 20
    rows = made(rng, words, 150, 200) + [(None, None), (1, ""), (2, " \n--12"), (3, "日本語日本語 ok"), (4, "longest " * 5000), *[(5, "repeated rowses")] * 9]
    rows += [(7, "ladderx " * 6 + "ladderxy " * 40 + "ladderxyz " * 300)]
    want = plain(rows)
    assert run(spark, rows) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f and f != r for _, f, r, *_ in want)


def test_parts_larger_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(variants, "WORDS", 8)
    rng = random.Random(12)
    rows = made(rng, ["abcabc" + "".join(rng.choices("abcd", k=3)) for _ in range(60)] + ["".join(rng.choices("ab", k=7)) for _ in range(60)], 80, 150)
    m = variants.members(spark.createDataFrame(list(plain_counts(rows).items()), "word string, n long"))
    assert m.where("x >= 0").count() and m.groupBy("m", "last", "bucket", "x", "y").count().agg({"count": "max"}).first()[0] < 60
    assert run(spark, rows) == plain(rows)


def test_recurrences():
    rng = np.random.default_rng(4)
    for m in (6, 7):
        words = {"".join(rng.choice(list("ab"), m + int(rng.integers(0, 2)))) for _ in range(150)}
        words = sorted(words)
        x = np.frombuffer(b"".join(w.encode().ljust(m + 1, b"\0") for w in words), np.uint8).reshape(-1, m + 1)
        short = np.array([len(w) == m for w in words])
        (ra, rb), (ia, ib) = variants.near(x[short], x, m)
        own = np.flatnonzero(short)
        got = {(words[own[a]], words[b]) for a, b in zip(np.r_[ra, ia], np.r_[rb, ib])}
        assert got == {(a, b) for a in words if len(a) == m for b in words if one_edit(a, b)}
        assert len(got) == len(ra) + len(ia)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), (1, "short")]) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_on_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = variants.op12_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
