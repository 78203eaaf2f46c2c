"""Operator 11 against a plain count, and its SQL against its query."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from designlake.llm import divergence

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, g int"


def plain(rows, least=divergence.LEAST_DOCS):
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    n, d, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        n[lang, source].update(words(text))
        d[lang].update(set(words(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in d[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        chance = lambda k, all_: 1 + 10**9 * (k + 5) // (all_ + 5 * len(kept))  # noqa: E731, B023
        p = {s: {t: chance(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: chance(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(found[:most])]
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_plain_counts(spark):
    rng = random.Random(5)
    words = ["Ärger", "ärger", "THE", "the", "a-b", "naïve", "x9y", "日本", "of", "ÉTÉ", *(f"w{c}" for c in "abcdefgh")]
    rows = []
    for _ in range(500):
        source = rng.choice(["s1", "s2", "s3", None, ""])
        share = words if source != "s2" else words[:6]
        rows.append((" ".join(rng.choices(share, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "only nulls"), ("", "fr", "a"), ("rare word", "fr", "b"), (" \n\t--", "lone", "z"), ("the " * 50_000, "en", "s1")] + [rows[0]] * 40
    assert run(spark, rows) == plain(rows)


def test_no_kept_terms_and_empty(spark):
    rows = [("one two", "en", "a"), ("two", "en", "b"), (None, None, None)]
    assert run(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert run(spark, []) == []


def test_runs_are_intersected():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, 3, (2, n))
        coded = []
        for c in (x, y):
            start = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
            coded.append((start, c[start]))
        assert divergence.apart(*coded, n) == np.abs(x - y).sum()


def test_equal_counts_stand_together(spark):
    """Terms with the same counts in all groups are one run in each column, however they are spelt."""
    rows = [(f"a{c} z{c} m{c}".replace("a", "a" * k), "en", f"s{k % 2}") for k in range(1, 61) for c in "bcdefgh"]
    docs = spark.createDataFrame([(i, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    _, used = divergence.audited(docs)
    cols = divergence.run_lengths(used).collect()
    assert sum(r["size"] for r in cols) == 14
    assert sum(len(s) for r in cols for s in r["starts"]) <= 2 * len(cols)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = "lang, source, part, item, value, rank"
    want = con.sql(divergence.ORACLE).project(cols).fetchall()
    got = divergence.op11_source_divergence(spark, SF).selectExpr(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
