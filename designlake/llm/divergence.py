"""Operator 11, source divergence audit: how far the word use of a language's sources lies apart, by run-length columns.

Every (lang, source) group gives each kept term of its language a smoothed chance in parts of 10 ** 9; two groups
differ by the sum of |p - q| over all kept terms. The vocabulary of a language is put in the order of the terms' count
vectors, so that equal counts of a group stand together; each stretch of that order is stored as run-length columns, one
a group, and a pair of groups is compared by intersecting the boundaries of their runs and multiplying each difference
by the length of the common run. Terms that a group lacks are runs of its smallest chance and cost nothing by term.

One scan counts terms within each task before anything is shuffled; stretches are ranges of the ordered vocabulary,
dealt over tasks, and a task holds one Arrow batch of it. All arithmetic is on integers; chances are decimals of 38
digits until they are rounded down.

Defined cases: a null text, lang or source is an empty one; groups without terms have pairs and no terms; a language
without kept terms has pairs of value 0, a language with one source has no pairs; repeated rows count each; long texts
are read whole; an empty table gives an empty result; only text, lang and source are read, other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

#: The fewest documents of a language that hold a kept term, what is added to each count, and the terms told of a group.
LEAST_DOCS, SMOOTH, TOP = 30, 5, 50
#: The most terms that a task counts before it hands its counts on.
HELD = 1 << 18
# everything but ASCII letters and bytes of other characters parts terms
LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(LETTERS).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), summed; a null term with zeros for each group."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0

        def out() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, d) in held.items():
                yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *(t.decode() for t in n)], "n": [0, *n.values()], "d": [0, *(d[t] for t in n)]})

        for p in parts:
            for lang, source, text in zip(p["lang"], p["source"], p["text"]):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                words, was = terms(text), len(n)
                n.update(words)
                d.update(set(words))
                size += len(n) - was
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return read.mapInPandas(run, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def chance(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10 ** 9 * (n + SMOOTH) / (total + SMOOTH * terms)), exact for any counts below 10 ** 18."""
    up = (n + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", up, (total + F.lit(SMOOTH) * terms).cast("decimal(20,0)"))


def audited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups: lang, source, g (its place in its language), zero (the chance of a term that it lacks), n_groups.
    used: lang, source, g, term, p, q of each kept term that a group has. Both are written tables."""
    counts = cut(term_counts(docs), "terms")
    vocabulary = cut(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("d")).where(F.col("d") >= LEAST_DOCS).drop("d"), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    kept = counts.where("term is not null").join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "all_total"])
    # few distinct counts first: the order by vectors then leaves fewer runs
    lang = Window.partitionBy("lang")
    zero = F.when(F.col("v") > 0, chance(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    groups = cut(groups.select("*", (F.row_number().over(lang.orderBy("total", "source")) - 1).alias("g"), F.count("*").over(lang).alias("n_groups"), zero.alias("zero")), "groups")
    each = kept.join(groups, ["lang", "source"])
    p, q = chance(F.col("n"), F.col("total"), F.col("v")), chance(F.col("all_n"), F.col("all_total"), F.col("v"))
    return groups, cut(each.select("lang", "source", "g", "term", p.alias("p"), q.alias("q")), "used")


def run_lengths(used: DataFrame) -> DataFrame:
    """lang, size, g, starts, chances: stretches of the ordered vocabulary; the columns of the groups g that have a term
    in it, each as where its runs start and the chance of each run, 0 for terms that the group lacks."""
    v = used.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p"))).alias("vector"))
    ordered = v.repartitionByRange("lang", "vector", "term").sortWithinPartitions("lang", "vector", "term")
    ordered = ordered.select("lang", F.col("vector.g").alias("g"), F.col("vector.p").alias("p"))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            names = np.array(b.column("lang").to_pylist(), object)
            edge = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            rows = {"lang": [], "size": [], "g": [], "starts": [], "chances": []}
            for lo, hi in zip(edge, edge[1:]):
                if hi == lo:
                    continue
                g, p = b.column("g").slice(lo, hi - lo), b.column("p").slice(lo, hi - lo)
                at = np.repeat(np.arange(hi - lo), g.value_lengths().to_numpy())
                g, p = g.flatten().to_numpy(), p.flatten().to_numpy()
                by = np.argsort(g, kind="stable")
                cols = np.split(by, np.flatnonzero(np.diff(g[by])) + 1)
                rows["lang"].append(names[lo])
                rows["size"].append(hi - lo)
                rows["g"].append([int(g[c[0]]) for c in cols])
                found = []
                for c in cols:
                    x = np.zeros(hi - lo, np.int64)
                    x[at[c]] = p[c]
                    start = np.r_[0, np.flatnonzero(np.diff(x)) + 1]
                    found.append((start.astype(np.int32), x[start]))
                rows["starts"].append([s for s, _ in found])
                rows["chances"].append([x for _, x in found])
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("lang", pa.string()), ("size", pa.int32()), ("g", pa.list_(pa.int32())), ("starts", pa.list_(pa.list_(pa.int32()))), ("chances", pa.list_(pa.list_(pa.int64())))]))

    return ordered.mapInArrow(encode, "lang string, size int, g array<int>, starts array<array<int>>, chances array<array<long>>")


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """The sum of |p - q| over a stretch, from the runs (starts, chances) of two columns."""
    start = np.union1d(a[0], b[0])
    f = np.abs(a[1][np.searchsorted(a[0], start, "right") - 1] - b[1][np.searchsorted(b[0], start, "right") - 1])
    return int((f * np.diff(np.r_[start, size])).sum())


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the distance of each two groups a < b (by g) of a language with kept terms."""
    zeros = cut(groups.where("zero is not null").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("g", "zero")))["zero"].alias("zeros")), "zeros")

    def intersect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lang, size, g, starts, chances, zeros in zip(p["lang"], p["size"], p["g"], p["starts"], p["chances"], p["zeros"]):
                have = {int(k): (np.asarray(s), np.where(np.asarray(x) == 0, zeros[k], x)) for k, s, x in zip(g, starts, chances)}
                for a in range(len(zeros)):
                    later = zeros[a + 1 :]
                    if a in have:
                        s, x = have[a]
                        value = (np.abs(x[:, None] - later[None, :]) * np.diff(np.r_[s, size])[:, None]).sum(axis=0)
                    else:
                        value = np.abs(later - zeros[a]) * size
                    own = have.get(a, (np.zeros(1, np.int64), zeros[a : a + 1]))
                    for b, other in have.items():
                        if b > a:
                            value[b - a - 1] = apart(own, other, size)
                    yield pd.DataFrame({"lang": lang, "a": np.int32(a), "b": np.arange(a + 1, len(zeros), dtype=np.int32), "value": value})

    parts = columns.join(zeros, "lang").select("lang", "size", "g", "starts", "chances", "zeros")
    return parts.mapInPandas(intersect, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: of each group its distance to every other source of its language (part
    pair), and the TOP terms that it uses more than its language does (part term)."""
    groups, used = audited(docs)
    sums = pair_sums(run_lengths(used), groups)
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pairs = groups.select("lang", "source", F.col("g").alias("a")).join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    more = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(pairs).unionByName(ranked(more).where(F.col("rank") <= TOP))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = lambda n, total, v: f"CAST(1 + (1000000000::HUGEINT * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * {v}) AS BIGINT)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vo AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
la AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM vo GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN vo USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, all_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) USING (lang, source) LEFT JOIN la USING (lang)),
c AS (SELECT g.lang, g.source, vo.term, coalesce(n.n, 0) AS n, {_P("coalesce(n.n, 0)", "g.total", "g.v")} AS p, {_P("all_n", "all_total", "g.v")} AS q FROM g JOIN vo USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = vo.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM c x JOIN c y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM c WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a QUALIFY part = 'pair' OR rank <= {TOP}"""
