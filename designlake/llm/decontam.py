"""Operator 5, benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Benchmark items are taken in blocks of at most `BLOCK` (so what is shipped to tasks has a fixed bound, and a
larger benchmark means more passes). Every n-gram of an item is a seed, however many documents it occurs in, so no copy is
missed for where it was edited or how often its item leaked. Where a document has a seed of an item, the item is
aligned with the words around the seeds' diagonals, unless these hold too few of its words to reach the score (a
bound that no alignment can beat, so common seeds cost little and lose nothing); the score is the alignment's share
of a perfect one.

Words are runs of ASCII letters, digits and other non-ASCII characters of the lower-cased text, so case and
punctuation do not hide a copy.

Defined cases: null and empty texts match nothing; an item with fewer words than a seed is searched by all its
words as one seed; items without words never match; repeated rows are judged each; an empty benchmark or document
table gives an empty result; of equal scores in a document the first place is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh
from .textvec import batches, ngram_hashes, words

SEED = 3
BLOCK = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5
FILTER_BITS = 20


class Items:
    """A block of benchmark items: word hashes, and the seeds as sorted hashes with item and place."""

    def __init__(self, ids: list, texts: list[str | None]):
        low = [(t or "").lower().encode() for t in texts]
        h, first = words(low) if low else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.ids, self.words = ids, [h[a:b] for a, b in zip(first[:-1], first[1:])]
        seeds = [ngram_hashes(w, min(SEED, len(w)) or 1) for w in self.words]
        item = np.repeat(np.arange(len(ids)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds] or [np.zeros(0, np.int64)])
        seed = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.keys = np.unique(self.seed)
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < SEED})
        self.vocabulary = [np.unique(w) for w in self.words]
        # passes few others than the seeds
        self.bitmap = np.zeros(1 << FILTER_BITS, bool)
        self.bitmap[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def found(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in w where a seed starts, and the seed's number in keys."""
        at, which = [], []
        for n in (*self.short, SEED):
            g = ngram_hashes(w, n)
            p = np.flatnonzero(self.bitmap[g >> np.uint64(64 - FILTER_BITS)])
            k = np.minimum(np.searchsorted(self.keys, g[p]), max(0, len(self.keys) - 1))
            ok = self.keys[k] == g[p] if len(self.keys) else np.zeros(len(p), bool)
            at.append(p[ok])
            which.append(k[ok])
        return np.concatenate(at), np.concatenate(which)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the end of it in text (exclusive), with linear gap costs."""
    h = np.zeros(len(text) + 1, np.int64)
    ramp = -GAP * np.arange(len(text) + 1)
    best = end = 0
    for x in item:
        new = np.maximum(h + GAP, 0)
        np.maximum(new[1:], h[:-1] + np.where(text == x, MATCH, MISMATCH), out=new[1:])
        h = np.maximum.accumulate(new + ramp) - ramp
        j = int(h.argmax())
        if h[j] > best:
            best, end = int(h[j]), j
    return best, end


def may_reach(vocabulary: np.ndarray, text: np.ndarray, m: int, score: float) -> bool:
    """Whether some part of text has enough words of an item of m words for an alignment of that share: score * m of them
    must match, and as each other word of the part costs 1 of at most 2 * m, the part has at most (3 - 2 * score) * m words."""
    k = np.minimum(np.searchsorted(vocabulary, text), len(vocabulary) - 1)
    n = np.r_[0, np.cumsum(vocabulary[k] == text)]
    span = min(len(text), int(np.ceil((3 - 2 * score) * m)))
    return bool((n[span:] - n[: len(n) - span]).max() >= score * m)


def matches(w: np.ndarray, at: np.ndarray, which: np.ndarray, items: Items, score: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end) of the items that w contains; at, which: seeds found in w."""
    lo = np.searchsorted(items.seed, items.keys[which])
    n = np.searchsorted(items.seed, items.keys[which], side="right") - lo
    pos = np.repeat(at, n)
    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, start = items.item[k], pos - items.place[k]
    order = np.lexsort((start, item))
    item, start, out = item[order], start[order], []
    i = 0
    while i < len(item):
        m = len(items.words[item[i]])
        j = i + 1
        while j < len(item) and item[j] == item[i] and start[j] - start[j - 1] <= m // 2:
            j += 1
        a, b = max(0, int(start[i]) - m // 2), min(len(w), int(start[j - 1]) + m + m // 2)
        got, end = align(items.words[item[i]], w[a:b]) if may_reach(items.vocabulary[item[i]], w[a:b], m, score) else (-1, 0)
        if got >= score * MATCH * m:
            _, back = align(items.words[item[i]][::-1], w[a : a + end][::-1])
            new = (int(item[i]), got / (MATCH * m), a + end - back, a + end)
            if out and out[-1][0] == new[0]:
                if new[1] > out[-1][1]:
                    out[-1] = new
            else:
                out.append(new)
        i = j
    return out


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[Items]:
    """Blocks of items, each small enough for the driver."""
    n = benchmark.count()
    parts = -(-n // size)
    for p in range(parts):
        rows = (benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)).select("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


def _texts(s: pd.Series) -> list[bytes]:
    return [t.lower().encode() if t else b"" for t in s]


def matcher(items: Items, score: float = SCORE):
    """A pandas UDF from text to the array of its matches with the block's items."""
    ids = [None if x is None else str(x) for x in items.ids]

    @F.pandas_udf("array<struct<item_id:string,score:double,first_word:long,end_word:long>>")
    def find(text: pd.Series) -> pd.Series:
        t, out = _texts(text), []
        for lo, hi in batches(t):
            w, first = words(t[lo:hi])
            at, which = items.found(w)
            order = np.argsort(at, kind="stable")
            at, which = at[order], which[order]
            cut = np.searchsorted(at, first)
            for d in range(hi - lo):
                i, j = cut[d], cut[d + 1]
                out.append([] if i == j else [{"item_id": ids[k], "score": s, "first_word": a, "end_word": b} for k, s, a, b in matches(w[first[d] : first[d + 1]], at[i:j] - first[d], which[i:j], items, score)])
        return pd.Series(out, dtype=object)

    return find


def found(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, block: int = BLOCK) -> tuple[DataFrame, str]:
    """docs with one more column: the array of matches (item_id, score, first_word, end_word)."""
    name = fresh(docs, "matches")
    column = None
    for items in blocks(benchmark, block):
        one = matcher(items, score)(F.col("text"))
        column = one if column is None else F.concat(column, one)
    if column is None:
        column = F.array().cast("array<struct<item_id:string,score:double,first_word:bigint,end_word:bigint>>")
    return docs.withColumn(name, column), name


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with their own columns."""
    df, name = found(docs, benchmark)
    return df.where(F.size(name) == 0).drop(name)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    df, name = found(docs.select("doc_id", "text"), bench)
    rows = df.select("doc_id", F.explode(name).alias("m"))
    return rows.select("doc_id", F.col("m.item_id").cast(bench.schema["item_id"].dataType).alias("item_id"), "m.score", "m.first_word", "m.end_word")
