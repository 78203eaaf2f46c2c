"""Operator 10, exact substring dedup over bytes: every byte covered by a `length`-byte string that also starts elsewhere.

The method named for it merges the Burrows-Wheeler transforms of shards by interleave refinement: a pass over all
symbols for each of `length` prefix lengths, each with a shuffle of the whole interleave (or all pairs of shards).
That cannot meet any budget that grows with the input alone, so repeated intervals are refined another way here
(the README says so): coarse names of strings first, and single strings only where coarse names disagree.

1. Equal texts are merged; a text with copies is itself repeated.
2. Every `length`-byte window has an anchor, its `gram`-byte substring of least hash, so equal windows have equal
   anchors. Windows in a row with one anchor form a zone of at most 2 * length bytes. Zones are named by the hash
   of their bytes and the anchor's place: a zone whose name occurs twice is repeated as a whole. A zone without a
   second name for its core (here the anchor; what all windows of it contain) has nothing else to find.
3. Where one core has several names, one zone of each name is cut into blocks of `BLOCK` windows by their distance
   from the anchor. Blocks are named and judged likewise, by the bytes that all windows of a full block contain.
4. What is still open is refined to single windows, which are counted by hash. A window found twice is repeated.

No step lists pairs or gathers a group: names are counted with partial aggregation, and the shuffled rows are one
per zone, about 2 / length of the bytes, and few more where near copies differ. Hashes have 64 bits.

Defined cases: null and empty texts have no bytes and nothing removed; repeated rows are copies of each other;
copies shorter than `length` stay; an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, forget
from .textvec import SECOND, batches, mix, prefix_sums, span_hashes

LENGTH = 200
GRAM = 32
BLOCK = 16


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each run of width entries; the last of equal ones."""
    low, at, span = h, np.arange(len(h)), 1

    def join(step: int) -> None:
        nonlocal low, at
        n = len(low) - step
        right = low[step:] <= low[:n]
        low, at = np.where(right, low[step:], low[:n]), np.where(right, at[step:], at[:n])

    while span * 2 <= width:
        join(span)
        span *= 2
    if width > span:
        join(width - span)
    return at


def zones(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Each zone's text number, first and last window and anchor (places in the text), core and name."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    if len(b) < length:
        return empty
    s = prefix_sums(b)
    lo = np.arange(len(b) - gram + 1)
    h = span_hashes(s, lo, lo + gram)
    at = least_places(h, length - gram + 1)
    w = np.arange(len(at))
    text = np.repeat(np.arange(len(texts)), size)[: len(at)]
    whole = w + length <= ends[text]
    w, at, text = w[whole], at[whole], text[whole]
    if not len(w):
        return empty
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first, last, anchor, text = w[new], w[np.r_[new[1:] - 1, len(w) - 1]], at[new], text[new]
    base = (ends - size)[text]
    return text, first - base, last - base, anchor - base, h[anchor], _name(s, first, last, anchor, length)


def _name(s: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Hash of the bytes of windows first to last, and of their places against the anchor."""
    return mix(span_hashes(s, first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))


def _cut_up(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of n parts each: every part's item, and its number in the item."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - (np.cumsum(n) - n)[item]


def blocks(texts: list[bytes], of: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int, block: int) -> tuple[np.ndarray, ...]:
    """Windows lo to hi of anchors at in the texts numbered of, cut by distance from the anchor: text, first, last, anchor,
    core, name. Of single windows (block 1) the core is a second hash of the same bytes."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    base = (np.cumsum(size) - size)[of]
    lo, hi, at = lo + base, hi + base, at + base
    near, far = (at - hi) // block, (at - lo) // block
    item, k = _cut_up(far - near + 1)
    j = near[item] + k
    a = at[item]
    first, last = np.maximum(lo[item], a - (j + 1) * block + 1), np.minimum(hi[item], a - j * block)
    s = prefix_sums(raw)
    if block == 1:
        core = span_hashes(prefix_sums(raw, SECOND), first, first + length)
    else:
        core = mix(span_hashes(s, a - j * block, a - (j + 1) * block + 1 + length) + j.astype(np.uint64))
    name = _name(s, first, last, a, length)
    base = base[item]
    return of[item], first - base, last - base, a - base, core, name


def merged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash of the text), and the distinct texts (key, hash, copies, n_bytes, bytes: compressed)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.md5(text).alias("hash"), text.alias("bytes"))
    # the texts go through the shuffle once; a partial aggregation would sort them on both sides of it
    texts = rows.groupBy("hash").agg(F.count("*").alias("copies"), F.any_value("bytes").alias("bytes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor().compress
        for p in parts:
            p["n_bytes"] = [len(x) for x in p["bytes"]]
            p["bytes"] = [squeeze(x) for x in p["bytes"]]
            yield p

    # later joins move the texts again, so they stay compressed
    texts = texts.mapInPandas(run, "hash string, copies long, bytes binary, n_bytes long")
    return rows.select("doc_id", "hash"), cut(texts.withColumn("key", F.monotonically_increasing_id()), "texts")


def unpacked(column: pd.Series) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column]


ROWS = "key long, lo int, hi int, at int, core long, name long"


def _frame(key, lo, hi, at, core, name) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "at": at.astype(np.int32), "core": core.view(np.int64), "name": name.view(np.int64)})


def _zone_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t, key = unpacked(p["bytes"]), p["key"].to_numpy()
            for a, b in batches(t):
                text, *zone = zones(t[a:b], length, gram)
                yield _frame(key[a:b][text], *zone)

    return texts.select("key", "bytes").mapInPandas(run, ROWS)


def _finer_rows(texts: DataFrame, length: int, block: int) -> DataFrame:
    """texts (key, bytes, asked: array of lo, hi, at) to rows of their blocks; of single windows if block is 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t, key = unpacked(p["bytes"]), p["key"].to_numpy()
            lo, hi, at = (p[c].to_numpy() for c in ("lo", "hi", "at"))
            n = np.array([len(x) for x in lo], np.int64)
            for a, b in batches(t):
                of = np.repeat(np.arange(b - a), n[a:b])
                text, *rows = blocks(t[a:b], of, *(np.concatenate(x[a:b]).astype(np.int64) for x in (lo, hi, at)), length, block)
                yield _frame(key[a:b][text], *rows)

    return texts.select("key", "bytes", *[F.col(f"asked.{c}").alias(c) for c in ("lo", "hi", "at")]).mapInPandas(run, ROWS)


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows to those whose name occurs twice (key, lo, hi), and those to refine by text: one of each name of a mixed core."""
    names = cut(rows.groupBy("core", "name").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi", "at")).alias("first")), "names")
    mixed = names.groupBy("core").agg(F.count("*").alias("names")).where("names > 1").select("core")
    ask = names.join(mixed, "core", "left_semi").select("first.*")
    ask = cut(ask.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("asked")), "asked")
    twice = cut(rows.select("key", "lo", "hi", "core", "name").join(names.where("n > 1").select("core", "name"), ["core", "name"], "left_semi").select("key", "lo", "hi"), "twice")
    forget(names, rows)
    return twice, ask


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the intervals lo to hi."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return lo[new], hi[np.r_[new[1:] - 1, len(hi) - 1]]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash), and per hash of a text: n_bytes, starts and ends of the removed runs, kept_sha256."""
    rows, texts = merged(docs)
    z = cut(_zone_rows(texts.where(F.col("n_bytes") >= length), length, gram), "zones")
    found, ask = _judged(z)
    z = cut(_finer_rows(texts.join(ask, "key"), length, block), "blocks")
    more, ask = _judged(z)
    z = cut(_finer_rows(texts.join(ask, "key"), length, 1), "windows")
    twice = z.groupBy("core", "name").agg(F.count("*").alias("n")).where("n > 1").select("core", "name")
    found = found.unionByName(more).unionByName(z.join(twice, ["core", "name"], "left_semi").select("key", "lo", "hi"))
    found = found.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for b, n, lo, hi in zip(unpacked(p["bytes"]), p["copies"], p["lo"], p["hi"]):
                if n > 1 and len(b) >= length:
                    a, e = np.array([0]), np.array([len(b)])
                elif lo is None:
                    a = e = np.zeros(0, np.int64)
                else:
                    a, e = _runs(np.asarray(lo, np.int64), np.asarray(hi, np.int64) + length)
                sha, done = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), e.tolist()):
                    sha.update(b[done:x])
                    done = y
                sha.update(b[done:])
                out.append((len(b), a, e, sha.hexdigest()))
            yield pd.DataFrame({"hash": p["hash"].to_numpy(), "n_bytes": [x[0] for x in out], "starts": [x[1] for x in out], "ends": [x[2] for x in out], "kept_sha256": [x[3] for x in out]})

    full = texts.join(found, "key", "left").select("hash", "bytes", "copies", F.col("found.lo").alias("lo"), F.col("found.hi").alias("hi"))
    return rows, full.mapInPandas(run, "hash string, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string")


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    d = cut(texts.select("hash", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256"), "removed")
    return rows.join(d, "hash").drop("hash")
