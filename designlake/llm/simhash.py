"""Operator 8, SimHash near-dedup: BK-trees over fingerprints, followed only along edges within the radius.

A fingerprint within `radius` bits of another agrees with it in one of radius + 1 bit blocks (pigeonhole), so
each shard holds the distinct fingerprints that share one block's value, and one BK-tree per shard finds its
links: children are keyed by their Hamming distance to the parent, and a query at distance d from a node follows
the edges d - radius to d + radius. A shard above `shard_rows` is cut again by blocks of its other bits; what is
still larger is cut into shard trees that every row of the shard is searched in. Trees of a partition are
built and searched together, level by level, as one forest of arrays. Each shard returns a spanning forest of
its links, never all pairs; star contraction joins the forests.

Defined cases: a null or blank text has fingerprint 0, linked like any other; exact copies share a fingerprint
and are merged before the search; a null doc_id never names a component unless all its ids are null; repeated
rows and ties get the same component; an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import cut, fresh, text_or_empty

RADIUS = 4
SHINGLE = 4
SHARD_ROWS = 2048
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the A-Z-lowered text; of all words if there are fewer."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1], (ends[k - 1 :] - 1).tolist())], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(np.ascontiguousarray(h[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([simhash(shingle_hashes(t)) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def _bits(fp, places: list[int]):
    """The bits of a long column at consecutive places, as an int column."""
    return F.shiftrightunsigned(fp, places[0]).bitwiseAND(F.lit((1 << len(places)) - 1).cast("long")).cast("int")


def _bits_at(fp, places: list[int]):
    """As _bits, for places that need not be consecutive: runs of them are put together."""
    out, run = F.lit(0), []
    for i, p in enumerate(places):
        run.append(p)
        if i + 1 == len(places) or places[i + 1] != p + 1:
            out = F.shiftleft(out, len(run)).bitwiseOR(_bits(fp, run))
            run = []
    return out


def shards(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """fp to rows (shard, tree, fp): fp is searched in that tree of that shard, and is one of its nodes if own."""
    fp = F.col("fp")
    blocks = _blocks(list(range(64)), radius + 1)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), _bits(fp, x).alias("v")) for i, x in enumerate(blocks)])).alias("k")).select("fp", "k.b", "k.v")
    # where a block's value is shared by too many, the other bits make blocks of their own
    hot = rows.groupBy("b", "v").count().where(F.col("count") > shard_rows).select("b", "v", F.lit(True).alias("hot"))
    rows = rows.join(hot, ["b", "v"], "left")
    finer = F.lit(None)
    for i, x in enumerate(blocks):
        rest = [p for p in range(64) if p not in x]
        finer = F.when(F.col("b") == i, F.array(*[F.struct(F.lit(j).alias("b2"), _bits_at(fp, y).alias("v2")) for j, y in enumerate(_blocks(rest, radius + 1))])).otherwise(finer)
    none = F.array(F.struct(F.lit(-1).alias("b2"), F.lit(0).alias("v2")))
    rows = rows.withColumn("s", F.explode(F.when(F.col("hot"), finer).otherwise(none))).select("b", "v", "s.b2", "s.v2", "fp")
    key = ["b", "v", "b2", "v2"]
    big = rows.where("b2 >= 0").groupBy(*key).count().where(F.col("count") > shard_rows).select(*key, F.ceil(F.col("count") / shard_rows).cast("int").alias("trees"))
    rows = rows.join(big, key, "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    return rows.select(F.xxhash64(*key, "tree").alias("shard"), "fp", (F.col("tree") == F.col("home")).alias("own"))


class Forest:
    """BK-trees of many shards: node arrays, children of a node sorted by their edge (distance to the node)."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard: a number for each value, ascending; the first value of a shard is its tree's root."""
        n = len(value)
        self.value, self.parent, self.edge = value, np.full(n, -1), np.zeros(n, np.int64)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.roots, self.root_shard = np.flatnonzero(first), shard[first]
        item = np.flatnonzero(~first)
        at = np.repeat(self.roots, np.diff(np.r_[self.roots, n]))[item]
        while len(item):
            d = np.bitwise_count(value[item] ^ value[at]).astype(np.int64)
            key = at * 65 + d
            # the first waiting value on an edge becomes the child there, the others go on from it
            _, head, which = np.unique(key, return_index=True, return_inverse=True)
            child = item[head]
            self.parent[child], self.edge[child] = at[head], d[head]
            stay = np.ones(len(item), bool)
            stay[head] = False
            at, item = child[which][stay], item[stay]
        order = np.lexsort((self.edge, self.parent))
        self.child = order
        self.key = self.parent[order] * 65 + self.edge[order]

    def within(self, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's position, node) at most radius apart, searching each query from its root."""
        q, at, found = np.arange(len(query)), root, []
        while len(q):
            d = np.bitwise_count(query[q] ^ self.value[at]).astype(np.int64)
            near = d <= radius
            found.append((q[near], at[near]))
            lo = np.searchsorted(self.key, at * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, at * 65 + np.minimum(d + radius, 64), side="right") - lo
            q = np.repeat(q, n)
            step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            at = self.child[np.repeat(lo, n) + step]
        return np.concatenate([x for x, _ in found] or [q]), np.concatenate([x for _, x in found] or [q])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked nodes the least label, in place."""
    while len(a):
        x, y = label[a], label[b]
        go = x != y
        a, b, x, y = a[go], b[go], x[go], y[go]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label[:] = up


def _forest_edges(shard: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, value) of whole shards; rows are sorted by shard."""
    node = np.flatnonzero(own)
    tree = Forest(shard[node], fp[node])
    at = np.searchsorted(tree.root_shard, shard)
    has = at < len(tree.roots)
    has[has] = tree.root_shard[at[has]] == shard[has]
    query, root = np.flatnonzero(has), tree.roots[at[has]] if len(tree.roots) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[tree.roots, len(node)])[at[has]] if len(tree.roots) else np.zeros(0, np.int64)
    label = np.arange(len(fp))
    step = np.cumsum(np.minimum(sizes, SHARD_ROWS)) // (1 << 20)
    for s in range(int(step[-1]) + 1 if len(step) else 0):
        lo, hi = np.searchsorted(step, s), np.searchsorted(step, s, side="right")
        q, found = tree.within(fp[query[lo:hi]], root[lo:hi], radius)
        a, b = query[lo:hi][q], node[found]
        _merge(label, a[a != b], b[a != b])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct fp to (u, v): pairs that connect just what chains of links of at most radius bits connect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def solve(b: pd.DataFrame) -> pd.DataFrame:
            u, v = _forest_edges(b["shard"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["own"].to_numpy(), radius)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

        for b in batches:
            if not len(b):
                continue
            last = b["shard"].iat[-1]
            whole = b["shard"].to_numpy() != last
            if whole.any() or (rest and rest[-1]["shard"].iat[-1] != last):
                yield solve(pd.concat([*rest, b[whole]], ignore_index=True))
                rest = [b[~whole]]
            else:
                rest.append(b)
        if rest:
            yield solve(pd.concat(rest, ignore_index=True))

    rows = shards(fps, radius, shard_rows)
    return rows.repartition("shard").sortWithinPartitions("shard", "fp").mapInPandas(run, "u long, v long")


def _placed(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """Distinct fps with root, a fingerprint that names the component."""
    root = components(links(fps.select("fp"), radius, shard_rows)).withColumnsRenamed({"u": "fp", "v": "root"})
    return fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    own = cut(fingerprints(docs), "fingerprints")
    placed = _placed(cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), radius, shard_rows)
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(placed.select("fp", "root").join(of_root, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, with its own columns: the one with the smallest doc_id (a null one only where
    all are null), then by a hash of text and columns, so that null and repeated ids drop no other component's rows."""

    @F.pandas_udf("long")
    def fingerprint(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(t)) for t in text], np.uint64).view(np.int64))

    mark = fresh(docs, "row_mark")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    marked = docs.withColumn(mark, F.concat(F.md5(text_or_empty().cast("binary")), F.md5(rest.cast("binary"))))
    own = cut(marked.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(mark).alias("mark"), fingerprint("text").alias("fp")), "fingerprints")
    placed = _placed(cut(own.select("fp").distinct(), "distinct"), RADIUS, SHARD_ROWS)
    least = own.join(placed, "fp").groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "mark")).alias("k"))
    kept = cut(least.select(F.col("k.mark").alias(mark)), "kept")
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
