"""Operator 4, sharding by vector bin packing: bytes, tokens and rows are balanced jointly (law `bytes`).

Documents of equal text form a group, and a group goes to one shard. Only one vector (bytes, tokens, rows) of each group
is packed. Groups of like size are interchangeable, so those whose largest share is below 1 / (shards * `FINE`) of the
whole are dealt to buckets by a hash of the text, and each bucket packs its groups, largest first, into all shards: a group
goes where the dot product with the shard's residual capacity is highest, all as shares of the bucket's totals. What
buckets are out of balance by does not add up: the whole is never less even than its buckets. The others, at most
3 * shards * FINE whatever the input, are packed first, in one bucket; what they take from each shard is taken off its
capacity in all other buckets. A group that alone exceeds a whole shard's share in some dimension cannot be evened out: it
is split into as few pieces as fit (by a hash of doc_id), and this is the only case in which equal texts part.

Slots are ranks by (group, doc_id) within a shard: ranks within a part of a shard's rows, and offsets of the parts.

Defined cases: a null text has no bytes of text and forms a group of its own; repeated rows are separate members of
their group; rows of equal group and doc_id are interchangeable; empty tables give empty results; only doc_id and text
are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .store import cut

SHARDS = 40
OVERHEAD = 16
FINE = 50
BUCKET_GROUPS = 50_000
PARTS = 64
DIMS = ("size", "tokens", "one")


def pack(vectors: np.ndarray, shards: int, taken: np.ndarray | None = None, start: int = 0, scale: np.ndarray | None = None) -> np.ndarray:
    """Shard of each vector: largest first, to the highest dot product with the residual capacity.

    Both are shares of the vectors' totals (or of scale), and a vector only goes to a shard with room in all dimensions while one has it, else
    to the one that is least over. taken (shards x dimensions): shares that are gone beforehand; the rest is
    filled to the same height. start turns the shard numbers, so that ties do not favour the same shard everywhere.
    """
    v = vectors / (np.maximum(vectors.sum(axis=0), 1) if scale is None else scale)
    room = np.full((shards, v.shape[1]), 1.0 / shards) if taken is None else (1 + taken.sum(axis=0)) / shards - taken
    room = np.roll(room, -start, axis=0)
    out = np.empty(len(v), np.int64)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        x = v[i]
        score = room @ x
        tight = (room < x).any(axis=1)
        j = int((room - x).min(axis=1).argmax()) if tight.all() else int(np.where(tight, -np.inf, score).argmax())
        out[i] = j
        room[j] -= x
    return (out + start) % shards


def packed(docs: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    d = docs.select("doc_id", size.alias("size"), word_count(F.col("text")).alias("tokens"), F.lit(1).cast("long").alias("one"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("group"))
    d = cut(d, "sizes")
    whole = d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS]).first()
    total = np.maximum(np.array([whole[c] for c in DIMS], np.float64), 1)
    groups = d.groupBy("group").agg(*[F.sum(c).alias(c) for c in DIMS])
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(DIMS, total)])
    groups = cut(groups.withColumn("share", share), "groups")

    # large groups: a bounded list, packed here
    large = groups.where(F.col("share") * shards * FINE > 1).orderBy(F.desc("share"), "group").collect()
    pieces = [(g["group"], k, *[g[c] / n for c in DIMS]) for g in large for n in [max(1, int(np.ceil(g["share"] * shards - 1e-9)))] for k in range(n)]
    vectors = np.array([p[2:] for p in pieces], np.float64).reshape(-1, 3)
    room = pack(vectors, shards, scale=total)
    gone = np.zeros((shards, 3))
    np.add.at(gone, room, vectors)
    rest = np.maximum(total - vectors.sum(axis=0), 1e-9)
    spark = docs.sparkSession
    n_small = groups.count() - len(large)
    buckets = max(1, -(-n_small // bucket_groups))

    def place(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("group", ignore_index=True)
        at = pack(b[list(DIMS)].to_numpy(np.float64), shards, gone / rest, int(b["bucket"].iat[0]) % shards)
        return pd.DataFrame({"group": b["group"], "shard": at.astype(np.int32)})

    small = groups.where(F.col("share") * shards * FINE <= 1).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    small = small.groupBy("bucket").applyInPandas(place, "group string, shard int").withColumn("piece", F.lit(0))
    listed = spark.createDataFrame([(g, k, int(s)) for (g, k, *_), s in zip(pieces, room)], "group string, piece int, shard int")
    of_group = cut(small.unionByName(listed), "placed")

    piece = F.lit(0)
    split = {g: k + 1 for g, k, *_ in pieces if k}
    for g, n in split.items():  # fewer than 3 * shards groups exceed a shard
        piece = F.when(F.col("group") == g, F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.lit(n)).cast("int")).otherwise(piece)
    rows = cut(d.drop("one").withColumn("piece", piece).join(of_group.hint("merge"), ["group", "piece"]), "rows")
    part = F.pmod(F.xxhash64("group", "doc_id"), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("group", "doc_id", "size")) - 1
    ranked = rows.withColumn("rank", rank).join(first, ["shard", "part"])
    return ranked.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))


def op4_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
