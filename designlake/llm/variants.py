"""Operator 12, spelling variant grouping: words one edit apart, found with a bit-sliced position index.

Two words that differ by one code point share the first half of the shorter one (its first k of m) or its last m - k
code points. Each word therefore stands in four shards: by its first or its last part, as the shorter or as the longer
word of a pair. A shard holds words of m and m + 1 code points; for each position and letter it has the set of words
with that letter there, as bits. Every word of length m is read letter by letter against all words of its shard at once:
with E the set that agrees so far, R that with one letter replaced and I that with one letter more,

    I <- (I | E) & next[c]      R <- (R & here[c]) | (E & ~here[c])      E <- E & here[c]

where here[c] and next[c] are the words with the letter c at this and at the following position. Only two positions are
held at a time. A pair is reported by its first part where it shares that, else by its last, so each is found once.

Shards are dealt by a hash of the part into as many buckets as keep them near `WORDS` words (fewer for long words); a
part with more words than that is split into blocks, each pair of blocks a shard of its own, so no group grows.

Defined cases: a null or empty text has no words; a null doc_id is written as an empty string; repeated rows count each;
of near words that occur equally often the first in code-point order is the form; long texts and long words are read
whole; an empty table gives an empty result; only doc_id and text are read, other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut

LEAST_CHARS, LEAST_N, TIMES, ONE_IN = 6, 5, 5, 199
#: The most words that a task counts before it hands its counts on; words and code points of a shard.
HELD, WORDS, CHARS = 1 << 19, 512, 1 << 20
# Latin-1: letters stand, A-Z in lower case, everything else parts words
_LETTERS = bytes(c if c >= 0xC0 or c < 128 and chr(c).isalpha() else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def runs(text: str | None) -> list[bytes]:
    """The maximal runs of letters of a text in Latin-1, only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: every word of LEAST_CHARS or more that occurs LEAST_N times, after a code point is deleted from one in
    ONE_IN runs (by a checksum of doc_id and run)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        out = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in n], "n": list(n.values())})
        for p in parts:
            for doc, text in zip(p["doc_id"], p["text"]):
                words = [w for w in runs(text) if len(w) >= LEAST_CHARS]
                n.update(words)
                first = crc32(f"{doc}:".encode())
                for w in set(words):
                    h = crc32(w if w.isascii() else w.decode("latin-1").encode(), first)
                    if not h % ONE_IN:
                        k, at = words.count(w), h % len(w)
                        n[w] -= k
                        if len(w) > LEAST_CHARS:
                            n[w[:at] + w[at + 1 :]] += k
                if len(n) > HELD:
                    yield out()
                    n = Counter()
        if n:
            yield out()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return read.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def members(words: DataFrame) -> DataFrame:
    """Each word with the shards that it stands in: last (by its end), m, bucket, x and y (blocks of words that ask and of
    words that are asked), asks and asked."""
    size = F.length("word")
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"), F.explode(F.array(F.lit(False), F.lit(True))).alias("last")).where(F.col("m") >= LEAST_CHARS)
    half = F.floor(F.col("m") / 2).cast("int")
    each = each.withColumn("part", F.when(F.col("last"), F.substr("word", half - F.col("m"), F.col("m") - half)).otherwise(F.substr("word", F.lit(1), half)))
    fit = F.greatest(F.lit(1), F.least(F.lit(WORDS), F.floor(F.lit(CHARS) / F.col("m")))).cast("int")
    sizes = each.groupBy("m", "last", "part").agg(F.count("*").alias("in_part"))
    # as many rows as there are lengths of words: a file that Spark sees is small, so that words are not dealt by length
    buckets = cut(sizes.groupBy("m").agg(F.ceil(F.sum("in_part") / 2 / F.first(fit)).cast("int").alias("buckets")), "buckets")
    big = sizes.where(F.col("in_part") > fit).select("m", "last", "part", F.ceil(F.col("in_part") / fit).cast("int").alias("blocks"))
    each = each.join(big, ["m", "last", "part"], "left").join(buckets, "m")
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")
    rest = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda x, y, asks, asked: F.struct(x.alias("x"), y.alias("y"), F.lit(asks).alias("asks"), F.lit(asked).alias("asked"))
    alone = F.array(place(F.lit(-1), F.lit(-1), True, True))
    split = F.concat(F.transform(rest, lambda y: place(own, y, True, False)), F.transform(rest, lambda x: place(x, own, False, True)))
    # a part that is split has its shards to itself
    bucket = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("part"), F.col("buckets"))).otherwise(F.xxhash64("part"))
    return each.select("word", "n", "m", "last", bucket.alias("bucket"), F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(split)).alias("at")).select("*", "at.*").drop("at")


def bit_sets(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of a column of letters the words that have it, as 64-bit rows; and each letter's row, 0 for none."""
    letters = np.unique(column)
    row = np.zeros(256, np.intp)
    row[letters] = np.arange(1, len(letters) + 1)
    bits = np.zeros((len(letters) + 1, -(-len(column) // 64) * 64), bool)
    bits[row[column], np.arange(len(column))] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), row


def near(asking: np.ndarray, asked: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of asking (m letters) and of asked (m or m + 1 letters, 0 after the end) that are one edit apart: first those
    with a letter replaced, then those where asked has one more."""
    longer = np.packbits(np.pad(asked[:, m] != 0, (0, -len(asked) % 64)), bitorder="little").view(np.uint64)
    shorter = np.packbits(np.pad(asked[:, m] == 0, (0, -len(asked) % 64)), bitorder="little").view(np.uint64)
    same = np.full((len(asking), len(longer)), ~np.uint64(0))
    replaced, more = np.zeros_like(same), np.zeros_like(same)
    here, row = bit_sets(asked[:, 0])
    for k in range(m):
        after, after_row = bit_sets(asked[:, k + 1])
        more = (more | same) & after[after_row[asking[:, k]]]
        have = here[row[asking[:, k]]]
        replaced = (replaced & have) | (same & ~have)
        same &= have
        here, row = after, after_row
    for found in (replaced & shorter, (more | same) & longer):
        at, cell = np.nonzero(found)
        bit = np.unpackbits(found[at, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, b = np.nonzero(bit)
        yield at[k], cell[k] * 64 + b


def links(words: DataFrame) -> DataFrame:
    """word, near, n: each word with each near word and how often that occurs; every pair once in each direction."""

    def search(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        m, last = int(key[0]), bool(key[1])
        raw = [w.encode("latin-1") for w in p["word"]]
        letters = np.frombuffer(b"".join(w.ljust(m + 1, b"\0") for w in raw), np.uint8).reshape(-1, m + 1)
        size = np.array([len(w) for w in raw])
        ask, asked = np.flatnonzero(p["asks"].to_numpy() & (size == m)), np.flatnonzero(p["asked"].to_numpy())
        out = [(ask[:0], ask[:0])]
        if len(p) > 1 and len(ask) and len(asked):
            half = m // 2
            for k, (a, b) in enumerate(near(letters[ask], letters[asked], m)):
                a, b = ask[a], asked[b]
                first = (letters[a, :half] == letters[b, :half]).all(axis=1)
                if last:  # the last m - half letters agree; those of the longer word start one later
                    end = (letters[a, half:m] == letters[b, half + k : m + k]).all(axis=1)
                    keep = end & ~first
                else:
                    keep = first
                a, b = a[keep], b[keep]
                out.append((a, b))
                if k:
                    out.append((b, a))
        a, b = (np.concatenate(x) for x in zip(*out))
        word, n = p["word"].to_numpy(), p["n"].to_numpy()
        return pd.DataFrame({"word": word[a], "near": word[b], "n": n[b]})

    shard = ["m", "last", "bucket", "x", "y"]
    # few bytes, much work: as many tasks as there are shuffle partitions, which are not put together
    dealt = members(words).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *shard)
    return dealt.groupBy(*shard).applyInPandas(search, "word string, near string, n long")


def followed(forms: DataFrame) -> DataFrame:
    """word, root from word, form: forms followed to the last one, twice as far each round (a form occurs TIMES as often,
    so the rounds are few)."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; form is the near word that occurs most, if TIMES as often."""
    words = cut(word_counts(docs), "words")
    best = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    j = words.join(best, "word", "left")
    form = F.when(-F.col("best.n") >= F.lit(TIMES) * F.col("n"), F.col("best"))
    found = cut(j.select("word", form["near"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-form["n"]).alias("form_n")), "forms")
    roots = followed(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
