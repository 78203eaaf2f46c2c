"""Operator 3, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased characters. Document frequencies are counted over every
learnable document (a label, and crc32 of doc_id mod 4 not 2), by bucket. The
weights are fitted on a bounded sample of those documents, `SAMPLE` by hash of doc_id, in one task: follow the
regularised leader (proximal, per-coordinate rates) with an elastic net; then one temperature is fitted on sampled
documents that the weights did not see. The model is a matrix of `BUCKETS` x languages whatever the corpus.
Prediction scores every n-gram of every whole text.

Defined cases: a null text or one without letters is `und` with score 0; rows without lang or doc_id are never
learned from; with nothing to learn from, all is `und`; repeated rows get equal results; very long texts
are scored whole, in slices; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = 3
SAMPLE = 4000
EPOCHS = 3
L1, L2, ALPHA, BETA = 1e-4, 1e-4, 0.5, 1.0
SCALE = 10.0
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of each order at every character of the texts, and each text's first and last position.

    Two zero characters follow each text, so that no n-gram sees the next text.
    """
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    first = np.cumsum(size + 2) - size - 2
    c = np.frombuffer(("\0\0".join(low) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    n, out, mixed = len(c) - 2, [], np.uint32(0)
    for k in range(ORDERS):
        mixed = mixed * MULTIPLIERS[2] + (c[k : n + k] + np.uint32(k + 1)) * MULTIPLIERS[k]
        h = mixed ^ (mixed >> np.uint32(15))
        out.append(((h * MULTIPLIERS[1]) >> np.uint32(32 - 15)).astype(np.int32))
    return out, first, first + size


def slices(texts: list[str | None], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def pieces(texts: list[str], most: int = 400_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts with long ones cut into pieces, each with the characters that its last n-grams reach into; the text
    of each piece; and how many of its characters start n-grams."""
    out, of, n = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), most):
            out.append(t[a : a + most + ORDERS - 1])
            of.append(i)
            n.append(min(most, len(t) - a))
    return out, np.array(of, np.int64), np.array(n, np.int64)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def document_frequencies(texts: list[str]) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    seen = np.zeros(BUCKETS, bool)
    parts, of, n = pieces([t.lower() for t in texts])
    for lo, hi in slices(parts):
        g, first, _ = grams(parts[lo:hi])
        for i, a in enumerate(first.tolist(), lo):
            for x in g:
                seen[x[a : a + n[i]]] = True
            if i + 1 == len(of) or of[i + 1] != of[i]:
                total += seen
                seen[:] = False
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of one text: features and values; term frequencies are shares of the text's n-grams."""
    g, first, last = grams([text])
    at, n = np.unique(np.concatenate([x[first[0] : last[0]] for x in g]), return_counts=True)
    return at, SCALE * n / max(1, n.sum()) * idf[at]


def fit(texts: list[str], langs: list[str], idf: np.ndarray) -> dict:
    """Weights and temperature from the sample; every fifth document only serves the temperature."""
    names = sorted(set(langs))
    k = len(names)
    y = np.array([names.index(x) for x in langs])
    xs = [vector(t, idf) for t in texts]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    def soft(s):
        e = np.exp(s - s.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    learn = [i for i in range(len(xs)) if i % 5 or len(xs) < 20]
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            at = np.append(xs[i][0], BUCKETS)
            v = np.append(xs[i][1], 1.0)
            w = weights(at)
            p = soft(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    rest = [i for i in range(len(xs)) if i % 5 == 0]
    s = np.array([xs[i][1] @ w[xs[i][0]] + w[BUCKETS] for i in rest]).reshape(-1, k)
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(soft(s / t)[np.arange(len(rest)), y[rest]], 1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))]) if rest else 1.0
    return {"names": names, "weights": (SCALE * idf[:, None] * w[:BUCKETS]).astype(np.float32), "bias": w[BUCKETS], "temperature": best}


def scores(texts: list[str], model: dict) -> np.ndarray:
    """Probabilities (texts x languages)."""
    out = np.zeros((len(texts), len(model["names"])))
    parts, of, n = pieces([t.lower() for t in texts])
    for lo, hi in slices(parts):
        g, first, _ = grams(parts[lo:hi])
        for x in g:
            sums = np.zeros((len(x) + 1, out.shape[1]))
            np.cumsum(model["weights"][x], axis=0, dtype=np.float64, out=sums[1:])
            np.add.at(out, of[lo:hi], sums[first + n[lo:hi]] - sums[first])
    out /= np.maximum(1, ORDERS * np.bincount(of, n, len(texts)))[:, None]
    s = (out + model["bias"]) / model["temperature"]
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model from the documents that may be learned from (doc_id, text, lang), or None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            df = document_frequencies(b["text"].tolist())
            at = np.flatnonzero(df)
            yield pd.DataFrame({"bucket": np.r_[-1, at], "n": np.r_[len(b), df[at]]})

    # at most BUCKETS rows a batch, added up within a task and then by bucket; the model has as many rows
    sums = known.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    rows = int(got.loc[got["bucket"] < 0, "n"].sum())
    if not rows:
        return None
    df = np.zeros(BUCKETS, np.int64)
    seen = got[got["bucket"] >= 0]
    df[seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log((1 + rows) / (1 + df)) + 0.1

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([b for b in batches] or [pd.DataFrame({"text": [], "lang": [], "at": []})], ignore_index=True).sort_values(["at", "text"])
        if len(got):
            yield pd.DataFrame({"model": [pickle.dumps(fit(got["text"].tolist(), got["lang"].tolist(), idf))]})

    # a cut-off that leaves about twice the sample, by the number of rows; few are sorted, whatever the number
    at = F.xxhash64("doc_id", F.lit("sample"))
    most = min(1.0, 2 * (sample + 50) / rows)
    few = known.where(at <= F.lit(int(-(1 << 63) + most * ((1 << 64) - 1)) if most < 1 else (1 << 63) - 1))
    picked = few.select("lang", at.alias("at"), "text").orderBy("at").limit(sample)
    return pickle.loads(picked.coalesce(1).mapInPandas(learn, "model binary").first()["model"])


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs's doc_id with lang_pred and score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if t and LETTER.search(t) else None for t in b["text"]]
            known = [i for i, t in enumerate(texts) if t is not None and model]
            name, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if known:
                p = scores([texts[i] for i in known], model)
                name[known], score[known] = np.array(model["names"], object)[p.argmax(axis=1)], p.max(axis=1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": name, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
