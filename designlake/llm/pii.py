"""Operator 1, information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are the protected entities. Terms near an entity are counted over the corpus:
with n(t, e) rows in which term t stands near entity e, n(t) rows that hold t anywhere and n(e) of N distinct contexts
that are e's, a term tells log2(P(e | t) / P(e)) of the log2(1 / P(e)) bits that name the entity, where
P(e | t) = n(t, e) / max(n(t), n(t, e)). Copies count alike in both, so they leave that chance as it is. A term is
generalised where the share reaches `GENERALISE` and removed where it reaches `REMOVE`, everywhere it occurs, if the two
also meet more often than chance explains: with k distinct contexts that hold t, and lambda = n(t) * n(e) * 2 * NEAR /
(words of the corpus) expected, lambda ** k / k! must not exceed `RISK`. An entity that is seen once is thus told by words
that hardly occur elsewhere, and a common word is told by no entity.

Three scans: the base spans and what stands near them; the rows that hold each candidate term, added up within a task
before anything is shuffled; and, once the thresholds have left few terms, where these occur. Terms reach a scan as a
bitmap of at most 2 ** `MOST_BITS` bits; exact joins follow it, and the keys of these are dealt over `SALTS` tasks each.

Defined cases: a null or empty text has no spans; a null doc_id is kept as such; repeated rows each get their
spans; long runs of digits or letters are read in linear time; equal entities in copies of one passage count
as one context; an empty table gives an empty result; only doc_id and text are read, and other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simhash import LOWER
from .store import cut, fresh
from .textvec import batches, mix, ngram_hashes, placed_words

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.85, 0.95
RISK = 1e-4
NEAR = 10
LEAST_CHARS = 3
#: Bits of a bitmap for each term in it, and the most bits of one (32 MB).
ROOM, MOST_BITS = 6, 28
SALTS = 16

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits that an earlier start has failed on
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: each @ is tried with the run of characters before it."""
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, (end := m.end())
        at = t.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by start and kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(filter(str.isdigit, value)) if kind != 'ip' else value}"


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Of each span: hashes of its entity, of the nearest words, of the terms near it, and of those of them that stood
    near the same entity in this text before."""
    raw = text.encode().translate(LOWER)
    h, _, lo, hi, b = placed_words([raw])
    at = np.append(np.flatnonzero((b[: len(raw)] & 0xC0) != 0x80), len(raw))  # first byte of each code point
    inside = np.zeros(len(h), bool)
    ranges = [(int(np.searchsorted(hi, at[x], side="right")), int(np.searchsorted(lo, at[y]))) for _, x, y in spans]
    for x, y in ranges:
        inside[x:y] = True
    out, seen = [], {}
    for (kind, a, b), (x, y) in zip(spans, ranges):
        around = np.r_[max(0, x - NEAR) : x, y : min(len(h), y + NEAR)]
        near = around[~inside[around] & (hi[around] - lo[around] >= LEAST_CHARS)] if len(around) else around
        mark = h[np.r_[max(0, x - 3) : x, y : min(len(h), y + 3)].astype(np.int64)]
        ctx = int(mix(ngram_hashes(mark, len(mark))).view(np.int64)[0]) if len(mark) else 0
        name = int(np.uint64(xxhash.xxh64_intdigest(entity(kind, text[a:b]))).view(np.int64))
        terms, before = set(h[near].view(np.int64).tolist()), seen.setdefault(name, set())
        out.append({"entity": name, "context": ctx, "terms": sorted(terms - before), "again": sorted(terms & before)})
        before |= terms
    return out


BASE = "h long, n_email long, n_ip long, n_card long, n_phone long, n_words long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:long,context:long,terms:array<long>,again:array<long>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), counts, base spans and what stands near them, of every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            spans = [base_spans(t) for t in p["text"]]
            out = p[["doc_id", "h"]].copy()
            for i, k in enumerate(KINDS[:4]):
                out[f"n_{k}"] = [sum(x[0] == k for x in s) for s in spans]
            out["n_words"] = [len(t.split()) if t else 0 for t in p["text"]]
            out["base_sha256"] = [digest(s) for s in spans]
            out["base"] = [[{"start": a, "kind": KINDS.index(k), "end": b} for k, a, b in s] for s in spans]
            out["near"] = [contexts(t, s) if s else [] for t, s in zip(p["text"], spans)]
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInPandas(run, f"doc_id {kind}, {BASE}")


def pairs(scan: DataFrame) -> DataFrame:
    """entity, term, n_te (rows), contexts (distinct ones with both) and n_e (distinct contexts of the entity)."""
    near = scan.select(F.explode("near").alias("x")).select("x.*")
    new = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("row")))
    old = F.transform("again", lambda t: F.struct(t.alias("term"), F.lit(0).alias("row")))
    one = near.select("entity", "context", F.explode(F.concat(new, old)).alias("t")).groupBy("entity", "t.term", "context").agg(F.sum("t.row").alias("rows"))
    both = one.groupBy("entity", "term").agg(F.sum("rows").alias("n_te"), F.count("*").alias("contexts"))
    per = near.groupBy("entity", "context").agg(F.lit(1)).groupBy("entity").agg(F.count("*").alias("n_e"))
    return both.join(per, "entity")


def bitmap(terms: DataFrame, count: int) -> np.ndarray:
    """The packed bits of the terms' hashes, at least 2 ** ROOM for each of count terms but 2 ** MOST_BITS at most."""
    bits = min(MOST_BITS, max(16, count.bit_length() + ROOM))
    out = np.zeros((256, (1 << bits) // 2048), np.uint8)

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        mine = np.zeros((1 << bits) // 256, bool)
        mine[(p["term"].to_numpy().view(np.uint64) << np.uint64(8)) >> np.uint64(72 - bits)] = True
        return pd.DataFrame({"slot": [p["slot"].iat[0]], "bits": [np.packbits(mine).tobytes()]})

    slot = F.shiftrightunsigned("term", 56).cast("int")
    for r in terms.select("term", slot.alias("slot")).groupBy("slot").applyInPandas(pack, "slot int, bits binary").toLocalIterator():
        out[r["slot"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _held(h: np.ndarray, packed: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (8 * len(packed)).bit_length() + 1)
    return (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def row_counts(docs: DataFrame, packed: np.ndarray) -> DataFrame:
    """term, n: in how many rows each word stands whose hash is in the bitmap; a few rows for a term, to be added up."""
    held = docs.sparkSession.sparkContext.broadcast(packed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t = [x.encode().translate(LOWER) if x else b"" for x in p["text"]]
            for lo, hi in batches(t):
                h, first, a, b, _ = placed_words(t[lo:hi])
                hit = np.flatnonzero(_held(h, held.value) & (b - a >= LEAST_CHARS))
                doc, h = np.searchsorted(first, hit, side="right"), h[hit]
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                term, n = np.unique(h[new], return_counts=True)
                yield pd.DataFrame({"term": term.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(run, "term long, n long")


def occurrences(docs: DataFrame, packed: np.ndarray) -> DataFrame:
    """doc_id, h, term, start, end of every word whose hash is in the bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(packed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t = [x.encode().translate(LOWER) if x else b"" for x in p["text"]]
            for lo, hi in batches(t):
                h, first, a, b, raw = placed_words(t[lo:hi])
                hit = np.flatnonzero(_held(h, held.value) & (b - a >= LEAST_CHARS))
                if not len(hit):
                    continue
                doc = np.searchsorted(first, hit, side="right") - 1
                begin = np.cumsum([0] + [len(x) + 1 for x in t[lo:hi]])[doc]
                chars = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])  # code points before each byte
                rows = p.iloc[lo:hi].iloc[doc]
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "h": rows["h"].to_numpy(), "term": h[hit].view(np.int64), "start": (chars[a[hit]] - chars[begin]).astype(np.int32), "end": (chars[b[hit]] - chars[begin]).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInPandas(run, f"doc_id {kind}, h long, term long, start int, end int")


def _all_terms(t: DataFrame) -> tuple[DataFrame, int]:
    t = t.select("term").distinct()
    return t, t.count()


def telling(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """term, told: the terms that tell an entity with a share of GENERALISE or more, beyond chance."""
    both = cut(pairs(scan), "pairs")
    counts = row_counts(docs, bitmap(*_all_terms(both))).groupBy("term").agg(F.sum("n").alias("n_t"))
    sizes = scan.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0], both.groupBy("entity").agg(F.first("n_e").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, contexts_ = F.lit(float(max(1, sizes[0]))), F.lit(float(sizes[1]))
    told = 1 + F.log2(F.col("n_te") / F.greatest("n_t", "n_te")) / -F.log2(F.col("n_e") / F.greatest(contexts_, F.col("n_e") + 1))
    expected = F.col("n_t") * F.col("n_e") * F.lit(2.0 * NEAR) / words
    k = F.least(F.col("contexts"), F.lit(20)).cast("int")
    beyond = (expected < 1) & (F.pow(expected, k) / F.factorial(k) <= RISK)
    return both.join(counts, "term").where(beyond).groupBy("term").agg(F.max(told).alias("told")).where(F.col("told") >= GENERALISE)


def found(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, h, counts, base_sha256, base, and spans: all of start, kind, end, action."""
    scan = cut(scanned(docs), "pii")
    terms = cut(telling(scan, docs), "terms")
    action = F.when(F.col("told") >= REMOVE, "remove").otherwise("generalise")
    salted = terms.select("term", action.alias("action"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")  # the list of terms grows with the corpus
    seen = occurrences(docs, bitmap(*_all_terms(terms))).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    added = seen.join(salted, ["term", "salt"]).select("doc_id", "h", F.struct("start", F.lit(4).alias("kind"), "end", "action").alias("s"))
    added = added.groupBy("doc_id", "h").agg(F.collect_set("s").alias("added")).withColumnsRenamed({"doc_id": "of_doc", "h": "of_h"})
    all_ = scan.drop("near", "n_words").join(added, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_h")), "left").drop("of_doc", "of_h")
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("remove").alias("action")))
    free = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return all_.withColumn("spans", F.sort_array(F.concat(base, F.coalesce(free, F.array().cast("array<struct<start:int,kind:int,end:int,action:string>>"))))).drop("added")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with the spans in its texts replaced by their kind in brackets, or dropped where a term is removed."""
    h, of_doc, of_h, marks = (fresh(docs, c) for c in ("text_hash", "of_doc", "of_hash", "marks"))
    spans = found(docs).select(F.col("doc_id").alias(of_doc), F.col("h").alias(of_h), F.col("spans").alias(marks)).where(F.size(marks) > 0).distinct()

    @F.pandas_udf("string")
    def replace(text: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(text, marks):
            if t is None or m is None or not len(m):
                out.append(t)
                continue
            done, at = [], 0
            for s in m:
                if s["start"] >= at:
                    gone = KINDS[s["kind"]] == "term" and s["action"] == "remove"
                    done += [t[at : s["start"]], "" if gone else f"[{KINDS[s['kind']].upper()}]"]
                    at = s["end"]
            out.append("".join([*done, t[at:]]))
        return pd.Series(out, dtype=object)

    full = docs.withColumn(h, F.xxhash64("text"))
    j = full.join(spans, F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(h) == F.col(of_h)), "left")
    return j.select(*[replace(F.col("text"), F.col(marks)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return f.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))
