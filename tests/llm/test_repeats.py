import hashlib
import random
from collections import Counter

from designlake.llm.repeats import repeated


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = [False] * len(b)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        starts = [i for i in range(len(b)) if hit[i] and not (i and hit[i - 1])]
        ends = [i + 1 for i in range(len(b)) if hit[i] and not (i + 1 < len(b) and hit[i + 1])]
        out.append((len(b), starts, ends, hashlib.sha256(bytes(c for c, h in zip(b, hit) if not h)).hexdigest()))
    return out


def run(spark, texts, length, gram, block=4):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hash int")
    rows, found = repeated(docs, length, gram, block)
    got = {r.doc_id: (r.n_bytes, list(r.starts), list(r.ends), r.kept_sha256) for r in rows.join(found, "hash").collect()}
    return [got[i] for i in range(len(texts))]


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "ba", "ünï", "x", "yz", "aaaa"]
    base = "".join(rng.choice(words) for _ in range(200))
    texts = [None, "", "a" * 90, "a" * 31, "ab" * 60, base, base, base[:150] + "!" + base[150:], "q" + base[40:120], "short", "short"]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    for length, gram in ((20, 6), (33, 8)):
        assert run(spark, texts, length, gram) == brute(texts, length)


def test_empty(spark):
    assert run(spark, [], 20, 6) == []
