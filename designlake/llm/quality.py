"""Operator 7, quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over the document's own text; no shuffle, no user function.

Defined cases: a null or blank text has no words and fails; ties and repeated rows are judged each on its
own; an empty table gives an empty table; other columns of the input are never read, so their names may
clash with the metrics; very long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import WORD, bound, fresh, word_array

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you",
    "au", "aux", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu", "auf", "im",
    "al", "como", "con", "del", "el", "ella", "es", "lo", "los", "las", "más", "no", "para", "por", "se", "su", "una", "y",
]


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if metric lies outside [low, high]; it is judged from `words` words on."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")
    words: int = 0


#: The threshold table.
RULES = (
    Rule("word length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop words", "stop_ratio", low=0.03, words=50),
    Rule("repeated lines", "dup_line_ratio", high=0.35),
    Rule("stuttered words", "stutter_ratio", high=0.3, words=10),
)

WINDOW = 5


def _staged(df: DataFrame, text: Column) -> tuple[DataFrame, str]:
    """Add the measurements as one struct column; returns the frame and the column's name."""
    q = fresh(df, "quality")
    t = F.coalesce(text, F.lit(""))
    df = bound(df, q, F.struct(word_array(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("sym")))
    w = F.col(q)["w"]
    n = F.size(w)
    # a window's words hashed together, so that equal windows meet when the hashes are sorted
    h = F.transform(F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    df = bound(
        df,
        q,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.col(q)["sym"].alias("n_symbols"),
            F.size(F.col(q)["lines"]).cast("long").alias("n_lines"),
            (F.size(F.col(q)["lines"]) - F.size(F.array_distinct(F.col(q)["lines"]))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(F.filter(w, lambda x, i: (F.get(w, i - 1) == x).eqNullSafe(True))).cast("long").alias("n_stutter"),
            h.alias("h"),
        ),
    )
    h = F.col(q)["h"]
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = bound(df, q, F.col(q).withField("h", pairs))
    s = F.col(q)["h"]
    twice = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])).eqNullSafe(True) | (F.get(s, k + 1)["x"] == e["x"]).eqNullSafe(True))
    df = bound(df, q, F.col(q).withField("h", F.sort_array(F.transform(twice, lambda e: e["i"]))))
    p = F.col(q)["h"]
    # each repeated window covers its words up to where the next repeated window starts
    cover = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = bound(df, q, F.col(q).dropFields("h").withField("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")))
    return df, q


def measured(docs: DataFrame, rules=RULES, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column: a struct of counts, ratios, base_failed, broken (names of broken rules) and kept."""
    df, q = _staged(docs, F.col(text))
    m = F.col(q)
    per = lambda x, by: F.when(m[by] > 0, m[x] / m[by]).otherwise(0.0)
    ratios = {"mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "stutter_ratio": per("n_stutter", "n_words")}
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    df = bound(df, q, F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop", "n_stutter", "n_repeat_words")], *[v.alias(k) for k, v in ratios.items()], base.alias("base_failed")))
    broken = [F.when((m["n_words"] >= r.words) & ((m[r.metric] < r.low) | (m[r.metric] > r.high)), F.lit(r.name)) for r in rules]
    df = bound(df, q, m.withField("broken", F.array_compact(F.array(*broken))))
    return bound(df, q, m.withField("kept", ~m["base_failed"] & (F.size(m["broken"]) == 0))), q


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    df, q = measured(docs, rules)
    return df.where(F.col(q)["kept"]).drop(q)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df, q = measured(docs)
    m = F.col(q)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return df.select("doc_id", *[m[c].alias(c) for c in names])


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + {WINDOW})) AS p
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], lower(x)))) AS n_stop,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 16.0 * n_words
       AND n_symbols / n_words <= 0.1 AND (n_words < 50 OR n_stop / n_words >= 0.03)
       AND n_dup_lines / n_lines <= 0.35 AND n_stutter / n_words <= 0.3 AS kept
FROM f
"""
