"""Operator 13, URL filters: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

Features are expressions of the URL alone: lengths, depths, ratio of digits, hyphens, entropy of the host's characters,
numbers of parameters, and statistics of suffixes (top-level name, last two names, file ending): how many labelled URLs
have the suffix and which share of them is blocked. The trees learn from labelled URLs; in the query these are the ones
that a rule judges. Equal rows of features and label count once, with their number as weight, so that copies neither
fill nor tilt the training set, which holds about `MOST` of such rows (chosen by a hash) at most. Only this set is read
many times; pages are read once to train and once to judge, without a shuffle.

Defined cases: a null URL, or one without `://`, has an empty host and path; a suffix that no labelled URL has gets the
overall share; without labelled URLs all others are allowed, with labels of one kind only all get that verdict; repeated
rows are judged each; long URLs are read whole, in linear time; an empty table gives an empty result; only page_id and
url are read, other columns may have any names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound, cut

# Verdict, host and path of the rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The most different rows of features that the trees learn from, and the trees' number, depth and step.
MOST, TREES, DEPTH, STEP = 100_000, 20, 4, 0.3
#: What a suffix's share of blocked URLs is drawn to the overall share with, in URLs.
PRIOR = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0123456789-."
SUFFIXES = {"top": r"[^.]*$", "site": r"[^.]*(?:\.[^.]*)?$", "ending": None}
LEXICAL = ["url_chars", "host_chars", "path_chars", "host_depth", "path_depth", "host_digits", "path_digits", "hyphens", "entropy", "params", "query_chars", "secure"]
FEATURES = [*LEXICAL, *[f"{s}_{k}" for s in SUFFIXES for k in ("seen", "share")]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; of equally long ones the first in order."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(sorted(rules, key=lambda r: r[1] + r[2], reverse=True), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Bits a character, over SYMBOLS and all other characters as one more."""
    n = F.greatest(F.length(text), F.lit(1))
    term = lambda k: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0)
    parts = [term(_count(text, c)) for c in SYMBOLS] + [term(F.length(F.translate(text, SYMBOLS, "")))]
    return sum(parts[1:], parts[0])


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, the LEXICAL features and a hash of each suffix. Features are whole numbers of few
    values, so that their split points do not depend on how rows are dealt."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", url.alias("url"))
    d = bound(d, "u", F.struct(host.alias("host"), path.alias("path"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"))).select("page_id", "url", "u.*")
    steps = lambda x, width, most: F.least(F.floor(x / width), F.lit(most)).cast("double")
    ratio = lambda t: F.round(10 * _count(F.col(t), "0123456789") / F.greatest(F.length(t), F.lit(1)))
    values = {
        "url_chars": steps(F.length("url"), 4, 30), "host_chars": steps(F.length("host"), 2, 30), "path_chars": steps(F.length("path"), 2, 30),
        "host_depth": steps(_count(F.col("host"), "."), 1, 15), "path_depth": steps(_count(F.col("path"), "/"), 1, 15),
        "host_digits": ratio("host"), "path_digits": ratio("path"), "hyphens": steps(_count(F.col("host"), "-"), 1, 15), "entropy": steps(entropy(F.col("host")), 0.25, 30),
        "params": F.when(F.col("query") == "", 0.0).otherwise(steps(_count(F.col("query"), "&") + 1, 1, 15)), "query_chars": steps(F.length("query"), 4, 30), "secure": F.lower(F.substring("url", 1, 8)).startswith("https:").cast("double"),
    }
    suffix = {s: F.regexp_extract("host", p, 0) if p else F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1) for s, p in SUFFIXES.items()}
    return d.select("page_id", "host", "path", *[v.cast("double").alias(k) for k, v in values.items()], *[F.xxhash64(v).alias(s) for s, v in suffix.items()])


def training_set(labelled: DataFrame, most: int = MOST) -> DataFrame:
    """Different rows of features, suffixes and blocked (0 or 1), with n: how many labelled URLs are alike; about `most`
    of them, chosen by a hash of the row."""
    keys = [*LEXICAL, *SUFFIXES, "blocked"]
    t = cut(labelled.groupBy(*keys).agg(F.count("*").cast("double").alias("n")), "labelled")
    rows = t.count()
    if rows > most:
        t = t.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < F.lit(1_000_000 * most // rows))
    return t


def suffix_shares(train: DataFrame) -> dict[str, DataFrame]:
    """Of each kind of suffix a table of suffix, seen (its number of labelled URLs in steps of powers of two) and share
    (hundredths that are blocked). At most as many rows as the training set."""
    n, blocked = train.agg(F.sum("n"), F.sum(F.col("n") * F.col("blocked"))).first()
    overall = (blocked or 0.0) / n if n else 0.0
    share = (F.sum(F.col("n") * F.col("blocked")) + F.lit(PRIOR * overall)) / (F.sum("n") + F.lit(PRIOR))
    return {s: cut(train.groupBy(s).agg(F.least(F.floor(F.log2(F.sum("n") + 1)), F.lit(30)).cast("double").alias(f"{s}_seen"), F.round(30 * share).alias(f"{s}_share")), f"suffix-{s}") for s in SUFFIXES} | {"overall": round(30 * overall)}


def with_suffixes(d: DataFrame, shares: dict) -> DataFrame:
    """d with the statistics of its suffixes, as a vector; the tables are small files, which Spark sees and broadcasts."""
    for s in SUFFIXES:
        d = d.join(shares[s], s, "left")
    d = d.fillna({f"{s}_seen": 0.0 for s in SUFFIXES} | {f"{s}_share": float(shares["overall"]) for s in SUFFIXES})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(d)


def fit(labelled: DataFrame, most: int = MOST) -> tuple[GBTClassificationModel | str, dict]:
    """The trees (or, for labels of one kind, that verdict) and the suffix statistics, from lexical() rows with blocked."""
    train = cut(training_set(labelled, most), "train")
    kinds = [r[0] for r in train.select("blocked").distinct().collect()]
    shares = suffix_shares(train)
    if len(kinds) < 2:
        return "block" if kinds == [1.0] else "allow", shares
    rows = cut(with_suffixes(train, shares).select("features", "blocked", "n"), "vectors")
    return GBTClassifier(featuresCol="features", labelCol="blocked", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=13).fit(rows), shares


def judged(d: DataFrame, model: GBTClassificationModel | str, shares: dict) -> DataFrame:
    """d (of lexical()) with score, the model's chance that a URL is to be blocked."""
    if isinstance(model, str):
        return d.withColumn("score", F.lit(1.0 if model == "block" else 0.0))
    return model.transform(with_suffixes(d, shares)).withColumn("score", vector_to_array("probability")[1])


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page. labelled (url, blocked) teaches the trees; without it
    they learn from the pages that a rule judges."""
    d = bound(lexical(pages), "r", F.struct(rule(F.col("host"), F.col("path"), rules).alias("of")))
    if labelled is None:
        known = d.where("r.of is not null").withColumn("blocked", (F.col("r.of.verdict") == "block").cast("double"))
    else:
        known = lexical(labelled.select(F.struct(F.col("blocked").cast("double").alias("b")).alias("page_id"), "url")).where("page_id.b is not null").withColumn("blocked", F.col("page_id.b"))
    model, shares = fit(known)
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged(d, model, shares).select("page_id", "host", "path", F.col("r.of.rule").alias("rule"), F.coalesce("r.of.verdict", own).alias("verdict"), "score")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
