"""Operator 6, mixing sources to target weights: weighted fair queueing with DataFrame functions only.

Each source is a queue of its documents in a shuffled order, repeated up to `cap` times. A copy's virtual
finish time is the source's cumulative size up to and with that copy, divided by the source's target. Copies
in the order of virtual finish time, cut at the total budget, are the mix. A queue closes when its target has
been served, so every copy that finishes by time 1 fits the budget and at most one copy of each source
straddles time 1; only these few are still ordered and cut one by one.

Cumulative sizes come from a two-level prefix sum (buckets of the shuffled order, then offsets of buckets),
so a source with a third of all rows is spread over `buckets` tasks.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, ranked last; a
source of size 0 has target 0; equal shuffle keys are ordered by doc_id and size, so reruns agree; repeated
rows are queued each; an empty table gives an empty one. Other columns are carried and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import WORD, fresh

CAP = 3
BUCKETS = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """60 bits of a seeded MD5; the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """One row per source: source, rank, source_size, target. Sources weigh weights[rank mod len] by code point.

    The share of the whole budget that a source would get beyond cap times its size goes to the others by weight
    until none is above: sources sorted by size over weight are filled in one pass of window sums.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("long"))
    everything = Window.partitionBy()
    s = s.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("budget", F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(onward))
    free = F.col("level") * F.col("weight") < F.col("full")
    s = s.withColumn("level", F.min(F.when(free, F.struct(F.col("full") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("full").cast("double")), F.col("full").cast("double"))
    return s.select("source", "rank", "source_size", target.alias("target"), "budget")


def queued(sized: DataFrame, targets: DataFrame, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """sized (doc_id, source, size, and more) with served (cumulative size in its source), source_size and target.

    The offsets of buckets are sources x buckets rows, joined by key, never broadcast by force.
    """
    k = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = sized.withColumn("_key", k).withColumn("_at", shuffle_key(F.col("doc_id"), seed))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / F.lit((1 << 60) // buckets)).cast("int"))
    part = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_in"))
    offsets = part.withColumn("_before", F.sum("_in").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("_in")).drop("_in")
    offsets = offsets.join(targets.withColumn("_key", k).drop("source"), "_key")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("size").over(inside)).join(offsets, ["_key", "_bucket"])
    return rows.withColumn("served", F.col("_before") + F.col("_run")).drop("_bucket", "_run", "_before")


def scheduled(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: its columns, source_size, target, and copies: how often the mix takes it.

    served and target give the virtual finish time of copy e (from 0): (e * source_size + served) / target.
    """
    targets = source_targets(sized, weights, cap)
    q = queued(sized, targets, seed, buckets)
    end = lambda e: F.lit(e) * F.col("source_size") + F.col("served")
    some = F.col("size") > 0
    full = sum((F.when(some & (end(e) <= F.col("target")), 1).otherwise(0) for e in range(cap)), F.lit(0))
    # the copy that begins before its source's target and ends after it
    astride = F.coalesce(*[F.when(some & (end(e) > F.col("target")) & (end(e) - F.col("size") < F.col("target")), F.lit(e)) for e in range(cap)])
    q = q.withColumn("full", full).withColumn("astride", astride)
    # sources that have one: their copies compete for what the finished copies leave of the budget
    taken = q.groupBy("_key").agg(F.sum(F.col("full") * F.col("size")).alias("used"), F.max(F.when(F.col("astride").isNotNull(), F.struct((F.col("astride") * F.col("source_size") + F.col("served")).alias("end"), "size", "target", "rank", "budget"))).alias("x"))
    taken = taken.withColumn("used", F.sum("used").over(Window.partitionBy()))
    order = Window.orderBy(F.col("x.end") / F.col("x.target"), "x.rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = taken.where(F.col("x").isNotNull()).withColumn("in", F.col("used") + F.sum("x.size").over(order) <= F.col("x.budget")).select("_key", "in")
    q = q.join(fits.where("in"), "_key", "left")
    copies = F.col("full") + F.when(F.col("astride").isNotNull() & F.col("in"), 1).otherwise(0)
    return q.withColumn("copies", copies.cast("int")).drop("_key", "full", "astride", "in", "rank", "budget")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as taken, range-sorted by virtual finish time.

    Sizes are scheduled without the texts; one shuffle by row key brings the texts back.
    """
    key, n, at, of, no, turns = (fresh(docs, c) for c in ("row_key", "row_no", "finish_time", "plan_key", "plan_no", "turns"))
    same = Window.partitionBy(key).orderBy(F.lit(0))
    full = docs.withColumn(key, F.struct(F.col("doc_id"), F.col("source"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))).withColumn(n, F.row_number().over(same))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    plan = scheduled(sized, weights, cap, seed).where("copies > 0")
    plan = plan.withColumn("_no", F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy("served")))
    turn = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: (e * F.col("source_size") + F.col("served")) / F.col("target"))
    plan = plan.select(F.struct("doc_id", "source", "h").alias(of), F.col("_no").alias(no), turn.alias(turns))
    joined = full.join(plan, F.col(key).eqNullSafe(F.col(of)) & (F.col(n) == F.col(no)))
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(turns).alias(at))
    return out.repartitionByRange(F.col(at)).sortWithinPartitions(at).drop(at)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = scheduled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS pos FROM documents),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM d GROUP BY source),
s1 AS (
  SELECT *, 1 + rk % 3 AS w, {CAP} * source_size AS full_size, sum(source_size) OVER () AS budget FROM s0),
s2 AS (
  SELECT *, CAST(budget - coalesce(sum(full_size) OVER (ORDER BY full_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY full_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM s1),
s3 AS (
  SELECT *, coalesce(least((SELECT arg_min(lv, full_size / w) FROM s2 WHERE lv * w < full_size) * w, CAST(full_size AS DOUBLE)), CAST(full_size AS DOUBLE)) AS target FROM s2),
q AS (
  SELECT d.doc_id, d.size, s3.source_size, s3.target, s3.rk, s3.budget,
         sum(d.size) OVER (PARTITION BY s3.rk ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING) AS c
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
e AS (SELECT *, unnest(range(0, {CAP})) AS e FROM q),
f AS (
  SELECT *, e * source_size + c AS fin, size > 0 AND e * source_size + c - size < target AS started FROM e),
g AS (
  SELECT *, sum(CASE WHEN started THEN size ELSE 0 END) OVER (ORDER BY CASE WHEN started THEN fin / target END NULLS LAST, rk, c ROWS UNBOUNDED PRECEDING) AS cum FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN started AND cum <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id, size, source_size, target
"""
