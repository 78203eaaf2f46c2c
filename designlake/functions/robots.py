"""robots.txt: which rule decides on a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AGENT = "designlake"
MOST_CHARS = 200_000


def rules(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, grp, agents, ln, allow, pattern of every rule: lines of agents in a row share the rules that follow them."""
    lines = df.select(*by, F.posexplode(F.split(F.substring(column, 1, MOST_CHARS), r"\r?\n")).alias("ln", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    colon = F.instr(line, ":")
    lines = lines.where(colon > 0).select(*by, "ln", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.substring(line, colon + 1, F.lit(1 << 30))).alias("value"))
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy(*by).orderBy("ln")
    agent = F.col("key") == "user-agent"
    lines = lines.withColumn("new", (agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int"))
    lines = lines.withColumn("grp", F.sum("new").over(order)).where("grp > 0")
    agents = lines.where(agent).groupBy(*by, "grp").agg(F.collect_set(F.lower("value")).alias("agents"))
    return lines.where(~agent).join(agents, [*by, "grp"], "right").select(*by, "grp", "agents", "ln", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def verdicts(paths: DataFrame, found: DataFrame, by: list[str], path: str, agent: str = AGENT) -> DataFrame:
    """paths with allowed and pattern (of the rule that decided, else null).

    The first group whose agents contain ours counts, else the first for all; in it the longest pattern that fits, of
    equal ones the first. A host without rules allows all.
    """
    own = F.exists("agents", lambda a: a.contains(agent))
    groups = found.groupBy(*by).agg(F.coalesce(F.min(F.when(own, F.col("grp"))), F.min(F.when(F.array_contains("agents", "*"), F.col("grp")))).alias("grp"))
    r = found.join(groups, [*by, "grp"]).where("pattern <> ''").select(*by, "ln", "allow", "pattern")
    anchored = F.col("pattern").endswith("$")
    body = F.when(anchored, F.substring("pattern", F.lit(1), F.length("pattern") - 1)).otherwise(F.col("pattern"))
    body = F.regexp_replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    r = r.withColumn("regex", F.concat(F.lit("^"), body, F.when(anchored, "$").otherwise("")))
    hit = paths.join(r, by).where(F.expr(f"`{path}` rlike regex"))
    best = hit.groupBy(*by, path).agg(F.max(F.struct(F.length("pattern").alias("n"), (-F.col("ln")).alias("o"), "allow", "pattern")).alias("b"))
    j = paths.join(best, [*by, path], "left")
    return j.select(*paths.columns, F.coalesce("b.allow", F.lit(True)).alias("allowed"), F.col("b.pattern").alias("pattern"))
