"""Tokens of effects: radii, shadows, borders, motion, breakpoints and the container, by page.

Each reads values as strings with an ordinal; of equal counts the value seen first comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css
from .tally import added, tally

# Names of radii and shadows from the smallest on, and how many of the commonest values count.
RADII, SHADOWS = ("sm", "md", "lg", "xl", "2xl", "3xl"), ("sm", "md", "lg", "xl")
MOST_RADII, MOST_PILLS, MOST_SHADOWS, MOST_BORDERS, MOST_TIMES = 10, 20, 6, 5, 6


def _named(names: tuple[str, ...], at: Column, other: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), at - 1), other)


def radii(df: DataFrame, by: list[str], value: str, ordinal: str) -> DataFrame:
    """by, token, value, px, n: the recurring ones of the commonest radii below 100 px, named by size, and the pill as `full`."""
    v = F.col(value)
    t = tally(df.where((v != "") & (v != "0px") & ~v.startswith("0px 0px")), by, value, ordinal).withColumn("px", F.coalesce(css.number(v), F.lit(0.0)))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("px", "rank"))
    ramp = t.where((F.col("rank") <= MOST_RADII) & (F.col("n") > 1) & (F.col("px") > 0) & (F.col("px") < 100))
    ramp = ramp.select(*by, _named(RADII, at, F.concat(F.lit("r-"), css.whole(F.col("px")).cast("string"))).alias("token"), value, "px", "n")
    pill = t.where((F.col("rank") <= MOST_PILLS) & ((F.col("px") >= 100) | v.contains("%"))).groupBy(*by).agg(F.min(F.struct("rank", value, "n")).alias("p"))
    return ramp.unionByName(pill.select(*by, F.lit("full").alias("token"), F.col(f"p.{value}").alias(value), F.lit(9999.0).alias("px"), F.col("p.n").alias("n")))


def shadows(df: DataFrame, by: list[str], value: str, ordinal: str) -> DataFrame:
    """by, token, value, n: the recurring ones of the commonest shadows, named from the least blur on."""
    v = F.col(value)
    t = tally(df.where((v != "") & (v != "none")), by, value, ordinal).where((F.col("rank") <= MOST_SHADOWS) & (F.col("n") > 1))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(css.blur(v), "rank"))
    return t.select(*by, _named(SHADOWS, at, F.concat(F.lit("shadow-"), at.cast("string"))).alias("token"), value, "n")


def border_widths(df: DataFrame, by: list[str], value: str, ordinal: str) -> DataFrame:
    """by, value, n of the commonest widths, those that recur and are above 0."""
    t = tally(df, by, value, ordinal).where(F.col("rank") <= MOST_BORDERS)
    return t.where((F.col("n") > 1) & (css.number(F.col(value)) > 0)).select(*by, value, "n")


def motion(df: DataFrame, by: list[str], durations: str, easings: str, ordinal: str) -> DataFrame:
    """by, kind, value, n, rank of the commonest durations and easings, and whether durations make transitions a habit."""
    out = None
    for kind, column, skipped in (("duration", durations, ["0s"]), ("easing", easings, ["ease", "linear"])):
        # equal lists of a group are added up before any is taken apart
        whole = df.groupBy(*by, column).agg(F.count("*").alias("m"), F.min(ordinal).alias("o"))
        each = whole.select(*by, "m", "o", F.posexplode(css.split_list(F.col(column))).alias("i", "value")).where(~F.col("value").isin(*skipped))
        t = added(each.select(*by, "value", "m", (F.col("o") * 16 + F.col("i")).alias("o")), by, "value", "m", "o").where(F.col("rank") <= MOST_TIMES).withColumn("kind", F.lit(kind))
        out = t if out is None else out.unionByName(t)
    used = F.coalesce(F.sum(F.when(F.col("kind") == "duration", F.col("n"))).over(Window.partitionBy(*by)), F.lit(0)) > 3
    return out.select(*by, "kind", "value", "n", "rank", used.alias("uses_transitions"))


def breakpoints(df: DataFrame, by: list[str], query: str) -> DataFrame:
    """by, width: the distinct widths that media queries name."""
    # equal queries of a group are read once
    return df.select(*by, query).distinct().select(*by, F.explode(css.media_widths(F.col(query))).alias("width")).distinct()


def next_breakpoints(df: DataFrame, by: list[str], width: str) -> DataFrame:
    """by, react_at (the first above 768, else null) and html_at (the first from 700 on, else the first of all)."""
    w = F.col(width)
    return df.groupBy(*by).agg(F.min(F.when(w > 768, w)).alias("react_at"), F.coalesce(F.min(F.when(w >= 700, w)), F.min(w)).alias("html_at"))


def container(df: DataFrame, by: list[str], max_width: str, width: str, left: str, ordinal: str, viewport: int = 1440) -> DataFrame:
    """by, max_width, padding_x: the commonest width of wrappers that span the page, and their commonest padding."""
    m = css.number(F.col(max_width))
    w = df.select(*by, F.col(ordinal).alias("o"), m.alias("m"), F.col(width).alias("w"), F.coalesce(css.number(F.col(left)), F.lit(0.0)).alias("p"))
    w = w.where(F.col("m").between(480, 2200) & (F.col("w") >= F.least(F.lit(float(viewport)), "m") * 0.75))
    w = w.groupBy(*by, "m", "p").agg(F.count("*").alias("k"), F.min("o").alias("o"))
    best = lambda c, name: added(w.where(F.col(c) > 0), by, c, "k", "o").where("rank = 1").select(*by, css.whole(F.col(c)).alias(name))
    return best("m", "max_width").join(best("p", "padding_x"), by, "left")


def _parts(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, px, k: the numbers in the values of each group, rounded, and how often each is there; equal ones are added up
    before any is read. px is null for what is no number."""
    each = df.select(*by, F.explode(F.flatten(F.array(*[F.split(F.coalesce(v, F.lit("")), r"\s+") for v in values]))).alias("part"))
    return each.groupBy(*by, "part").agg(F.count("*").alias("k")).select(*by, css.whole(css.number(F.col("part"))).alias("px"), "k")


def spacing(df: DataFrame, by: list[str], values: list[str], units: tuple[int, ...] = (8, 6, 4, 2), share: float = 0.6) -> DataFrame:
    """by, total, base, confidence of every group: the coarsest unit that explains `share` of its spacings, else the last;
    4 and 0 for a group without any. A value counts for each number in it, rounded, from 1 to 256."""
    times = lambda fits: F.coalesce(F.sum(F.when(F.col("px").between(1, 256) & fits, F.col("k"))), F.lit(0))
    t = _parts(df, by, values).groupBy(*by).agg(times(F.lit(True)).alias("total"), *[times(F.col("px") % u == 0).alias(f"n{u}") for u in units])
    base = F.coalesce(*[F.when(F.col(f"n{u}") / F.col("total") >= share, u) for u in units], F.lit(units[-1]))
    part = F.coalesce(*[F.when(base == u, F.col(f"n{u}") / F.col("total")) for u in units])
    none = F.col("total") == 0
    return t.select(*by, "total", F.when(none, 4).otherwise(base).alias("base"), F.when(none, 0.0).otherwise(F.round(part, 3)).alias("confidence"))


def spacing_steps(df: DataFrame, by: list[str], values: list[str], most: int = 20) -> DataFrame:
    """by, px, key: the least recurring spacings of a group with their names on its grid."""
    t = _parts(df, by, values).where(F.col("px").between(1, 256)).groupBy(*by, "px").agg(F.sum("k").alias("n")).where("n > 1")
    t = t.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("px"))).where(F.col("at") <= most)
    return t.join(spacing(df, by, values), by).select(*by, "px", css.spacing_key(F.col("px"), F.col("base")).alias("key"))
