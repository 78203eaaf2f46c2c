"""Sections of pages: the content root, candidates, and what kind each is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tree

# The least height of a section and of page chrome, and the least share of the viewport's width.
LEAST_HEIGHT, CHROME_HEIGHT, LEAST_WIDTH, VIEWPORT, FILLS = 60, 24, 0.55, 1440, 0.85
# How prices, quotations and numbers of a stats strip look.
PRICE = r"(?i)(?:[$£€¥]\s?\d|\d+\s?(?:/|per\s)\s?(?:mo|month|yr|year|seat|user))"
QUOTE = "[“”\"„«»]"
STAT = r"(?i)\d[\d,.]*\s*(%|\+|k|m|x)\b"
# A background that shows nothing, and the characters of a section's text that rules look at.
CLEAR, TEXT_CHARS = "rgba(0, 0, 0, 0)", 600


def content_root(n: DataFrame, hops: int = 6) -> DataFrame:
    """page_id, i: from the first root down to a sole child that fills its parent, or to a main of two children or more.

    n has boxes. One row a page; each step is two joins by page and parent.
    """
    n = n.withColumn("area", F.col("w") * F.col("h"))
    kids = n.where("parent is not null and area > 0").groupBy("page_id", "parent").agg(F.count("*").alias("n"), F.min(F.struct("i", "area")).alias("only"), F.min(F.when(F.col("tag") == "main", F.col("i"))).alias("main"))
    count = n.where("parent is not null").groupBy("page_id", F.col("parent").alias("main")).agg(F.count("*").alias("in_main"))
    kids = kids.join(count, ["page_id", "main"], "left")
    now = n.where("parent is null").groupBy("page_id").agg(F.min(F.struct("i", "area")).alias("r")).select("page_id", "r.i", "r.area")
    area = n.select("page_id", F.col("i").alias("next"), F.col("area").alias("next_area"))
    for _ in range(hops):
        j = now.join(kids.withColumnRenamed("parent", "i"), ["page_id", "i"], "left")
        sole = (F.col("n") == 1) & (F.col("only.area") > F.col("area") * FILLS)
        step = F.when(sole, F.col("only.i")).when(F.col("in_main") >= 2, F.col("main"))
        j = j.select("page_id", "i", "area", F.coalesce(step, "i").alias("next"))
        now = j.join(area, ["page_id", "next"]).select("page_id", F.col("next").alias("i"), F.col("next_area").alias("area"))
    return now.select("page_id", "i")


def candidates(n: DataFrame) -> DataFrame:
    """page_id, i, ord, total, whole: sections of each page from top to bottom: large children of the content root and the
    page's own header, navigation and footer; the root itself (whole) where there is none."""
    root = content_root(n).withColumnRenamed("i", "root")
    wide = n.join(root, "page_id").where((F.col("parent") == F.col("root")) & (F.col("h") >= LEAST_HEIGHT) & (F.col("w") >= VIEWPORT * LEAST_WIDTH))
    first = n.where("parent is null").groupBy("page_id").agg(F.min("i").alias("first_root"))
    chrome = n.join(first, "page_id").where((F.col("parent") == F.col("first_root")) & F.col("tag").isin("header", "nav", "footer") & (F.col("h") >= CHROME_HEIGHT))
    found = wide.select("page_id", "i", "y").union(chrome.select("page_id", "i", "y")).distinct()
    whole = root.join(found.select("page_id").distinct(), "page_id", "left_anti").join(n.select("page_id", F.col("i").alias("root"), "y"), ["page_id", "root"]).select("page_id", F.col("root").alias("i"), "y")
    all_ = found.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)))
    page = Window.partitionBy("page_id")
    return all_.select("page_id", "i", (F.row_number().over(page.orderBy("y", "i")) - 1).alias("ord"), F.count("*").over(page).alias("total"), "whole")


def features(n: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """found with what its section holds: tag, role, box, counts of tags in it, its text, and its repeat.

    n has own_text, role and background; marks page_id, i, repeat, images of sections with a repeat."""
    e = tree.within(n.select("page_id", "i", "depth", "tag", "own_text", "background"), found)
    below = lambda fits: F.count(F.when(fits & (F.col("d") > F.col("of")), 1))
    tag = lambda *t: F.col("tag").isin(*t)
    filled = (F.col("tag") == "a") & (F.col("background") != CLEAR)
    text = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "own_text"))), lambda x: x["own_text"]), " "), 1, TEXT_CHARS)
    g = e.groupBy("page_id", F.col("of").alias("i"), F.col("of_ord").alias("ord"), F.col("of_total").alias("total"), F.col("of_whole").alias("whole")).agg(
        below(tag("a")).alias("links"), below(tag("h1") & (F.col("own_text") != "")).alias("h1"), below(tag("blockquote")).alias("quotes"), below(tag("details", "summary")).alias("details"),
        below(tag("form", "input")).alias("forms"), below(tag("button") | filled).alias("buttons"), below(tag("img")).alias("images"), text.alias("text"),
    )
    own = n.select("page_id", "i", "tag", "role", "y", "h")
    m = marks.select("page_id", "i", "repeat", F.col("images").alias("pictures"))
    return g.join(own, ["page_id", "i"]).join(m, ["page_id", "i"], "left").fillna({"repeat": 0, "pictures": False})


def kind() -> Column:
    """What a section is, by the first rule that fits; columns as of features()."""
    c = F.col
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return (
        F.when(c("whole"), "content")
        .when(c("tag") == "footer", "footer")
        .when((c("tag") == "nav") | (c("role") == "navigation") | ((c("tag") == "header") & (c("y") < 200) & (c("h") < 200)) | ((c("y") < 160) & (c("h") <= 120) & (c("links") >= 3)), "nav")
        .when((c("ord") >= c("total") - 1) & (c("links") >= 6), "footer")
        .when(c("h1") > 0, "hero")
        .when(c("text").rlike(PRICE) & c("repeat").between(2, 5), "pricing")
        .when((c("quotes") > 0) | (c("text").rlike(QUOTE) & (c("repeat") <= 3)), "testimonial")
        .when(c("details") > 0, "faq")
        .when(c("pictures") & (c("repeat") >= 3), "logo-cloud")
        .when((c("repeat") >= 3) & (c("repeat") <= 5) & c("text").rlike(STAT) & (letters < 240), "stats")
        .when((c("repeat") >= 3) & (c("images") >= c("repeat")), "gallery")
        .when(c("repeat") >= 3, "feature-grid")
        .when(c("forms") > 0, "cta")
        .when((c("buttons") >= 1) & (c("h") < 520) & (c("links") <= 4), "cta")
        .otherwise("content")
    )
