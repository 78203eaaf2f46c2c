"""Selectors of page elements that stay the same, and elements found again by any number of selectors.

n is a table of page elements (tree.nodes) with id and cls, empty where an element has none. Nothing is compared page by
page: selectors become keys, and looking up is one join on page and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tree

# The ids that can stand in a selector as they are, and the most steps of a path.
PLAIN_ID, MOST_STEPS = r"^[A-Za-z][A-Za-z0-9_-]*\z", 8


def stable(n: DataFrame) -> DataFrame:
    """page_id, i, selector: `#id` where the id is plain and the page's only one, else the steps to the element from up to
    MOST_STEPS - 1 elements above it, or from body.

    A step is the tag, and the place among the parent's like tags where there are several. Roots other than body count as
    children of one body, which is not named. An element inside a second body is named from that body on."""
    like = Window.partitionBy("page_id", "parent", "tag")
    nth = F.row_number().over(like.orderBy("i"))
    alone = (F.col("tag") == "body") | (F.count("*").over(like) == 1)
    step = F.when(alone, F.col("tag")).otherwise(F.concat("tag", F.lit(":nth-of-type("), nth.cast("string"), F.lit(")")))
    s = n.select("page_id", "i", "depth", step.alias("step"))
    near = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("depth") - (MOST_STEPS - 1)), F.col("depth"))
    at = F.transform(F.sort_array(F.collect_list(F.struct("level", F.col("at.step").alias("step"))), asc=False), lambda x: x["step"])
    p = tree._levels(s, near, "step").groupBy("page_id", "i").agg(at.alias("up"))
    body = F.array_position("up", "body").cast("int")
    p = p.withColumn("up", F.when(body > 0, F.slice("up", F.lit(1), F.greatest(body, F.lit(1)))).otherwise(F.col("up")))
    path = p.select("page_id", "i", F.array_join(F.reverse("up"), " > ").alias("path"))
    ids = n.select("page_id", "i", "id", F.count("*").over(Window.partitionBy("page_id", "id")).alias("same"))
    named = ids.where((F.col("same") == 1) & F.col("id").rlike(PLAIN_ID)).select("page_id", "i", "id")
    return path.join(named, ["page_id", "i"], "left").select("page_id", "i", F.coalesce(F.concat(F.lit("#"), "id"), "path").alias("selector"))


def find(asked: DataFrame, n: DataFrame) -> DataFrame:
    """asked (page_id, selector and other columns) with i: the page's element that has this stable selector; else for `#id`
    the first one with the id, for `.class` the largest one of the class (the first of equal ones); else -1.

    n has page_id, i, selector, id, cls and area. Blanks around a selector do not count; an empty, null or other selector
    finds nothing. Repeated selectors are answered once each. One row a key is left before the join."""
    key = lambda k, tier, size: n.select("page_id", k.alias("key"), F.struct(F.lit(tier).alias("tier"), size.cast("double").alias("size"), F.col("i").cast("long").alias("i")).alias("hit"))
    classes = F.explode(F.array_distinct(F.split("cls", r"\s+")))
    by_class = n.select("page_id", "i", "area", classes.alias("c")).select("page_id", F.concat(F.lit("."), "c").alias("key"), F.struct(F.lit(2).alias("tier"), (-F.col("area")).cast("double").alias("size"), F.col("i").cast("long").alias("i")).alias("hit"))
    keys = key(F.col("selector"), 0, F.lit(0)).unionByName(key(F.concat(F.lit("#"), "id"), 1, F.lit(0))).unionByName(by_class)
    keys = keys.groupBy("page_id", "key").agg(F.min("hit")["i"].alias("hit"))
    wanted = asked.withColumn("key", F.nullif(F.regexp_replace("selector", r"^\s+|\s+$", ""), F.lit("")))
    return wanted.join(keys, ["page_id", "key"], "left").withColumn("i", F.coalesce("hit", F.lit(-1).cast("long"))).drop("key", "hit")


def scoped(n: DataFrame, found: DataFrame) -> DataFrame:
    """The subtrees of found elements (page_id, selector, i), each a tree of its own: page_id, selector, i, parent, tag,
    depth, was (i on the page). The root is 0 and its parent -1; what was not found (-1) has no rows, so that a selector
    without a match never widens to the page. A page may be asked for many elements, inside one another too."""
    roots = found.where("i >= 0").select("page_id", "i", "selector").distinct()
    each = roots.groupBy("page_id", "i").agg(F.collect_list("selector").alias("selectors"))
    top = each.join(n.select("page_id", "i", F.col("depth").alias("top")), ["page_id", "i"])
    s = tree.within(n.select("page_id", "i", "parent", "tag", "depth"), top).withColumn("selector", F.explode("of_selectors"))
    parent = F.when(F.col("d") == F.col("of"), -1).otherwise(F.col("parent") - F.col("of")).cast("long")
    return s.select("page_id", "selector", (F.col("d") - F.col("of")).alias("i"), parent.alias("parent"), "tag", (F.col("depth") - F.col("of_top")).alias("depth"), F.col("d").alias("was"))
