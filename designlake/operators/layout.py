"""How sections are laid out: the container that governs them, the wrapper that bounds them, columns, repeated items.

n is a table of page elements with boxes (w, h, top), and styles as CSS strings: display, template (grid columns), gap,
max_width, padding_left, padding_top, padding_bottom, font_size. The largest of the elements in a section is one grouped
maximum over tree.within, so the work grows with a page's elements, not with its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css
from . import tree

# How many elements of a section are looked at for its container and wrapper, and the least share of its area.
FIRST_CONTAINER, FIRST_WRAPPER, SHARE = 400, 300, 0.15
# Widths of a wrapper, its least share of the section, the height of one row, items and lines kept.
NARROWEST, WIDEST, SPANS, ROW, MOST_ITEMS, MOST_LINES, PROSE = 480, 2200, 0.8, 12, 12, 12, 20


def _area(w: str = "w", h: str = "h") -> Column:
    return F.col(w) * F.col(h)


def children(n: DataFrame) -> DataFrame:
    """page_id, i, children (of any size), shown (with an area) and in_row: those that stand as high as the first shown."""
    k = n.where("parent is not null").select("page_id", F.col("parent").alias("i"), F.col("i").alias("child"), "top", (_area() > 0).alias("shows"))
    first = F.first(F.when(F.col("shows"), F.col("top")), ignorenulls=True).over(Window.partitionBy("page_id", "i").orderBy("child").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    k = k.withColumn("row", F.col("shows") & (F.abs(F.col("top") - first) < ROW))
    return k.groupBy("page_id", "i").agg(F.count("*").alias("children"), F.count(F.when(F.col("shows"), 1)).alias("shown"), F.count(F.when(F.col("row"), 1)).alias("in_row"))


def containers(n: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, i, container, wrapper (null for none) of each section of found (page_id, i).

    The container is the largest grid or flex element with two children, else the largest element with three, that covers
    SHARE of the section, else the section; the wrapper the largest element (or the section) with a bounded width that it
    nearly fills. Of equally large ones the first."""
    e = n.join(children(n), ["page_id", "i"], "left").select("page_id", "i", "depth", _area().alias("area"), "w", "display", "max_width", F.coalesce("children", F.lit(0)).alias("children"))
    marked = found.select("page_id", "i").join(n.select("page_id", "i", _area().alias("area"), "w"), ["page_id", "i"])
    e = tree.within(e, marked)
    below = (F.col("d") > F.col("of")) & (F.col("d") <= F.col("of") + FIRST_CONTAINER) & (F.col("area") > F.col("of_area") * SHARE)
    width = css.number(F.col("max_width"))
    bounded = (F.col("d") <= F.col("of") + FIRST_WRAPPER) & width.between(NARROWEST, WIDEST) & (F.col("w") >= F.least(F.col("of_w").cast("double"), width) * SPANS)
    flows = F.col("display").contains("grid") | F.col("display").contains("flex")
    top = lambda fits: (-F.max(F.when(fits, F.struct("area", (-F.col("d")).alias("o"))))["o"])
    g = e.groupBy("page_id", F.col("of").alias("i")).agg(top(below & flows & (F.col("children") >= 2)).alias("placed"), top(below & (F.col("children") >= 3)).alias("stacked"), top(bounded).alias("wrapper"))
    return g.select("page_id", "i", F.coalesce("placed", "stacked", "i").alias("container"), "wrapper")


def columns(display: Column, template: Column, shown: Column, in_row: Column) -> Column:
    """The tracks of a grid's template; else the first row of a flex element's children; else 1."""
    tracks = F.size(F.filter(F.split(F.trim(template), r"\s+"), lambda t: t != ""))
    return F.when((template != "none") & (tracks > 0), tracks).when(display.contains("flex") & (shown > 0), F.greatest(in_row, F.lit(1))).otherwise(1).cast("int")


def layouts(n: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, i, container, display, gap, columns, max_width, padding_top, padding_bottom, padding_x, min_height of each
    section; sizes in whole pixels, 0 where there is none."""
    px = lambda c: css.whole(F.coalesce(css.number(F.col(c)), F.lit(0.0)))
    c = containers(n, found)
    box = n.join(children(n), ["page_id", "i"], "left").select("page_id", F.col("i").alias("container"), "display", "template", px("gap").alias("gap"), F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("in_row", F.lit(0)).alias("in_row"))
    wrap = n.select("page_id", F.col("i").alias("wrapper"), px("max_width").alias("max_width"), px("padding_left").alias("wrap_x"))
    own = n.select("page_id", "i", px("padding_top").alias("padding_top"), px("padding_bottom").alias("padding_bottom"), px("padding_left").alias("own_x"), F.col("h").cast("long").alias("min_height"))
    j = c.join(own, ["page_id", "i"]).join(box, ["page_id", "container"]).join(wrap, ["page_id", "wrapper"], "left")
    count = columns(F.col("display"), F.coalesce("template", F.lit("")), F.col("shown"), F.col("in_row"))
    x = F.when(F.col("own_x") != 0, F.col("own_x")).otherwise(F.coalesce("wrap_x", F.lit(0)))
    return j.select("page_id", "i", "container", "display", "gap", count.alias("columns"), "max_width", "padding_top", "padding_bottom", x.alias("padding_x"), "min_height")


def repeated(n: DataFrame, c: DataFrame) -> DataFrame:
    """page_id, i, container, item, place, repeat, row: the members of the repeat of each section's container (c: page_id, i,
    container), in order, with how many there are and how many stand in the first row."""
    shown = n.where(_area() > 0)
    kids = tree.signatures(n).select("page_id", "i", "signature").join(shown.where("parent is not null").select("page_id", "i", F.col("parent").alias("container"), "top"), ["page_id", "i"])
    groups = tree.largest_groups(kids.withColumnRenamed("container", "parent")).select("page_id", F.col("parent").alias("container"), "signature", F.col("n").alias("repeat"))
    k = kids.withColumnRenamed("i", "item").join(groups, ["page_id", "container", "signature"])
    order = Window.partitionBy("page_id", "container").orderBy("item")
    k = k.withColumn("place", F.row_number().over(order)).withColumn("near", (F.abs(F.col("top") - F.first("top").over(order)) < ROW).cast("int"))
    k = k.withColumn("row", F.sum("near").over(Window.partitionBy("page_id", "container")))
    return c.select("page_id", "i", "container").join(k, ["page_id", "container"]).select("page_id", "i", "container", "item", "place", "repeat", F.col("row").cast("int").alias("row"))


def items(n: DataFrame, r: DataFrame) -> DataFrame:
    """page_id, i, place, item, heading, body, lines, image, href, has_icon of the first MOST_ITEMS items of each repeat.

    n has own_text, src and href (empty for none) too. The heading is the first text of a heading in the item, else its
    largest text, else its first line; the body the first other line of prose, else any other line. Lines are distinct."""
    kept = r.where(F.col("place") <= MOST_ITEMS)
    e = tree.within(n.select("page_id", "i", "depth", "tag", "own_text", "src", "href", css.number(F.col("font_size")).alias("size")), kept.select("page_id", F.col("item").alias("i")).distinct())
    below, says = F.col("d") > F.col("of"), F.col("own_text") != ""
    first = lambda fits, value, *by: F.min(F.when(fits, F.struct(*by, "d", F.col(value).alias("x"))))["x"]
    lines = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(says, F.struct("d", "own_text")))), lambda x: x["own_text"])), 1, MOST_LINES)
    g = e.groupBy("page_id", F.col("of").alias("item")).agg(
        lines.alias("lines"),
        first(below & says & F.col("tag").isin(*tree.HEADINGS), "own_text").alias("headed"),
        first(below & says, "own_text", (-F.coalesce("size", F.lit(0.0))).alias("s")).alias("largest"),
        F.coalesce(first(F.col("src") != "", "src"), F.lit("")).alias("image"),
        F.coalesce(first(F.col("href") != "", "href"), F.lit("")).alias("href"),
        F.coalesce(F.bool_or(below & (F.col("tag") == "svg")), F.lit(False)).alias("has_icon"),
    )
    g = g.withColumn("heading", F.coalesce("headed", "largest", F.get("lines", F.lit(0)), F.lit("")))
    others = F.filter("lines", lambda x: x != F.col("heading"))
    body = F.coalesce(F.get(F.filter(others, lambda x: F.length(x) > PROSE), F.lit(0)), F.get(others, F.lit(0)), F.lit(""))
    return kept.select("page_id", "i", "item", "place").join(g, ["page_id", "item"]).select("page_id", "i", "place", "item", "heading", body.alias("body"), F.array_join("lines", "\n").alias("lines"), "image", "href", "has_icon")


def repeat_marks(n: DataFrame, r: DataFrame, most: int | None = MOST_ITEMS) -> DataFrame:
    """page_id, i, repeat, row, images of each section with a repeat; images: whether all but one of its items have one, where
    only the first `most` items are looked at, all for None."""
    kept = r if most is None else r.where(F.col("place") <= most)
    pictures = tree.within(n.select("page_id", "i", "depth", "src"), kept.select("page_id", F.col("item").alias("i")).distinct()).where("src <> ''").select("page_id", F.col("of").alias("item")).distinct()
    have = kept.join(pictures, ["page_id", "item"], "left_semi").groupBy("page_id", "i").agg(F.count("*").alias("with_image"))
    g = r.groupBy("page_id", "i").agg(F.max("repeat").alias("repeat"), F.max("row").alias("row"))
    return g.join(have, ["page_id", "i"], "left").select("page_id", "i", "repeat", "row", (F.coalesce("with_image", F.lit(0)) >= F.col("repeat") - 1).alias("images"))
