"""What of a page can be seen: hidden elements and their subtrees go, and what stays is numbered anew.

Elements come in document order and a subtree is a range of numbers, so an element is inside a hidden one where the
furthest end of the hidden ones before it is not before it: one running maximum, linear in a page's elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css

# The most elements of a page, and the tag whose inside is not looked at.
MOST_NODES, SEALED = 3000, "svg"


def hidden() -> Column:
    """Elements that hide their subtree, of CSS strings display, visibility and opacity; null strings hide nothing."""
    clear = F.coalesce(css.number(F.col("opacity")) == 0, F.lit(False))
    return F.coalesce(F.col("display") == "none", F.lit(False)) | F.coalesce(F.col("visibility") == "hidden", F.lit(False)) | clear


def rendered(n: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """n's elements that are seen, at most `most` of a page: its columns, with i, parent and n_descendants counted among
    these, was (the old i) and truncated (true on each row of a page that had more).

    n has page_id, i, parent, tag, n_descendants, w, h, display, visibility, opacity. An element goes with its subtree if
    it is hidden; without a subtree if it has no area (one with children stays, as their parent). What an svg holds is
    its drawing and no element. A page without any visible element has no rows; null sizes count as no area."""
    page = Window.partitionBy("page_id").orderBy("i")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("i") + F.col("n_descendants")
    empty = (F.coalesce(F.col("w") * F.col("h"), F.lit(0)) == 0) & (F.col("n_descendants") == 0)
    e = n.withColumn("_hides", hidden())
    e = e.withColumn("_met", F.coalesce(F.max(F.when(F.col("_hides") | (F.col("tag") == SEALED), end)).over(before) < F.col("i"), F.lit(True)))
    e = e.withColumn("_keep", (F.col("_met") & ~F.col("_hides") & ~empty).cast("long"))
    e = e.withColumn("_upto", F.sum("_keep").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    # an element that is met when the page is full, seen or not, shows that the walk ended early
    e = e.withColumn("truncated", F.max(F.col("_met") & (F.col("_upto") - F.col("_keep") >= most)).over(Window.partitionBy("page_id")))
    kept = e.where((F.col("_keep") == 1) & (F.col("_upto") <= most)).withColumn("_end", end)
    last = e.select("page_id", F.col("i").alias("_end"), F.least(F.col("_upto"), F.lit(most)).alias("_last"))
    kept = kept.join(last, ["page_id", "_end"])
    up = kept.select("page_id", F.col("i").alias("parent"), (F.col("_upto") - 1).alias("_parent"))
    out = kept.join(up, ["page_id", "parent"], "left")
    made = {"was": F.col("i"), "i": F.col("_upto") - 1, "parent": F.col("_parent"), "n_descendants": F.col("_last") - F.col("_upto")}
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in n.columns], made["was"].alias("was"), "truncated")
