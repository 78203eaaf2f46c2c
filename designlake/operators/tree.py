"""Page elements as a tree: nodes with parent, depth and subtree from the order of tags.

Steps are windows within a page, which is the unit of distribution. Markup is read as follows, in one pass: comments,
scripts and styles go first; tags in `SKIPPED` are no nodes, and with `html` no part of the tree; tags in `INLINE` hold
their own text only; a `p` lasts until it is closed or another block starts or ends; every other tag (a block) lasts
until it is closed, or to the end of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that are no nodes, tags without content, and tags inside a line of text.
SKIPPED = ["script", "style", "noscript", "template", "link", "meta", "head", "title", "br", "wbr", "source", "track", "param", "base", "html"]
VOID = ["img", "input", "hr", "area", "col", "embed"]
INLINE = ["a", "b", "i", "em", "strong", "span", "small", "u", "code", "sub", "sup", "label"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
UNSEEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<![^>]*>"
HOPS = 8
# Fixed value: characters of an element's own text that rules look at.
OWN_CHARS = 400
#: Characters of markup of a task, so that there are more tasks, not larger ones, where there are more pages.
TASK_CHARS = 8_000_000


def tags(pages: DataFrame) -> DataFrame:
    """page_id, t, tag of every opening tag."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("t", "tag"))


def dealt(pages: DataFrame, chars: int = TASK_CHARS) -> DataFrame:
    """page_id and html, each page whole in one of as many partitions as the markup needs. One sum is asked for first."""
    total = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("page_id", "html").repartition(max(least, -(-total // chars)), "page_id")


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nodes(pages: DataFrame, chars: int | None = OWN_CHARS) -> DataFrame:
    """page_id, i, tag, parent (null for a root), depth, n_descendants, own_text, t and end of each element.

    i counts a page's elements in document order; t and end are numbers of tags. own_text has at most `chars` characters, all
    for None.
    """
    clean = dealt(pages).select("page_id", F.regexp_replace("html", UNSEEN, "").alias("html"))
    # the text after a tag has the tag's number
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit("<[^>]*>"), 0).alias("token"), F.slice(F.split("html", "<[^>]*>"), 2, 1 << 30).alias("after"))
    t = clean.select("page_id", F.posexplode(both).alias("t", "x")).select("page_id", F.col("t").cast("long").alias("t"), "x.token", F.coalesce("x.after", F.lit("")).alias("after"))
    tag = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    t = t.withColumn("tag", tag).withColumn("close", F.col("token").startswith("</"))
    line, leaf = F.col("tag").isin(*INLINE), F.col("tag").isin(*VOID)
    t = t.withColumn("kind", F.when(F.col("tag").isin("", *SKIPPED), "none").when(leaf, "leaf").when(line, "inline").when(F.col("tag") == "p", "p").otherwise("block"))
    t = t.withColumn("node", ((F.col("kind") != "none") & ~F.col("close")).cast("int"))
    block = F.when(F.col("kind") == "block", F.when(F.col("close"), -1).otherwise(1)).otherwise(0)
    page = Window.partitionBy("page_id").orderBy("t")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("seen", F.sum("node").over(so_far)).withColumn("level", F.sum(block).over(so_far))
    # a tag's number, and how many elements stand before it: the last one of these ends a subtree that the tag ends
    stop = lambda t, upto: F.struct(t.alias("t"), upto.alias("upto"))
    here_t = stop(F.col("t"), F.col("seen") - F.col("node"))
    t = t.withColumn("i", F.when(F.col("node") == 1, F.col("seen") - 1)).withColumn("last_t", F.max(stop(F.col("t") + 1, F.col("seen"))).over(Window.partitionBy("page_id")))
    # what ends a p, and the p that is open before and after a tag
    mark = F.col("kind").isin("p", "block")
    t = t.withColumn("p_end", F.min(F.when(mark, here_t)).over(page.rowsBetween(1, Window.unboundedFollowing)))
    here = F.when(mark, F.struct(F.when((F.col("kind") == "p") & ~F.col("close"), F.col("i")).alias("i")))
    t = t.withColumn("p_now", F.last(here, ignorenulls=True).over(so_far)["i"]).withColumn("p_was", F.last(here, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))["i"])
    # a block and its end tag share a level
    is_block = F.col("kind") == "block"
    own = F.col("level") + F.when(is_block & F.col("close"), 1).otherwise(0)
    ends = F.lead(here_t).over(Window.partitionBy("page_id", is_block, own).orderBy("t"))
    end = F.when(is_block, ends).when(F.col("kind") == "p", F.col("p_end")).otherwise(stop(F.col("t") + 1, F.col("seen")))
    t = t.withColumn("end", F.coalesce(end, "last_t"))
    # the innermost open block: the last one opened at the level that a tag finds, or leaves
    opened = F.when(is_block & ~F.col("close"), F.col("i"))
    t = t.withColumn("up", F.col("level") - F.when(is_block & ~F.col("close"), 1).otherwise(0))
    each = t.withColumn("s", F.explode(F.when(opened.isNotNull(), F.array(F.struct(F.col("level").alias("at"), opened.alias("of"), F.lit(0).alias("part")), F.struct(F.col("up").alias("at"), F.lit(None).cast("long").alias("of"), F.lit(1).alias("part")))).otherwise(F.array(F.struct(F.col("level").alias("at"), F.lit(None).cast("long").alias("of"), F.lit(1).alias("part"))))))
    each = each.withColumn("block", F.last("s.of", ignorenulls=True).over(Window.partitionBy("page_id", "s.at").orderBy("t", "s.part"))).where("s.part = 1")
    parent = F.when(F.col("kind").isin("inline", "leaf"), F.coalesce("p_was", "block")).otherwise(F.col("block"))
    depth = F.col("up") + 1 + F.when(F.col("kind").isin("inline", "leaf") & F.col("p_was").isNotNull(), 1).otherwise(0)
    # the element that the text after a tag belongs to
    owner = F.when((F.col("kind") == "inline") & ~F.col("close"), F.col("i")).when((F.col("kind") == "block") & ~F.col("close"), F.col("i")).otherwise(F.coalesce("p_now", "block"))
    each = each.withColumn("parent", parent).withColumn("depth", depth).withColumn("owner", owner)
    # an element and the texts after its tags meet in one grouping; the steps above run once
    node = F.struct("tag", "parent", "depth", "t", "end", "token")
    parts = F.array(F.when(F.col("node") == 1, F.struct("i", node.alias("n"), F.lit(None).cast("struct<t: bigint, after: string>").alias("x"))), F.when(F.col("owner").isNotNull(), F.struct(F.col("owner").alias("i"), F.lit(None).cast(each.select(node.alias("n")).schema["n"].dataType).alias("n"), F.struct("t", "after").alias("x"))))
    each = each.select("page_id", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("s")).select("page_id", "s.*")
    own = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["after"]), "")
    n = each.groupBy("page_id", "i").agg(F.first("n", ignorenulls=True).alias("n"), own.alias("own")).where("n is not null").select("page_id", "i", "n.*", "own")
    said = _collapsed(F.col("own"))
    said = said if chars is None else F.substring(said, 1, chars)
    return n.select("page_id", "i", "tag", "parent", F.col("depth").cast("long").alias("depth"), (F.col("end.upto") - F.col("i") - 1).alias("n_descendants"), said.alias("own_text"), "t", F.col("end.t").alias("end"), "token")


def signatures(n: DataFrame) -> DataFrame:
    """page_id, i, n_children, signature: a node's tag, its sorted child tags, marks of media, headings and links in its
    subtree, and the size of the subtree as a power of two."""
    kids = n.where("parent is not null").groupBy("page_id", F.col("parent").alias("i")).agg(F.count("*").alias("n_children"), F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("kids"))
    so_far = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marks = {"m": ["img", "svg", "picture"], "h": HEADINGS, "a": ["a", "button"]}
    run = n.select("page_id", "i", "tag", "n_descendants", *[F.sum(F.col("tag").isin(*v).cast("int")).over(so_far).alias(k) for k, v in marks.items()])
    # what a subtree holds: the running counts at its last element less those at its first
    last = run.select("page_id", F.col("i").alias("last"), *[F.col(k).alias(f"{k}_end") for k in marks])
    run = run.withColumn("last", F.col("i") + F.col("n_descendants")).join(last, ["page_id", "last"])
    flags = [F.when(F.col(f"{k}_end") > F.col(k), f"+{k}").otherwise("") for k in marks]
    size = F.floor(F.log2(F.col("n_descendants") + 1.0)).cast("long").cast("string")
    return run.join(kids, ["page_id", "i"], "left").select("page_id", "i", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.concat("tag", F.lit("["), F.coalesce("kids", F.lit("")), F.lit("]"), *flags, F.lit("~"), size).alias("signature"))


def _step() -> Column:
    nth = F.row_number().over(Window.partitionBy("page_id", "parent", "tag").orderBy("i"))
    return F.concat("tag", F.lit(":nth-of-type("), nth.cast("string"), F.lit(")"))


def steps(n: DataFrame) -> DataFrame:
    """page_id, i and step: the node's part of a selector path, its tag and its place among its parent's like tags."""
    return n.select("page_id", "i", _step().alias("step"))


def _levels(n: DataFrame, levels: Column, *carried: str) -> DataFrame:
    """n once for each of its levels (of `levels`, its own depth at most) with at: what is open there, a struct of i, carried.

    Elements come in document order, so the last one of a level is the one around (or is) an element of that level or
    below. One window by page and level, linear in elements and levels asked for."""
    e = n.withColumn("level", F.explode(F.filter(levels, lambda x: x <= F.col("depth"))))
    own = F.when(F.col("level") == F.col("depth"), F.struct("i", *carried))
    return e.withColumn("at", F.last(own, ignorenulls=True).over(Window.partitionBy("page_id", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))


def ancestors(n: DataFrame) -> DataFrame:
    """page_id, i, ancestor, hop: every element above each, 1 for its parent."""
    top = F.sequence(F.lit(1).cast("long"), F.col("depth"))
    return _levels(n.select("page_id", "i", "depth"), top).where("level < depth").select("page_id", "i", F.col("at.i").alias("ancestor"), (F.col("depth") - F.col("level")).alias("hop"))


def paths(n: DataFrame, most: int = HOPS) -> DataFrame:
    """page_id, i, path: the steps of an element and of up to most - 1 above it, but for body."""
    s = n.select("page_id", "i", "depth", _step().alias("step"))
    near = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("depth") - (most - 1)), F.col("depth"))
    e = _levels(s, near, "step").where(~F.col("at.step").startswith("body:"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", F.col("at.step").alias("step")))), lambda x: x["step"]), " > ")
    return e.groupBy("page_id", "i").agg(path.alias("path"))


def within(n: DataFrame, marked: DataFrame) -> DataFrame:
    """n's columns (i as d), of and of_ columns: each element in the subtree of a marked one, itself included; once for each
    marked element around it. marked has page_id, i and columns that come back as of_. A page's marked elements stand at
    few depths, each of which is looked at once; n has depth."""
    more = {c: f"of_{c}" for c in marked.columns if c not in ("page_id", "i")}
    m = n.join(marked.withColumnsRenamed(more).withColumn("marked", F.lit(True)), ["page_id", "i"], "left")
    at = n.select("page_id", "i", "depth").join(marked.select("page_id", "i"), ["page_id", "i"]).groupBy("page_id").agg(F.collect_set("depth").alias("depths"))
    e = _levels(m.drop("of").join(at, "page_id"), F.col("depths"), "marked", *more.values()).where("at.marked")
    return e.select("page_id", F.col("at.i").alias("of"), F.col("i").alias("d"), *[c for c in n.columns if c not in ("page_id", "i")], *[f"at.{c}" for c in more.values()])


def largest_groups(k: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """page_id, parent, signature, n, children of k (page_id, i, parent, signature): the largest group of children of one
    signature, the first seen of equal ones, where it has `least` members and `share` of the children."""
    g = k.groupBy("page_id", "parent", "signature").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    g = g.withColumn("children", F.sum("n").over(Window.partitionBy("page_id", "parent")))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("page_id", "parent").orderBy(F.desc("n"), "first")))
    return g.where((F.col("rank") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("children"))).drop("rank", "first")


def repeats(n: DataFrame) -> DataFrame:
    """The largest group of like children of each element, by the signature; see largest_groups."""
    return largest_groups(n.where("parent is not null").select("page_id", "i", "parent").join(signatures(n), ["page_id", "i"]))


def subtree(n: DataFrame, root: DataFrame) -> DataFrame:
    """The subtree of one element of each page (root: page_id, i) as a tree of its own: page_id, i, parent, tag, depth;
    the root is 0 and its parent -1."""
    r = root.select("page_id", F.col("i").alias("root")).join(n.select("page_id", F.col("i").alias("root"), F.col("depth").alias("top"), "n_descendants"), ["page_id", "root"]).withColumnRenamed("n_descendants", "size")
    s = n.join(r, "page_id").where((F.col("i") >= F.col("root")) & (F.col("i") <= F.col("root") + F.col("size")))
    return s.select("page_id", (F.col("i") - F.col("root")).alias("i"), F.when(F.col("i") == F.col("root"), -1).otherwise(F.col("parent") - F.col("root")).cast("long").alias("parent"), "tag", (F.col("depth") - F.col("top")).alias("depth"))


def boxes(n: DataFrame, width: int = 1440, line: int = 24) -> DataFrame:
    """n with x, y, w, h: where a plain layout puts each element, one line for each, and 20 px in from its parent."""
    return n.select("*", (F.col("depth") * 20).alias("x"), (F.col("i") * line).alias("y"), (F.lit(width) - F.col("depth") * 40).alias("w"), ((F.col("n_descendants") + 1) * line).alias("h"))
