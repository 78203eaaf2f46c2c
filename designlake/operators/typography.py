"""The type scale and the font families of pages, from text elements with their computed styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css

# Characters that make prose, names below body size, and the characters kept of a sample.
PROSE, BELOW, SAMPLE = 60, ("small", "caption", "micro"), 90
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Faces that systems bring along, addresses of font files and of a font service, and the files kept.
SYSTEM = ("-apple-system", "blinkmacsystemfont", "segoe ui", "roboto", "helvetica neue", "helvetica", "arial", "system-ui", "ui-sans-serif", "sans-serif", "noto sans")
FONT_FILE, TYPEKIT, MOST_FILES = r"(?i)\.(woff2?|ttf|otf|eot)(\?|$)", "use.typekit.net", 6


def text_styles(df: DataFrame, by: list[str]) -> DataFrame:
    """Elements with text and a font size: by, ord, tag, chars, size, weight and the styles that a group tallies.

    df has ord, tag, text_len and the CSS strings font_size, font_weight, line_height, family.
    """
    size = css.whole(F.coalesce(css.number(F.col("font_size")), F.lit(0.0)))
    weight = css.whole(F.coalesce(F.nullif(css.number(F.col("font_weight")), F.lit(0.0)), F.lit(400.0)))
    d = df.where("text_len > 0").select(*by, "ord", "tag", F.col("text_len").alias("chars"), size.alias("size"), weight.alias("weight"), "line_height", "family")
    return d.where("size > 0").withColumn("line_height", css.line_height(F.col("line_height"), F.col("size")))


def _mode(styles: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value of most characters of each group; of equal ones the first seen."""
    t = styles.groupBy(*by, "size", "weight", value).agg(F.sum("chars").alias("w"), F.min("ord").alias("o"))
    return t.groupBy(*by, "size", "weight").agg(F.max(F.struct("w", (-F.col("o")).alias("o"), F.col(value).alias("v")))["v"].alias(value))


def groups(styles: DataFrame, by: list[str]) -> DataFrame:
    """by, size, weight, chars, n, line_height, family (primary) of each size and weight."""
    key = [*by, "size", "weight"]
    g = styles.groupBy(*key).agg(F.sum("chars").alias("chars"), F.count("*").alias("n"), F.min("ord").alias("first_at"))
    g = g.join(_mode(styles, by, "line_height"), key).join(_mode(styles, by, "family"), key)
    return g.withColumn("family", css.primary_family(F.col("family")))


def _detail(c: str, none: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(none)).alias(c)


def _said(df: DataFrame, by: list[str], *columns: str | Column) -> DataFrame:
    """by, ord, chars, size, weight and columns of the elements with text and a size."""
    size = css.whole(F.coalesce(css.number(F.col("font_size")), F.lit(0.0)))
    weight = css.whole(F.coalesce(F.nullif(css.number(F.col("font_weight")), F.lit(0.0)), F.lit(400.0)))
    return df.where(F.length("text") > 0).select(*by, "ord", F.length("text").alias("chars"), size.alias("size"), weight.alias("weight"), *columns).where("size > 0")


def letter_spacings(df: DataFrame, by: list[str]) -> DataFrame:
    """by, size, weight, letter_spacing of each group, as details has them, without the rest."""
    return _mode(_said(df, by, _detail("letter_spacing", "normal")), by, "letter_spacing")


def details(df: DataFrame, by: list[str], tags: int = 6) -> DataFrame:
    """by, size, weight, letter_spacing, text_transform, tags, sample of each group: the values of most characters (the first
    seen of equal ones; none stands for normal or none), the first tags in order of reading, and the longest text, the
    first of equal ones; of texts longer than a sample the last one, cut.

    df has ord, tag, text and the CSS strings font_size, font_weight, letter_spacing, text_transform. Samples are one
    maximum a group, not its texts; elements without text or size do not count."""
    key = [*by, "size", "weight"]
    t = _said(df, by, "tag", "text", _detail("letter_spacing", "normal"), _detail("text_transform", "none"))
    long = F.col("chars") > SAMPLE
    best = F.max(F.struct(long.alias("long"), F.when(long, F.col("ord")).otherwise(F.col("chars")).alias("a"), F.when(long, F.lit(0)).otherwise(-F.col("ord")).alias("b"), F.substring("text", 1, SAMPLE).alias("text")))["text"]
    g = t.groupBy(*key).agg(best.alias("sample"))
    first = t.groupBy(*key, "tag").agg(F.min("ord").alias("o")).groupBy(*key).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o", "tag"))), 1, tags), lambda x: x["tag"]), ",").alias("tags"))
    return g.join(first, key).join(_mode(t, by, "letter_spacing"), key).join(_mode(t, by, "text_transform"), key).select(*key, "letter_spacing", "text_transform", "tags", "sample")


def _first(condition: Column, by: list[str], *order) -> Column:
    """Whether a row is the first of its page among those with the condition."""
    rank = F.row_number().over(Window.partitionBy(*by, condition).orderBy(*order))
    return condition & (rank == 1)


def named(styles: DataFrame, by: list[str]) -> DataFrame:
    """groups with name: body, h1 to h6 by their tags, display, names below body size, else the group's own size.

    Names are claimed in that order, each step a window over the page's groups.
    """
    key = [*by, "size", "weight"]
    tags = styles.where(F.col("tag").isin(*HEADINGS)).groupBy(*key).pivot("tag", list(HEADINGS)).agg(F.count(F.lit(1)))
    g = groups(styles, by).join(tags, key, "left")
    page = Window.partitionBy(*by)
    prose = F.max(F.when(F.col("chars") >= PROSE, 1).otherwise(0)).over(page) == 1
    # of equal sizes the order of the scale decides: larger and bolder first
    scale = [F.desc("size"), F.desc("weight")]
    g = g.withColumn("prose", ~prose | (F.col("chars") >= PROSE))
    g = g.withColumn("name", F.when(_first(F.col("prose"), by, F.desc("chars"), *scale), "body"))
    g = g.withColumn("body_size", F.max(F.when(F.col("name") == "body", F.col("size"))).over(page))
    for h in HEADINGS:
        free = F.col("name").isNull() & (F.coalesce(F.col(h), F.lit(0)) > 0)
        g = g.withColumn("name", F.coalesce("name", F.when(_first(free, by, F.desc(h), *scale), h)))
    largest = F.row_number().over(page.orderBy(*scale)) == 1
    g = g.withColumn("name", F.coalesce("name", F.when(largest & (F.col("size") > F.col("body_size")), "display")))
    low = F.col("name").isNull() & (F.col("size") < F.col("body_size"))
    at = F.row_number().over(Window.partitionBy(*by, low).orderBy(*scale))
    g = g.withColumn("name", F.coalesce("name", F.when(low, F.get(F.array(*[F.lit(x) for x in BELOW]), at - 1))))
    # what is left is called by its size; of one size the second adds its weight
    open_ = F.col("name").isNull()
    nth = F.row_number().over(Window.partitionBy(*by, open_, "size").orderBy(F.desc("weight")))
    own = F.concat(F.lit("text-"), F.col("size").cast("string"), F.when(nth > 1, F.concat(F.lit("-"), F.col("weight").cast("string"))).otherwise(""))
    g = g.withColumn("name", F.coalesce("name", own))
    return g.select(*key, "chars", "n", "line_height", "family", "name", (F.col("n").cast("long") > 1).alias("again"), "body_size")


def scale(styles: DataFrame, by: list[str]) -> DataFrame:
    """The named groups that recur or are not below body size."""
    return named(styles, by).where(F.col("again") | (F.col("size") >= F.col("body_size"))).drop("again")


def stacks(styles: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """by, family, area (characters times size), weights, rank of the stacks that cover most."""
    t = styles.groupBy(*by, "family").agg(F.sum(F.col("chars") * F.col("size")).alias("area"), F.array_sort(F.collect_set("weight")).alias("weights"), F.min("ord").alias("o"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("area"), "o"))).where(F.col("rank") <= most)
    return t.select(*by, F.col("family").alias("stack"), css.primary_family(F.col("family")).alias("family"), "area", F.array_join(F.transform("weights", lambda w: w.cast("string")), ";").alias("weights"), "rank")


def families(styles: DataFrame, sizes: DataFrame, network: DataFrame, asked: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """by, rank, stack, family, usage, source, weights, urls, area of the stacks that cover most.

    sizes has by and size of headings; network by, ord, url; asked by, family of web fonts. A stack is used for mono by its
    name, for display where headings cover over half of it, else for body. It comes from the first that fits: a web font of
    that name, files with its name, the system, the font service, any files."""
    t = styles.join(sizes.select(*by, "size", F.lit(1).alias("heads")).distinct(), [*by, "size"], "left")
    size = F.col("chars") * F.col("size")
    t = t.groupBy(*by, F.col("family").alias("stack")).agg(F.sum(size).alias("area"), F.sum(F.when(F.col("heads") == 1, size).otherwise(0)).alias("head_area"), F.array_sort(F.collect_set("weight")).alias("weights"), F.min("ord").alias("o"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("area"), "o"))).where(F.col("rank") <= most)
    t = t.withColumn("family", css.primary_family(F.col("stack"))).withColumn("lower", F.lower("family"))
    n = network.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(F.col("url").rlike(FONT_FILE), F.struct("ord", "url")))).alias("files"), F.coalesce(F.bool_or(F.col("url").contains(TYPEKIT)), F.lit(False)).alias("service"))
    w = asked.groupBy(*by).agg(F.collect_set(F.lower("family")).alias("asked"))
    t = t.join(n, by, "left").join(w, by, "left")
    files = F.coalesce(F.transform("files", lambda f: f["url"]), F.array().cast("array<string>"))
    key = F.substring(F.regexp_replace("lower", r"\s+", ""), 1, 8)
    t = t.withColumn("all_files", files).withColumn("key", key).withColumn("own_files", F.filter("all_files", lambda u: F.contains(F.lower(u), F.col("key"))))
    source = F.when(F.coalesce(F.array_contains("asked", F.col("lower")), F.lit(False)), "google").when(F.size("own_files") > 0, "self-hosted").when(F.col("lower").isin(*SYSTEM), "system").when(F.coalesce("service", F.lit(False)), "adobe").when(F.size("all_files") > 0, "self-hosted").otherwise("unknown")
    usage = F.when(F.col("stack").rlike("(?i)mono|code|courier"), "mono").when(F.col("head_area") > F.col("area") * 0.5, "display").otherwise("body")
    urls = F.when(F.size("own_files") > 0, F.col("own_files")).when(source == "self-hosted", F.slice("all_files", 1, MOST_FILES)).otherwise(F.array().cast("array<string>"))
    return t.select(*by, "rank", "stack", "family", usage.alias("usage"), source.alias("source"), F.array_join(F.transform("weights", lambda x: x.cast("string")), ";").alias("weights"), F.array_join(urls, "\n").alias("urls"), "area")


def import_code(fallback: str = "400;700") -> Column:
    """How to load a family (family, stack, source, weights and urls as families gives them), as code with comments: at most
    four files are declared and eight named. Weights are those used, else `fallback`."""
    weights = F.when(F.coalesce(F.col("weights"), F.lit("")) == "", F.lit(fallback)).otherwise(F.col("weights"))
    href = F.concat(F.lit("@import url('https://fonts.googleapis.com/css2?family="), F.regexp_replace("family", r"\s+", "+"), F.lit(":wght@"), weights, F.lit("&display=swap');"))
    name = F.regexp_replace("family", "[^A-Za-z0-9]", "_")
    stack = F.concat(F.lit("font-family: "), "stack", F.lit(";"))
    listed = F.concat(F.lit("'"), F.replace(weights, F.lit(";"), F.lit("', '")), F.lit("'"))
    files = F.filter(F.split(F.coalesce("urls", F.lit("")), "\n"), lambda u: u != "")
    faces = F.transform(F.slice(files, 1, 4), lambda u: F.concat(F.lit("@font-face { font-family: '"), F.col("family"), F.lit("'; src: url('"), u, F.lit("') format('woff2'); font-display: swap; }")))
    sources = F.transform(F.slice(files, 1, 8), lambda u: F.concat(F.lit(" * "), u))
    # The words of the code and its comments.
    google = F.concat(F.lit("/* CSS */\n"), href, F.lit("\n\n// next/font (preferred in Next.js — self-hosts and avoids a round trip)\nimport { "), name, F.lit(" } from 'next/font/google';\nconst font = "), name, F.lit("({\n  subsets: ['latin'],\n  weight: ["), listed, F.lit("],\n  display: 'swap',\n});"))
    hosted = F.array_join(F.concat(F.array(F.lit("/* Self-hosted. Copy the files, then declare them: */")), faces, F.array(F.lit(""), F.lit("/* Original sources:")), sources, F.array(F.lit(" */"))), "\n")
    adobe = F.lit("/* Adobe Fonts (Typekit). Add your own kit id: */\n@import url('https://use.typekit.net/YOUR_KIT.css');")
    system = F.concat(F.lit("/* System stack — no import needed. */\n"), stack)
    unknown = F.concat(F.lit('/* "'), "family", F.lit('" is requested by the stack, but no font file was served\n * with the page. It either resolved from a local install or fell back to\n * the next family. To use it deliberately, load it explicitly: */\n'), href, F.lit("\n\n"), stack)
    source = F.col("source")
    return F.when(source == "google", google).when(source == "self-hosted", hosted).when(source == "adobe", adobe).when(source == "system", system).otherwise(unknown)
