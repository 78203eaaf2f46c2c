"""Images, icons and fonts of pages, and the copy of their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css, text
from ..sources.scratch import written
from . import sections, tree

# How brand images are named; icon libraries by class and by what else their drawings share.
BRAND = r"(?i)logo|brand|wordmark|favicon|icon-\d|app-icon"
GRID = "0 0 24 24"
LIBRARIES = [("lucide", "(?i)lucide"), ("feather", "(?i)feather"), ("heroicons", "(?i)heroicon"), ("font-awesome", r"(?i)\bfa[-srlbd]?\b|fontawesome"), ("material", "(?i)material-icons|mui-")]
MOST_IMAGES, SAMPLES, BODY_LINES, CTAS, LINKS = 120, 4, 8, 6, 40
# Backgrounds that fill nothing, and the names of components by a section's kind.
UNFILLED = ("rgba(0, 0, 0, 0)", "transparent")
NAMES = {"feature-grid": "FeatureCard", "pricing": "PricingTier", "testimonial": "TestimonialCard", "logo-cloud": "LogoMark", "stats": "StatItem", "faq": "FaqItem", "gallery": "GalleryItem"}
VIEWPORTS = ["desktop", "tablet", "mobile"]
#: Drawings of a task, so that there are more tasks, not larger ones, where there are more drawings.
TASK_ROWS = 250_000


def images(d: DataFrame, by: list[str]) -> DataFrame:
    """The first of each image of a group in document order, at most MOST_IMAGES, with its size, role and whether it is
    the brand's. d has ord, src, alt, cls, natural_w, natural_h, y, w, h, is_background. Data URIs are told apart by
    their start and their alt text; rows without src are no images, a null alt or cls is an empty one."""
    d = d.withColumns({c: F.coalesce(c, F.lit("")) for c in ("alt", "cls")})
    key = F.when(F.col("src").startswith("data:"), F.concat(F.substring("src", 1, 64), F.lit("|"), F.col("alt"))).otherwise(F.col("src"))
    rest = [c for c in d.columns if c not in (*by, "ord")]
    d = d.where("src <> ''").groupBy(*by, key.alias("key")).agg(F.min(F.struct("ord", *rest)).alias("x")).select(*by, "key", "x.*")
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "key"))).where(F.col("place") <= MOST_IMAGES)
    width, height = [F.when(F.col(f"natural_{k}") != 0, F.col(f"natural_{k}")).otherwise(F.col(k)) for k in "wh"]
    d = d.withColumn("width", width).withColumn("height", height)
    named = F.col("src").rlike(BRAND) | F.col("alt").rlike(BRAND)
    role = (
        F.when(F.col("is_background"), "background")
        .when(named | F.col("cls").rlike(BRAND), "logo")
        .when((F.col("width") <= 48) & (F.col("height") <= 48), "icon")
        .when((F.col("width") <= 96) & (F.abs(F.col("width") - F.col("height")) <= 4), "avatar")
        .when((F.col("y") < 900) & (F.col("w") > 400), "hero")
        .otherwise("photo")
    )
    return d.select(*by, "place", "src", "alt", "width", "height", role.alias("role"), ((role == "logo") | named).alias("is_brand"))


def _in_library(name: str, pattern: str) -> Column:
    fits = F.col("cls").rlike(pattern)
    if name in ("lucide", "feather"):
        fits &= F.col("view_box") == GRID
    if name == "lucide":
        fits &= (F.col("fill") == "none") & (F.col("stroke") != "none")
    return fits


def svg_label(view_box: Column, width: Column, height: Column, paths: Column, d: Column) -> Column:
    """A drawing in one line, its path cut after 60 characters."""
    cut = F.concat(F.substring(d, 1, 60), F.when(F.length(d) > 60, "…").otherwise(""))
    return F.format_string('<svg viewBox="%s" width="%s" height="%s" paths="%s" d="%s">', view_box, width.cast("string"), height.cast("string"), paths.cast("string"), cut)


def _dealt(d: DataFrame, by: list[str], rows: int) -> DataFrame:
    """d, each group whole in one of as many partitions as its rows need. One count is asked for first."""
    least = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(max(least, -(-d.count() // rows)), *by)


def icons(d: DataFrame, by: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """library, confidence, n and samples: the first library that two drawings of a group or more are from and the share
    of them, else `custom` and the share on the common grid. d has ord, view_box, cls, fill, stroke, width, height,
    paths, d."""
    marks = [_in_library(k, p).cast("int").alias(f"in{i}") for i, (k, p) in enumerate(LIBRARIES)]
    label = svg_label(*[F.col(k) for k in ("view_box", "width", "height", "paths", "d")])
    d = _dealt(d.select(*by, "ord", (F.col("view_box") == GRID).cast("int").alias("on_grid"), label.alias("label"), *marks), by, rows)
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum("on_grid").alias("on_grid"), *[F.sum(f"in{i}").alias(f"n{i}") for i in range(len(LIBRARIES))])
    first = F.coalesce(*[F.when(F.col(f"n{i}") >= 2, i) for i in range(len(LIBRARIES))])
    hits = F.coalesce(*[F.when(F.col(f"n{i}") >= 2, F.col(f"n{i}")) for i in range(len(LIBRARIES))], F.col("on_grid"))
    g = g.select(*by, "n", first.alias("first"), (F.floor(hits * 100.0 / F.col("n") + 0.5) / 100.0).alias("confidence"))
    counts = F.col("first").isNull()
    for i in range(len(LIBRARIES)):
        counts |= (F.col("first") == i) & (F.col(f"in{i}") == 1)
    s = d.join(g, by).where(counts).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "label"))).where(F.col("place") <= SAMPLES)
    s = s.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), "\n").alias("samples"))
    library = F.coalesce(*[F.when(F.col("first") == i, k) for i, (k, _) in enumerate(LIBRARIES)], F.lit("custom"))
    return g.join(s, by).select(*by, library.alias("library"), "confidence", "n", "samples")


def google_families(d: DataFrame, by: list[str]) -> DataFrame:
    """family and first (its first request's ord) of the web fonts that a group's requests (ord, url) name."""
    d = d.where(F.col("url").contains("fonts.googleapis.com"))
    d = d.select(*by, "ord", F.explode(F.regexp_extract_all("url", F.lit("[?&]family=([^&#]*)"), 1)).alias("v"))
    plain = F.coalesce(F.try_url_decode("v"), F.col("v"))
    family = F.trim(F.replace(F.substring_index(plain, ":", 1), F.lit("+"), F.lit(" ")))
    return d.groupBy(*by, family.alias("family")).agg(F.min("ord").alias("first"))


def manifest(found: DataFrame, drawn: DataFrame, fonts: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: counts of its images, its brand images and roles, its icon library, its web fonts."""
    i = found.groupBy(*by).agg(F.count("*").alias("images"), F.sum(F.col("is_brand").cast("int")).alias("brand_images"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    f = fonts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "family"))), lambda x: x["family"]), ",").alias("fonts"))
    none = F.lit(0).cast("long")
    return i.join(drawn.drop("samples"), by, "full").join(f, by, "full").select(*by, F.coalesce("images", none).alias("images"), F.coalesce("brand_images", none).alias("brand_images"), F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("library", F.lit("custom")).alias("library"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n", none).alias("icons"), F.coalesce("fonts", F.lit("")).alias("fonts"))


def responsive(base: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """base's sections (ord, kind, columns) as another viewport shows them: the section of the same order and kind there,
    else the first one of that order, else hidden. other has seq too, its order of reading."""
    o = other.groupBy(*by, "ord", F.col("kind").alias("other_kind")).agg(F.min(F.struct("seq", "columns", "display")).alias("o"))
    j = base.join(o, [*by, "ord"], "left")
    best = F.min(F.when(F.col("o").isNotNull(), F.struct((F.col("kind") != F.col("other_kind")).cast("int").alias("miss"), F.col("o"))))
    g = j.groupBy(*by, "ord", "kind", F.col("columns").alias("wide")).agg(best.alias("b"))
    there = F.col("b.o.columns")
    return g.select(*by, "ord", "kind", F.coalesce(there, F.lit(0)).alias("columns"), F.coalesce("b.o.display", F.lit("none")).alias("display"), there.isNotNull().alias("visible"), F.coalesce(there < F.col("wide"), F.lit(False)).alias("stacks"))


def asked_viewports(asked: Column) -> tuple[Column, Column]:
    """The valid viewports of a list, all where there is none, in their own order; and those but the first."""
    valid = F.array(*[F.lit(v) for v in VIEWPORTS])
    kept = F.array_intersect(valid, F.coalesce(asked, F.array().cast("array<string>")))
    kept = F.when(F.size(kept) > 0, kept).otherwise(valid)
    return kept, F.array_except(kept, F.slice(kept, 1, 1))


def button_like() -> Column:
    """Buttons, and links that look like one; of elements with tag, role, cls, background and has_border."""
    filled = ~F.col("background").isin(*UNFILLED)
    link = (F.col("tag") == "a") & (filled | F.col("has_border") | F.col("cls").rlike(r"(?i)\b(btn|button|cta)\b"))
    return (F.col("tag") == "button") | (F.col("role") == "button") | link


def section_copy(n: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """page_id, i, id, kind, heading, level, eyebrow, subheading, body, ctas, variants, links of each section of `found`
    (page_id, i, id, kind); items has the lines of its repeat.

    The heading is the first text of the highest of h1 to h4, the eyebrow the first small or upper-case text above it. Body
    lines are texts of over 24 characters that are neither, and not said in an item of the repeat; calls to action are
    buttons and links like them, by all text in them (of nested tags parted by blanks), unless an item says it. Navigation
    and footers have links, but no heading and no repeat.
    """
    chrome = F.col("kind").isin("nav", "footer")
    columns = ["tag", "own_text", "role", "cls", "href", "background", "has_border", "y", "font_size", "text_transform"]
    e = tree.within(n.select("page_id", "i", "depth", *columns), found.select("page_id", "i", "kind")).where("d > of").withColumnsRenamed({"of": "i", "of_kind": "kind"}).drop("depth")
    # heading, eyebrow and the first prose below the heading of a section, beside each of its elements
    section, says = Window.partitionBy("page_id", "i"), F.col("own_text") != ""
    size = css.number(F.col("font_size"))
    small = (F.col("text_transform") == "uppercase") | (F.coalesce(F.nullif(size, F.lit(0.0)), F.lit(16.0)) < 15)
    e = e.withColumn("h", F.min(F.when(says & F.col("tag").isin("h1", "h2", "h3", "h4") & ~chrome, F.struct("tag", "d", "own_text", "y"))).over(section))
    e = e.withColumn("b", F.min(F.when(says & (F.col("y") < F.col("h.y")) & (F.length("own_text") < 60) & small, F.struct("d", "own_text"))).over(section))
    e = e.withColumn("prose", (F.length("own_text") > 24) & ~F.col("d").eqNullSafe(F.col("h.d")) & ~F.col("d").eqNullSafe(F.col("b.d")))
    e = written(e.withColumn("under", F.min(F.when(F.col("prose") & (F.col("y") >= F.col("h.y")), F.struct("d", "own_text"))).over(section)), "sections-in")
    top = e.groupBy("page_id", "i").agg(F.max("h.own_text").alias("heading"), F.max(F.substring("h.tag", 2, 1)).cast("int").alias("level"), F.max("b.own_text").alias("eyebrow"), F.max("under.own_text").alias("below"))
    # all the text in a button or link, wherever its section begins
    variant = F.when(~F.col("background").isin(*UNFILLED), "primary").when(F.col("has_border"), "secondary").otherwise("link")
    acts = e.select("page_id", "i", "d", variant.alias("variant"), F.filter(F.array(F.when(button_like(), "cta"), F.when((F.col("tag") == "a") & chrome, "link")), lambda x: x.isNotNull()).alias("uses")).where(F.size("uses") > 0)
    whole = tree.within(n.select("page_id", "i", "depth", "own_text"), acts.select("page_id", F.col("d").alias("i")).distinct()).where(says)
    whole = whole.groupBy("page_id", F.col("of").alias("d")).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "own_text"))), lambda x: x["own_text"]), " "), 1, sections.TEXT_CHARS).alias("label"))
    acts = acts.join(whole, ["page_id", "d"]).select("page_id", "i", "d", "label", F.explode("uses").alias("use"), "variant")
    body = e.where("prose").select("page_id", "i", "d", F.col("own_text").alias("label"), F.lit("body").alias("use"), F.lit("").alias("variant"))
    # sections with links have no items
    said = items.join(found.where(~chrome).select("page_id", "i"), ["page_id", "i"], "left_semi").select("page_id", "i", F.explode(F.split("lines", "\n")).alias("label")).distinct()
    lines = body.unionByName(acts).join(said, ["page_id", "i", "label"], "left_anti")
    most = {"body": (BODY_LINES, 400), "cta": (CTAS, 80), "link": (LINKS, 40)}
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "i", "use").orderBy("d")))
    lines = lines.where(F.coalesce(*[F.when(F.col("use") == k, F.col("place") <= v) for k, (v, _) in most.items()]))
    told = lambda k, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("use") == k, F.struct("place", c)))), lambda x: F.substring(x[c], 1, most[k][1])), "\n")
    first = F.min(F.when((F.col("use") == "body") & (F.col("place") == 1), F.col("label")))
    g = lines.groupBy("page_id", "i").agg(told("body", "label").alias("body"), told("cta", "label").alias("ctas"), told("cta", "variant").alias("variants"), told("link", "label").alias("links"), first.alias("first"))
    full = found.join(top, ["page_id", "i"], "left").join(g, ["page_id", "i"], "left")
    sub = F.when(~F.col("below").eqNullSafe(F.col("first")) & F.col("below").isNotNull(), F.col("below")).otherwise(F.coalesce("first", F.lit("")))
    return full.select("page_id", "i", "id", "kind", "heading", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("eyebrow", F.lit("")).alias("eyebrow"), sub.alias("subheading"), *[F.coalesce(k, F.lit("")).alias(k) for k in ("body", "ctas", "variants", "links")])


def section_notes(n: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """page_id, i, notes (one a line) of each section of found (page_id, i, kind): what a rebuild must not miss."""
    s = found.join(n.select("page_id", "i", "position", "backdrop", "image"), ["page_id", "i"]).join(marks.select("page_id", "i", "repeat", "row"), ["page_id", "i"], "left")
    name = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in NAMES.items()], F.lit("Item"))
    notes = [
        F.when(F.col("position").isin("sticky", "fixed"), F.concat(F.lit("Pinned to the viewport (position: "), "position", F.lit(")."))),
        F.when((F.col("backdrop") != "") & (F.col("backdrop") != "none"), F.concat(F.lit("Backdrop filter: "), "backdrop", F.lit("."))),
        F.when(F.col("image").contains("gradient"), F.concat(F.lit("Background gradient: "), F.substring("image", 1, 160), F.lit("."))),
        F.when(F.col("repeat").isNotNull() & ~F.col("kind").isin("nav", "footer"), F.concat(F.col("repeat").cast("string"), F.lit(" repeating items in "), F.col("row").cast("string"), F.lit(" column(s) — emit one "), name, F.lit(" and map over the data."))),
    ]
    return s.select("page_id", "i", F.concat_ws("\n", *notes).alias("notes"))


def component_names(found: DataFrame) -> DataFrame:
    """page_id, i, component: the kind of a section as a name; later ones of a kind are numbered from 2."""
    nth = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("i"))
    return found.select("page_id", "i", F.concat(text.pascal(F.col("kind")), F.when(nth > 1, nth.cast("string")).otherwise("")).alias("component"))


def page_html(copy: DataFrame) -> DataFrame:
    """page_id, html: a page rebuilt from its sections' copy."""
    lines = lambda c, a, b: F.when(F.col(c) == "", "").otherwise(F.concat(F.lit(a), F.replace(text.html(F.col(c)), F.lit("\n"), F.lit(b + a)), F.lit(b)))
    head = F.coalesce(F.concat(F.lit("<h2>"), text.html(F.col("heading")), F.lit("</h2>")), F.lit(""))
    part = F.concat(F.lit('<section id="'), F.col("id"), F.lit('">'), head, lines("body", "<p>", "</p>"), lines("ctas", "<button>", "</button>"), lines("links", "<a>", "</a>"), F.lit("</section>"))
    return copy.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))), lambda x: x["part"]), "\n").alias("html"))
