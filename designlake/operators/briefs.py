"""Pages as documents by level: a page has sections, a section lines, buttons, links and items; as JSON and as a brief.

Each level is gathered by one aggregation from the level below (items to sections, sections to pages). A section's lines
and items are few (see assets and layout), so a page is one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .assets import NAMES

MODES = ("verbatim", "placeholder")
JSON = {"ignoreNullFields": "false"}


def _lines(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))


def in_mode(c: Column, mode: str) -> Column:
    """A text as it stands, or as placeholder text of its shape."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return c if mode == "verbatim" else text.placeholder(c)


def described(copy: DataFrame, laid: DataFrame, items: DataFrame, notes: DataFrame, mode: str = "verbatim") -> DataFrame:
    """One row a section (page_id, i) with all that is known of it: id, kind, ord, layout (a struct), heading, level, eyebrow,
    subheading, body, links, notes (arrays), ctas (label, variant) and items (heading, body, image, href, icon).

    copy is assets.section_copy, laid layout.layouts, items layout.items and notes assets.section_notes. Sections without
    layout, items or notes keep null or empty ones. In mode placeholder all copy is stand-in text; addresses stay."""
    say = lambda c: in_mode(F.coalesce(c, F.lit("")), mode)
    each = lambda a: F.transform(a, lambda x: in_mode(x, mode))
    it = F.struct("place", say(F.col("heading")).alias("heading"), say(F.col("body")).alias("body"), "image", "href", F.col("has_icon").alias("icon"))
    g = items.groupBy("page_id", "i").agg(F.transform(F.array_sort(F.collect_list(it)), lambda x: F.struct(x["heading"].alias("heading"), x["body"].alias("body"), x["image"].alias("image"), x["href"].alias("href"), x["icon"].alias("icon"))).alias("items"))
    sizes = F.struct("display", "columns", "gap", "max_width", "padding_top", "padding_bottom", "padding_x", "min_height").alias("layout")
    d = copy.join(laid.select("page_id", "i", sizes), ["page_id", "i"], "left").join(g, ["page_id", "i"], "left").join(notes, ["page_id", "i"], "left")
    ctas = F.transform(F.arrays_zip(_lines("ctas").alias("label"), _lines("variants").alias("variant")), lambda x: F.struct(in_mode(x["label"], mode).alias("label"), x["variant"].alias("variant")))
    ord_ = F.regexp_extract("id", r"^section-(\d+)-", 1).cast("int")
    chrome = F.col("kind").isin("nav", "footer")
    none = F.array().cast("array<struct<heading:string,body:string,image:string,href:string,icon:boolean>>")
    return d.select(
        "page_id", "i", "id", "kind", ord_.alias("ord"), "layout", say(F.col("heading")).alias("heading"), "level", say(F.col("eyebrow")).alias("eyebrow"), say(F.col("subheading")).alias("subheading"),
        each(_lines("body")).alias("body"), ctas.alias("ctas"), each(_lines("links")).alias("links"), F.when(chrome, none).otherwise(F.coalesce("items", none)).alias("items"), _lines("notes").alias("notes"),
    )


def _by_page(d: DataFrame, value: Column, between: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ord", "i", value.alias("v"))))
    return d.groupBy("page_id").agg(F.array_join(F.transform(rows, lambda x: x["v"]), between).alias("v"), F.count("*").alias("n"), F.count(F.when(F.size("items") > 0, 1)).alias("repeats"))


def spec(pages: DataFrame, d: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """page_id, json of each page (page_id and what to tell of it): its columns as `page`, `design` (page_id, json) where
    given and known, sections in order and counts. Unknown sizes are null; a page without sections has an empty list."""
    fields = {"id": "id", "kind": "kind", "order": "ord", "layout": "layout", "heading": "heading", "headingLevel": "level", "eyebrow": "eyebrow", "subheading": "subheading", "bodyText": "body", "ctas": "ctas", "navLinks": "links", "items": "items", "notes": "notes"}
    s = _by_page(d, F.to_json(F.struct(*[F.col(c).alias(k) for k, c in fields.items()]), JSON), ",")
    told = pages.select("page_id", F.to_json(F.struct(*[c for c in pages.columns if c != "page_id"]), JSON).alias("page"))
    out = told.join(s, "page_id", "left")
    out = out.withColumn("design", F.lit(None).cast("string")) if design is None else out.join(design.select("page_id", F.col("json").alias("design")), "page_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    parts = [
        F.concat(F.lit('"page":'), "page"), F.concat(F.lit('"design":'), "design"), F.concat(F.lit('"sections":['), F.coalesce("v", F.lit("")), F.lit("]")),
        F.concat(F.lit('"stats":{"sections":'), number("n"), F.lit(',"components":'), number("repeats"), F.lit("}")),
    ]
    return out.select("page_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def _table(heads: list[str], rows: Column, cells) -> Column:
    """A markdown table of an array; cells gives an entry's cells (and its place)."""
    line = lambda x, k: F.concat(F.lit("| "), F.concat_ws(" | ", *cells(x, k)), F.lit(" |"))
    top = f"| {' | '.join(heads)} |\n| {' | '.join('---' for _ in heads)} |\n"
    return F.concat(F.lit(top), F.array_join(F.transform(rows, line), "\n"))


def label(kind: Column) -> Column:
    return F.array_join(F.transform(F.split(kind, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), " ")


def section_markdown() -> Column:
    """A section of `described` as the part of a brief that tells how to build it; what it lacks is left out."""
    px = lambda c: F.concat(F.lit("`"), F.col(c).cast("string"), F.lit("px`"))
    say = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"- {name}: \""), c, F.lit('"')))
    head = F.concat(F.lit("### 3."), F.col("ord").cast("string"), F.lit(" "), label(F.col("kind")), F.lit(" — `"), "id", F.lit("`"))
    wide = F.when(F.col("layout.columns") > 1, F.concat(F.lit(" · "), F.col("layout.columns").cast("string"), F.lit(" columns"))).otherwise("")
    laid = F.concat_ws("\n", F.lit("**Layout**\n"), F.concat(F.lit("- Display: `"), "layout.display", F.lit("`"), wide), F.when(F.col("layout.gap") > 0, F.concat(F.lit("- Gap: "), px("layout.gap"))),
        F.concat(F.lit("- Padding: "), px("layout.padding_top"), F.lit(" top, "), px("layout.padding_bottom"), F.lit(" bottom, "), px("layout.padding_x"), F.lit(" sides")), F.when(F.col("layout.max_width") > 0, F.concat(F.lit("- Content max-width: "), px("layout.max_width"))))
    others = F.filter("body", lambda x: x != F.col("subheading"))
    level = F.when(F.col("level") > 0, F.col("level")).otherwise(2).cast("string")
    heading = F.when(F.col("heading") != "", F.concat(F.lit("- Heading (h"), level, F.lit('): "'), "heading", F.lit('"')))
    told = F.concat_ws("\n", say("Eyebrow", "eyebrow"), heading, say("Subheading", "subheading"), F.when(F.size(others) > 0, F.array_join(F.transform(others, lambda x: F.concat(F.lit('- Body: "'), x, F.lit('"'))), "\n")))
    buttons = _table(["Label", "Variant"], F.col("ctas"), lambda x, k: [text.cell(x["label"]), text.cell(x["variant"])])
    media = lambda x: F.when(x["image"] != "", x["image"]).when(x["icon"], "icon").otherwise("")
    repeat = F.concat(F.lit("**Repeating component — `<"), F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in NAMES.items()], F.lit("Item")), F.lit(" />`**\n\n"), _table(["#", "Heading", "Body", "Link", "Media"], F.col("items"), lambda x, k: [(k + 1).cast("string"), text.cell(x["heading"]), text.cell(x["body"]), text.cell(x["href"]), text.cell(media(x))]))
    return F.concat_ws(
        "\n\n", head, F.when(F.col("layout").isNotNull(), laid), F.when(told != "", F.concat(F.lit("**Content**\n\n"), told)), F.when(F.size("ctas") > 0, F.concat(F.lit("**Buttons**\n\n"), buttons)),
        F.when(F.size("links") > 0, F.concat(F.lit("**Links:** "), F.array_join("links", " · "))), F.when(F.size("items") > 0, repeat), F.when(F.size("notes") > 0, F.concat(F.lit("**Notes**\n\n- "), F.array_join("notes", "\n- "))),
    )


def brief(pages: DataFrame, d: DataFrame) -> DataFrame:
    """page_id, brief of each page (page_id, url, title): its name, its sections in order as a table, then each in detail."""
    row = F.concat(F.lit("| "), F.col("ord").cast("string"), F.lit(" | "), label(F.col("kind")), F.lit(" | "), text.cell(F.col("heading")), F.lit(" | "), F.coalesce(F.concat(F.col("layout.min_height").cast("string"), F.lit("px")), F.lit("—")), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "i", row.alias("row"), section_markdown().alias("text"))))
    s = d.groupBy("page_id").agg(rows.alias("s"))
    name = F.coalesce("title", "url", F.lit(""))
    of = lambda k, between: F.array_join(F.transform("s", lambda x: x[k]), between)
    none = F.lit("_None detected._")
    structure = F.when(F.size("s") > 0, F.concat(F.lit("| # | Section | Heading | Height |\n| --- | --- | --- | --- |\n"), of("row", "\n"))).otherwise(none)
    detail = F.when(F.size("s") > 0, of("text", "\n\n")).otherwise(none)
    parts = [F.concat(F.lit("# "), name), F.lit("## 2. Page structure"), structure, F.lit("## 3. Sections"), detail]
    return pages.select("page_id", "url", "title").join(s, "page_id", "left").select("page_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("brief"))


def compact(pages: DataFrame, d: DataFrame) -> DataFrame:
    """page_id, brief of each page (page_id, url, title): one line a section with layout and padding, and below it what it
    says, its buttons and its repeat."""
    quoted = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f'  - {name}: "'), c, F.lit('"')))
    columns = F.when(F.col("layout.columns") > 1, F.concat(F.lit(", "), F.col("layout.columns").cast("string"), F.lit(" cols"))).otherwise("")
    pad = F.concat(F.lit("pad "), F.col("layout.padding_top").cast("string"), F.lit("/"), F.col("layout.padding_bottom").cast("string"))
    name = F.concat(F.lit("- **"), F.col("ord").cast("string"), F.lit(". "), label(F.col("kind")), F.lit("** (`"), "kind", F.lit("`)"))
    buttons = F.array_join(F.transform("ctas", lambda x: F.concat(F.lit('"'), x["label"], F.lit('" ('), x["variant"], F.lit(")"))), ", ")
    line = F.concat_ws(
        "\n", F.concat_ws(" · ", name, F.concat("layout.display", columns), pad), quoted("Heading", "heading"), quoted("Sub", "subheading"), F.when(F.size("ctas") > 0, F.concat(F.lit("  - Buttons: "), buttons)),
        F.when(F.size("items") > 0, F.concat(F.lit("  - "), F.size("items").cast("string"), F.lit("× `<"), F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in NAMES.items()], F.lit("Item")), F.lit(" />`"))),
    )
    s = _by_page(d, line, "\n")
    head = F.concat(F.lit("# "), F.coalesce("title", "url", F.lit("")), F.lit("\n\nSource: "), F.coalesce("url", F.lit("")), F.lit(" · "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" sections\n\n## Sections\n"))
    return pages.select("page_id", "url", "title").join(s, "page_id", "left").select("page_id", F.concat_ws("\n", head, "v").alias("brief"))
