"""Queries over images, icons, fonts, viewports and the copy of sections, and the same in SQL.

Images, drawings, font requests and renders are derived from lineitem and events by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets, briefs, layout, sections
from ..sources.scratch import written
from . import catalogue

_K, _Q, _D = "l_partkey", "CAST(l_quantity AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)"
_S = lambda x: f"CAST({x} AS STRING)"
BY = ["page_id"]
IMAGES = {
    "page_id": "l_suppkey",
    "ord": "l_orderkey * 10 + l_linenumber",
    "src": f"CASE {_K} % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('data:image/png;base64,', repeat('A', 50 + CAST({_K} % 3 AS INT))) WHEN 2 THEN concat('/img/logo-', {_S(f'{_K} % 40')}, '.svg') ELSE concat('/img/', {_S(f'{_K} % 300')}, '.jpg') END",
    "alt": f"CASE WHEN {_K} % 9 = 0 THEN 'Brand mark' ELSE concat('a', {_S(f'{_K} % 11')}) END",
    "cls": f"CASE WHEN {_K} % 10 = 3 THEN 'wordmark' ELSE 'pic' END",
    "natural_w": f"CASE WHEN {_Q} % 3 = 0 THEN 0 ELSE {_Q} * 8 END",
    "natural_h": f"CASE WHEN {_Q} % 3 = 0 THEN 0 ELSE {_Q} * 8 + {_D} END",
    "y": f"{_D} * 200",
    "w": f"{_Q} * 12",
    "h": f"{_Q} * 12",
    "is_background": f"{_K} % 8 = 5",
}
ICONS = {
    "page_id": "l_suppkey",
    "ord": "l_orderkey * 10 + l_linenumber",
    "view_box": f"CASE WHEN {_Q} % 4 = 0 THEN '0 0 20 20' ELSE '0 0 24 24' END",
    "cls": f"CASE WHEN {_K} % 2 = 0 THEN 'plain' ELSE CASE l_suppkey % 6 WHEN 0 THEN 'lucide lucide-x' WHEN 1 THEN 'Feather' WHEN 2 THEN 'fas fa-x' WHEN 3 THEN 'heroicon' WHEN 4 THEN 'MUI-icon' ELSE 'fabric' END END",
    "fill": f"CASE WHEN {_Q} % 5 = 0 THEN '#000' ELSE 'none' END",
    "stroke": f"CASE WHEN {_Q} % 7 = 0 THEN 'none' ELSE 'currentColor' END",
    "width": _Q,
    "height": f"{_Q} + 1",
    "paths": _D,
    "d": f"concat('M', repeat('1 2 ', CAST({_Q} AS INT)))",
}
REQUESTS = {
    "page_id": "l_suppkey",
    "ord": "l_orderkey * 10 + l_linenumber",
    "url": f"concat(CASE WHEN {_Q} % 4 = 0 THEN 'https://cdn.example/css?family=None' ELSE 'https://fonts.googleapis.com/css2?family=' END, CASE {_K} % 5 WHEN 0 THEN 'Inter:wght@400;700' WHEN 1 THEN 'IBM+Plex%20Sans:400' WHEN 2 THEN 'Lora' WHEN 3 THEN '' ELSE 'Noto%3A300' END, CASE WHEN {_D} > 5 THEN concat('&family=Font+', {_S(f'{_K} % 4')}) ELSE '' END, '&display=swap#family=x')",
}
_KIND = f"CASE {_K} % 3 WHEN 0 THEN 'hero' WHEN 1 THEN 'content' ELSE 'gallery' END"
SECTIONS = {"page_id": "l_orderkey", "ord": "l_linenumber", "kind": _KIND, "columns": f"CAST(1 + {_Q} % 4 AS INT)"}
#: The same sections on a narrow screen: some are gone, some of another kind, some stand twice.
NARROW = {"page_id": "l_orderkey", "ord": f"CAST(l_linenumber - CASE WHEN {_Q} % 6 = 0 THEN 1 ELSE 0 END AS INT)", "kind": f"CASE WHEN {_K} % 7 = 0 THEN 'content' ELSE {_KIND} END", "columns": f"CAST(1 + {_Q} % 2 AS INT)", "display": f"CASE WHEN {_D} > 5 THEN 'flex' ELSE 'block' END", "seq": "l_linenumber"}
_GONE = f"{_K} % 5 <> 0"
ASKED = "concat(CASE WHEN event_id % 2 = 0 THEN 'mobile,' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN 'watch,' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN 'desktop,' ELSE '' END, CASE WHEN event_id % 7 = 0 THEN 'tablet,mobile' ELSE '' END)"


def _rows(spark, sf_dir, columns, where="true"):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where).select(*[F.expr(v).alias(k) for k, v in columns.items()])


def image_manifest(spark, sf_dir):
    return assets.images(_rows(spark, sf_dir, IMAGES), BY)


def icon_library(spark, sf_dir):
    return assets.icons(_rows(spark, sf_dir, ICONS), BY)


def google_fonts(spark, sf_dir):
    return assets.google_families(_rows(spark, sf_dir, REQUESTS), BY)


def asset_manifest(spark, sf_dir):
    return assets.manifest(image_manifest(spark, sf_dir), icon_library(spark, sf_dir), google_fonts(spark, sf_dir), BY)


def responsive_match(spark, sf_dir):
    base = _rows(spark, sf_dir, SECTIONS).groupBy("page_id", "ord").agg(F.min(F.struct("kind", "columns")).alias("s")).select("page_id", "ord", "s.*")
    return assets.responsive(base, _rows(spark, sf_dir, NARROW, _GONE), BY)


def viewport_sets(spark, sf_dir):
    kept, others = assets.asked_viewports(F.split(F.expr(ASKED), ","))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(kept, ",").alias("viewports"), F.array_join(others, ",").alias("others"))


def _described(spark, sf_dir):
    """Elements, the members of repeats, and sections with their kinds."""
    n = catalogue._boxes(spark, sf_dir)
    found = catalogue._found(n)
    repeated = catalogue._repeated(n, found)
    return n, repeated, written(catalogue.classified(n, found, repeated).select("page_id", "i", "id", "kind"), "sections")


def section_copy(spark, sf_dir):
    n, repeated, found = _described(spark, sf_dir)
    return assets.section_copy(n, found, layout.items(n, repeated))


def section_notes(spark, sf_dir):
    n, repeated, found = _described(spark, sf_dir)
    return assets.section_notes(n, found, layout.repeat_marks(n, repeated))


def component_names(spark, sf_dir):
    """The component of each section, of a repeat by all its items."""
    return assets.component_names(catalogue.classified(catalogue._boxes(spark, sf_dir), most=None))


def page_html(spark, sf_dir):
    return assets.page_html(section_copy(spark, sf_dir))


def _specified(spark, sf_dir, mode="verbatim"):
    n, repeated, found = _described(spark, sf_dir)
    items = written(layout.items(n, repeated), "items")
    laid = layout.layouts(n, found.select("page_id", "i"))
    notes = assets.section_notes(n, found, layout.repeat_marks(n, repeated))
    return written(briefs.described(assets.section_copy(n, found, items), laid, items, notes, mode), "specified")


def _told(spark, sf_dir):
    return catalogue.meta_extract(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "page_id").select("page_id", "url", "title", "description", "lang", "theme_color")


def spec_json(spark, sf_dir):
    """Each page with its sections, their layout, copy, buttons, links, items and notes, as one JSON document."""
    return briefs.spec(_told(spark, sf_dir), _specified(spark, sf_dir))


def page_brief(spark, sf_dir):
    """The structure of each page and how to build each section, as text."""
    return briefs.brief(_told(spark, sf_dir), _specified(spark, sf_dir))


def compact_sections(spark, sf_dir):
    """The sections of each page in a few lines."""
    return briefs.compact(_told(spark, sf_dir), _specified(spark, sf_dir))


QUERIES = [image_manifest, icon_library, google_fonts, asset_manifest, responsive_match, viewport_sets, section_copy, section_notes, component_names, page_html, spec_json, page_brief, compact_sections]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _sel(columns, where="true"):
    return f"SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM lineitem WHERE {where}"


_SUB = lambda name: f"({SQL[name]})"
_FIRST = " ".join(f"WHEN count(*) FILTER (lib{i}) >= 2 THEN {i}" for i in range(len(assets.LIBRARIES)))
_HITS = " ".join(f"WHEN count(*) FILTER (lib{i}) >= 2 THEN count(*) FILTER (lib{i})" for i in range(len(assets.LIBRARIES)))
_LIB = ", ".join(f"regexp_matches(cls, '{p}'){extra} AS lib{i}" for i, ((_, p), extra) in enumerate(zip(assets.LIBRARIES, [f" AND view_box = '{assets.GRID}' AND fill = 'none' AND stroke <> 'none'", f" AND view_box = '{assets.GRID}'", "", "", ""])))
_ESC = lambda c: f"""replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_TAGGED = lambda c, t: f"CASE WHEN {c} = '' THEN '' ELSE '<{t}>' || replace({_ESC(c)}, chr(10), '</{t}><{t}>') || '</{t}>' END"

SQL = {
    "image_manifest": f"""WITH im AS ({_sel(IMAGES)}),
k AS (SELECT *, CASE WHEN src LIKE 'data:%' THEN left(src, 64) || '|' || alt ELSE src END AS key FROM im WHERE src <> '' QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY ord, src, alt, cls, natural_w, natural_h, y, w, h, is_background) = 1),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord, key) AS INTEGER) AS place, coalesce(nullif(natural_w, 0), w) AS width, coalesce(nullif(natural_h, 0), h) AS height, regexp_matches(src, '{assets.BRAND}') OR regexp_matches(alt, '{assets.BRAND}') AS named FROM k),
r AS (SELECT *, CASE WHEN is_background THEN 'background' WHEN named OR regexp_matches(cls, '{assets.BRAND}') THEN 'logo' WHEN greatest(width, height) <= 48 THEN 'icon' WHEN width <= 96 AND abs(width - height) <= 4 THEN 'avatar' WHEN y < 900 AND w > 400 THEN 'hero' ELSE 'photo' END AS role FROM p WHERE place <= {assets.MOST_IMAGES})
SELECT page_id, place, src, alt, width, height, role, role = 'logo' OR named AS is_brand FROM r""",
    "icon_library": f"""WITH ic AS ({_sel(ICONS)}), l AS (SELECT *, {_LIB} FROM ic),
g AS (SELECT page_id, count(*) AS n, CASE {_FIRST} END AS first, floor((CASE {_HITS} ELSE count(*) FILTER (view_box = '{assets.GRID}') END) * 100.0::DOUBLE / count(*) + 0.5) / 100.0::DOUBLE AS confidence FROM l GROUP BY page_id),
s AS (SELECT page_id, '<svg viewBox="' || view_box || '" width="' || width || '" height="' || height || '" paths="' || paths || '" d="' || left(d, 60) || CASE WHEN length(d) > 60 THEN '…' ELSE '' END || '">' AS label, ord FROM l JOIN g USING (page_id) WHERE first IS NULL OR list_extract([lib0, lib1, lib2, lib3, lib4], first + 1) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord, label) <= {assets.SAMPLES}),
t AS (SELECT page_id, string_agg(label, chr(10) ORDER BY ord, label) AS samples FROM s GROUP BY page_id)
SELECT page_id, coalesce(list_extract([{', '.join(f"'{k}'" for k, _ in assets.LIBRARIES)}], first + 1), 'custom') AS library, confidence, n, samples FROM g JOIN t USING (page_id)""",
    "google_fonts": f"""WITH rq AS ({_sel(REQUESTS)}), v AS (SELECT page_id, ord, unnest(regexp_extract_all(url, '[?&]family=([^&#]*)', 1)) AS v FROM rq WHERE contains(url, 'fonts.googleapis.com'))
SELECT page_id, trim(replace(split_part(url_decode(replace(v, '+', ' ')), ':', 1), '+', ' ')) AS family, min(ord) AS first FROM v GROUP BY ALL""",
    "responsive_match": f"""WITH b AS (SELECT * FROM ({_sel(SECTIONS)}) QUALIFY row_number() OVER (PARTITION BY page_id, ord ORDER BY kind, columns) = 1), o AS ({_sel(NARROW, _GONE)}),
j AS (SELECT b.page_id, b.ord, b.kind, b.columns AS wide, o.columns AS there, o.display FROM b LEFT JOIN o ON o.page_id = b.page_id AND o.ord = b.ord QUALIFY row_number() OVER (PARTITION BY b.page_id, b.ord ORDER BY o.kind IS DISTINCT FROM b.kind, o.seq, o.columns, o.display) = 1)
SELECT page_id, ord, kind, coalesce(there, 0) AS columns, coalesce(display, 'none') AS display, there IS NOT NULL AS visible, coalesce(there < wide, FALSE) AS stacks FROM j""",
    "viewport_sets": f"""WITH a AS (SELECT event_id, string_split({ASKED}, ',') AS asked FROM events),
k AS (SELECT event_id, list_filter({assets.VIEWPORTS}, lambda v: list_contains(asked, v)) AS kept FROM a),
f AS (SELECT event_id, CASE WHEN len(kept) > 0 THEN kept ELSE {assets.VIEWPORTS} END AS kept FROM k)
SELECT event_id, array_to_string(kept, ',') AS viewports, array_to_string(kept[2:], ',') AS others FROM f""",
    "component_names": f"""WITH c AS ({catalogue._CLASSIFIED(catalogue._REPEATS_IN(""))}), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY i) AS nth FROM c)
SELECT page_id, i, list_aggregate(list_transform(string_split(kind, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') || CASE WHEN nth > 1 THEN CAST(nth AS VARCHAR) ELSE '' END AS component FROM n""",
    "section_copy": f"""WITH fd AS MATERIALIZED (SELECT page_id, i, id, kind, kind IN ('nav', 'footer') AS chrome FROM ({catalogue.SQL['section_classify']})),
n AS MATERIALIZED (WITH {catalogue._NODES}, {catalogue._BOX} SELECT * FROM bx), im AS MATERIALIZED ({catalogue.SQL['repeat_items']}),
ins AS (SELECT fd.*, d.i AS d, d.n_descendants AS size, d.tag, d.own_text AS t, d.role, d.cls, d.background, d.has_border, d.y, coalesce(nullif(TRY_CAST(replace(d.font_size, 'px', '') AS DOUBLE), 0), 16) AS fs, d.text_transform FROM fd JOIN n AS s USING (page_id, i) JOIN n AS d ON d.page_id = fd.page_id AND d.i > fd.i AND d.i <= fd.i + s.n_descendants),
top AS (SELECT page_id, i, d AS h_at, y AS h_y, t AS heading, CAST(tag[2] AS INTEGER) AS level FROM ins WHERE t <> '' AND NOT chrome AND tag IN ('h1', 'h2', 'h3', 'h4') QUALIFY row_number() OVER (PARTITION BY page_id, i ORDER BY tag, d) = 1),
br AS (SELECT page_id, i, d AS b_at, t AS eyebrow FROM ins JOIN top USING (page_id, i) WHERE t <> '' AND y < h_y AND length(t) < 60 AND (text_transform = 'uppercase' OR fs < 15) QUALIFY row_number() OVER (PARTITION BY page_id, i ORDER BY d) = 1),
said AS (SELECT DISTINCT page_id, i, unnest(string_split(lines, chr(10))) AS t FROM im JOIN fd USING (page_id, i) WHERE NOT chrome),
pr AS (SELECT ins.page_id, ins.i, d, t, y, h_y FROM ins LEFT JOIN top USING (page_id, i) LEFT JOIN br USING (page_id, i) WHERE length(t) > 24 AND d IS DISTINCT FROM h_at AND d IS DISTINCT FROM b_at),
bl AS (SELECT page_id, i, arg_min(t, d) AS below FROM pr WHERE y >= h_y GROUP BY page_id, i),
ac AS (SELECT *, tag = 'button' OR role = 'button' OR tag = 'a' AND (background NOT IN ('rgba(0, 0, 0, 0)', 'transparent') OR has_border OR regexp_matches(cls, '(?i)\\b(btn|button|cta)\\b')) AS act, CASE WHEN background NOT IN ('rgba(0, 0, 0, 0)', 'transparent') THEN 'primary' WHEN has_border THEN 'secondary' ELSE 'link' END AS variant FROM ins),
wh AS (SELECT ac.page_id, ac.i, ac.d, ac.act, ac.tag, ac.chrome, ac.variant, substr(string_agg(x.own_text, ' ' ORDER BY x.i), 1, {sections.TEXT_CHARS}) AS t FROM ac JOIN n x ON x.page_id = ac.page_id AND x.i BETWEEN ac.d AND ac.d + ac.size WHERE x.own_text <> '' AND (act OR ac.tag = 'a' AND chrome) GROUP BY ALL),
ln AS (SELECT page_id, i, d, t, 'body' AS use, '' AS variant FROM pr WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.page_id = pr.page_id AND said.i = pr.i AND said.t = pr.t)
  UNION ALL SELECT page_id, i, d, t, 'cta', variant FROM wh WHERE act AND NOT EXISTS (SELECT 1 FROM said WHERE said.page_id = wh.page_id AND said.i = wh.i AND said.t = wh.t) UNION ALL SELECT page_id, i, d, t, 'link', variant FROM wh WHERE tag = 'a' AND chrome),
ct AS (SELECT *, row_number() OVER (PARTITION BY page_id, i, use ORDER BY d) AS place FROM ln QUALIFY place <= CASE use WHEN 'body' THEN {assets.BODY_LINES} WHEN 'cta' THEN {assets.CTAS} ELSE {assets.LINKS} END),
g AS (SELECT page_id, i, string_agg(t, chr(10) ORDER BY d) FILTER (use = 'body') AS body, string_agg(t[:80], chr(10) ORDER BY d) FILTER (use = 'cta') AS ctas, string_agg(variant, chr(10) ORDER BY d) FILTER (use = 'cta') AS variants, string_agg(t[:40], chr(10) ORDER BY d) FILTER (use = 'link') AS links, min(t) FILTER (use = 'body' AND place = 1) AS first FROM ct GROUP BY page_id, i)
SELECT page_id, i, id, kind, heading, coalesce(level, 0) AS level, coalesce(eyebrow, '') AS eyebrow, CASE WHEN below IS NOT NULL AND below IS DISTINCT FROM first THEN below ELSE coalesce(first, '') END AS subheading, coalesce(body, '') AS body, coalesce(ctas, '') AS ctas, coalesce(variants, '') AS variants, coalesce(links, '') AS links
FROM fd LEFT JOIN top USING (page_id, i) LEFT JOIN br USING (page_id, i) LEFT JOIN bl USING (page_id, i) LEFT JOIN g USING (page_id, i)""",
    "section_notes": f"""WITH {catalogue._NODES}, {catalogue._REPEATED}, fd AS MATERIALIZED (SELECT page_id, i, kind FROM ({catalogue.SQL['section_classify']})),
rw AS (SELECT t.page_id, t.i, any_value(t.repeat) AS repeat, count(*) FILTER (abs(k.top - f.top) < {layout.ROW}) AS in_row FROM it t JOIN bx k ON k.page_id = t.page_id AND k.i = t.item JOIN it u ON u.page_id = t.page_id AND u.i = t.i AND u.place = 1 JOIN bx f ON f.page_id = u.page_id AND f.i = u.item GROUP BY t.page_id, t.i)
SELECT fd.page_id, fd.i, concat_ws(chr(10), CASE WHEN position IN ('sticky', 'fixed') THEN 'Pinned to the viewport (position: ' || position || ').' END, CASE WHEN backdrop NOT IN ('', 'none') THEN 'Backdrop filter: ' || backdrop || '.' END,
  CASE WHEN contains(image, 'gradient') THEN 'Background gradient: ' || image[:160] || '.' END, CASE WHEN repeat IS NOT NULL AND kind NOT IN ('nav', 'footer') THEN repeat || ' repeating items in ' || in_row || ' column(s) — emit one ' || CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in assets.NAMES.items())} ELSE 'Item' END || ' and map over the data.' END) AS notes
FROM fd JOIN bx ON bx.page_id = fd.page_id AND bx.i = fd.i LEFT JOIN rw ON rw.page_id = fd.page_id AND rw.i = fd.i""",
}
SQL["asset_manifest"] = f"""WITH i AS (SELECT page_id, count(*) AS images, count(*) FILTER (is_brand) AS brand_images, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM {_SUB("image_manifest")} GROUP BY page_id),
f AS (SELECT page_id, string_agg(family, ',' ORDER BY first, family) AS fonts FROM {_SUB("google_fonts")} GROUP BY page_id)
SELECT page_id, coalesce(images, 0) AS images, coalesce(brand_images, 0) AS brand_images, coalesce(roles, '') AS roles, coalesce(library, 'custom') AS library, coalesce(confidence, 0) AS confidence, coalesce(n, 0) AS icons, coalesce(fonts, '') AS fonts
FROM i FULL JOIN {_SUB("icon_library")} AS ic USING (page_id) FULL JOIN f USING (page_id)"""
SQL["page_html"] = f"""SELECT page_id, string_agg('<section id="' || id || '">' || coalesce('<h2>' || {_ESC("heading")} || '</h2>', '') || {_TAGGED("body", "p")} || {_TAGGED("ctas", "button")} || {_TAGGED("links", "a")} || '</section>', chr(10) ORDER BY i) AS html FROM {_SUB("section_copy")} GROUP BY page_id"""

_LIST = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, chr(10)) END"
_SPECIFIED = f"""mt AS MATERIALIZED (SELECT m.page_id, url, title, description, lang, theme_color FROM ({catalogue.SQL["meta_extract"]}) m JOIN pages USING (page_id)),
cp AS MATERIALIZED ({SQL["section_copy"]}), la AS MATERIALIZED ({catalogue.SQL["section_layout"]}), ri AS MATERIALIZED ({catalogue.SQL["repeat_items"]}), no AS MATERIALIZED ({SQL["section_notes"]}),
il AS (SELECT page_id, i, list({{'heading': heading, 'body': body, 'image': image, 'href': href, 'icon': has_icon}} ORDER BY place) AS items FROM ri GROUP BY page_id, i),
sd AS MATERIALIZED (SELECT cp.page_id, cp.i, id, kind, CAST(regexp_extract(id, '^section-(\\d+)-', 1) AS INTEGER) AS ord, {{'display': display, 'columns': columns, 'gap': gap, 'max_width': max_width, 'padding_top': padding_top, 'padding_bottom': padding_bottom, 'padding_x': padding_x, 'min_height': min_height}} AS layout,
  coalesce(heading, '') AS heading, level, eyebrow, subheading, {_LIST("body")} AS body, list_transform(range(1, len({_LIST("ctas")}) + 1), lambda k: {{'label': ({_LIST("ctas")})[k], 'variant': string_split(variants, chr(10))[k]}}) AS ctas, {_LIST("links")} AS links, CASE WHEN kind IN ('nav', 'footer') OR items IS NULL THEN [] ELSE items END AS items, {_LIST("notes")} AS notes
  FROM cp JOIN la USING (page_id, i) LEFT JOIN il USING (page_id, i) LEFT JOIN no USING (page_id, i))"""
SQL["spec_json"] = f"""WITH {_SPECIFIED}, sj AS (SELECT page_id, count(*) AS n, count(*) FILTER (len(items) > 0) AS r, string_agg(CAST(to_json({{'id': id, 'kind': kind, 'order': ord, 'layout': layout, 'heading': heading, 'headingLevel': level, 'eyebrow': eyebrow, 'subheading': subheading, 'bodyText': body, 'ctas': ctas, 'navLinks': links, 'items': items, 'notes': notes}}) AS VARCHAR), ',' ORDER BY ord, i) AS v FROM sd GROUP BY page_id)
SELECT page_id, '{{"page":' || CAST(to_json({{'url': url, 'title': title, 'description': description, 'lang': lang, 'theme_color': theme_color}}) AS VARCHAR) || ',"sections":[' || coalesce(v, '') || '],"stats":{{"sections":' || coalesce(n, 0) || ',"components":' || coalesce(r, 0) || '}}}}' AS json FROM mt LEFT JOIN sj USING (page_id)"""
_LABEL = "list_aggregate(list_transform(string_split(kind, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
_CELL = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN '—' ELSE replace({c}, '|', '\\|') END"
_BULLET = lambda name, c: f"'- {name}: \"' || nullif({c}, '') || '\"'"
_ROWS = lambda rows, line: f"array_to_string(list_transform({rows}, {line}), chr(10))"
_NL = "chr(10) || chr(10)"
SQL["page_brief"] = f"""WITH {_SPECIFIED},
ot AS (SELECT *, list_filter(body, lambda x: x <> subheading) AS others FROM sd),
tl AS (SELECT *, concat_ws(chr(10), {_BULLET("Eyebrow", "eyebrow")}, '- Heading (h' || CASE WHEN level > 0 THEN level ELSE 2 END || '): "' || nullif(heading, '') || '"', {_BULLET("Subheading", "subheading")}, CASE WHEN len(others) > 0 THEN {_ROWS("others", "lambda x: '- Body: " + chr(34) + "' || x || '" + chr(34) + "'")} END) AS told FROM ot),
tx AS (SELECT page_id, i, ord, '| ' || ord || ' | ' || {_LABEL} || ' | ' || {_CELL("heading")} || ' | ' || layout.min_height || 'px |' AS line, concat_ws({_NL}, '### 3.' || ord || ' ' || {_LABEL} || ' — `' || id || '`',
  concat_ws(chr(10), '**Layout**' || chr(10), '- Display: `' || layout.display || '`' || CASE WHEN layout.columns > 1 THEN ' · ' || layout.columns || ' columns' ELSE '' END, CASE WHEN layout.gap > 0 THEN '- Gap: `' || layout.gap || 'px`' END, '- Padding: `' || layout.padding_top || 'px` top, `' || layout.padding_bottom || 'px` bottom, `' || layout.padding_x || 'px` sides', CASE WHEN layout.max_width > 0 THEN '- Content max-width: `' || layout.max_width || 'px`' END),
  CASE WHEN told <> '' THEN '**Content**' || {_NL} || told END, CASE WHEN len(ctas) > 0 THEN '**Buttons**' || {_NL} || '| Label | Variant |' || chr(10) || '| --- | --- |' || chr(10) || {_ROWS("ctas", "lambda c: '| ' || " + _CELL("c.label") + " || ' | ' || c.variant || ' |'")} END,
  CASE WHEN len(links) > 0 THEN '**Links:** ' || array_to_string(links, ' · ') END, CASE WHEN len(items) > 0 THEN '**Repeating component — `<' || CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in assets.NAMES.items())} ELSE 'Item' END || ' />`**' || {_NL} || '| # | Heading | Body | Link | Media |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10)
    || {_ROWS("range(1, len(items) + 1)", "lambda k: '| ' || k || ' | ' || " + _CELL("items[k].heading") + " || ' | ' || " + _CELL("items[k].body") + " || ' | ' || " + _CELL("items[k].href") + " || ' | ' || " + _CELL("CASE WHEN items[k].image <> '' THEN items[k].image WHEN items[k].icon THEN 'icon' ELSE '' END") + " || ' |'")} END,
  CASE WHEN len(notes) > 0 THEN '**Notes**' || {_NL} || '- ' || array_to_string(notes, chr(10) || '- ') END) AS section FROM tl),
pt AS (SELECT page_id, string_agg(line, chr(10) ORDER BY ord, i) AS lines, string_agg(section, {_NL} ORDER BY ord, i) AS detail FROM tx GROUP BY page_id)
SELECT page_id, '# ' || coalesce(title, url, '') || {_NL} || '## 2. Page structure' || {_NL} || coalesce('| # | Section | Heading | Height |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || lines, '_None detected._') || {_NL} || '## 3. Sections' || {_NL} || coalesce(detail, '_None detected._') || chr(10) AS brief FROM mt LEFT JOIN pt USING (page_id)"""
_SAID = lambda name, c: f"'  - {name}: \"' || nullif({c}, '') || '\"'"
SQL["compact_sections"] = f"""WITH {_SPECIFIED},
cl AS (SELECT page_id, i, ord, concat_ws(chr(10), concat_ws(' · ', '- **' || ord || '. ' || {_LABEL} || '** (`' || kind || '`)', layout.display || CASE WHEN layout.columns > 1 THEN ', ' || layout.columns || ' cols' ELSE '' END, 'pad ' || layout.padding_top || '/' || layout.padding_bottom), {_SAID("Heading", "heading")}, {_SAID("Sub", "subheading")},
  CASE WHEN len(ctas) > 0 THEN '  - Buttons: ' || array_to_string(list_transform(ctas, lambda c: '"' || c.label || '" (' || c.variant || ')'), ', ') END, CASE WHEN len(items) > 0 THEN '  - ' || len(items) || '× `<' || CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in assets.NAMES.items())} ELSE 'Item' END || ' />`' END) AS line FROM sd),
cg AS (SELECT page_id, count(*) AS n, string_agg(line, chr(10) ORDER BY ord, i) AS v FROM cl GROUP BY page_id)
SELECT page_id, concat_ws(chr(10), '# ' || coalesce(title, url, '') || {_NL} || 'Source: ' || coalesce(url, '') || ' · ' || coalesce(n, 0) || ' sections' || {_NL} || '## Sections' || chr(10), v) AS brief FROM mt LEFT JOIN cg USING (page_id)"""
