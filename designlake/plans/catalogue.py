"""Registered queries over the page, style and event tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import challenge, color, url
from ..operators import jobs, layout, sections, selectors, tally, tree, visible
from ..sources.scratch import written


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _styles(spark, sf_dir):
    """Style observations: group, px, weight in cents, ordinal."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_quantity").cast("long").alias("px"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("area"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


STYLES = "SELECT l_suppkey AS page_id, CAST(l_quantity AS BIGINT) AS px, CAST(round(l_extendedprice * 100) AS BIGINT) AS area, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"


def tag_tally(spark, sf_dir):
    return tally.tally(tree.tags(_t(spark, sf_dir, "pages")), ["page_id"], "tag", "t")


def url_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", url.normalized(F.col("url")).alias("url"))


def weighted_mode(spark, sf_dir):
    return tally.weighted_mode(_styles(spark, sf_dir), ["page_id"], "px", "area", "ord")


def _channels():
    return [((F.col("p_partkey") * 37) % 256), ((F.col("p_partkey") * 59) % 256), ((F.col("p_size") * 5) % 256)]


def color_oklab(spark, sf_dir):
    l, a, b = color.oklab(*_channels())
    p = _t(spark, sf_dir, "part").select("p_partkey", color.hex_colour(*_channels()).alias("hex"), l.alias("l"), a.alias("a"), b.alias("b"))
    return p.select("p_partkey", "hex", F.round("l", 4).alias("lightness"), F.round(F.hypot("a", "b"), 4).alias("chroma"))


def _nodes(spark, sf_dir):
    return tree.nodes(_t(spark, sf_dir, "pages"))


def dom_nodes(spark, sf_dir):
    """Every element with its parent, depth, subtree size and whole own text."""
    return tree.nodes(_t(spark, sf_dir, "pages"), None).drop("t", "end", "token")


def tree_descendants(spark, sf_dir):
    return _nodes(spark, sf_dir).select("page_id", "i", "tag", "depth", "n_descendants")


def tree_children(spark, sf_dir):
    return _nodes(spark, sf_dir).select("page_id", "i", "tag", "parent")


def node_signature(spark, sf_dir):
    return tree.signatures(_nodes(spark, sf_dir))


def tree_ancestors(spark, sf_dir):
    return tree.ancestors(_nodes(spark, sf_dir))


def css_paths(spark, sf_dir):
    return tree.paths(_nodes(spark, sf_dir))


def repeat_groups(spark, sf_dir):
    return tree.repeats(_nodes(spark, sf_dir))


def subtree_slice(spark, sf_dir):
    """The largest element of each page with three levels above it or more, as a tree of its own; the first of equal ones."""
    n = _nodes(spark, sf_dir)
    root = n.where("depth >= 2").groupBy("page_id").agg(F.max(F.struct("n_descendants", (-F.col("i")).alias("o")))["o"].alias("o")).select("page_id", (-F.col("o")).alias("i"))
    return tree.subtree(n, root)


def selector_lookup(spark, sf_dir):
    """Of each page the element of a path (the second item of a list), else the largest of a class (`ad`), else -1."""
    n = _nodes(spark, sf_dir)
    exact = tree.paths(n).where("path like '%li:nth-of-type(2)'").groupBy("page_id").agg(F.min("i").alias("exact"))
    of_class = n.where(F.col("token").rlike('class="([^"]* )?ad( [^"]*)?"')).groupBy("page_id").agg(F.max(F.struct("n_descendants", (-F.col("i")).alias("o")))["o"].alias("o"))
    return _t(spark, sf_dir, "pages").select("page_id").join(exact, "page_id", "left").join(of_class, "page_id", "left").select("page_id", F.coalesce("exact", -F.col("o"), F.lit(-1)).alias("i"))


#: Styles of page elements, which the tables lack, from their place, by expressions that Spark and DuckDB both read.
NODE_STYLES = {
    "top": "(i - i % 6) * 24",
    "display": "CASE (page_id * 7 + i) % 5 WHEN 0 THEN 'grid' WHEN 1 THEN 'inline-flex' ELSE 'block' END",
    "template": "CASE (page_id + i) % 3 WHEN 0 THEN 'none' WHEN 1 THEN ' 100px  minmax(0,1fr) 1fr' ELSE '' END",
    "max_width": "CASE WHEN (page_id + i) % 4 = 0 THEN concat(CAST(300 + i % 11 * 200 AS STRING), '.5px') ELSE 'none' END",
    "gap": "CASE WHEN i % 3 = 0 THEN 'normal' ELSE concat(CAST(i % 7 * 4 AS STRING), '.5px 8px') END",
    "padding_left": "CASE WHEN i % 2 = 0 THEN '0px' ELSE concat(CAST(i % 4 * 8 AS STRING), 'px') END",
    "padding_top": "concat(CAST(i % 5 * 8 AS STRING), 'px')",
    "padding_bottom": "concat(CAST(i % 6 * 10 AS STRING), '.4px')",
    "font_size": "concat(CAST(12 + i * 5 % 9 * 2 AS STRING), 'px')",
    "text_transform": "CASE WHEN i % 11 = 0 THEN 'uppercase' ELSE 'none' END",
    "background": "CASE (page_id + i) % 6 WHEN 0 THEN 'rgb(1, 2, 3)' WHEN 1 THEN 'transparent' ELSE 'rgba(0, 0, 0, 0)' END",
    "has_border": "(page_id + i) % 9 = 0",
    "position": "CASE i % 13 WHEN 1 THEN 'sticky' WHEN 2 THEN 'fixed' ELSE 'static' END",
    "backdrop": "CASE WHEN i % 5 = 1 THEN 'blur(8px)' ELSE 'none' END",
    "image": "CASE WHEN i % 4 = 1 THEN 'linear-gradient(red, blue)' ELSE 'none' END",
}
#: Attributes of elements, empty where there is none.
ATTRIBUTES = {"role": r'(?i)\srole="([^"]*)"', "cls": r'(?i)\sclass="([^"]*)"', "src": r'(?i)^<img\s(?:[^>]*\s)?src="([^"]*)"', "href": r'(?i)^<a\s(?:[^>]*\s)?href="([^"]*)"'}


def _boxes(spark, sf_dir):
    """Elements with boxes, styles and attributes."""
    n = tree.boxes(_nodes(spark, sf_dir))
    return written(n.select("*", *[F.expr(v).alias(k) for k, v in NODE_STYLES.items()], *[F.regexp_extract("token", p, 1).alias(k) for k, p in ATTRIBUTES.items()]).drop("token"), "nodes")


def content_root(spark, sf_dir):
    return sections.content_root(_boxes(spark, sf_dir))


def section_candidates(spark, sf_dir):
    return sections.candidates(_boxes(spark, sf_dir))


#: Ids of elements, and what hides them; by expressions that both engines read, as in NODE_STYLES.
SEEN = {
    "id": "CASE WHEN i % 7 = 2 THEN concat('part-', CAST(i AS STRING)) WHEN i % 11 = 3 THEN 'twice' WHEN i % 13 = 4 THEN '9th' WHEN tag = 'article' THEN 'story' ELSE '' END",
    "visibility": "CASE WHEN (page_id * 3 + i) % 29 = 5 THEN 'hidden' ELSE 'visible' END",
    "opacity": "CASE WHEN (page_id + i) % 31 = 7 THEN '0' WHEN i % 5 = 0 THEN '0.5' ELSE '1' END",
    "flat": "(page_id + i * 5) % 17 = 0",
}
#: Selectors that each page is asked for.
ASKED = ["article", "#story", " #twice", "#part-9 ", "#nothing", ".ad", ".none", "body > nav > ul > li:nth-of-type(2) > a", "body > footer", "div > p", ""]


def _named(spark, sf_dir):
    """Elements with ids, classes and what hides them; some are flat."""
    b = tree.boxes(_nodes(spark, sf_dir))
    n = b.select("*", F.expr(NODE_STYLES["display"]).alias("shown_as"), *[F.expr(v).alias(k) for k, v in SEEN.items()], F.regexp_extract("token", ATTRIBUTES["cls"], 1).alias("cls"))
    return written(n.withColumn("display", F.when((F.col("page_id") + F.col("i")) % 37 == 11, "none").otherwise(F.col("shown_as"))).withColumn("h", F.when(F.col("flat"), 0).otherwise(F.col("h"))).drop("token", "shown_as", "flat"), "named")


def stable_selectors(spark, sf_dir):
    return selectors.stable(_named(spark, sf_dir))


def _asked(spark, sf_dir):
    n = _named(spark, sf_dir)
    asked = n.select("page_id").distinct().withColumn("selector", F.explode(F.array(*[F.lit(a) for a in ASKED])))
    keyed = n.join(selectors.stable(n), ["page_id", "i"]).withColumn("area", F.col("w") * F.col("h"))
    return n, selectors.find(asked, keyed)


def selector_table(spark, sf_dir):
    """The element of each page for each of the selectors asked for, -1 for none."""
    return _asked(spark, sf_dir)[1]


def scoped_trees(spark, sf_dir):
    """The subtrees of the elements that selector_table finds, as trees of their own."""
    n, found = _asked(spark, sf_dir)
    return selectors.scoped(n, found)


def rendered_nodes(spark, sf_dir):
    """The elements of a page that can be seen."""
    return visible.rendered(_named(spark, sf_dir)).select("page_id", "i", "parent", "tag", "n_descendants", "was", "truncated")


def _found(n):
    return written(sections.candidates(n), "candidates")


def _repeated(n, found):
    return written(layout.repeated(n, layout.containers(n, found)), "repeated")


def section_classify(spark, sf_dir):
    return classified(_boxes(spark, sf_dir))


def classified(n: DataFrame, found: DataFrame | None = None, repeated: DataFrame | None = None, most: int | None = layout.MOST_ITEMS) -> DataFrame:
    """Sections with their kinds; of a repeat, `most` items are looked at for images, all for None."""
    found = _found(n) if found is None else found
    marks = layout.repeat_marks(n, _repeated(n, found) if repeated is None else repeated, most)
    f = sections.features(n, found, marks).withColumn("kind", sections.kind())
    return f.select("page_id", "i", "kind", F.concat(F.lit("section-"), (F.col("ord") + 1).cast("string"), F.lit("-"), "kind").alias("id"), "links", "repeat", F.length("text").alias("chars"))


def section_layout(spark, sf_dir):
    n = _boxes(spark, sf_dir)
    return layout.layouts(n, _found(n))


def repeat_items(spark, sf_dir):
    n = _boxes(spark, sf_dir)
    return layout.items(n, _repeated(n, _found(n)))


_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_VALUE = lambda name: (rf'(?i)\s{name}\s*=\s*"([^"]*)"', rf"(?i)\s{name}\s*=\s*'([^']*)'")
_WITH = lambda tag, name, value: rf"""(?i)<{tag}\s(?:{_ATTRS}\s)?{name}\s*=\s*["']?{value}(?:["'\s/]{_ATTRS})?>"""
#: Parts of a page's head: the first tag that has them, the attribute (None: the text inside) and most characters. Attributes
#: come in any order and with either kind of quotes.
META = {
    "title": (r"(?is)<title[^>]*>(.*?)</title>", None, 200),
    "lang": (rf"(?i)<html\s{_ATTRS}>", "lang", 100),
    "description": (_WITH("meta", "name", "description"), "content", 400),
    "theme_color": (_WITH("meta", "name", "theme-color"), "content", 100),
    "og_image": (_WITH("meta", "property", "og:image"), "content", 2000),
    "generator": (_WITH("meta", "name", "generator"), "content", 200),
    "favicon": (_WITH("link", "rel", "(?:shortcut )?icon"), "href", 2000),
}


def head_part(html: Column, name: str) -> Column:
    """One of META's parts of a page; null where the page, the tag or the attribute is missing or blank."""
    pattern, attribute, most = META[name]
    if attribute is None:
        value = F.regexp_extract(html, pattern, 1)
    else:
        tag = F.regexp_extract(html, pattern, 0)
        value = F.coalesce(*[F.nullif(F.regexp_extract(tag, p, 1), F.lit("")) for p in _VALUE(attribute)])
    return F.nullif(F.substring(F.trim(F.regexp_replace(value, r"\s+", " ")), 1, most), F.lit(""))


def meta_extract(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", *[head_part(F.col("html"), k).alias(k) for k in META])


def text_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    return lines.groupBy("doc_id", F.trim("line").alias("line")).agg(F.min("pos").cast("long").alias("first_at"), F.count("*").alias("n"))


def job_latest_state(spark, sf_dir):
    return jobs.latest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


def job_ttl_sweep(spark, sf_dir):
    return jobs.expired(job_latest_state(spark, sf_dir), "at", 30)


def nth_of_type(spark, sf_dir):
    return tree.steps(_nodes(spark, sf_dir))


def challenge_verdict(spark, sf_dir):
    n = _nodes(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"))
    p = _t(spark, sf_dir, "pages").select("page_id", "url", challenge.visible_text(F.col("html")).alias("text")).join(n, "page_id", "left")
    p = p.withColumn("evidence", challenge.evidence(F.col("text"), F.coalesce("n", F.lit(0))))
    blocked = F.col("evidence").isNotNull()
    return p.select("page_id", blocked.alias("blocked"), "evidence", F.when(blocked, challenge.vendor(F.col("text"), F.col("url"))).alias("vendor"))


def own_text(spark, sf_dir):
    text = challenge.visible_text(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.substring(text, 1, 600).alias("text"), F.length(text).cast("long").alias("n_chars"))


def page_links(spark, sf_dir):
    """Link targets of each page with their number and first place."""
    a = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("t", "href"))
    return tally.tally(a, ["page_id"], "href", "t")


QUERIES = [tag_tally, url_normalize, weighted_mode, color_oklab, tree_descendants, tree_children, node_signature, dom_nodes, tree_ancestors, css_paths, repeat_groups, subtree_slice, selector_lookup, stable_selectors, selector_table, scoped_trees, rendered_nodes, content_root, section_candidates, section_classify, section_layout, repeat_items, meta_extract, text_lines, job_latest_state, job_ttl_sweep, nth_of_type, challenge_verdict, own_text, page_links]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow((CAST({c} / 255.0 AS DOUBLE) + 0.055) / 1.055, 2.4) END"


_Q = lambda names: ", ".join(f"'{n}'" for n in names)
#: Elements by their spans: a parent is the innermost span around a tag, found by a join instead of running levels.
_TREE = rf"""
cl AS (SELECT page_id, regexp_replace(html, '{tree.UNSEEN}', '', 'g') AS html FROM pages),
tk AS (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]*>')) AS token, unnest(string_split_regex(html, '<[^>]*>')[2:]) AS after, unnest(range(len(regexp_extract_all(html, '<[^>]*>')))) AS t FROM cl),
tg AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, token LIKE '</%' AS cl FROM tk),
kd AS (SELECT *, CASE WHEN tag IN ('', {_Q(tree.SKIPPED)}) THEN 'none' WHEN tag IN ({_Q(tree.VOID)}) THEN 'leaf' WHEN tag IN ({_Q(tree.INLINE)}) THEN 'inline' WHEN tag = 'p' THEN 'p' ELSE 'block' END AS kind,
  max(t) OVER (PARTITION BY page_id) + 1 AS last_t FROM tg),
lv AS (SELECT *, CAST(sum(CASE WHEN kind <> 'block' THEN 0 WHEN cl THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY t) AS BIGINT) AS lev FROM kd),
el AS (SELECT page_id, t, tag, kind, lev, last_t, token, row_number() OVER (PARTITION BY page_id ORDER BY t) - 1 AS i FROM lv WHERE NOT cl AND kind <> 'none'),
be AS (SELECT e.page_id, e.i, min(c.t) AS e FROM el e JOIN lv c ON c.page_id = e.page_id AND c.t > e.t AND c.kind = 'block' AND c.cl AND c.lev < e.lev WHERE e.kind = 'block' GROUP BY ALL),
pe AS (SELECT e.page_id, e.i, min(c.t) AS e FROM el e JOIN lv c ON c.page_id = e.page_id AND c.t > e.t AND c.kind IN ('p', 'block') WHERE e.kind = 'p' GROUP BY ALL),
span AS (SELECT el.*, CASE WHEN kind = 'block' THEN coalesce(be.e, last_t) WHEN kind = 'p' THEN coalesce(pe.e, last_t) ELSE t + 1 END AS e FROM el LEFT JOIN be USING (page_id, i) LEFT JOIN pe USING (page_id, i)),
par AS (SELECT c.page_id, c.i, c.tag, c.t, c.e, c.token, max(p.i) AS parent, count(p.i) + 1 AS depth FROM span c LEFT JOIN span p ON p.page_id = c.page_id AND p.t < c.t AND p.e > c.t AND (p.kind = 'block' OR p.kind = 'p' AND c.kind IN ('inline', 'leaf')) GROUP BY ALL),
nd AS (SELECT a.page_id, a.i, a.tag, a.parent, a.depth, a.t, a.e, a.token, count(d.i) AS n_descendants FROM par a LEFT JOIN span d ON d.page_id = a.page_id AND d.t > a.t AND d.t < a.e GROUP BY ALL),
ow AS (SELECT x.page_id, x.t, x.after, max(s.i) AS i FROM lv x JOIN span s ON s.page_id = x.page_id AND s.t <= x.t AND s.e > x.t AND (s.kind <> 'leaf') AND (s.kind <> 'inline' OR s.t = x.t) GROUP BY ALL),
"""
_OWN = r"trim(regexp_replace(string_agg(after, '' ORDER BY t), '\s+', ' ', 'g'))"
_SAID = lambda own: f"""{_TREE}tx AS (SELECT page_id, i, {own} AS own_text FROM ow GROUP BY ALL),
full_ AS (SELECT nd.*, coalesce(own_text, '') AS own_text FROM nd LEFT JOIN tx USING (page_id, i))
"""  # noqa: E731
_NODES = _SAID(f"substr({_OWN}, 1, {tree.OWN_CHARS})")
_DOM = lambda nodes: f"WITH {nodes} SELECT page_id, i, tag, parent, depth, n_descendants, own_text FROM full_"
_STEPS = "st AS (SELECT page_id, i, tag || ':nth-of-type(' || row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY i) || ')' AS step FROM nd)"
_ABOVE = "ab AS (SELECT n.page_id, n.i, a.i AS ancestor, n.depth - a.depth AS hop FROM nd n JOIN nd a ON a.page_id = n.page_id AND a.i < n.i AND n.i <= a.i + a.n_descendants)"
_PATHS = f"""{_STEPS}, {_ABOVE}, hops AS (SELECT * FROM ab UNION ALL SELECT page_id, i, i, 0 FROM nd),
pt AS (SELECT h.page_id, h.i, string_agg(step, ' > ' ORDER BY hop DESC) AS path FROM hops h JOIN st ON st.page_id = h.page_id AND st.i = h.ancestor WHERE hop < {tree.HOPS} AND step NOT LIKE 'body:%' GROUP BY ALL)"""
_HAS = lambda k, tags: f"CASE WHEN count(d.i) FILTER (d.tag IN ({_Q(tags)})) > 0 THEN '+{k}' ELSE '' END"
_SIGNED = f"""
k AS (SELECT page_id, parent AS i, count(*) AS n, string_agg(tag, ',' ORDER BY tag) AS kids FROM nd WHERE parent IS NOT NULL GROUP BY ALL),
f AS (SELECT n.page_id, n.i, {_HAS("m", ["img", "svg", "picture"])} || {_HAS("h", tree.HEADINGS)} || {_HAS("a", ["a", "button"])} AS flags FROM nd n LEFT JOIN nd d ON d.page_id = n.page_id AND d.i > n.i AND d.i <= n.i + n.n_descendants GROUP BY ALL),
sg AS (SELECT nd.page_id, nd.i, nd.parent, coalesce(k.n, 0) AS n_children, tag || '[' || coalesce(kids, '') || ']' || flags || '~' || CAST(floor(log2(n_descendants + 1)) AS BIGINT) AS signature FROM nd JOIN f USING (page_id, i) LEFT JOIN k USING (page_id, i))"""
_REPEATS = """
gr AS (SELECT page_id, parent, signature, count(*) AS n, min(i) AS o FROM sg WHERE parent IS NOT NULL GROUP BY ALL),
rp AS (SELECT page_id, parent, signature, n, CAST(sum(n) OVER (PARTITION BY page_id, parent) AS BIGINT) AS children FROM gr QUALIFY row_number() OVER (PARTITION BY page_id, parent ORDER BY n DESC, o) = 1),
rep AS (SELECT * FROM rp WHERE n >= 3 AND n >= 0.6 * children)"""
_BOX = f"""bx AS (SELECT *, i * 24 AS y, 1440 - depth * 40 AS w, (n_descendants + 1) * 24 AS h, (1440 - depth * 40) * (n_descendants + 1) * 24 AS area,
  {", ".join(f"{v} AS {k}" for k, v in NODE_STYLES.items())}, {", ".join(f"regexp_extract(token, '{p}', 1) AS {k}" for k, p in ATTRIBUTES.items())} FROM full_)"""
_ROOT = f"""{_BOX},
kk AS (SELECT page_id, parent, count(*) AS n, min(i) AS sole, arg_min(area, i) AS only_area, min(i) FILTER (tag = 'main') AS main FROM bx WHERE parent IS NOT NULL AND area > 0 GROUP BY ALL),
mc AS (SELECT page_id, parent AS main, count(*) AS in_main FROM bx WHERE parent IS NOT NULL GROUP BY ALL),
r0 AS (SELECT page_id, min(i) AS i, arg_min(area, i) AS area FROM bx WHERE parent IS NULL GROUP BY page_id)""" + "".join(
    f""",
r{s + 1} AS (SELECT v.page_id, v.i, bx.area FROM (SELECT r.page_id, CASE WHEN kk.n = 1 AND only_area > r.area * {sections.FILLS} THEN sole WHEN in_main >= 2 THEN kk.main ELSE r.i END AS i FROM r{s} r LEFT JOIN kk ON kk.page_id = r.page_id AND kk.parent = r.i LEFT JOIN mc ON mc.page_id = r.page_id AND mc.main = kk.main) v JOIN bx USING (page_id, i))"""
    for s in range(6)
)
_FOUND = f"""{_ROOT},
top AS (SELECT page_id, min(i) AS top FROM bx WHERE parent IS NULL GROUP BY page_id),
cf AS (SELECT b.page_id, b.i, b.y FROM bx b JOIN r6 ON r6.page_id = b.page_id AND b.parent = r6.i WHERE b.h >= {sections.LEAST_HEIGHT} AND b.w >= {sections.VIEWPORT * sections.LEAST_WIDTH}
  UNION SELECT b.page_id, b.i, b.y FROM bx b JOIN top ON top.page_id = b.page_id AND b.parent = top.top WHERE b.tag IN ('header', 'nav', 'footer') AND b.h >= {sections.CHROME_HEIGHT}),
ca AS (SELECT *, FALSE AS whole FROM cf UNION ALL SELECT r6.page_id, r6.i, bx.y, TRUE FROM r6 JOIN bx USING (page_id, i) WHERE r6.page_id NOT IN (SELECT page_id FROM cf)),
cand AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY y, i) - 1 AS ord, count(*) OVER (PARTITION BY page_id) AS total, whole FROM ca)"""
_PX = lambda c: rf"CAST(floor(coalesce(TRY_CAST(nullif(regexp_extract({c}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+))', 1), '') AS DOUBLE), 0) + 0.5) AS BIGINT)"
_LAID = rf"""{_FOUND},
ch AS (SELECT page_id, parent AS i, count(*) AS children, count(*) FILTER (area > 0) AS shown, count(*) FILTER (area > 0 AND abs(top - top0) < {layout.ROW}) AS in_row FROM (SELECT *, first_value(CASE WHEN area > 0 THEN top END IGNORE NULLS) OVER (PARTITION BY page_id, parent ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top0 FROM bx WHERE parent IS NOT NULL) GROUP BY page_id, parent),
ins AS (SELECT s.page_id, s.i, d.i AS d, d.area, d.display, coalesce(ch.children, 0) AS children, b.area AS s_area, b.w AS s_w, d.w, TRY_CAST(nullif(regexp_extract(d.max_width, '^\s*([+-]?(?:\d+\.?\d*|\.\d+))', 1), '') AS DOUBLE) AS mw
  FROM cand s JOIN bx b USING (page_id, i) JOIN bx d ON d.page_id = s.page_id AND d.i BETWEEN s.i AND s.i + b.n_descendants LEFT JOIN ch ON ch.page_id = d.page_id AND ch.i = d.i),
cn AS (SELECT page_id, i, coalesce(arg_max(d, row(area, -d)) FILTER (d > i AND d <= i + {layout.FIRST_CONTAINER} AND area > s_area * {layout.SHARE} AND children >= 2 AND (contains(display, 'grid') OR contains(display, 'flex'))),
  arg_max(d, row(area, -d)) FILTER (d > i AND d <= i + {layout.FIRST_CONTAINER} AND area > s_area * {layout.SHARE} AND children >= 3), i) AS container,
  arg_max(d, row(area, -d)) FILTER (d <= i + {layout.FIRST_WRAPPER} AND mw BETWEEN {layout.NARROWEST} AND {layout.WIDEST} AND w >= least(s_w, mw) * {layout.SPANS}) AS wrapper FROM ins GROUP BY page_id, i)"""
_REPEATS_IN = lambda kept: f"""{_SIGNED}, {_REPEATS}, {_LAID},
it AS (SELECT c.page_id, c.i, c.container, k.i AS item, r.n AS repeat, row_number() OVER (PARTITION BY c.page_id, c.i ORDER BY k.i) AS place FROM cn c JOIN rep r ON r.page_id = c.page_id AND r.parent = c.container JOIN sg k ON k.page_id = c.page_id AND k.parent = c.container AND k.signature = r.signature),
ii AS (SELECT t.*, d.i AS d, d.tag, d.own_text, d.src, d.href, TRY_CAST(replace(d.font_size, 'px', '') AS DOUBLE) AS size FROM it t JOIN bx b ON b.page_id = t.page_id AND b.i = t.item JOIN bx d ON d.page_id = t.page_id AND d.i BETWEEN t.item AND t.item + b.n_descendants{kept}),
mk AS (SELECT page_id, i, any_value(repeat) AS repeat, count(DISTINCT item) FILTER (src <> '') >= any_value(repeat) - 1 AS pictures FROM ii GROUP BY page_id, i)"""  # noqa: E731
_REPEATED = _REPEATS_IN(f" WHERE t.place <= {layout.MOST_ITEMS}")
_NAMED = f"""nm AS MATERIALIZED (SELECT * REPLACE (CASE WHEN flat THEN 0 ELSE h END AS h), CASE WHEN (page_id + i) % 37 = 11 THEN 'none' ELSE '' END AS display FROM
  (SELECT page_id, i, tag, parent, depth, n_descendants, 1440 - depth * 40 AS w, (n_descendants + 1) * 24 AS h, regexp_extract(token, '{ATTRIBUTES["cls"]}', 1) AS cls, {", ".join(f"{v} AS {k}" for k, v in SEEN.items())} FROM full_))"""
#: Each element's own steps of a path are told from how many elements around it there are, by a join with all of them.
_STABLE = f"""{_NAMED}, ls AS (SELECT page_id, i, parent, depth, n_descendants, CASE WHEN tag = 'body' OR count(*) OVER (PARTITION BY page_id, parent, tag) = 1 THEN tag ELSE tag || ':nth-of-type(' || row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY i) || ')' END AS step FROM nm),
ar AS (SELECT e.page_id, e.i, a.i AS a, a.step, e.depth - a.depth AS hop FROM ls e JOIN ls a ON a.page_id = e.page_id AND e.i BETWEEN a.i AND a.i + a.n_descendants),
hb AS (SELECT *, min(CASE WHEN step = 'body' THEN hop END) OVER (PARTITION BY page_id, i) AS body FROM ar WHERE hop < {selectors.MOST_STEPS}),
ph AS (SELECT page_id, i, string_agg(step, ' > ' ORDER BY hop DESC) AS path FROM hb WHERE hop <= coalesce(body, hop) GROUP BY page_id, i),
sl AS MATERIALIZED (SELECT page_id, i, CASE WHEN regexp_matches(id, '{selectors.PLAIN_ID}') AND count(*) OVER (PARTITION BY page_id, id) = 1 THEN '#' || id ELSE path END AS selector FROM nm JOIN ph USING (page_id, i))"""
_FIND = f"""{_STABLE}, wa AS (SELECT page_id, selector, trim(selector) AS key FROM (SELECT DISTINCT page_id FROM nm), (SELECT unnest([{_Q(ASKED)}]) AS selector)),
fi AS (SELECT page_id, selector, CASE WHEN key = '' THEN -1 ELSE coalesce((SELECT min(i) FROM sl WHERE sl.page_id = wa.page_id AND sl.selector = key), CASE key[1] WHEN '#' THEN (SELECT min(i) FROM nm WHERE nm.page_id = wa.page_id AND id = key[2:])
  WHEN '.' THEN (SELECT arg_max(i, row(w * h, -i)) FROM nm WHERE nm.page_id = wa.page_id AND list_contains(string_split_regex(cls, '\\s+'), key[2:])) END, -1) END AS i FROM wa)"""
_IN = lambda *t: f"count(*) FILTER (d.i > s.i AND d.tag IN ({_Q(t)}))"

LATEST = 'SELECT user_id, count(*) AS n_events, arg_max(event_type, row(ts, event_id)) AS state, max(ts) AS "at" FROM events GROUP BY user_id'

_TEXT = rf"trim(regexp_replace(regexp_replace(html, '{challenge.UNSEEN}', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_PHRASE = " ".join(f"WHEN contains(lower(t), '{p}') THEN '{p}'" for p in challenge.PHRASES)
_VENDOR = " ".join(f"WHEN regexp_matches(lower(t || ' ' || url), '{r}') THEN '{v}'" for r, v in challenge.VENDORS)

_LIT = lambda p: "'" + p.replace("'", "''") + "'"
_HEAD = lambda p, a: f"regexp_extract(html, {_LIT(p)}, 1)" if a is None else "coalesce(" + ", ".join(f"nullif(regexp_extract(regexp_extract(html, {_LIT(p)}, 0), {_LIT(v)}, 1), '')" for v in _VALUE(a)) + ")"

_CLASSIFIED = lambda repeated: f"""WITH {_NODES}, {repeated},
s0 AS (SELECT c.*, b.tag, b.role, b.y, b.h, b.n_descendants FROM cand c JOIN bx b USING (page_id, i)),
ft AS (SELECT s.page_id, s.i, s.ord, s.total, s.whole, s.tag, s.role, s.y, s.h, {_IN("a")} AS links, count(*) FILTER (d.i > s.i AND d.tag = 'h1' AND d.own_text <> '') AS h1, {_IN("blockquote")} AS quotes, {_IN("details", "summary")} AS details, {_IN("form", "input")} AS forms,
  count(*) FILTER (d.i > s.i AND (d.tag = 'button' OR d.tag = 'a' AND d.background <> '{sections.CLEAR}')) AS buttons, {_IN("img")} AS images, substr(string_agg(d.own_text, ' ' ORDER BY d.i), 1, {sections.TEXT_CHARS}) AS text FROM s0 s JOIN bx d ON d.page_id = s.page_id AND d.i BETWEEN s.i AND s.i + s.n_descendants GROUP BY ALL),
fr AS (SELECT ft.*, coalesce(mk.repeat, 0) AS repeat, coalesce(mk.pictures, FALSE) AS pictures FROM ft LEFT JOIN mk USING (page_id, i)),
kn AS (SELECT *, CASE WHEN whole THEN 'content' WHEN tag = 'footer' THEN 'footer' WHEN tag = 'nav' OR role = 'navigation' OR tag = 'header' AND y < 200 AND h < 200 OR y < 160 AND h <= 120 AND links >= 3 THEN 'nav' WHEN ord >= total - 1 AND links >= 6 THEN 'footer' WHEN h1 > 0 THEN 'hero'
  WHEN regexp_matches(text, '{sections.PRICE}') AND repeat BETWEEN 2 AND 5 THEN 'pricing' WHEN quotes > 0 OR regexp_matches(text, '{sections.QUOTE}') AND repeat <= 3 THEN 'testimonial' WHEN details > 0 THEN 'faq' WHEN pictures AND repeat >= 3 THEN 'logo-cloud'
  WHEN repeat BETWEEN 3 AND 5 AND regexp_matches(text, '{sections.STAT}') AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 240 THEN 'stats' WHEN repeat >= 3 AND images >= repeat THEN 'gallery' WHEN repeat >= 3 THEN 'feature-grid'
  WHEN forms > 0 OR buttons >= 1 AND h < 520 AND links <= 4 THEN 'cta' ELSE 'content' END AS kind FROM fr)
SELECT page_id, i, kind, 'section-' || (ord + 1) || '-' || kind AS id, links, repeat, length(text) AS chars FROM kn"""  # noqa: E731

SQL = {
    "dom_nodes": _DOM(_SAID(_OWN)),
    "tree_descendants": f"WITH {_NODES} SELECT page_id, i, tag, depth, n_descendants FROM nd",
    "tree_children": f"WITH {_NODES} SELECT page_id, i, tag, parent FROM nd",
    "nth_of_type": f"WITH {_NODES}, {_STEPS} SELECT * FROM st",
    "node_signature": f"WITH {_NODES}, {_SIGNED} SELECT page_id, i, n_children, signature FROM sg",
    "tree_ancestors": f"WITH {_NODES}, {_ABOVE} SELECT * FROM ab",
    "css_paths": f"WITH {_NODES}, {_PATHS} SELECT * FROM pt",
    "repeat_groups": f"WITH {_NODES}, {_SIGNED}, {_REPEATS} SELECT * FROM rep",
    "subtree_slice": f"""WITH {_NODES}, r AS (SELECT page_id, i AS root, depth AS top, n_descendants AS size FROM nd WHERE depth >= 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_descendants DESC, i) = 1)
SELECT nd.page_id, i - root AS i, CASE WHEN i = root THEN -1 ELSE parent - root END AS parent, tag, depth - top AS depth FROM nd JOIN r ON r.page_id = nd.page_id AND i BETWEEN root AND root + size""",
    "selector_lookup": f"""WITH {_NODES}, {_PATHS}, ex AS (SELECT page_id, min(i) AS i FROM pt WHERE path LIKE '%li:nth-of-type(2)' GROUP BY page_id),
cs AS (SELECT page_id, i FROM nd WHERE regexp_matches(token, 'class="([^"]* )?ad( [^"]*)?"') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_descendants DESC, i) = 1)
SELECT p.page_id, coalesce(ex.i, cs.i, -1) AS i FROM pages p LEFT JOIN ex USING (page_id) LEFT JOIN cs USING (page_id)""",
    "stable_selectors": f"WITH {_NODES}, {_STABLE} SELECT * FROM sl",
    "selector_table": f"WITH {_NODES}, {_FIND} SELECT * FROM fi",
    "scoped_trees": f"""WITH {_NODES}, {_FIND}
SELECT fi.page_id, selector, d.i - fi.i AS i, CASE WHEN d.i = fi.i THEN -1 ELSE d.parent - fi.i END AS parent, d.tag, d.depth - r.depth AS depth, d.i AS was FROM fi JOIN nm r ON r.page_id = fi.page_id AND r.i = fi.i JOIN nm d ON d.page_id = fi.page_id AND d.i BETWEEN r.i AND r.i + r.n_descendants""",
    "rendered_nodes": f"""WITH {_NODES}, {_NAMED}, hd AS (SELECT *, display = 'none' OR visibility = 'hidden' OR TRY_CAST(opacity AS DOUBLE) = 0 AS hides FROM nm),
mt AS (SELECT * FROM hd WHERE NOT EXISTS (SELECT 1 FROM hd a WHERE a.page_id = hd.page_id AND a.i < hd.i AND hd.i <= a.i + a.n_descendants AND (a.hides OR a.tag = '{visible.SEALED}'))),
kp AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS nr FROM mt WHERE NOT hides AND NOT (w * h = 0 AND n_descendants = 0)),
fu AS (SELECT page_id, i AS filled FROM kp WHERE nr = {visible.MOST_NODES - 1}),
ct AS (SELECT * FROM kp WHERE nr < {visible.MOST_NODES})
SELECT c.page_id, c.nr AS i, p.nr AS parent, c.tag, (SELECT count(*) FROM ct d WHERE d.page_id = c.page_id AND d.i > c.i AND d.i <= c.i + c.n_descendants) AS n_descendants, c.i AS was,
  EXISTS (SELECT 1 FROM fu JOIN mt ON mt.page_id = fu.page_id AND mt.i > filled WHERE fu.page_id = c.page_id) AS truncated FROM ct c LEFT JOIN ct p ON p.page_id = c.page_id AND p.i = c.parent""",
    "content_root": f"WITH {_NODES}, {_ROOT} SELECT page_id, i FROM r6",
    "section_candidates": f"WITH {_NODES}, {_FOUND} SELECT * FROM cand",
    "section_classify": _CLASSIFIED(_REPEATED),
    "section_layout": rf"""WITH {_NODES}, {_LAID}
SELECT c.page_id, c.i, c.container, k.display, {_PX("k.gap")} AS gap, CAST(CASE WHEN k.template <> 'none' AND trim(k.template) <> '' THEN len(string_split_regex(trim(k.template), '\s+')) WHEN contains(k.display, 'flex') AND coalesce(ch.shown, 0) > 0 THEN greatest(ch.in_row, 1) ELSE 1 END AS INTEGER) AS columns,
CASE WHEN w.i IS NOT NULL THEN {_PX("w.max_width")} END AS max_width, {_PX("s.padding_top")} AS padding_top, {_PX("s.padding_bottom")} AS padding_bottom, CASE WHEN {_PX("s.padding_left")} <> 0 THEN {_PX("s.padding_left")} WHEN w.i IS NULL THEN 0 ELSE {_PX("w.padding_left")} END AS padding_x, s.h AS min_height
FROM cn c JOIN bx s ON s.page_id = c.page_id AND s.i = c.i JOIN bx k ON k.page_id = c.page_id AND k.i = c.container LEFT JOIN ch ON ch.page_id = c.page_id AND ch.i = c.container LEFT JOIN bx w ON w.page_id = c.page_id AND w.i = c.wrapper""",
    "repeat_items": f"""WITH {_NODES}, {_REPEATED},
ln AS (SELECT page_id, i, item, own_text, min(d) AS d FROM ii WHERE own_text <> '' GROUP BY page_id, i, item, own_text),
lr AS (SELECT *, row_number() OVER (PARTITION BY page_id, i, item ORDER BY d) AS nth FROM ln QUALIFY nth <= {layout.MOST_LINES}),
ls AS (SELECT page_id, i, item, list(own_text ORDER BY nth) AS x FROM lr GROUP BY page_id, i, item),
ig AS (SELECT page_id, i, item, any_value(place) AS place, arg_min(own_text, d) FILTER (d > item AND own_text <> '' AND tag IN ({_Q(tree.HEADINGS)})) AS headed, arg_min(own_text, row(-size, d)) FILTER (d > item AND own_text <> '') AS largest,
  coalesce(arg_min(src, d) FILTER (src <> ''), '') AS image, coalesce(arg_min(href, d) FILTER (href <> ''), '') AS href, coalesce(bool_or(d > item AND tag = 'svg'), FALSE) AS has_icon FROM ii GROUP BY page_id, i, item),
ih AS (SELECT ig.*, coalesce(x, []) AS x, coalesce(headed, largest, x[1], '') AS heading FROM ig LEFT JOIN ls USING (page_id, i, item)),
io AS (SELECT *, list_filter(x, lambda l: l <> heading) AS others FROM ih)
SELECT page_id, i, CAST(place AS INTEGER) AS place, item, heading, coalesce(list_filter(others, lambda l: length(l) > {layout.PROSE})[1], others[1], '') AS body, array_to_string(x, chr(10)) AS lines, image, href, has_icon FROM io""",
    "challenge_verdict": f"""
WITH {_NODES}, p AS (SELECT pages.page_id, coalesce(url, '') AS url, {_TEXT} AS t, coalesce(n, 0) AS n FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM el GROUP BY page_id) USING (page_id)),
e AS (SELECT *, CASE WHEN n >= {challenge.ELEMENTS} THEN NULL {_PHRASE} END AS evidence FROM p)
SELECT page_id, evidence IS NOT NULL AS blocked, evidence, CASE WHEN evidence IS NULL THEN NULL {_VENDOR} ELSE '{challenge.OTHER}' END AS vendor FROM e""",
    "own_text": f"SELECT page_id, substr(t, 1, 600) AS text, length(t) AS n_chars FROM (SELECT page_id, {_TEXT} AS t FROM pages)",
    "page_links": """
WITH a AS (SELECT page_id, unnest(x) AS href, unnest(range(len(x))) AS t FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS x FROM pages)),
g AS (SELECT page_id, href, count(*) AS n, min(t) AS first_at FROM a GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first_at) AS rank FROM g""",
    "tag_tally": r"""
WITH t AS (SELECT page_id, unnest(x) AS tag, unnest(range(len(x))) AS t FROM (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS x FROM pages)),
g AS (SELECT page_id, tag, count(*) AS n, min(t) AS first_at FROM t GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first_at) AS rank FROM g""",
    "url_normalize": r"""
WITH u AS (SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS u FROM pages),
s AS (SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_extract(u, '^[^/?#]*//([^/?#]*@)', 1) AS login, lower(regexp_extract(u, '^[^/?#]*//(?:[^/?#]*@)?([^/?#]*)', 1)) AS host,
  replace(regexp_extract(u, '^[^/?#]*//[^/?#]*(/[^?#]*)', 1), ' ', '%20') AS p, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS q FROM u),
k AS (SELECT *, list_filter(string_split(substr(q, 2), '&'), lambda x: regexp_matches(x, '(?i)^(utm_[^=]*|fbclid[^=]*|gclid[^=]*|ref|ref_[^=]*)(=.*)?$')) AS gone,
  list_filter(string_split(substr(q, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid[^=]*|gclid[^=]*|ref|ref_[^=]*)(=.*)?$')) AS kept FROM s)
SELECT page_id, scheme || '://' || login || regexp_replace(host, CASE scheme WHEN 'https' THEN ':(443)?$' ELSE ':(80)?$' END, '') || CASE WHEN p = '' THEN '/' ELSE p END
  || CASE WHEN len(gone) = 0 THEN replace(q, ' ', '%20') WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, ' ', '+')), '&') END AS url FROM k""",
    "weighted_mode": f"""
WITH s AS ({STYLES}), g AS (SELECT page_id, px, CAST(sum(area) AS BIGINT) AS weight, min(ord) AS o FROM s GROUP BY ALL)
SELECT page_id, px, weight FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, o) = 1""",
    "color_oklab": f"""
WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 59) % 256 AS g, (p_size * 5) % 256 AS b FROM part),
x AS (SELECT *, {_linear("r")} AS lr, {_linear("g")} AS lg, {_linear("b")} AS lb FROM c),
m AS (SELECT *, {", ".join(f"cbrt({r[0]} * lr + {r[1]} * lg + {r[2]} * lb) AS m{k}" for k, r in enumerate(color.TO_LMS))} FROM x),
o AS (SELECT *, {", ".join(f"CAST({r[0]} AS DOUBLE) * m0 + CAST({r[1]} AS DOUBLE) * m1 + CAST({r[2]} AS DOUBLE) * m2 AS o{k}" for k, r in enumerate(color.TO_LAB))} FROM m)
SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, round(o0, 4) AS lightness, round(sqrt(o1 * o1 + o2 * o2), 4) AS chroma FROM o""",
    "meta_extract": "SELECT page_id, " + ", ".join(rf"nullif(substr(trim(regexp_replace({_HEAD(p, a)}, '\s+', ' ', 'g')), 1, {n}), '') AS {k}" for k, (p, a, n) in META.items()) + " FROM pages",
    "text_lines": "WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) SELECT doc_id, trim(line) AS line, min(pos) AS first_at, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY doc_id, trim(line)",
    "job_latest_state": LATEST,
    "job_ttl_sweep": f'WITH j AS ({LATEST}) SELECT * FROM j WHERE j."at" < (SELECT max(k."at") FROM j AS k) - INTERVAL 30 MINUTE',
}
