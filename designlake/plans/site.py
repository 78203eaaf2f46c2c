"""Queries over sites, imports, requests and emitted files, and the same in SQL.

Inputs that the tables lack (robots.txt, harvests as JSON, request actions) are derived from their rows by expressions
that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import robots
from ..operators import assets, effects, emit, jobs, palette, stylesheets, typography
from ..sources import imports
from ..sources.scratch import written
from . import catalogue, design, sheets

_PATH = "coalesce(nullif(regexp_extract(url, '^[^/?#]*//[^/?#]*(/[^?#]*)', 1), ''), '/')"
_RULES = f"""concat('# rules', chr(10), 'User-agent: other', chr(10), 'Disallow: /', chr(10), CASE WHEN page_id % 3 = 0 THEN concat('User-agent: {robots.AGENT}bot', chr(10), 'user-agent : x', chr(10)) ELSE concat('User-Agent: *', chr(10)) END,
'Crawl-delay: 1', chr(10), 'Disallow: /', substr({_PATH}, 2, 3), '* # part', chr(10), CASE WHEN page_id % 2 = 0 THEN concat('Allow: ', {_PATH}, '$') WHEN page_id % 5 = 0 THEN 'Disallow: /*.html$' ELSE 'Disallow:' END)"""
_RAW = """CASE WHEN page_id % 7 = 6 THEN NULL ELSE concat('{"url":"', CASE WHEN page_id % 7 = 3 THEN '' ELSE concat('https://a.example/', page_id) END, '","title":"t","nodes":[', CASE WHEN page_id % 7 = 2 THEN '' ELSE '{"tag":"p","text":"x"},{"tag":"a"}' END, CASE WHEN page_id % 7 = 1 THEN '' ELSE ']}' END) END"""
_ACTION = "CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'claim' WHEN 2 THEN 'create' WHEN 3 THEN 'complete' ELSE 'decline' END"


FONT_ORD = "l_orderkey * 10 + l_linenumber"
#: Requests for fonts: by a service that is asked by name, for files, and by another service.
FONT_URL = "CASE l_partkey % 5 WHEN 0 THEN concat('https://fonts.googleapis.com/css2?family=', CASE WHEN l_suppkey % 3 = 0 THEN 'Inter:wght@400' ELSE 'Lora' END) WHEN 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN concat('/f/SegoeUI-', CAST(l_partkey % 9 AS STRING), '.woff2?v') ELSE '/app.js' END WHEN 2 THEN CASE WHEN l_suppkey % 7 = 0 THEN 'https://use.typekit.net/a.css' ELSE '/x.css' END WHEN 3 THEN CASE WHEN l_suppkey % 5 = 0 THEN concat('/f/', CAST(l_partkey % 9 AS STRING), '.ttf') ELSE '/y.png' END ELSE '/z' END"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def robots_verdict(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"), F.expr(_RULES).alias("txt"))
    return robots.verdicts(p.select("page_id", "path"), robots.rules(p, ["page_id"], "txt"), ["page_id"], "path")


def harvest_import(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.expr(_RAW).alias("raw"))
    d = imports.checked(p, "raw")
    return d.select("page_id", "reason", F.col("harvest.url").alias("url"), F.size("harvest.nodes").alias("n_nodes"))


def _requests(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("request"), F.col("ts").alias("at"), "event_id", F.expr(_ACTION).alias("action"))
    return jobs.requests(e, "request", "at", "event_id", "action")


def request_states(spark, sf_dir):
    return _requests(spark, sf_dir)


def pending_requests(spark, sf_dir):
    """Requests that wait at the time of their user's newest change, newest first by place; idle ones are gone."""
    s = _requests(spark, sf_dir).withColumn("queue", F.floor(F.col("request") / 100).cast("long"))
    s = s.withColumn("now", F.max("updated_at").over(Window.partitionBy("queue")))
    live = jobs.waiting(s, F.col("now"), 60 * 24 * jobs.REQUEST_MINUTES // 60)
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("created_at"), "request"))
    return live.select("queue", "request", "created_at", "updated_at", place.alias("place"))


def _steps(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 0, "done").when(F.col("event_id") % 31 == 0, "error").otherwise(F.col("event_type")).alias("state"))


def job_events_kept(spark, sf_dir):
    return jobs.until_terminal(_steps(spark, sf_dir), "job", "at", "seq", "state")


def job_expiry(spark, sf_dir):
    return jobs.swept(_steps(spark, sf_dir), "job", "at", "seq", "state", 60 * 24)


def color_map(spark, sf_dir):
    tokens = written(design._clusters(spark, sf_dir), "palette")
    return emit.colour_names(tokens, design._roles(spark, sf_dir, tokens), ["page_id"])


def extraction_stats(spark, sf_dir):
    """Of each page its elements, colour tokens, sections, sections with a component that repeats, and unreadable sheets."""
    n = catalogue._boxes(spark, sf_dir)
    nodes = n.groupBy("page_id").agg(F.count("*").alias("nodes"))
    parts = catalogue.classified(n).groupBy("page_id").agg(F.count("*").alias("sections"), F.count(F.when((F.col("repeat") > 0) & ~F.col("kind").isin("nav", "footer"), 1)).alias("components"))
    colours = design._clusters(spark, sf_dir).where(F.col("rank") <= palette.MOST_TOKENS).groupBy("page_id").agg(F.count("*").alias("colors"))
    unread = sheets.sheet_statistics(spark, sf_dir).select("page_id", "unreadable")
    j = nodes.join(parts, "page_id", "left").join(colours, "page_id", "left").join(unread, "page_id", "left")
    return j.select("page_id", "nodes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("colors", "sections", "components", "unreadable")])


def font_families(spark, sf_dir, texts=None, scale=None):
    """Stacks of each page with what they are used for and where they come from."""
    texts = written(design._texts(spark, sf_dir), "texts") if texts is None else texts
    scale = typography.scale(texts, ["page_id"]) if scale is None else scale
    heads = scale.where(F.col("name").rlike("^(display|h[1-6])$")).select("page_id", "size")
    lines = _t(spark, sf_dir, "lineitem")
    network = lines.select(F.col("l_suppkey").alias("page_id"), F.expr(FONT_ORD).alias("ord"), F.expr(FONT_URL).alias("url"))
    asked = assets.google_families(network, ["page_id"])
    return typography.families(texts, heads, network, asked, ["page_id"])


def font_imports(spark, sf_dir):
    """How to load each family of a page."""
    return font_families(spark, sf_dir).select("page_id", "rank", "family", "source", typography.import_code().alias("code"))


def _design(spark, sf_dir, *names):
    """The tables of each page's design that an emitter writes, by their names; others are not computed."""
    of = lambda q, *a: written(q(spark, sf_dir), "design")
    out, wanted = {}, set(names)
    if wanted & {"colours", "dark"}:
        clusters = written(design._clusters(spark, sf_dir), "clusters")
        roles = written(design._roles(spark, sf_dir, clusters), "roles")
        out["colours"] = written(emit.colour_names(clusters, roles, ["page_id"]), "colours")
    if "dark" in wanted:
        out["dark"] = written(design.dark_palette(spark, sf_dir, roles), "dark").where("dark is not null").select("page_id", F.col("role").alias("name"), F.col("dark").alias("hex"), F.lit(0).alias("source"), F.array_position(F.array(*[F.lit(r) for r in palette.ROLES]), F.col("role")).cast("int").alias("ord"))
    if wanted & {"families", "scale"}:
        texts = written(design._texts(spark, sf_dir), "texts")
        out["scale"] = written(typography.scale(texts, ["page_id"]), "scale")
    if "families" in wanted:
        out["families"] = written(font_families(spark, sf_dir, texts, out["scale"]), "design")
    if wanted & {"keyframes", "variables"}:
        # sheets are cut into pieces once for both that read them
        pieces = written(stylesheets.told(sheets._pieces(spark, sf_dir)), "pieces")
        out |= {"keyframes": stylesheets.conditions(stylesheets.rules(pieces)).where("kind = 'keyframes'"), "variables": stylesheets.root_variables(stylesheets.custom_properties(pieces))}
    if "grid" in wanted:
        out["grid"] = design.spacing_grid(spark, sf_dir)
    if "borders" in wanted:
        out["borders"] = design.border_widths(spark, sf_dir)
    tables = {"spacing": design.spacing_steps, "radii": design.radius_tokens, "shadows": design.shadow_tokens, "motion": design.motion_tokens, "breakpoints": design.media_breakpoints, "container": design.container_width}
    return out | {k: of(q) for k, q in tables.items() if k in wanted}


def tokens_css(spark, sf_dir):
    return emit.css_variables(_design(spark, sf_dir, "colours", "dark", "families", "scale", "spacing", "radii", "shadows", "motion", "container"), ["page_id"])


def tailwind_theme(spark, sf_dir):
    return emit.tailwind_theme(_design(spark, sf_dir, "colours", "families", "scale", "spacing", "radii", "shadows", "breakpoints"), ["page_id"])


def tailwind_config(spark, sf_dir):
    parts = _design(spark, sf_dir, "colours", "families", "scale", "radii", "shadows", "motion", "breakpoints", "container")
    parts["scale"] = parts["scale"].join(design._letter_spacings(spark, sf_dir), ["page_id", "size", "weight"], "left")
    return emit.tailwind_config(parts, ["page_id"])


def design_tokens_json(spark, sf_dir):
    return emit.tokens_json(_design(spark, sf_dir, "colours", "dark", "families", "scale", "spacing", "grid", "radii", "shadows", "borders", "motion", "keyframes", "breakpoints", "container", "variables"), ["page_id"])


def compact_brief(spark, sf_dir):
    return emit.brief(design.type_scale(spark, sf_dir), design.spacing_grid(spark, sf_dir), design.container_width(spark, sf_dir), ["page_id"])


QUERIES = [robots_verdict, harvest_import, request_states, pending_requests, job_events_kept, job_expiry, color_map, extraction_stats, font_families, font_imports, tokens_css, tailwind_theme, tailwind_config, design_tokens_json, compact_brief]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_REQUESTS = f"""r0 AS (SELECT user_id * 100 + event_id % 37 AS request, ts AS "at", event_id, {_ACTION} AS action FROM events),
r1 AS (SELECT *, min(row("at", event_id)) FILTER (action = 'create') OVER (PARTITION BY request) AS made FROM r0),
r2 AS (SELECT *, made IS NOT NULL AND row("at", event_id) >= made AS live FROM r1),
r3 AS (SELECT *, count(*) FILTER (live AND action IN ('complete', 'decline')) OVER (PARTITION BY request ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM r2),
r4 AS (SELECT *, coalesce(live AND ended = 0 AND (action <> 'create' OR row("at", event_id) = made), FALSE) AS counts FROM r3),
rq AS (SELECT request, CASE arg_max(action, row("at", event_id)) FILTER (counts) WHEN 'create' THEN 'pending' WHEN 'claim' THEN 'claimed' WHEN 'complete' THEN 'done' WHEN 'decline' THEN 'declined' END AS status, min("at") FILTER (action = 'create') AS created_at, max("at") FILTER (counts) AS updated_at, count(*) FILTER (NOT counts) AS refused FROM r4 GROUP BY request)"""
_KEPT = """s AS (SELECT user_id AS job, ts AS "at", event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'done' WHEN event_id % 31 = 0 THEN 'error' ELSE event_type END AS state FROM events),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.job = s.job AND o.state IN ('done', 'error') AND row(o."at", o.seq) < row(s."at", s.seq)))"""
_SUB = lambda name: f"({design.SQL[name]})"
_LINES = lambda parts: " UNION ALL ".join(f"SELECT page_id, {i} AS section, CAST({o} AS BIGINT) AS ord, {line} AS line FROM {src if src.isidentifier() else f'({src})'}" for i, (src, o, line) in enumerate(parts))
_BYSIZE = "row_number() OVER (PARTITION BY page_id ORDER BY size DESC, weight DESC)"
_BYTOKEN = "row_number() OVER (PARTITION BY page_id ORDER BY token)"
_FILE = lambda name, head, tail, parts: f"SELECT page_id, '{head}' || string_agg(line, chr(10) ORDER BY section, ord) || '{tail}' AS {name} FROM ({_LINES(parts)}) GROUP BY page_id"

_BYCOLOUR = "row_number() OVER (PARTITION BY page_id ORDER BY source, ord, name)"
_J = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
_OBJECT = lambda k, src, name, value, order: f"SELECT page_id, '{k}' AS k, '{{' || string_agg({_J(name)} || ':' || {_J(value)}, ',' ORDER BY {'source, ord, name' if order == _BYCOLOUR else order}) || '}}' AS json FROM {src} GROUP BY page_id"
_ARRAY = lambda k, src, value, order: f"SELECT page_id, '{k}' AS k, '[' || string_agg({value}, ',' ORDER BY {order}) || ']' AS json FROM {src} GROUP BY page_id"
_COLOURS = f"""{design._ROLES}, al AS (SELECT page_id, role AS name, hex, 0 AS source, CAST(list_position([{', '.join(repr(r) for r in palette.ROLES)}], role) - 1 AS INTEGER) AS ord FROM given UNION ALL SELECT page_id, name, hex, 1, rank FROM pal WHERE rank <= {palette.MOST_TOKENS})
SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY source, ord, hex) = 1"""
_FAMILIES = rf"""{design._E}, {design._TEXTS}, hd AS (SELECT DISTINCT page_id, size FROM {_SUB("type_scale")} WHERE regexp_matches(name, '^(display|h[1-6])$')),
fn AS (SELECT DISTINCT l_suppkey AS page_id, {FONT_ORD} AS ord, {FONT_URL} AS url FROM lineitem),
ff AS (SELECT page_id, coalesce(list(url ORDER BY ord, url) FILTER (regexp_matches(url, '{typography.FONT_FILE}')), []) AS files, bool_or(contains(url, '{typography.TYPEKIT}')) AS service FROM fn GROUP BY page_id),
gq AS (SELECT page_id, list(DISTINCT lower(trim(replace(split_part(url_decode(replace(v, '+', ' ')), ':', 1), '+', ' ')))) AS asked FROM (SELECT page_id, unnest(regexp_extract_all(url, '[?&]family=([^&#]*)', 1)) AS v FROM fn WHERE contains(url, 'fonts.googleapis.com')) GROUP BY page_id),
fs AS (SELECT t.page_id, t.family AS stack, CAST(sum(chars * t.size) AS BIGINT) AS area, coalesce(sum(chars * t.size) FILTER (hd.size IS NOT NULL), 0) AS heads, array_to_string(list_transform(list_sort(list_distinct(list(weight))), lambda w: CAST(w AS VARCHAR)), ';') AS weights, min(ord) AS o FROM t LEFT JOIN hd ON hd.page_id = t.page_id AND hd.size = t.size GROUP BY t.page_id, t.family),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY area DESC, o) AS INTEGER) AS rank, {design._FAMILY("stack")} AS family FROM fs QUALIFY rank <= 6),
fo AS (SELECT fr.*, files, coalesce(service, FALSE) AS service, coalesce(asked, []) AS asked, list_filter(files, lambda u: contains(lower(u), left(regexp_replace(lower(family), '\s+', '', 'g'), 8))) AS own FROM fr LEFT JOIN ff USING (page_id) LEFT JOIN gq USING (page_id)),
fq AS (SELECT *, CASE WHEN list_contains(asked, lower(family)) THEN 'google' WHEN len(own) > 0 THEN 'self-hosted' WHEN lower(family) IN ({", ".join(f"'{x}'" for x in typography.SYSTEM)}) THEN 'system' WHEN service THEN 'adobe' WHEN len(files) > 0 THEN 'self-hosted' ELSE 'unknown' END AS source FROM fo),
fam AS MATERIALIZED (SELECT page_id, rank, stack, family, CASE WHEN regexp_matches(stack, '(?i)mono|code|courier') THEN 'mono' WHEN heads > area * 0.5 THEN 'display' ELSE 'body' END AS usage, source, weights, array_to_string(CASE WHEN len(own) > 0 THEN own WHEN source = 'self-hosted' THEN files[:{typography.MOST_FILES}] ELSE [] END, chr(10)) AS urls, area FROM fq)"""
_DESIGN = f"""{_FAMILIES}, cm AS MATERIALIZED ({_COLOURS}), dk AS MATERIALIZED (SELECT page_id, role AS name, dark AS hex, list_position([{', '.join(repr(r) for r in palette.ROLES)}], role) AS ord FROM {_SUB("dark_palette")} WHERE dark IS NOT NULL),
sc AS MATERIALIZED (SELECT ts.*, tg.line_height, tg.family FROM {_SUB("type_scale")} ts JOIN {_SUB("type_groups")} tg USING (page_id, size, weight)), sp AS MATERIALIZED {_SUB("spacing_steps")}, rd AS MATERIALIZED {_SUB("radius_tokens")}, sw AS MATERIALIZED {_SUB("shadow_tokens")}, mo AS MATERIALIZED {_SUB("motion_tokens")}, bk AS MATERIALIZED {_SUB("media_breakpoints")}, ct AS MATERIALIZED {_SUB("container_width")}"""

SQL = {
    "robots_verdict": rf"""WITH p AS (SELECT page_id, {_PATH} AS path, {_RULES} AS txt FROM pages),
l0 AS (SELECT page_id, unnest(string_split_regex(txt, '\r?\n')) AS raw, unnest(range(len(string_split_regex(txt, '\r?\n')))) AS ln FROM p),
l1 AS (SELECT page_id, ln, lower(trim(split_part(x, ':', 1))) AS key, trim(substr(x, instr(x, ':') + 1)) AS value FROM (SELECT *, trim(regexp_replace(raw, '#.*$', '')) AS x FROM l0) WHERE instr(x, ':') > 0),
l2 AS (SELECT *, CASE WHEN key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY page_id ORDER BY ln), '') <> 'user-agent' THEN 1 ELSE 0 END AS fresh FROM l1 WHERE key IN ('user-agent', 'allow', 'disallow')),
l3 AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY ln) AS grp FROM l2),
g AS (SELECT page_id, coalesce(min(grp) FILTER (contains(lower(value), '{robots.AGENT}')), min(grp) FILTER (value = '*')) AS grp FROM l3 WHERE key = 'user-agent' GROUP BY page_id),
r AS (SELECT l3.page_id, ln, key = 'allow' AS allow, value AS pattern, CASE WHEN value LIKE '%$' THEN left(value, -1) ELSE value END AS body FROM l3 JOIN g USING (page_id, grp) WHERE key <> 'user-agent' AND value <> ''),
h AS (SELECT p.page_id, r.* EXCLUDE (page_id) FROM p JOIN r USING (page_id) WHERE regexp_matches(path, '^' || regexp_replace(regexp_replace(body, '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '\*', '.*', 'g') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END)),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, ln) = 1)
SELECT p.page_id, path, coalesce(allow, TRUE) AS allowed, pattern FROM p LEFT JOIN b USING (page_id)""",
    "harvest_import": f"""WITH p AS (SELECT page_id, {_RAW} AS raw FROM pages), v AS (SELECT *, json_valid(raw) AS ok FROM p),
d AS (SELECT page_id, CASE WHEN raw IS NULL THEN 'empty' WHEN NOT ok THEN 'not JSON' WHEN coalesce(CASE WHEN ok THEN raw ->> '$.url' END, '') = '' THEN 'no address' WHEN coalesce(CASE WHEN ok THEN json_array_length(raw, '$.nodes') END, 0) <= 0 THEN 'no measurable content' END AS reason, CASE WHEN ok THEN raw END AS j FROM v)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN j ->> '$.url' END AS url, CAST(CASE WHEN reason IS NULL THEN json_array_length(j, '$.nodes') END AS INTEGER) AS n_nodes FROM d""",
    "request_states": f"WITH {_REQUESTS} SELECT * FROM rq",
    "pending_requests": f"""WITH {_REQUESTS}, qu AS (SELECT *, request // 100 AS queue, max(updated_at) OVER (PARTITION BY request // 100) AS now FROM rq)
SELECT queue, request, created_at, updated_at, CAST(row_number() OVER (PARTITION BY queue ORDER BY created_at DESC, request) AS INTEGER) AS place FROM qu WHERE status = 'pending' AND updated_at >= now - INTERVAL 24 HOUR""",
    "job_events_kept": f'WITH {_KEPT} SELECT * FROM k',
    "job_expiry": f"""WITH {_KEPT} SELECT job, coalesce(max("at") FILTER (state IN ('done', 'error')), min("at")) AS since, coalesce(max("at") FILTER (state IN ('done', 'error')), min("at")) < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS expired FROM k GROUP BY job""",
    "color_map": _COLOURS,
    "extraction_stats": f"""WITH nd AS (SELECT page_id, count(*) AS nodes FROM ({catalogue._DOM(catalogue._NODES)}) GROUP BY page_id), sc AS (SELECT page_id, count(*) AS sections, count(*) FILTER (repeat > 0 AND kind NOT IN ('nav', 'footer')) AS components FROM ({catalogue.SQL["section_classify"]}) GROUP BY page_id),
cc AS (SELECT page_id, count(*) AS colors FROM {_SUB("color_clusters")} WHERE rank <= {palette.MOST_TOKENS} GROUP BY page_id)
SELECT page_id, nodes, coalesce(colors, 0) AS colors, coalesce(sections, 0) AS sections, coalesce(components, 0) AS components, coalesce(unreadable, 0) AS unreadable FROM nd LEFT JOIN sc USING (page_id) LEFT JOIN cc USING (page_id) LEFT JOIN (SELECT page_id, unreadable FROM ({sheets.SQL["sheet_statistics"]})) USING (page_id)""",
    "font_families": f"{_FAMILIES} SELECT page_id, rank, stack, family, usage, source, weights, urls, area FROM fam",
    "font_imports": f"""{_FAMILIES}, fu AS (SELECT *, '@import url(''https://fonts.googleapis.com/css2?family=' || regexp_replace(family, '\\s+', '+', 'g') || ':wght@' || weights || '&display=swap'');' AS href, regexp_replace(family, '[^A-Za-z0-9]', '_', 'g') AS name, list_filter(string_split(urls, chr(10)), lambda u: u <> '') AS files FROM fam)
SELECT page_id, rank, family, source, CASE source WHEN 'google' THEN concat_ws(chr(10), '/* CSS */', href, '', '// next/font (preferred in Next.js — self-hosts and avoids a round trip)', 'import {{ ' || name || ' }} from ''next/font/google'';', 'const font = ' || name || '({{', '  subsets: [''latin''],', '  weight: [''' || replace(weights, ';', ''', ''') || '''],', '  display: ''swap'',', '}});')
  WHEN 'self-hosted' THEN array_to_string(list_concat(list_concat(['/* Self-hosted. Copy the files, then declare them: */'], list_transform(files[:4], lambda u: '@font-face {{ font-family: ''' || family || '''; src: url(''' || u || ''') format(''woff2''); font-display: swap; }}')), list_concat(['', '/* Original sources:'], list_concat(list_transform(files[:8], lambda u: ' * ' || u), [' */']))), chr(10))
  WHEN 'adobe' THEN '/* Adobe Fonts (Typekit). Add your own kit id: */' || chr(10) || '@import url(''https://use.typekit.net/YOUR_KIT.css'');' WHEN 'system' THEN '/* System stack — no import needed. */' || chr(10) || 'font-family: ' || stack || ';'
  ELSE concat_ws(chr(10), '/* "' || family || '" is requested by the stack, but no font file was served', ' * with the page. It either resolved from a local install or fell back to', ' * the next family. To use it deliberately, load it explicitly: */', href, '', 'font-family: ' || stack || ';') END AS code FROM fu""",
    "tailwind_config": f"""{_DESIGN}, td AS MATERIALIZED {_SUB("type_details")}, sz AS (SELECT sc.*, td.letter_spacing FROM sc LEFT JOIN td USING (page_id, size, weight)),
fl AS (SELECT *, min(rank) OVER (PARTITION BY page_id, usage) AS o FROM fam QUALIFY row_number() OVER (PARTITION BY page_id, usage ORDER BY rank DESC) = 1),
pt AS ({_OBJECT("colors", "cm", "name", "hex", _BYCOLOUR)} UNION ALL {_OBJECT("borderRadius", "rd", "token", "radius", "token")} UNION ALL {_OBJECT("boxShadow", "sw", "token", "shadow", "token")} UNION ALL {_OBJECT("screens", "bk", "'bp' || width", "width || 'px'", "width")} UNION ALL {_OBJECT("maxWidth", "(SELECT * FROM ct WHERE max_width IS NOT NULL)", "'container'", "max_width || 'px'", "max_width")}
  UNION ALL {_OBJECT("transitionDuration", "(SELECT * FROM mo WHERE kind = 'duration' AND rank = 1)", "'DEFAULT'", "value", "rank")} UNION ALL {_OBJECT("transitionTimingFunction", "(SELECT * FROM mo WHERE kind = 'easing' AND rank = 1)", "'DEFAULT'", "value", "rank")}
  UNION ALL {_OBJECT("fontFamily", "fl", "usage", "list_transform(string_split(stack, ','), lambda x: trim(trim(x), chr(34) || chr(39)))", "o")}
  UNION ALL SELECT page_id, 'fontSize', '{{' || string_agg({_J("regexp_replace(name, '^text-', '')")} || ':["' || size || 'px",{{"lineHeight":"' || line_height || '","letterSpacing":' || {_J("CASE WHEN letter_spacing = 'normal' THEN '0' ELSE letter_spacing END")} || ',"fontWeight":"' || weight || '"}}]', ',' ORDER BY size DESC, weight DESC) || '}}' FROM sz GROUP BY page_id),
pg AS (SELECT page_id, map_from_entries(list(row(k, json))) AS m FROM pt GROUP BY page_id)
SELECT page_id, '{emit.CONFIG_HEAD}' || '{{' || concat_ws(',', {", ".join(f"'{chr(34)}{k}{chr(34)}:' || coalesce(m['{k}'], '{{}}')" for k in ("colors", "fontFamily", "fontSize", "borderRadius", "boxShadow", "screens", "maxWidth", "transitionDuration", "transitionTimingFunction"))}) || '}}' || '{emit.CONFIG_TAIL}' AS config FROM pg""",
    "tokens_css": f"""{_DESIGN}, cl AS ({_LINES([
        ("SELECT DISTINCT page_id FROM cm", "0", "'  /* Color */'"), ("cm", _BYCOLOUR, "'  --color-' || name || ': ' || hex || ';'"), ("SELECT DISTINCT page_id FROM fam", "0", "chr(10) || '  /* Typography */'"), ("fam", "rank", "'  --font-' || usage || ': ' || stack || ';'"),
        ("sc", _BYSIZE, "'  --text-' || name || ': ' || size || 'px;' || chr(10) || '  --leading-' || name || ': ' || line_height || ';'"), ("SELECT DISTINCT page_id FROM sp", "0", "chr(10) || '  /* Spacing */'"), ("sp", "px", "'  --space-' || px || ': ' || px || 'px;'"),
        ("SELECT DISTINCT page_id FROM rd", "0", "chr(10) || '  /* Radius */'"), ("rd", _BYTOKEN, "'  --radius-' || token || ': ' || radius || ';'"), ("SELECT DISTINCT page_id FROM sw", "0", "chr(10) || '  /* Elevation */'"), ("sw", _BYTOKEN, "'  --shadow-' || token || ': ' || shadow || ';'"),
        ("SELECT * FROM ct WHERE max_width IS NOT NULL", "0", "chr(10) || '  /* Layout */' || chr(10) || '  --container-max: ' || max_width || 'px;'"), ("SELECT DISTINCT page_id FROM mo WHERE rank = 1", "0", "chr(10) || '  /* Motion */'"),
        ("SELECT * FROM mo WHERE rank = 1 AND kind = 'duration'", "0", "'  --duration: ' || value || ';'"), ("SELECT * FROM mo WHERE rank = 1 AND kind = 'easing'", "0", "'  --easing: ' || value || ';'")])}),
dl AS (SELECT page_id, string_agg('    --color-' || name || ': ' || hex || ';', chr(10) ORDER BY ord) AS x FROM dk GROUP BY page_id)
SELECT page_id, ':root {{' || chr(10) || string_agg(line, chr(10) ORDER BY section, ord) || chr(10) || '}}' || chr(10) || coalesce(chr(10) || '@media (prefers-color-scheme: dark) {{' || chr(10) || '  :root {{' || chr(10) || any_value(x) || chr(10) || '  }}' || chr(10) || '}}' || chr(10), '') AS css FROM cl LEFT JOIN dl USING (page_id) GROUP BY page_id""",
    "tailwind_theme": f"""{_DESIGN}, tl AS ({_LINES([
        ("cm", _BYCOLOUR, "'  --color-' || name || ': ' || hex || ';'"), ("fam", "rank", "'  --font-' || usage || ': ' || stack || ';'"), ("sc", _BYSIZE, "'  --text-' || name || ': ' || size || 'px;' || chr(10) || '  --text-' || name || '--line-height: ' || line_height || ';' || chr(10) || '  --text-' || name || '--font-weight: ' || weight || ';'"),
        ("sp", "px", "'  --spacing-' || px || ': ' || px || 'px;'"), ("rd", _BYTOKEN, "'  --radius-' || token || ': ' || radius || ';'"), ("sw", _BYTOKEN, "'  --shadow-' || token || ': ' || shadow || ';'"), ("bk", "width", "'  --breakpoint-bp' || width || ': ' || width || 'px;'")])})
SELECT page_id, '@import "tailwindcss";' || chr(10) || chr(10) || '@theme {{' || chr(10) || string_agg(line, chr(10) ORDER BY section, ord) || chr(10) || '}}' || chr(10) AS theme FROM tl GROUP BY page_id""",
    "design_tokens_json": f"""{_DESIGN}, gd AS MATERIALIZED {_SUB("spacing_grid")}, bw AS MATERIALIZED {_SUB("border_widths")}, kf AS MATERIALIZED (SELECT * FROM ({sheets.SQL["css_conditions"]}) WHERE kind = 'keyframes'), vr AS MATERIALIZED ({sheets.SQL["root_variables"]}),
pt AS ({_OBJECT("colors", "cm", "name", "hex", _BYCOLOUR)} UNION ALL {_OBJECT("colorRoles", "(SELECT * FROM cm WHERE source = 0)", "name", "hex", "ord")} UNION ALL {_OBJECT("darkColors", "dk", "name", "hex", "ord")} UNION ALL {_OBJECT("radii", "rd", "token", "radius", "token")} UNION ALL {_OBJECT("shadows", "sw", "token", "shadow", "token")} UNION ALL {_OBJECT("sourceVariables", "vr", "name", "value", "name")}
  UNION ALL {_ARRAY("families", "fam", f"'{{' || concat_ws(',', '\"name\":' || {_J('family')}, '\"stack\":' || {_J('stack')}, '\"usage\":' || {_J('usage')}, '\"source\":' || {_J('source')}, '\"weights\":[' || replace(weights, ';', ',') || ']') || '}}'", "rank")}
  UNION ALL {_ARRAY("scale", "sc", f"'{{' || concat_ws(',', '\"name\":' || {_J('name')}, '\"fontSize\":\"' || size || 'px\"', '\"lineHeight\":' || line_height, '\"fontWeight\":' || weight, '\"family\":' || {_J('family')}) || '}}'", "size DESC, weight DESC")}
  UNION ALL {_ARRAY("steps", "sp", "'\"' || px || 'px\"'", "px")} UNION ALL {_ARRAY("borderWidths", "bw", _J('border_width'), "n DESC, border_width")} UNION ALL {_ARRAY("durations", "(SELECT * FROM mo WHERE kind = 'duration')", _J('value'), "rank")} UNION ALL {_ARRAY("easings", "(SELECT * FROM mo WHERE kind = 'easing')", _J('value'), "rank")}
  UNION ALL {_ARRAY("keyframes", "kf", _J('value'), "rank")} UNION ALL {_ARRAY("breakpoints", "bk", "'\"' || width || 'px\"'", "width")} UNION ALL SELECT page_id, 'grid', '\"baseUnit\":\"' || base || 'px\",\"confidence\":' || confidence FROM gd
  UNION ALL SELECT page_id, 'container', '{{\"maxWidth\":' || coalesce('\"' || max_width || 'px\"', 'null') || ',\"paddingX\":' || coalesce(padding_x, 0) || '}}' FROM ct),
pg AS (SELECT page_id, map_from_entries(list(row(k, json))) AS m FROM pt GROUP BY page_id)
SELECT page_id, '{{' || concat_ws(',', '"colors":' || coalesce(m['colors'], '{{}}'), '"colorRoles":' || coalesce(m['colorRoles'], '{{}}'), '"darkColors":' || m['darkColors'], '"typography":{{"families":' || coalesce(m['families'], '[]') || ',"scale":' || coalesce(m['scale'], '[]') || '}}', '"spacing":{{' || m['grid'] || ',"values":' || coalesce(m['steps'], '[]') || '}}', '"radii":' || coalesce(m['radii'], '{{}}'), '"shadows":' || coalesce(m['shadows'], '{{}}'), '"borderWidths":' || coalesce(m['borderWidths'], '[]'),
  '"motion":{{"durations":' || coalesce(m['durations'], '[]') || ',"easings":' || coalesce(m['easings'], '[]') || ',"keyframes":' || coalesce(m['keyframes'], '[]') || '}}', '"breakpoints":' || coalesce(m['breakpoints'], '[]'), '"container":' || coalesce(m['container'], '{{"maxWidth":null,"paddingX":0}}'), '"sourceVariables":' || coalesce(m['sourceVariables'], '{{}}')) || '}}' AS json FROM pg""",
    "compact_brief": _FILE("brief", "' || '# Type' || chr(10) || '", "", [(f"SELECT * FROM {_SUB('type_scale')} QUALIFY {_BYSIZE} <= 8", _BYSIZE, "'- ' || name || ': ' || size || 'px/' || weight"), (_SUB("spacing_grid"), "0", "'Grid: ' || base || 'px'"), (_SUB("container_width"), "0", "'Container: ' || coalesce(CAST(max_width AS VARCHAR), '—') || 'px'")]),
}
