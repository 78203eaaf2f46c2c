"""Colour notations against published examples and plain formulas; palettes against a loop over single uses."""

import math
import os
from collections import defaultdict

import pytest

from designlake.functions import css, notations
from designlake.operators import emit, palette
from designlake.plans import design

SF = "/root/testdata/sf0.001"
LCH = ("l", "c", "h")


def parsed(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r for r in notations.parsed(d, "v").collect()}


# examples whose channels are published with the notations
EXAMPLES = {
    "#123": "#112233", "#1234": "#112233", "#Ab12cD": "#ab12cd", "#ab12cd80": "#ab12cd", "rgb(12 34 56)": "#0c2238", "rgb(12, 34, 56, 0.5)": "#0c2238", "rgba(10%, 20%, 30%)": "#1a334d", "rgb(300 -5 0)": "#ff0000",
    "hsl(120, 100%, 25%)": "#008000", "hsl(0.5turn 50% 50% / 20%)": "#40bfbf", "hsl(200grad 50% 50%)": "#40bfbf", "hsl(3.141592653589793rad 50% 50%)": "#40bfbf", "hsl(-180 50% 50%)": "#40bfbf",
    "hwb(90 10% 10%)": "#80e61a", "hwb(0 80% 80%)": "#808080", "lch(52.2345% 72.2 56.2)": "#c65d07", "lab(52.2345% 40.1645 59.9971)": "#c65d06", "oklch(59.686% 0.15619 49.7694)": "#c65d07",
    "color(srgb 0.5 0.25 0)": "#804000", "color(srgb-linear 0.5 0.5 0.5)": "#bcbcbc", "color(display-p3 1 1 1)": "#ffffff", "color(prophoto-rgb 1 1 1)": "#ffffff", "color(rec2020 1 1 1)": "#ffffff", "color(a98-rgb 0 0 0)": "#000000", "color(xyz 0.4124 0.2126 0.0193)": "#ff0000", "color(xyz-d50 0.4361 0.2225 0.0139)": "#ff0000", "REBECCAPURPLE": "#663399", " white ": "#ffffff", "oklab(none none none)": "#000000",
}


def near(a, b):
    return all(abs(int(a[k : k + 2], 16) - int(b[k : k + 2], 16)) <= 1 for k in (1, 3, 5))


def test_notations(spark):
    got = parsed(spark, EXAMPLES)
    assert {k: v for k, v in EXAMPLES.items() if k not in got or not near(got[k].hex, v)} == {}
    assert got["rgb(300 -5 0)"].r == 300 and got["rgb(300 -5 0)"].g == -5
    assert (got["#ab12cd80"].alpha, got["rgb(12, 34, 56, 0.5)"].alpha, got["hsl(0.5turn 50% 50% / 20%)"].alpha) == (128 / 255, 0.5, 0.2)


def test_what_is_no_visible_colour(spark):
    none = [None, "", "none", "transparent", "currentcolor", "#12", "#12345", "rgb(1 2)", "rgb(1, 2 3)", "hwb(1, 2%, 3%)", "rgba(0, 0, 0, 0.07)", "color(other 1 1 1)", "inherit", "rgb(1 2 3) x", "#00000010", "url(#abc)", "x" * 20_000]
    assert parsed(spark, none) == {}
    assert set(parsed(spark, ["rgba(0, 0, 0, 0.08)", "#00000015", "#00000014"])) == {"rgba(0, 0, 0, 0.08)", "#00000015"}


def test_lightness_chroma_and_hue(spark):
    """Against the published matrix from OKLab to linear sRGB, run forward from (l, c, h) to channels."""
    got = parsed(spark, [f"rgb({r}, {g}, {b})" for r in (0, 60, 255) for g in (0, 130, 255) for b in (20, 255)] + ["oklch(70% 0.1 400)", "oklab(70% 0.1 -25%)", "oklch(70% 25% 40)"])
    for r in got.values():
        a, b = r.c * math.cos(math.radians(r.h)), r.c * math.sin(math.radians(r.h))
        l, m, s = (x**3 for x in (r.l + 0.3963377774 * a + 0.2158037573 * b, r.l - 0.1055613458 * a - 0.0638541728 * b, r.l - 0.0894841775 * a - 1.291485548 * b))
        lin = (4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s, -1.2684380046 * l + 2.6097574011 * m - 0.3413193965 * s, -0.0041960863 * l - 0.7034186147 * m + 1.707614701 * s)
        back = [255 * (12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055) for x in lin]
        assert all(abs(x - y) < 1.2 for x, y in zip(back, (r.r, r.g, r.b))), r
    assert (got["oklch(70% 0.1 400)"].l, got["oklch(70% 0.1 400)"].c, got["oklch(70% 0.1 400)"].h) == (0.7, 0.1, 40.0)
    assert got["oklch(70% 25% 40)"].hex == got["oklch(70% 0.1 400)"].hex and got["oklab(70% 0.1 -25%)"].h == 315.0


def test_known_colours_of_the_queries(spark):
    got = parsed(spark, design._KNOWN)
    assert {k: r.hex for k, r in got.items()} == design._KNOWN


def test_seven_properties(spark):
    cols = "page int, ord long, tag string, role string, cls string, area long, width long, height long, text_len long, font_size string, color string, background string, border_color string, border_width string, border_bottom_color string, border_bottom_width string, image string, shadow string, is_svg boolean, fill string, stroke string"
    row = lambda **k: tuple(({"page": 1, "ord": 1, "tag": "p", "area": 1000, "width": 100, "height": 10, "text_len": 0, "font_size": "20px"} | k).get(c.split()[0]) for c in cols.split(", "))
    rows = [
        row(text_len=7, color="#111", background="#222", border_color="#333", border_width="2px", border_bottom_color="#444", border_bottom_width="3px"),
        row(ord=2, image="linear-gradient(#555, rgba(1, 2, 3, .5) 20%, red)", shadow="0 0 #666 1px, 0 0 #777", fill="#888", stroke="#999"),
        row(ord=3, is_svg=True, fill="#888", stroke="none", role="link", background="#aaa"),
        row(ord=4, area=0, text_len=3, color="#bbb", background="#ccc", cls="my btn x"),
        row(ord=5, text_len=100, color="#ddd", font_size="x", cls="mybtn"),
    ]
    got = sorted((r.property, r.raw, r.area, r.on_interactive) for r in palette.uses(spark.createDataFrame(rows, cols), ["page"]).collect())
    assert got == sorted([
        ("color", "#111", 70.0, False), ("background-color", "#222", 1000.0, False), ("border-color", "#333", 440.0, False), ("border-color", "#444", 600.0, False),
        ("gradient-stop", "#555", 300.0, False), ("gradient-stop", "rgba(1, 2, 3, .5)", 300.0, False), ("box-shadow", "#666", 50.0, False),
        ("fill", "#888", 1000.0, True), ("stroke", "none", 1000.0, True), ("background-color", "#aaa", 1000.0, True), ("color", "#bbb", 30.0, True), ("color", "#ddd", 800.0, False),
    ])


def plain_palette(uses, look, body):
    """Clusters, roles and tokens of one page from its single uses, in order."""
    far = lambda a, b: math.dist(a["lab"], b["lab"])
    colour = lambda r: {"hex": r.hex, "l": r.l, "c": r.c, "h": r.h, "lab": (r.l, r.c * math.cos(math.radians(r.h)), r.c * math.sin(math.radians(r.h)))}
    all_ = []
    for u in sorted((u for u in uses if u.raw in look), key=lambda u: (-u.area, u.ord)):
        me = colour(look[u.raw])
        hit = next((x for x in all_ if far(x, me) < css.MERGE), None)
        if hit is None:
            all_.append(hit := me | {"n": 0, "area": 0.0, "on": 0.0, "by": defaultdict(float)})
        hit["n"] += 1
        hit["area"] += u.area
        hit["by"][u.property] += u.area
        hit["on"] += u.area if u.on_interactive else 0
    all_.sort(key=lambda x: -round(x["area"], 6))
    by = lambda p: sorted((x for x in all_ if x["by"].get(p, 0) > 0), key=lambda x: -round(x["by"][p], 6))
    roles, taken = {}, []

    def assign(x, role):
        if x is not None:
            roles[role] = x
            taken.append(x)
        return x

    first = lambda xs: next(iter(xs), None)
    grounds, texts, borders = by("background-color"), by("color"), by("border-color")
    ground = assign(first(grounds), "background")
    other = [x for x in grounds if x is not ground and far(x, ground) > 1.5 * css.MERGE]
    assign(first(x for x in other if x["c"] < css.GREY) or first(other), "surface")
    of_body = first(x for x in all_ if far(x, colour(body)) < css.MERGE) if body else None
    front = assign(of_body or first(texts), "foreground")
    if ground and front:
        lo, hi = sorted((ground["l"], front["l"]))
        mid = [x for x in texts if x is not front and lo + 0.05 < x["l"] < hi - 0.05]
        assign(first(x for x in mid if x["c"] < css.GREY) or first(mid), "muted")
    bright = [x for x in all_ if x["c"] >= css.GREY]
    main = max(bright, key=lambda x: round(x["on"], 6), default=None)
    main = assign(main if main and main["on"] else max(bright, key=lambda x: x["c"] * x["area"], default=None), "primary")
    assign(first(x for x in bright if not any(x is t for t in taken) and (not main or far(x, main) > 0.12)), "accent")
    assign(first(x for x in borders if not any(x is t for t in taken)) or first(borders), "border")
    return all_, {k: v["hex"] for k, v in roles.items()}, bool(ground) and ground["l"] < 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_palettes_match_a_loop(spark):
    e = design.elements(spark, SF, *design._OBSERVED).cache()
    uses, body = defaultdict(list), {}
    for r in palette.uses(e, design.BY).collect():
        uses[r.page_id].append(r)
    look = parsed(spark, {u.raw for us in uses.values() for u in us})
    for r in e.where("tag = 'body'").orderBy("ord", "color").collect():
        body.setdefault(r.page_id, look.get(r.color))
    clusters, roles, dark, tokens = defaultdict(list), defaultdict(dict), {}, defaultdict(list)
    found = design.color_clusters(spark, SF).cache()
    for r in found.orderBy("rank").collect():
        clusters[r.page_id].append((r.hex, r.n, round(r.area, 3), r.properties))
    for r in design.palette_roles(spark, SF).collect():
        roles[r.page_id][r.role], dark[r.page_id] = r.hex, r.is_dark
    for r in design.palette_tokens(spark, SF).orderBy("rank").collect():
        tokens[r.page_id].append((r.name, r.hex, r.roles))
    names = {r.hex: r.name for r in found.collect()}
    assert any(body.values()) and len({r for v in roles.values() for r in v}) == 7
    for p, us in uses.items():
        all_, given, is_dark = plain_palette(us, look, body.get(p))
        assert [(x["hex"], x["n"], round(x["area"], 3), ",".join(sorted(x["by"]))) for x in all_] == clusters[p]
        assert given == roles[p] and is_dark == dark[p]
        mine = lambda h: [r for r in palette.ROLES if given.get(r) == h]  # noqa: E731, B023
        assert tokens[p] == [((mine(x["hex"]) or [names[x["hex"]]])[0], x["hex"], ",".join(mine(x["hex"])) or "neutral") for x in all_[:24]]
    # the map of names to colours: roles, then names of clusters, the first of a name
    got = defaultdict(dict)
    for r in emit.colour_names(found, design._roles(spark, SF, found), design.BY).collect():
        got[r.page_id][r.name] = r.hex
    for p in uses:
        want = dict(roles[p])
        for h, *_ in clusters[p][:24]:
            want.setdefault(names[h], h)
        assert got[p] == want


def test_dark_roles(spark):
    light = spark.createDataFrame([(1, "background", "#fff"), (1, "border", "#eee"), (2, "background", "#fff"), (3, "foreground", "#000")], "page int, role string, hex string")
    dark = spark.createDataFrame([(1, "background", "#000"), (1, "accent", "#f00"), (2, "background", "#fff"), (2, "border", "#111"), (3, "background", "#000")], "page int, role string, hex string")
    got = sorted(map(tuple, palette.dark_roles(light, dark, ["page"]).collect()), key=repr)
    assert got == sorted([(1, "background", "#fff", "#000"), (1, "border", "#eee", None), (1, "accent", None, "#f00"), (3, "background", None, "#000"), (3, "foreground", "#000", None)], key=repr)


def test_groups_go_on_over_batches(spark):
    """Clusters and roles of groups larger than an Arrow batch, many in one, and one without a key."""
    rows = [(g, "color", f"c{g}-{i}", False, 1, 1.0, float(i % 7), i, f"#{i % 5:06x}", 1.0, 0.2 * (i % 5), 0.0, 0.0) for g in (1, None, 2, 3) for i in range(25 if g == 2 else 3)]
    seen = spark.createDataFrame(rows, "page long, property string, raw string, on_interactive boolean, n long, area double, largest double, first long, hex string, alpha double, l double, c double, h double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        found = palette.palette(seen, ["page"])
        got = defaultdict(list)
        for r in found.orderBy("page", "rank").collect():
            got[r.page].append((r.hex, r.n))
        given = {(r.page, r.role): r.hex for r in palette.roles(found, ["page"]).collect()}
    finally:
        spark.conf.set(key, size)
    # the largest use of each colour: 6 of its numbers come first
    assert got == {None: [("#000002", 1), ("#000001", 1), ("#000000", 1)], 1: [("#000002", 1), ("#000001", 1), ("#000000", 1)], 3: [("#000002", 1), ("#000001", 1), ("#000000", 1)], 2: [(f"#{i % 5:06x}", 5) for i in (6, 13, 20, 12, 19)]}
    assert given == {(g, "foreground"): got[g][0][0] for g in (None, 1, 2, 3)}


def test_no_table_is_made_for_each_group(spark):
    """A Python call for each page was what made palettes slow; batches of whole groups are solved instead."""
    seen = spark.createDataFrame([(1, "color", "#fff", False, 1, 1.0, 1.0, 1, "#ffffff", 1.0, 1.0, 0.0, 0.0)], "page long, property string, raw string, on_interactive boolean, n long, area double, largest double, first long, hex string, alpha double, l double, c double, h double")
    for d in (palette.palette(seen, ["page"]), palette.roles(palette.palette(seen, ["page"]), ["page"])):
        assert "FlatMapGroups" not in d._jdf.queryExecution().toString()
