"""Trees, layout and copy of random pages against plain walks over the same elements."""

import random
import re

import pytest

from designlake.operators import assets, layout, sections, tree
from designlake.sources.scratch import written

COLUMNS = "page_id long, i long, parent long, depth long, n_descendants long, tag string, own_text string, x int, y int, w int, h int, top int, display string, template string, gap string, max_width string, padding_left string, padding_top string, padding_bottom string, font_size string, text_transform string, background string, has_border boolean, position string, backdrop string, image string, role string, cls string, src string, href string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def page(rng, p, size):
    """Elements of one page in document order, as dicts."""
    out = []

    def grow(parent, depth, left):
        me = {"page_id": p, "i": len(out), "parent": parent, "depth": depth}
        out.append(me)
        kids = rng.choice([0, 0, 1, 2, 3, 4, 6]) if depth < 7 else 0
        like = rng.random() < 0.5
        tag = rng.choice(["li", "a", "img", "img"])
        for _ in range(kids):
            if len(out) >= size:
                break
            k = grow(me["i"], depth + 1, left)
            if like:
                out[k]["tag"] = tag
        return me["i"]

    grow(None, 1, size)
    while len(out) < size:
        grow(0, 2, size)
    for e in out:
        e.setdefault("tag", rng.choice(["div", "p", "h1", "h2", "h3", "a", "button", "img", "svg", "section", "form", "details", "blockquote", "span"]))
        if e["depth"] == 2:
            e["tag"] = rng.choice(["nav", "header", "footer", "section", "section", "div", "div"])
        elif e["tag"] in ("h1", "blockquote", "details") and rng.random() < 0.8:
            e["tag"] = "h4"
        tag = e["tag"]
        e |= {
            "own_text": rng.choice(["", "", "Ok", "Plans from $9/mo", "A line of prose that is long enough", "Another longer line of text, said once more", "99%"]), "x": 0, "y": e["i"] * 10, "w": rng.choice([0, 100, 700, 1200]), "h": rng.choice([20, 100, 500]), "top": e["i"] // 4 * 30,
            "display": rng.choice(["block", "grid", "inline-flex"]), "template": rng.choice(["none", "", " 1fr  2fr 1fr "]), "gap": rng.choice(["normal", "7.5px 2px"]), "max_width": rng.choice(["none", "500px", "1200.5px", "100px"]), "padding_left": rng.choice(["0px", "8.5px"]), "padding_top": "4px", "padding_bottom": "x",
            "font_size": rng.choice(["12px", "16px", "30px", "0px"]), "text_transform": rng.choice(["none", "none", "uppercase"]), "background": rng.choice(["rgba(0, 0, 0, 0)", "transparent", "rgb(1, 2, 3)"]), "has_border": rng.random() < 0.2,
            "position": rng.choice(["static", "fixed"]), "backdrop": rng.choice(["none", "", "blur(1px)"]), "image": rng.choice(["none", "linear-gradient(red, blue)"]), "role": rng.choice(["", "", "button", "navigation"]) if tag == "div" else "", "cls": rng.choice(["", "btn", "x-cta y"]), "src": "/a.png" if tag == "img" and rng.random() < 0.97 else "", "href": f"/{e['i']}" if tag == "a" else "",
        }
        if e["depth"] == 2:
            e |= {"w": 1200, "h": rng.choice([70, 300, 600])}
    for e in reversed(out):
        e["n_descendants"] = sum(1 + k["n_descendants"] for k in out if k["parent"] == e["i"])
    return out


class Plain:
    def __init__(self, nodes):
        self.n = nodes

    def kids(self, i):
        return [k for k in self.n if k["parent"] == i]

    def below(self, i, most=10**9):
        return self.n[i + 1 : i + 1 + min(most, self.n[i]["n_descendants"])]

    def up(self, i):
        out = []
        while self.n[i]["parent"] is not None:
            i = self.n[i]["parent"]
            out.append(i)
        return out


def number(text):
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))", text)
    return float(m[1]) if m else None


def area(e):
    return e["w"] * e["h"]


def container(t, s):
    own = t.n[s]
    big = [d for d in t.below(s, 400) if area(d) > 0.15 * area(own)]
    placed = [d for d in big if ("grid" in d["display"] or "flex" in d["display"]) and len(t.kids(d["i"])) >= 2]
    stacked = [d for d in big if len(t.kids(d["i"])) >= 3]
    return max(placed or stacked or [own], key=area)["i"]


def wrapper(t, s):
    own = t.n[s]
    fit = [d for d in [own, *t.below(s, 300)] if (m := number(d["max_width"])) and 480 <= m <= 2200 and d["w"] >= 0.8 * min(own["w"], m)]
    return max(fit, key=area, default=None)


def expected_layout(t, s):
    c, w, own, px = t.n[container(t, s)], wrapper(t, s), t.n[s], lambda v: int((number(v) or 0) + 0.5)
    kids = [k for k in t.kids(c["i"]) if area(k) > 0]
    if c["template"] != "none" and c["template"].split():
        n = len(c["template"].split())
    elif "flex" in c["display"] and kids:
        n = max(1, sum(abs(k["top"] - kids[0]["top"]) < 12 for k in kids))
    else:
        n = 1
    x = px(own["padding_left"]) or (px(w["padding_left"]) if w else 0)
    return (c["i"], c["display"], px(c["gap"]), n, px(w["max_width"]) if w else None, px(own["padding_top"]), px(own["padding_bottom"]), x, own["h"])


def group(t, c, signature):
    kids = [k for k in t.kids(c) if area(k) > 0]
    by = {}
    for k in kids:
        by.setdefault(signature[k["i"]], []).append(k)
    best = max(by.values(), key=len, default=[])
    return best if len(best) >= 3 and len(best) >= 0.6 * len(kids) else []


def lines(t, i, most=12):
    return list(dict.fromkeys(e["own_text"] for e in [t.n[i], *t.below(i)] if e["own_text"]))[:most]


def expected_item(t, i):
    below, said = t.below(i), lines(t, i)
    heads = [d["own_text"] for d in below if re.match("h[1-6]$", d["tag"]) and d["own_text"]]
    texts = [d for d in below if d["own_text"]]
    heading = (heads or [max(texts, key=lambda d: number(d["font_size"]))["own_text"] if texts else (said or [""])[0]])[0]
    others = [x for x in said if x != heading]
    body = ([x for x in others if len(x) > 20] or others or [""])[0]
    first = lambda key, es: next((e[key] for e in es if e[key]), "")
    return (heading, body, "\n".join(said), first("src", [t.n[i], *below]), first("href", [t.n[i], *below]), any(d["tag"] == "svg" for d in below))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(21)
    nodes = [page(rng, p, rng.choice([1, 5, 60, 150])) for p in range(24)]
    n = written(spark.createDataFrame([tuple(e[c] for c in NAMES) for es in nodes for e in es], COLUMNS), "elements")
    return {p: Plain(es) for p, es in enumerate(nodes)}, n


def test_ancestors_paths_and_membership(spark, pages):
    plain, n = pages
    got = {}
    for r in tree.ancestors(n).collect():
        got.setdefault((r.page_id, r.i), {})[r.hop] = r.ancestor
    for p, t in plain.items():
        for e in t.n:
            assert got.get((p, e["i"]), {}) == {k + 1: a for k, a in enumerate(t.up(e["i"]))}
    path = {(r.page_id, r.i): r.path for r in tree.paths(n).collect()}
    for p, t in plain.items():
        step = {e["i"]: f"{e['tag']}:nth-of-type({1 + sum(k['tag'] == e['tag'] for k in t.n[: e['i']] if k['parent'] == e['parent'])})" for e in t.n}
        assert all(path[p, e["i"]] == " > ".join(step[i] for i in [*reversed(t.up(e["i"])[:7]), e["i"]]) for e in t.n)
    marked = n.where("(i * 7 + page_id) % 5 = 0").select("page_id", "i", "tag")
    got = sorted((r.page_id, r.of, r.of_tag, r.d) for r in tree.within(n.select("page_id", "i", "depth"), marked).collect())
    want = [(p, e["i"], e["tag"], d) for p, t in plain.items() for e in t.n if (e["i"] * 7 + p) % 5 == 0 for d in range(e["i"], e["i"] + e["n_descendants"] + 1)]
    assert got == sorted(want)


def test_layouts_and_items(spark, pages):
    plain, n = pages
    found = written(n.where("depth = 2 or i = 0").select("page_id", "i"), "found")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in layout.layouts(n, found).select("page_id", "i", "container", "display", "gap", "columns", "max_width", "padding_top", "padding_bottom", "padding_x", "min_height").collect()}
    todo = [(p, e["i"]) for p, t in plain.items() for e in t.n if e["depth"] == 2 or e["i"] == 0]
    assert sorted(got) == sorted(todo)
    for p, i in todo:
        assert got[p, i] == expected_layout(plain[p], i), (p, i)
    signature = {(r.page_id, r.i): r.signature for r in tree.signatures(n).collect()}
    r = written(layout.repeated(n, layout.containers(n, found)), "repeated")
    items, marks = {}, {tuple(x)[:2]: tuple(x)[2:] for x in layout.repeat_marks(n, r).select("page_id", "i", "repeat", "row", "images").collect()}
    for x in layout.items(n, r).orderBy("place").collect():
        items.setdefault((x.page_id, x.i), []).append((x.item, x.heading, x.body, x.lines, x.image, x.href, x.has_icon))
    for p, i in todo:
        t = plain[p]
        members = group(t, container(t, i), {k: signature[p, k] for k in range(len(t.n))})
        assert items.get((p, i), []) == [(m["i"], *expected_item(t, m["i"])) for m in members[:12]], (p, i)
        if members:
            pictures = sum(bool(expected_item(t, m["i"])[3]) for m in members[:12])
            assert marks[p, i] == (len(members), sum(abs(m["top"] - members[0]["top"]) < 12 for m in members), pictures >= len(members) - 1)
        else:
            assert (p, i) not in marks
    assert items and any(v[2] for v in marks.values())


def test_kinds_and_copy(spark, pages):
    plain, n = pages
    found = written(sections.candidates(n), "found")
    r = written(layout.repeated(n, layout.containers(n, found)), "repeated")
    marks = {(x.page_id, x.i): (x.repeat, x.images, x.row) for x in layout.repeat_marks(n, r).collect()}
    f = sections.features(n, found, layout.repeat_marks(n, r)).withColumn("kind", sections.kind()).cache()
    kinds, whole = {}, {(x.page_id, x.i): x for x in found.collect()}
    for x in f.collect():
        t, e, c = plain[x.page_id], plain[x.page_id].n[x.i], whole[x.page_id, x.i]
        below, text = t.below(x.i), " ".join(k["own_text"] for k in [e, *t.below(x.i)])[:600]
        count = lambda *tags: sum(d["tag"] in tags for d in below)  # noqa: E731, B023
        rep, pics, _ = marks.get((x.page_id, x.i), (0, False, 0))
        links, buttons = count("a"), sum(d["tag"] == "button" or d["tag"] == "a" and d["background"] != "rgba(0, 0, 0, 0)" for d in below)
        if c.whole:
            want = "content"
        elif e["tag"] == "footer":
            want = "footer"
        elif e["tag"] == "nav" or e["role"] == "navigation" or e["tag"] == "header" and e["y"] < 200 and e["h"] < 200 or e["y"] < 160 and e["h"] <= 120 and links >= 3:
            want = "nav"
        elif c.ord >= c.total - 1 and links >= 6:
            want = "footer"
        elif any(d["tag"] == "h1" and d["own_text"] for d in below):
            want = "hero"
        elif re.search(r"[$£€¥]\s?\d", text) and 2 <= rep <= 5:
            want = "pricing"
        elif count("blockquote"):
            want = "testimonial"
        elif count("details", "summary"):
            want = "faq"
        elif pics and rep >= 3:
            want = "logo-cloud"
        elif rep >= 3:
            want = "stats" if rep <= 5 and "%" in text and len(re.sub("[^A-Za-z]", "", text)) < 240 else "gallery" if count("img") >= rep else "feature-grid"
        elif count("form", "input") or buttons >= 1 and e["h"] < 520 and links <= 4:
            want = "cta"
        else:
            want = "content"
        assert x.kind == want, (x, want)
        kinds[x.page_id, x.i] = want
    assert len(set(kinds.values())) >= 6
    named = written(f.select("page_id", "i", "kind", sections.F.lit("id").alias("id")), "named")
    copy = {(x.page_id, x.i): x for x in assets.section_copy(n, named, layout.items(n, r)).collect()}
    notes = {(x.page_id, x.i): x.notes for x in assets.section_notes(n, named, layout.repeat_marks(n, r)).collect()}
    said = {}
    for x in layout.items(n, r).collect():
        said.setdefault((x.page_id, x.i), set()).update(x.lines.split("\n"))
    for (p, i), kind in kinds.items():
        t, x, below = plain[p], copy[p, i], plain[p].below(i)
        chrome = kind in ("nav", "footer")
        repeat = set() if chrome else said.get((p, i), set())
        head = None if chrome else next((d for tag in ("h1", "h2", "h3", "h4") for d in below if d["tag"] == tag and d["own_text"]), None)
        brow = next((d for d in below if head and d["own_text"] and d["y"] < head["y"] and len(d["own_text"]) < 60 and (d["text_transform"] == "uppercase" or (number(d["font_size"]) or 16) < 15)), None)
        prose = [d for d in below if len(d["own_text"]) > 24 and d is not head and d is not brow]
        body = [d["own_text"] for d in prose if d["own_text"] not in repeat][:8]
        full = lambda d: " ".join(k["own_text"] for k in [d, *t.below(d["i"])] if k["own_text"])[:600]  # noqa: E731, B023
        solid = lambda d: d["background"] not in ("transparent", "rgba(0, 0, 0, 0)")
        like = [d for d in below if d["tag"] == "button" or d["role"] == "button" or d["tag"] == "a" and (solid(d) or d["has_border"] or d["cls"])]
        acts = [d for d in like if full(d) and full(d) not in repeat][:6]
        sub = next((d["own_text"] for d in prose if head and d["y"] >= head["y"]), None)
        assert (x.heading, x.level, x.eyebrow) == (head and head["own_text"], int(head["tag"][1]) if head else 0, brow["own_text"] if brow else "")
        assert x.body == "\n".join(body) and x.subheading == (sub if sub and sub != (body or [None])[0] else (body or [""])[0])
        assert x.ctas == "\n".join(full(d)[:80] for d in acts)
        assert x.variants == "\n".join("primary" if solid(d) else "secondary" if d["has_border"] else "link" for d in acts)
        assert x.links == ("\n".join([full(d)[:40] for d in below if d["tag"] == "a" and full(d)][:40]) if chrome else "")
        e = t.n[i]
        told = ["Pinned to the viewport (position: fixed)."] * (e["position"] == "fixed") + ["Backdrop filter: blur(1px)."] * (e["backdrop"] == "blur(1px)") + ["Background gradient: linear-gradient(red, blue)."] * ("grad" in e["image"])
        if (p, i) in marks and not chrome:
            told.append(f"{marks[p, i][0]} repeating items in {marks[p, i][2]} column(s) — emit one {assets.NAMES.get(kind, 'Item')} and map over the data.")
        assert notes[p, i] == "\n".join(told)


def test_pages_are_dealt_by_their_markup(spark):
    """More pages make more tasks, not larger ones; each page stays whole."""
    pages = spark.createDataFrame([(i, "<p>" + "x" * 97) for i in range(400)] + [(900, None)], "page_id long, html string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tree.dealt(pages).rdd.getNumPartitions() == least and tree.dealt(pages.limit(0)).rdd.getNumPartitions() == least
    many = tree.dealt(pages, 1000)
    assert many.rdd.getNumPartitions() == 40 and many.count() == 401
    chars = many.rdd.mapPartitions(lambda rows: [sum(len(r.html or "") for r in rows)]).collect()
    assert max(chars) < 3000
    assert f"hashpartitioning(page_id, {least})" in " ".join(re.sub(r"#\d+L?", "", tree.nodes(pages)._jdf.queryExecution().toString()).split())


def test_own_text_of_dom_nodes_is_whole(spark, tmp_path):
    """It ended after 400 characters."""
    import duckdb

    from designlake.plans import catalogue

    said = " ".join(f"word{k}" for k in range(300))
    spark.createDataFrame([(1, f"<div>{said}<b>x</b>end</div>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [(r.tag, r.own_text) for r in catalogue.dom_nodes(spark, str(tmp_path)).orderBy("i").collect()] == [("div", f"{said}end"), ("b", "x")]
    assert [r.own_text for r in catalogue._nodes(spark, str(tmp_path)).orderBy("i").collect()] == [said[:400], "x"]
    sql = lambda q: sorted(x[-1] for x in duckdb.sql(q.replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall())
    assert sql(catalogue.SQL["dom_nodes"]) == sorted([f"{said}end", "x"])


def test_components_are_named_by_all_items_of_a_repeat(spark, tmp_path):
    """Images were looked for in the first 12 items, so a longer repeat never had them."""
    import duckdb

    from designlake.plans import catalogue, copydeck

    items = lambda n, less=0: "<section>" + "<div><img src='a.png'></div>".replace("'", '"') * (n - less) + "<div><img></div>" * less + "</section>"
    spark.createDataFrame([(1, f"<body>{items(14)}{items(12)}{items(20, 1)}{items(20, 2)}</body>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [r.component for r in copydeck.component_names(spark, str(tmp_path)).orderBy("i").collect()]
    assert got == ["LogoCloud", "LogoCloud2", "LogoCloud3", "Gallery"]
    sql = duckdb.sql(copydeck.SQL["component_names"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert [x[2] for x in sorted(sql)] == got
    # the query of kinds keeps its rule, which looks at the first items
    assert [r.kind for r in catalogue.section_classify(spark, str(tmp_path)).orderBy("i").collect()] == ["gallery", "logo-cloud", "gallery", "gallery"]
