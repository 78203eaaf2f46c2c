"""Pages as JSON and as briefs, on hand-made sections."""

import json

import pytest

from designlake.operators import briefs

COPY = "page_id long, i long, id string, kind string, heading string, level int, eyebrow string, subheading string, body string, ctas string, variants string, links string"
LAID = "page_id long, i long, container long, display string, gap int, columns int, max_width int, padding_top int, padding_bottom int, padding_x int, min_height long"
ITEMS = "page_id long, i long, place int, item long, heading string, body string, lines string, image string, href string, has_icon boolean"
PAGES = "page_id long, url string, title string, note string"


def tables(spark):
    copy = [(1, 9, "section-10-cta", "cta", None, 0, "", "", "", "", "", ""), (1, 2, "section-2-feature-grid", "feature-grid", 'All "in" | one', 2, "New", "First line", "First line\nSecond line", "Go\nStay | here", "primary\nlink", ""), (1, 1, "section-1-nav", "nav", None, 0, "", "", "", "", "", "Home\nDocs")]
    laid = [(1, 2, 3, "grid", 12, 3, 1200, 8, 10, 0, 480), (1, 1, 1, "block", 0, 1, None, 0, 0, 24, 80)]
    items = [(1, 2, 2, 6, "B", "", "B", "", "", True), (1, 2, 1, 5, "A|", "Text", "A", "/a.png", "/x", True), (1, 1, 1, 4, "no", "no", "no", "", "", False)]
    notes = [(1, 2, "One.\nTwo."), (1, 1, "")]
    make = spark.createDataFrame
    return make(copy, COPY), make(laid, LAID), make(items, ITEMS), make(notes, "page_id long, i long, notes string"), make([(1, "https://a.example/", "Title", None), (2, "https://b.example/", None, "x"), (3, None, None, None)], PAGES)


def test_spec(spark):
    *parts, pages = tables(spark)
    design = spark.createDataFrame([(1, '{"colors":{}}')], "page_id long, json string")
    got = {r.page_id: json.loads(r.json) for r in briefs.spec(pages, briefs.described(*parts), design).collect()}
    assert got[2] == {"page": {"url": "https://b.example/", "title": None, "note": "x"}, "sections": [], "stats": {"sections": 0, "components": 0}}
    assert got[3]["page"] == {"url": None, "title": None, "note": None}
    one = got[1]
    assert one["design"] == {"colors": {}} and one["stats"] == {"sections": 3, "components": 1}
    assert [s["id"] for s in one["sections"]] == ["section-1-nav", "section-2-feature-grid", "section-10-cta"]
    nav, grid, cta = one["sections"]
    assert nav["navLinks"] == ["Home", "Docs"] and nav["items"] == [] and nav["notes"] == [] and nav["layout"]["max_width"] is None
    assert grid["ctas"] == [{"label": "Go", "variant": "primary"}, {"label": "Stay | here", "variant": "link"}] and grid["notes"] == ["One.", "Two."] and grid["bodyText"] == ["First line", "Second line"]
    assert grid["items"] == [{"heading": "A|", "body": "Text", "image": "/a.png", "href": "/x", "icon": True}, {"heading": "B", "body": "", "image": "", "href": "", "icon": True}]
    assert cta["layout"] is None and cta["heading"] == "" and cta["bodyText"] == []


def test_brief(spark):
    *parts, pages = tables(spark)
    got = {r.page_id: r.brief for r in briefs.brief(pages, briefs.described(*parts)).collect()}
    assert got[2] == "# https://b.example/\n\n## 2. Page structure\n\n_None detected._\n\n## 3. Sections\n\n_None detected._\n" and got[3].startswith("# \n")
    want = """# Title

## 2. Page structure

| # | Section | Heading | Height |
| --- | --- | --- | --- |
| 1 | Nav | — | 80px |
| 2 | Feature Grid | All "in" \\| one | 480px |
| 10 | Cta | — | — |

## 3. Sections

### 3.1 Nav — `section-1-nav`

**Layout**

- Display: `block`
- Padding: `0px` top, `0px` bottom, `24px` sides

**Links:** Home · Docs

### 3.2 Feature Grid — `section-2-feature-grid`

**Layout**

- Display: `grid` · 3 columns
- Gap: `12px`
- Padding: `8px` top, `10px` bottom, `0px` sides
- Content max-width: `1200px`

**Content**

- Eyebrow: "New"
- Heading (h2): "All "in" | one"
- Subheading: "First line"
- Body: "Second line"

**Buttons**

| Label | Variant |
| --- | --- |
| Go | primary |
| Stay \\| here | link |

**Repeating component — `<NAME />`**

| # | Heading | Body | Link | Media |
| --- | --- | --- | --- | --- |
| 1 | A\\| | Text | /x | /a.png |
| 2 | B | — | — | icon |

**Notes**

- One.
- Two.

### 3.10 Cta — `section-10-cta`
""".replace("NAME", briefs.NAMES.get("feature-grid", "Item"))
    assert got[1] == want


def test_placeholder_mode_keeps_shape_and_addresses(spark):
    *parts, pages = tables(spark)
    plain, other = (next(s for s in json.loads(briefs.spec(pages.where("page_id = 1"), briefs.described(*parts, mode=m)).first().json)["sections"] if s["kind"] == "feature-grid") for m in briefs.MODES)
    assert other["heading"] != plain["heading"] and len(other["heading"].split()) == len(plain["heading"].split())
    assert [len(x.split()) for x in other["bodyText"]] == [2, 2] and other["bodyText"] != plain["bodyText"]
    assert [x["href"] for x in other["items"]] == ["/x", ""] and [x["variant"] for x in other["ctas"]] == ["primary", "link"] and other["layout"] == plain["layout"]
    with pytest.raises(ValueError):
        briefs.described(*parts, mode="loud")


def test_empty_tables(spark):
    *parts, pages = (t.where("false") for t in tables(spark))
    d = briefs.described(*parts)
    assert d.count() == 0 and briefs.spec(pages, d).count() == 0 and briefs.brief(pages, d).count() == 0


def test_compact(spark):
    *parts, pages = tables(spark)
    got = {r.page_id: r.brief for r in briefs.compact(pages, briefs.described(*parts)).collect()}
    assert got[2] == "# https://b.example/\n\nSource: https://b.example/ · 0 sections\n\n## Sections\n"
    grid = '- **2. Feature Grid** (`feature-grid`) · grid, 3 cols · pad 8/10\n  - Heading: "All "in" | one"\n  - Sub: "First line"\n  - Buttons: "Go" (primary), "Stay | here" (link)\n  - 2× `<' + briefs.NAMES.get("feature-grid", "Item") + " />`"
    assert got[1] == "# Title\n\nSource: https://a.example/ · 3 sections\n\n## Sections\n\n- **1. Nav** (`nav`) · block · pad 0/0\n" + grid + "\n- **10. Cta** (`cta`)"
