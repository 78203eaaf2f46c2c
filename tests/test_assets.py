"""Rules of images, icons, fonts, viewports and section copy on hand-made rows."""

from pyspark.sql import functions as F

from designlake.operators import assets

IMAGE = "p long, ord long, src string, alt string, cls string, natural_w int, natural_h int, y int, w int, h int, is_background boolean"
ICON = "p long, ord long, view_box string, cls string, fill string, stroke string, width int, height int, paths int, d string"


def test_images(spark):
    data = "data:image/png;base64," + "A" * 60
    rows = [
        (1, 5, "/a.jpg", "", "", 0, 0, 100, 500, 300, False),
        (1, 2, "/a.jpg", "", "", 0, 0, 1000, 500, 300, False),
        (1, 3, data + "x", "One", "", 40, 40, 0, 0, 0, False),
        (1, 4, data + "y", "One", "", 40, 40, 0, 0, 0, False),
        (1, 6, data + "y", "Two logo", "", 40, 40, 0, 0, 0, False),
        (1, 7, "/me.jpg", "", "", 96, 92, 0, 0, 0, False),
        (1, 8, "/h.jpg", "", "", 900, 500, 899, 401, 0, False),
        (1, 9, "/bg-logo.jpg", "", "", 900, 500, 0, 0, 0, True),
        (1, 10, "/c.jpg", "", "wordmark", 900, 500, 0, 0, 0, False),
        (1, 13, data + "n", None, None, 40, 40, 0, 0, 0, False),
        (1, 11, None, "logo", "", 1, 1, 0, 0, 0, False),
        (1, 12, "", "logo", "", 1, 1, 0, 0, 0, False),
    ]
    got = [(r.src[-6:], r.role, r.is_brand) for r in assets.images(spark.createDataFrame(rows, IMAGE), ["p"]).orderBy("place").collect()]
    assert got == [("/a.jpg", "photo", False), ("AAAAAx", "icon", False), ("AAAAAy", "logo", True), ("me.jpg", "avatar", False), ("/h.jpg", "hero", False), ("go.jpg", "background", True), ("/c.jpg", "logo", True), ("AAAAAn", "icon", False)]
    many = [(2, i, f"/{i}.jpg", "", "", 1, 1, 0, 0, 0, False) for i in range(130)]
    assert assets.images(spark.createDataFrame(many, IMAGE), ["p"]).agg(F.max("place")).first()[0] == assets.MOST_IMAGES
    assert assets.images(spark.createDataFrame([], IMAGE), ["p"]).count() == 0


def test_icons(spark):
    g = assets.GRID
    rows = [(1, i, g, "lucide lucide-check", "none", "currentColor", 24, 24, 1, "M" * 61) for i in range(2)] + [(1, 9, g, "plain", "none", "none", 1, 2, 3, "M1")]
    rows += [(2, i, g, "lucide", "#000", "currentColor", 24, 24, 1, "M") for i in range(2)] + [(2, 3, "0 0 20 20", "fas fa-x", "", "", 1, 1, 1, "M")] + [(3, i, "", "fabric fas", "", "", 1, 1, 1, "M") for i in range(5)]
    got = {r.p: r for r in assets.icons(spark.createDataFrame(rows, ICON), ["p"]).collect()}
    assert (got[1].library, got[1].confidence, got[1].n) == ("lucide", 0.67, 3)
    assert got[1].samples.split("\n") == ['<svg viewBox="0 0 24 24" width="24" height="24" paths="1" d="' + "M" * 60 + '…">'] * 2
    assert (got[2].library, got[2].confidence) == ("custom", 0.67)
    assert (got[3].library, got[3].confidence, len(got[3].samples.split("\n"))) == ("font-awesome", 1.0, assets.SAMPLES)


def test_families_and_viewports(spark):
    url = "https://fonts.googleapis.com/css2?family=Open+Sans:wght@400&display=swap&family=IBM%20Plex"
    d = spark.createDataFrame([(1, 3, url), (1, 1, url), (1, 2, "https://cdn.example/?family=No"), (1, 4, None)], "p long, ord long, url string")
    assert sorted(tuple(r) for r in assets.google_families(d, ["p"]).collect()) == [(1, "IBM Plex", 1), (1, "Open Sans", 1)]
    d = spark.createDataFrame([(1, ["mobile", "watch", "desktop"]), (2, []), (3, None), (4, ["tablet"])], "i int, v array<string>")
    kept, others = assets.asked_viewports(F.col("v"))
    got = {r.i: (r.k, r.o) for r in d.select("i", kept.alias("k"), others.alias("o")).collect()}
    assert got == {1: (["desktop", "mobile"], ["mobile"]), 2: (assets.VIEWPORTS, assets.VIEWPORTS[1:]), 3: (assets.VIEWPORTS, assets.VIEWPORTS[1:]), 4: (["tablet"], [])}


def test_responsive(spark):
    base = spark.createDataFrame([(1, 0, "hero", 3), (1, 1, "cta", 1), (1, 2, "faq", 2)], "p long, ord int, kind string, columns int")
    other = spark.createDataFrame([(1, 0, "nav", 1, "block", 0), (1, 0, "hero", 2, "flex", 1), (1, 1, "faq", 1, "grid", 5), (1, 1, "nav", 4, "block", 4)], "p long, ord int, kind string, columns int, display string, seq int")
    got = sorted(tuple(r)[1:] for r in assets.responsive(base, other, ["p"]).collect())
    assert got == [(0, "hero", 2, "flex", True, True), (1, "cta", 4, "block", True, False), (2, "faq", 0, "none", False, False)]


def test_page_html(spark):
    d = spark.createDataFrame([(1, 9, "b", "nav", None, "", "", "x\ny"), (1, 2, "a", "hero", "A & B", "p1\n<p2>", "Go", "")], "page_id long, i long, id string, kind string, heading string, body string, ctas string, links string")
    assert assets.page_html(d).first().html == '<section id="a"><h2>A &amp; B</h2><p>p1</p><p>&lt;p2&gt;</p><button>Go</button></section>\n<section id="b"><a>x</a><a>y</a></section>'
    assert [r.component for r in assets.component_names(spark.createDataFrame([(1, 3, "feature-grid"), (1, 1, "feature-grid"), (1, 2, "hero")], "page_id long, i long, kind string")).orderBy("i").collect()] == ["FeatureGrid", "Hero", "FeatureGrid2"]
