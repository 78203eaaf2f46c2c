"""Steps that tokens share: what is dealt, and what is read once for equal strings."""

import re

from pyspark.sql import functions as F

from designlake.operators import assets, effects, stylesheets, typography


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sheets_are_dealt_once_and_before_they_are_cut(spark):
    s = spark.createDataFrame([(1, 0, "a{b:c} :root{--x: 1px} @import 'y{';"), (2, 0, "/* x */ p{q:'};"), (2, 1, "}b{}{"), (3, 0, None)], "page_id long, sheet long, css string")
    p = stylesheets.pieces(s)
    assert len(re.findall(r"Exchange hashpartitioning", plan(stylesheets.rules(p)))) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan(p))) == 1
    got = sorted(tuple(r) for r in p.select("page_id", "sheet", "t", "mark", "text", "level").collect())
    assert got == [(1, 0, 0, "{", "a", 0), (1, 0, 1, "}", "b:c", 1), (1, 0, 2, "{", ":root", 0), (1, 0, 3, "}", "--x: 1px", 1), (1, 0, 4, ";", "@import 'y{'", 0), (2, 0, 0, "{", "p", 0), (2, 1, 0, "}", "", 0), (2, 1, 1, "{", "b", 0), (2, 1, 2, "}", "", 1), (2, 1, 3, "{", "", 0)]


def test_equal_strings_are_added_up_before_they_are_read(spark):
    d = spark.createDataFrame([(1, i, ["8px 16px", "normal", "", None][i % 4], ["4px", "300px"][i % 2], ["0.2s, 0.3s", "0.3s"][i % 2], "ease") for i in range(12)] + [(2, 1, None, "auto", None, None)], "page_id long, ord long, gap string, padding string, duration string, easing string")
    for q in (effects.spacing(d, ["page_id"], ["gap", "padding"]), effects.spacing_steps(d, ["page_id"], ["gap", "padding"]), effects.motion(d, ["page_id"], "duration", "easing", "ord")):
        # no aggregate but those above the first one reads numbers or lists
        lowest = plan(q).rstrip().split("HashAggregate")[-1]
        assert "regexp_extract" not in lowest
    assert sorted(tuple(r) for r in effects.spacing(d, ["page_id"], ["gap", "padding"]).collect()) == [(1, 12, 4, 1.0), (2, 0, 4, 0.0)]
    assert sorted((r["px"], r["key"]) for r in effects.spacing_steps(d, ["page_id"], ["gap", "padding"]).collect()) == [(4, "1"), (8, "2"), (16, "4")]
    assert sorted((r["kind"], r["value"], r["n"], r["rank"]) for r in effects.motion(d, ["page_id"], "duration", "easing", "ord").collect()) == [("duration", "0.2s", 6, 2), ("duration", "0.3s", 12, 1)]


def test_letter_spacings_are_those_of_the_details(spark):
    d = spark.createDataFrame([(1, i, "p", "x" * (i % 3), "16px", ["400", "bold"][i % 2], ["", "1px", None, "-1px"][i % 4], "none") for i in range(20)], "page_id long, ord long, tag string, text string, font_size string, font_weight string, letter_spacing string, text_transform string")
    key = ["page_id", "size", "weight", "letter_spacing"]
    short = typography.letter_spacings(d, ["page_id"])
    assert sorted(map(tuple, short.select(*key).collect())) == sorted(map(tuple, typography.details(d, ["page_id"]).select(*key).collect()))
    assert plan(short).count("SortMergeJoin") + plan(short).count("BroadcastHashJoin") == 0


def test_drawings_are_dealt_by_their_number(spark):
    kinds = {"view_box": "'0 0 24 24'", "cls": "CASE WHEN id % 2 = 0 THEN 'Feather' ELSE '' END", "fill": "'none'", "stroke": "'none'", "width": "id", "height": "id", "paths": "id", "d": "'M'"}
    d = spark.range(200).select((F.col("id") % 50).alias("page_id"), F.col("id").alias("ord"), *[F.expr(v).alias(k) for k, v in kinds.items()])
    few, many = assets.icons(d, ["page_id"], rows=1000), assets.icons(d, ["page_id"], rows=2)
    assert re.search(r"hashpartitioning\(page_id#\d+L?, 100\)", plan(many))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == 50


def test_page_elements_are_read_from_markup_once(spark, tmp_path):
    """Subtree sizes and texts came from further passes over the markup, each with all windows."""
    from designlake.operators import tree

    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "<body><p>a<div>b<p>c</div>d<a>x</a></p></div>tail"), (2, "<ul><li>1<li>2</ul>")], "page_id long, html string").write.parquet(path)
    n = tree.nodes(spark.read.parquet(path))
    assert n._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert [(r.page_id, r.i, r.tag, r.n_descendants, r.own_text) for r in n.orderBy("page_id", "i").collect()] == [(1, 0, "body", 4, "d"), (1, 1, "p", 0, "a"), (1, 2, "div", 1, "b"), (1, 3, "p", 0, "c"), (1, 4, "a", 0, "x"), (2, 0, "ul", 2, ""), (2, 1, "li", 1, "1"), (2, 2, "li", 0, "2")]


def test_emitters_compute_only_the_tables_they_write(spark, monkeypatch):
    """Dark palettes and sheets were computed for files that do not have them, and a media query for each element with it."""
    from designlake.plans import site

    asked = []
    monkeypatch.setattr(site, "_design", lambda spark, sf_dir, *names: asked.append(set(names)) or {})
    for q in (site.tailwind_theme, site.tokens_css):
        try:
            q(spark, "")
        except KeyError:
            pass
    assert asked[0] == {"colours", "families", "scale", "spacing", "radii", "shadows", "breakpoints"}
    assert not asked[1] & {"breakpoints", "variables", "keyframes", "grid", "borders"}
    d = spark.createDataFrame([(1, "(min-width: 40em)")] * 3 + [(1, "(min-width: 640px)"), (2, None)], "page_id long, media string")
    got = effects.breakpoints(d, ["page_id"], "media")
    assert "media_widths" not in plan(got) and plan(got).rstrip().split("HashAggregate")[-1].count("regexp") == 0
    assert [tuple(r) for r in got.collect()] == [(1, 640)]
