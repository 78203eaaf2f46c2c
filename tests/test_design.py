"""Rules of tokens on hand-made values."""

from pyspark.sql import functions as F

from designlake.functions import css, text
from designlake.operators import effects, jobs
from designlake.sources import imports


def one(spark, value, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(f(F.col("v"))).collect()]


def test_colours(spark):
    got = one(spark, ["rgb(12, 150, 90)", "rgba(200, 1, 33, 0.25)", "transparent", "rgba(9, 9, 9, 0)", "", "#abc", None], css.rgb)
    assert [None if r is None else tuple(r) for r in got] == [(12, 150, 90, 1.0), (200, 1, 33, 0.25), None, None, None, (170, 187, 204, 1.0), None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(["#6b7280", "#1c1917", "#7c3aed", "#fefefe", "#010101"])], "i int, v string")
    d = d.select("i", css.rgb(F.col("v")).alias("c")).cache()
    d = d.select("i", *[x.alias(n) for x, n in zip(css.oklch(*[F.col(f"c.{k}") for k in "rgb"]), "lch")]).cache()
    names = [r[0] for r in d.orderBy("i").select(css.colour_name(*[F.col(n) for n in "lch"])).collect()]
    assert [n.split("-")[0] for n in names] == ["neutral", "neutral", "violet", "neutral", "neutral"] and names[3:] == ["neutral-50", "neutral-900"]


def test_strings_of_styles(spark):
    assert one(spark, ["16px", " .5em", "auto", "-3.25e1px", None], css.number) == [16.0, 0.5, None, -32.5, None]
    assert one(spark, ["Inter, -apple-system, sans-serif", '"Segoe UI", system-ui', "system-ui, sans-serif"], css.primary_family) == ["Inter", "Segoe UI", "system-ui"]
    assert one(spark, ["cubic-bezier(0.4, 0, 0.2, 1), ease", "0.2s, 0.3s", ""], css.split_list) == [["cubic-bezier(0.4, 0, 0.2, 1)", "ease"], ["0.2s", "0.3s"], []]
    widths = one(spark, ["(max-width: 768px)", "(min-width: 1024px)", "(min-width: 48em)", "(max-width: 1px)", "(min-width:600px) and (max-width:900px)"], css.media_widths)
    assert widths == [[769], [1024], [768], [], [601, 901]]
    assert one(spark, ["https://fonts.googleapis.com/css2?family=Open+Sans:wght@400&family=Inter", "https://x.example/?family=A"], css.google_families) == [["Open Sans", "Inter"], []]


def test_placeholder_keeps_the_shape(spark):
    words = ["Build tools fast.", "  Two words ", "42 — 7", "", "A b, C!"]
    out = one(spark, words, text.placeholder)
    assert out[2:4] == ["42 — 7", ""]
    for a, b in zip(words, out):
        assert len(a.split()) == len(b.split())
        for x, y in zip(a.split(), b.split()):
            assert x[:1].isupper() == y[:1].isupper() and (x[-1].isalnum() or x[-1] == y[-1])
    assert out == one(spark, words, text.placeholder)


def test_radii_spacing_and_status(spark):
    rows = [("p", i, v) for i, v in enumerate(["6px"] * 3 + ["12px"] * 2 + ["20px"] * 2 + ["0px", "7px", "50%", "9999px", "9999px", "0px 0px 3px"])]
    got = {r.token: r.px for r in effects.radii(spark.createDataFrame(rows, "page string, o long, v string"), ["page"], "v", "o").collect()}
    assert got == {"sm": 6.0, "md": 12.0, "lg": 20.0, "full": 9999.0}
    rows = [("a", f"{v}px") for v in (16, 40, 56, 72, 80) for _ in range(3)] + [("b", f"{v}px") for v in (3, 5, 11, 17, 37, 41) for _ in range(5)] + [("c", "auto"), ("c", None), ("d", "300px 0px")]
    got = {r.page: (r.base, r.confidence) for r in effects.spacing(spark.createDataFrame(rows, "page string, v string"), ["page"], ["v"]).collect()}
    assert got["a"] == (8, 1.0) and got["b"][1] < 0.5 and got["c"] == (4, 0.0) == got["d"]
    out = one(spark, [200, 301, 403, 404, 500], lambda v: text.http_failure(v, F.lit("u")), "int")
    assert out[:2] == [None, None] and "browser" in out[2] and "browser" not in out[3] and "server error" in out[4]


def test_requests_and_imports(spark):
    rows = [(1, 1, "create"), (1, 2, "claim"), (1, 3, "complete"), (1, 4, "decline"), (2, 1, "create"), (2, 2, "decline"), (3, 1, "claim"), (4, 1, "claim"), (4, 2, "create"), (5, 1, "create")]
    got = {r.k: (r.status, r.refused) for r in jobs.requests(spark.createDataFrame(rows, "k int, s int, action string").withColumn("at", F.timestamp_seconds("s")), "k", "at", "s", "action").collect()}
    assert got == {1: ("done", 1), 2: ("declined", 0), 3: (None, 1), 4: ("pending", 1), 5: ("pending", 0)}
    raw = ['{"url":"u","nodes":[{"tag":"p"}]}', '{"url":"u","nodes":[]}', '{"url":"u","nodes":[{"tag"', None, '{"nodes":[{"tag":"p"}]}', "x" * 50]
    d = imports.checked(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), "raw", most=40)
    assert {r.i: r.reason for r in d.collect()} == {0: None, 1: "no measurable content", 2: "not JSON", 3: "empty", 4: "no address", 5: "too large"}
