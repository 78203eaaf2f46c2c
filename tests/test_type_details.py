"""Details of type groups, import code and the Tailwind 3 configuration."""

import json
import random

import pytest

from designlake.operators import emit, typography

TEXT = "p long, ord long, tag string, text string, font_size string, font_weight string, letter_spacing string, text_transform string"


def test_details_as_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), k, rng.choice(["p", "h1", "h2", "a", "li", "b", "i", "td"]), rng.choice(["", None, "x" * rng.choice([1, 89, 90, 91, 120]) + str(k)]), rng.choice(["12.4px", "20px", "0px", "x"]), rng.choice(["400", "bold", "700"]), rng.choice(["", None, "normal", "1px", "2px"]), rng.choice(["", None, "none", "uppercase"])) for k in range(400)]
    rng.shuffle(rows)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in typography.details(spark.createDataFrame(rows, TEXT).repartition(3), ["p"]).collect()}
    want = {}
    for p, _, tag, text, size, weight, space, case in sorted(rows, key=lambda r: r[1]):
        if not text or size in ("0px", "x"):
            continue
        g = want.setdefault((p, 12 if size[0] == "1" else 20, 700 if weight == "700" else 400), {"space": {}, "case": {}, "tags": {}, "sample": ""})
        for k, v in (("space", space or "normal"), ("case", case or "none")):
            g[k][v] = g[k].get(v, 0) + len(text)
        g["tags"][tag] = 1
        if len(text) > len(g["sample"]):
            g["sample"] = text[:90]
    most = lambda d: max(d, key=d.get)
    assert got == {k: (most(g["space"]), most(g["case"]), ",".join(list(g["tags"])[:6]), g["sample"]) for k, g in want.items()}
    assert typography.details(spark.createDataFrame([], TEXT), ["p"]).count() == 0


def test_import_code(spark):
    rows = [("IBM Plex Sans", "google", "400;700", ""), ("Own", "self-hosted", "400", "\n".join(f"/{k}.woff2" for k in range(9))), ("Kit", "adobe", "", ""), ("Arial", "system", "", ""), ("Odd Face", "unknown", "", None)]
    d = spark.createDataFrame([(f, f"'{f}', serif", s, w, u) for f, s, w, u in rows], "family string, stack string, source string, weights string, urls string")
    code = {r.source: r.code for r in d.select("source", typography.import_code().alias("code")).collect()}
    assert code["google"].split("\n")[1] == "@import url('https://fonts.googleapis.com/css2?family=IBM+Plex+Sans:wght@400;700&display=swap');"
    assert "const font = IBM_Plex_Sans({\n  subsets: ['latin'],\n  weight: ['400', '700']," in code["google"]
    assert code["self-hosted"].count("@font-face { font-family: 'Own'; src: url('/") == 4 and code["self-hosted"].count("\n * /") == 8
    assert "use.typekit.net/YOUR_KIT.css" in code["adobe"] and code["system"].endswith("\nfont-family: 'Arial', serif;")
    assert "family=Odd+Face:wght@400;700&" in code["unknown"] and code["unknown"].endswith("\n\nfont-family: 'Odd Face', serif;")


@pytest.mark.parametrize("spaced", [True, False])
def test_tailwind_config(spark, spaced):
    make = lambda rows, schema: spark.createDataFrame(rows, "page_id long, " + schema)
    scale = make([(1, "text-20", 20, 700, 1.25, "-0.5px"), (1, "body", 16, 400, 1.5, "normal")], "name string, size long, weight long, line_height double, letter_spacing string")
    design = {
        "colours": make([(1, "accent", "#112233", 0, 1), (2, "accent", "#000000", 0, 1)], "name string, hex string, source int, ord int"),
        "families": make([(1, 1, '"My Face", serif', "body"), (1, 2, "Mono, monospace", "mono"), (1, 3, "Other", "body")], "rank int, stack string, usage string"),
        "scale": scale if spaced else scale.drop("letter_spacing"), "spacing": make([(1, 8)], "px long"), "radii": make([(1, "lg", "8px")], "token string, radius string"), "shadows": make([(1, "sm", '0 0 "x"')], "token string, shadow string"),
        "breakpoints": make([(1, 768), (1, 640)], "width int"), "container": make([(1, 1200), (2, None)], "max_width int"), "motion": make([(1, "duration", "0.2s", 1), (1, "duration", "9s", 2), (1, "easing", "ease", 1)], "kind string, value string, rank int"),
    }
    got = {r.page_id: r.config for r in emit.tailwind_config(design, ["page_id"]).collect()}
    assert all(c.startswith(emit.CONFIG_HEAD) and c.endswith(emit.CONFIG_TAIL) for c in got.values())
    theme = {p: json.loads(c[len(emit.CONFIG_HEAD) : -len(emit.CONFIG_TAIL)]) for p, c in got.items()}
    assert theme[2] == {"colors": {"accent": "#000000"}} | {k: {} for k in ("fontFamily", "fontSize", "borderRadius", "boxShadow", "screens", "maxWidth", "transitionDuration", "transitionTimingFunction")}
    one = theme[1]
    assert one["fontFamily"] == {"body": ["Other"], "mono": ["Mono", "monospace"]} and list(one["fontFamily"]) == ["body", "mono"]
    assert list(one["fontSize"]) == ["20", "body"] and one["fontSize"]["20"] == ["20px", {"lineHeight": "1.25"} | ({"letterSpacing": "-0.5px"} if spaced else {}) | {"fontWeight": "700"}]
    assert not spaced or one["fontSize"]["body"][1]["letterSpacing"] == "0"
    assert one["screens"] == {"bp640": "640px", "bp768": "768px"} and one["maxWidth"] == {"container": "1200px"} and one["boxShadow"] == {"sm": '0 0 "x"'}
    assert one["transitionDuration"] == {"DEFAULT": "0.2s"} and one["transitionTimingFunction"] == {"DEFAULT": "ease"} and "spacing" not in one
