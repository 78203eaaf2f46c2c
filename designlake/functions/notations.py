"""All notations of CSS colours: names, hex digits, rgb, hsl, hwb, lab, lch, oklab, oklch and color().

A string is taken apart, brought to one of a few colour spaces, from there to linear sRGB, and to OKLCH. The steps stand
in columns of their own (`parsed`), so no formula is evaluated twice for a row; callers pass distinct strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import color, css

# Names of colours and their channels.
NAMES = """aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e
coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b
darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00
darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f
darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff
firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520
gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0
khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080
lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a
lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0
lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3
mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585
midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000
olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee
palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080
rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57
seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa
springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3
white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32"""
# Fixed value: a colour inside of a longer value.
ANY = r"(?:rgba?|hsla?|hwb|lab|lch|oklab|oklch|color)\([^)]*\)|#[0-9a-fA-F]{3,8}\b"
# White points, and the chromaticities of each space's red, green and blue with its white.
D65, D50 = (0.3127, 0.3290), (0.3457, 0.3585)
PRIMARIES = {
    "srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), D65),
    "display-p3": ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06), D65),
    "a98-rgb": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), D65),
    "rec2020": ((0.708, 0.292), (0.17, 0.797), (0.131, 0.046), D65),
    "prophoto-rgb": ((0.734699, 0.265301), (0.159597, 0.840403), (0.036598, 0.000105), D50),
}
# The cone responses in which one white is turned into another.
CONES = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
_PART = rf"(?:none|{NUMBER}(?:%|deg|grad|rad|turn)?)"
_SPACES = "|".join(["srgb-linear", *PRIMARIES, "xyz-d50", "xyz-d65", "xyz"])
#: Name, space, three parts, alpha: with commas (of rgb and hsl only), or with blanks and a slash.
COMMAS = rf"^(rgba?|hsla?)(\()\s*({_PART})\s*,\s*({_PART})\s*,\s*({_PART})\s*(?:,\s*({_PART})\s*)?\)$"
BLANKS = rf"^(?:(rgba?|hsla?|hwb|lab|lch|oklab|oklch)(\()|(color)\(\s*({_SPACES})\s)\s*({_PART})\s+({_PART})\s+({_PART})\s*(?:/\s*({_PART})\s*)?\)$"


def _white(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def _adapt(source: tuple, target: tuple) -> np.ndarray:
    return np.linalg.inv(CONES) @ np.diag((CONES @ _white(*target)) / (CONES @ _white(*source))) @ CONES


def _to_xyz(space: str) -> np.ndarray:
    """The matrix from a space's linear channels to XYZ under D65."""
    *rgb, white = PRIMARIES[space]
    base = np.stack([_white(*p) for p in rgb], axis=1)
    m = base * np.linalg.solve(base, _white(*white))
    return m if white == D65 else _adapt(white, D65) @ m


_FROM_XYZ = np.linalg.inv(_to_xyz("srgb"))
#: To linear sRGB from each space's linear values; `oklab` from cubes of its cone responses.
LINEAR = {s: _FROM_XYZ @ _to_xyz(s) for s in PRIMARIES if s != "srgb"} | {"xyz": _FROM_XYZ, "xyz-d65": _FROM_XYZ, "xyz-d50": _FROM_XYZ @ _adapt(D50, D65), "oklab": np.linalg.inv(np.array(color.TO_LMS))}
_LAB_TO_LMS = np.linalg.inv(np.array(color.TO_LAB))


def _step(df: DataFrame, **values: Column) -> DataFrame:
    """df with new columns of one step, which the optimizer does not copy into later ones."""
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))
    return df.select("*", made.alias("_step")).select(*[c for c in df.columns if c not in values], *[F.col(f"_step.{k}") for k in values])


def _number(part: Column, whole: float | Column = 1.0, percent: float | Column = 1.0) -> Column:
    """A part as a number: percent of `percent`, plain numbers by `whole`; nothing is zero."""
    n = F.coalesce(F.regexp_extract(part, rf"^({NUMBER})", 1).try_cast("double"), F.lit(0.0))
    return F.when(part.endswith("%"), n / 100 * percent).otherwise(n * whole)


def _degrees(part: Column) -> Column:
    n = F.coalesce(F.regexp_extract(part, rf"^({NUMBER})", 1).try_cast("double"), F.lit(0.0))
    return F.when(part.endswith("grad"), n * 0.9).when(part.endswith("rad"), F.degrees(n)).when(part.endswith("turn"), n * 360).otherwise(n)


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _signed(x: Column, f) -> Column:
    return F.signum(x) * f(F.abs(x))


def parsed(values: DataFrame, column: str) -> DataFrame:
    """`column`, hex, r, g, b, alpha, l, c, h of each string that is a visible colour (alpha of css.ALPHA or more).

    r, g and b are rounded and may leave 0 to 255 for colours that sRGB lacks; hex is the nearest it has. Strings that are
    no colour, `none`, `transparent` and `currentcolor` are left out."""
    d = values.select(F.col(column).alias("raw")).where("raw is not null").distinct()
    names = iter(NAMES.split())
    named = F.create_map(*[F.lit(x) for n, v in zip(names, names) for x in (n, f"#{v}")])
    low = F.lower(F.trim("raw"))
    d = _step(d, text=F.coalesce(F.element_at(named, low), low))
    one = F.regexp_extract_all("text", F.lit(r"([0-9a-f])"), 1)
    short = F.col("text").rlike("^#[0-9a-f]{3,4}$")
    d = _step(d, digits=F.when(short, F.regexp_replace(F.array_join(one, ""), "(.)", "$1$1")).when(F.col("text").rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), F.substring("text", 2, 8)))
    commas, blanks = F.col("text").rlike(COMMAS), F.col("text").rlike(BLANKS)
    c, b = lambda i: F.regexp_extract("text", COMMAS, i), lambda i: F.regexp_extract("text", BLANKS, i)
    pick = lambda i, j: F.when(commas, c(i)).when(blanks, b(j))
    d = _step(d, name=F.regexp_replace(F.when(commas, c(1)).when(blanks, F.concat(b(1), b(3), b(4))), "^(rgb|hsl)a$", "$1"), p1=pick(3, 5), p2=pick(4, 6), p3=pick(5, 7), p4=pick(6, 8))
    is_ = lambda *n: F.col("name").isin(*n)
    byte = lambda i: F.conv(F.substring("digits", 1 + 2 * i, 2), 16, 10).cast("double") / 255
    alpha = F.when(F.col("digits").isNotNull(), F.when(F.length("digits") == 8, byte(3)).otherwise(1.0)).otherwise(F.when(F.col("p4") == "", 1.0).otherwise(_clip(_number(F.col("p4")))))
    d = _step(d, alpha=alpha, name=F.when(F.col("digits").isNotNull(), "hex").otherwise(F.regexp_replace("name", "^color", ""))).where(F.col("name").isNotNull() & (F.col("alpha") >= css.ALPHA))
    # the parts as numbers of the notation's own space, angles in degrees
    turn = is_("hsl", "hwb")
    n1 = F.when(is_("hex"), byte(0)).when(turn, _degrees(F.col("p1"))).when(is_("rgb"), _number(F.col("p1"), 1 / 255)).when(is_("lab", "lch"), 100 * _clip(_number(F.col("p1"), 0.01))).when(is_("oklab", "oklch"), _clip(_number(F.col("p1")))).otherwise(_number(F.col("p1")))
    reach = F.when(is_("lab"), 125.0).when(is_("lch"), 150.0).when(is_("oklab", "oklch"), 0.4).otherwise(1.0)
    second = _number(F.col("p2"), F.when(turn, 0.01).otherwise(1.0), reach)
    n2 = F.when(is_("hex"), byte(1)).when(is_("rgb"), _number(F.col("p2"), 1 / 255)).when(is_("lch", "oklch"), F.greatest(second, F.lit(0.0))).when(turn, _clip(second)).otherwise(second)
    third = _number(F.col("p3"), F.when(turn, 0.01).otherwise(1.0), reach)
    n3 = F.when(is_("hex"), byte(2)).when(is_("rgb"), _number(F.col("p3"), 1 / 255)).when(is_("lch", "oklch"), _degrees(F.col("p3"))).when(turn, _clip(third)).otherwise(third)
    d = _step(d, n1=n1, n2=n2, n3=n3)
    # polar to flat, and hues to red, green and blue
    x, y, z = (F.col(k) for k in ("n1", "n2", "n3"))
    hsl_l = F.when(is_("hwb"), 0.5).otherwise(z)
    hsl_a = F.when(is_("hwb"), 0.5).otherwise(y * F.least(z, 1 - z))
    ray = lambda k: F.pmod(F.lit(float(k)) + F.pmod(x, F.lit(360.0)) / 30, F.lit(12.0))
    hue = lambda k: hsl_l - hsl_a * F.greatest(F.lit(-1.0), F.least(ray(k) - 3, 9 - ray(k), F.lit(1.0)))
    sum_ = y + z
    wheel = lambda k: F.when(is_("hsl"), hue(k)).when(sum_ >= 1, y / sum_).otherwise(hue(k) * (1 - sum_) + y)
    polar = is_("lch", "oklch")
    d = _step(
        d,
        space=F.when(is_("hex", "rgb", "hsl", "hwb"), "srgb").when(is_("lab", "lch"), "xyz-d50").when(is_("oklab", "oklch"), "oklab").otherwise(F.col("name")),
        v1=F.when(turn, wheel(0)).otherwise(x), v2=F.when(turn, wheel(8)).when(polar, y * F.cos(F.radians(z))).otherwise(y), v3=F.when(turn, wheel(4)).when(polar, y * F.sin(F.radians(z))).otherwise(z),
    )
    of = lambda *s: F.col("space").isin(*s)
    lab = is_("lab", "lch")
    fy = (F.col("v1") + 16) / 116
    back = lambda f, w: w * F.when(f * f * f > 216 / 24389, f * f * f).otherwise((116 * f - 16) / (24389 / 27))
    white = [float(w) for w in _white(*D50)]
    flat = [F.when(lab, back(f, w)) for f, w in zip((fy + F.col("v2") / 500, fy, fy - F.col("v3") / 200), white)]
    d = _step(d, **{f"w{i + 1}": F.coalesce(f, F.col(f"v{i + 1}")) for i, f in enumerate(flat)})
    w = [F.col(f"w{i}") for i in (1, 2, 3)]
    cone = [sum((F.lit(float(k)) * v for k, v in zip(row[1:], w[1:])), F.lit(float(row[0])) * w[0]) for row in _LAB_TO_LMS]

    def unbent(v: Column, k: Column) -> Column:
        """A channel made linear by its space's curve; of oklab a cubed cone response."""
        curve = F.when(of("srgb", "display-p3"), _signed(v, lambda a: F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))))
        curve = curve.when(of("a98-rgb"), _signed(v, lambda a: F.pow(a, F.lit(563 / 256)))).when(of("prophoto-rgb"), _signed(v, lambda a: F.when(a <= 16 / 512, a / 16).otherwise(F.pow(a, F.lit(1.8)))))
        curve = curve.when(of("rec2020"), _signed(v, lambda a: F.when(a < 0.018053968510807 * 4.5, a / 4.5).otherwise(F.pow((a + 0.09929682680944) / 1.09929682680944, F.lit(1 / 0.45)))))
        return curve.when(of("oklab"), k * k * k).otherwise(v)

    d = _step(d, **{f"u{i + 1}": unbent(v, k) for i, (v, k) in enumerate(zip(w, cone))})
    u = [F.col(f"u{i}") for i in (1, 2, 3)]
    rows = []
    for i in range(3):
        out = None
        for s, m in LINEAR.items():
            term = sum((F.lit(float(k)) * v for k, v in zip(m[i][1:], u[1:])), F.lit(float(m[i][0])) * u[0])
            out = F.when(of(s), term) if out is None else out.when(of(s), term)
        rows.append(out.otherwise(u[i]))
    d = _step(d, **{f"k{i + 1}": r for i, r in enumerate(rows)})
    k = [F.col(f"k{i}") for i in (1, 2, 3)]
    bent = lambda v: _signed(v, lambda a: F.when(a <= 0.0031308, a * 12.92).otherwise(1.055 * F.pow(a, F.lit(1 / 2.4)) - 0.055))
    lms = [F.cbrt(sum((F.lit(q) * v for q, v in zip(row[1:], k[1:])), F.lit(row[0]) * k[0])) for row in color.TO_LMS]
    d = _step(d, **{f"s{i + 1}": F.when(of("srgb"), w[i]).otherwise(bent(k[i])) for i in range(3)}, **{f"m{i + 1}": m for i, m in enumerate(lms)})
    m = [F.col(f"m{i}") for i in (1, 2, 3)]
    d = _step(d, **{f"o{i + 1}": F.when(of("oklab"), F.col(f"w{i + 1}")).otherwise(F.lit(row[0]) * m[0] + F.lit(row[1]) * m[1] + F.lit(row[2]) * m[2]) for i, row in enumerate(color.TO_LAB)})
    grey = of("srgb") & (F.col("s1") == F.col("s2")) & (F.col("s2") == F.col("s3"))
    chroma = F.when(grey, 0.0).otherwise(F.when(is_("oklch"), y).otherwise(F.hypot("o2", "o3")))
    hue_ = F.when(grey | (chroma == 0), 0.0).when(is_("oklch"), F.pmod(z, F.lit(360.0))).otherwise(F.pmod(F.degrees(F.atan2("o3", "o2")) + 360, F.lit(360.0)))
    whole = [css.whole(F.col(f"s{i}") * 255).cast("int") for i in (1, 2, 3)]
    d = _step(d, r=whole[0], g=whole[1], b=whole[2], l=F.round("o1", 4), c=F.round(chroma, 4), h=F.round(hue_, 2))
    clipped = [F.least(F.greatest(F.col(q), F.lit(0)), F.lit(255)) for q in "rgb"]
    return d.select(F.col("raw").alias(column), color.hex_colour(*clipped).alias("hex"), "r", "g", "b", "alpha", "l", "c", "h")
