"""Expressions over CSS values as strings: numbers, colours, font stacks, lists, shadows and media queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import color

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

# The least lightness of each step, and the hue below which a name holds.
STEPS = [(0.97, 50), (0.93, 100), (0.87, 200), (0.79, 300), (0.70, 400), (0.61, 500), (0.52, 600), (0.42, 700), (0.30, 800), (0, 900)]
HUES = [(15, "red"), (45, "orange"), (75, "amber"), (105, "yellow"), (135, "lime"), (165, "green"), (195, "teal"), (225, "cyan"), (255, "blue"), (285, "indigo"), (315, "violet"), (345, "pink"), (360, "red")]
# The least visible alpha, the distance below which colours are one, and the chroma below which one is grey.
ALPHA, MERGE, GREY = 0.08, 0.008, 0.05
# Names in a font stack that are no family.
GENERIC = ["sans-serif", "serif", "monospace", "cursive", "fantasy", "system-ui", "ui-sans-serif", "ui-serif", "ui-monospace", "ui-rounded", "-apple-system", "blinkmacsystemfont", "inherit", "initial"]


def number(value: Column) -> Column:
    """The number that a string starts with, else null."""
    return F.regexp_extract(value, NUMBER, 1).try_cast("double")


def whole(value: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(value + 0.5)


def rgb(value: Column) -> Column:
    """struct(r, g, b, alpha) of #rgb, #rrggbb, rgb() and rgba(); null for others and for what is hardly visible."""
    three, six = value.rlike("^#[0-9a-fA-F]{3}$"), value.rlike("^#[0-9a-fA-F]{6}$")
    digits = F.when(three, F.regexp_replace(value, "([0-9a-fA-F])", "$1$1")).otherwise(value)
    part = [F.conv(F.substring(digits, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)]
    call = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([0-9.]+)\s*)?\)$"
    arg = [F.regexp_extract(value, call, i + 1).try_cast("int") for i in range(3)]
    alpha = F.coalesce(F.regexp_extract(value, call, 4).try_cast("double"), F.lit(1.0))
    out = F.when(three | six, F.struct(*[p.alias(c) for p, c in zip(part, "rgb")], F.lit(1.0).alias("alpha"))).when(value.rlike(call), F.struct(*[a.alias(c) for a, c in zip(arg, "rgb")], alpha.alias("alpha")))
    return F.when(out["alpha"] >= ALPHA, out)


def oklch(r: Column, g: Column, b: Column) -> list[Column]:
    """Lightness and chroma to 4 places, hue in degrees to 2; a grey has neither chroma nor hue."""
    l, x, y = color.oklab(r, g, b)
    grey = (r == g) & (g == b)
    hue = F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))
    return [F.round(l, 4), F.when(grey, F.lit(0.0)).otherwise(F.round(F.hypot(x, y), 4)), F.when(grey, F.lit(0.0)).otherwise(F.round(hue, 2))]


def distance(one: list[Column], other: list[Column]) -> Column:
    """Of two colours as lightness, chroma and hue, in OKLab."""
    flat = lambda x: (x[0], x[1] * F.cos(F.radians(x[2])), x[1] * F.sin(F.radians(x[2])))
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(flat(one), flat(other))), F.lit(0.0)))


def colour_name(l: Column, c: Column, h: Column) -> Column:
    """Hue or neutral, and the step of lightness; each value stands once in the expression."""
    first = lambda rows, fits: F.get(F.filter(F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(str(n)).alias("n")) for at, n in rows]), fits), 0)["n"]
    step = F.coalesce(first(STEPS, lambda s: l >= s["at"]), F.lit("950"))
    hue = F.coalesce(first(HUES, lambda s: h < s["at"]), F.lit("red"))
    return F.concat(F.when(c < GREY, F.lit("neutral")).otherwise(hue), F.lit("-"), step)


def primary_family(stack: Column) -> Column:
    """The first family of a stack that is not generic, else its first entry."""
    names = F.transform(F.split(stack, ","), lambda p: F.regexp_replace(F.trim(p), "^[\"']|[\"']$", ""))
    own = F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*GENERIC))
    return F.coalesce(F.get(own, 0), F.get(names, 0), F.lit(""))


def line_height(value: Column, size: Column) -> Column:
    """As a ratio of the font size, 3 places; 1.2 where it is normal or unknown."""
    px = number(value)
    return F.when((F.coalesce(value, F.lit("")) == "") | (value == "normal") | px.isNull() | (size <= 0), F.lit(1.2)).otherwise(F.round(px / size, 3))


def split_list(value: Column) -> Column:
    """Entries between commas that stand in no parentheses (of one level)."""
    parts = F.regexp_extract_all(value, F.lit(r"((?:[^,(]|\([^)]*\))+)"), 1)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def blur(shadow: Column) -> Column:
    lengths = F.regexp_extract_all(shadow, F.lit(r"(-?\d+(?:\.\d+)?)px"), 1)
    return F.coalesce(F.get(lengths, 2), F.get(lengths, 1), F.lit("0")).cast("double")


def media_widths(query: Column) -> Column:
    """Widths in px that a media query names; one pixel more if max-width stands anywhere in it; 240 to 2560 only."""
    pattern = r"\((?:min|max)-width:\s*([\d.]+)(px|em|rem)\)"
    both = F.arrays_zip(F.regexp_extract_all(query, F.lit(pattern), 1).alias("v"), F.regexp_extract_all(query, F.lit(pattern), 2).alias("u"))
    px = F.transform(both, lambda m: whole(m["v"].try_cast("double") * F.when(m["u"] == "px", 1).otherwise(16)) + F.when(query.contains("max-width"), 1).otherwise(0))
    return F.filter(px, lambda v: v.between(240, 2560))


def spacing_key(px: Column, base: Column) -> Column:
    """A step's name: quarters of rem where the base divides it, else its size."""
    quarter = px / 4
    text = F.when(px % 4 == 0, quarter.cast("long").cast("string")).otherwise(F.regexp_replace(quarter.cast("string"), r"\.", "_"))
    return F.when(px % base == 0, text).otherwise(F.concat(F.lit("px-"), px.cast("string")))


def padding(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """The shortest shorthand of four sides."""
    return F.when((top == bottom) & (left == right), F.when(top == left, top).otherwise(F.concat_ws(" ", top, right))).otherwise(F.concat_ws(" ", top, right, bottom, left))


def google_families(url: Column) -> Column:
    """Families that a stylesheet address of that font service asks for."""
    found = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]family=([^&#]*)"), 1), lambda v: F.trim(F.regexp_replace(F.split_part(v, F.lit(":"), F.lit(1)), r"\+|%20", " ")))
    return F.when(url.contains("fonts.googleapis.com"), found).otherwise(F.array().cast("array<string>"))
