"""Colours of pages: observations by property, clusters around leaders, and roles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css, notations
from ..sources.scratch import written

LCH = ("l", "c", "h")
# Roles in their order, and the most colours of a palette.
ROLES, MOST_TOKENS = ("background", "surface", "foreground", "muted", "primary", "accent", "border"), 24
# What has colours, by the place of its use in an element, and the parts of a pixel that areas are counted in.
PROPERTIES = ("color", "background-color", "border-color", "border-color", "gradient-stop", "box-shadow", "fill", "stroke")
UNIT = 1_000_000


def interactive(tag: Column, role: Column, classes: Column) -> Column:
    return tag.isin("button", "a") | F.coalesce(role.isin("button", "link"), F.lit(False)) | F.coalesce(classes.rlike(r"(?i)\b(btn|button|cta)\b"), F.lit(False))


def _sources(df: DataFrame, by: list[str]) -> DataFrame:
    """by, at, k (its place in PROPERTIES), raw, units, on_interactive: each string of an element that has colours, with what
    a colour in it covers in millionths, and the place of its first one. See uses."""
    number = lambda c: F.coalesce(css.number(F.col(c)), F.lit(0.0))
    size = F.coalesce(F.nullif(number("font_size"), F.lit(0.0)), F.lit(16.0))
    # what is read from strings stands in columns before it is used more than once
    rest = ["text_len", "width", "height", "color", "background", "border_color", "border_bottom_color", "image", "shadow", "is_svg", "fill", "stroke"]
    d = df.select(*by, "ord", F.col("area").cast("double").alias("area"), *rest, size.alias("size"), number("border_width").alias("top"), number("border_bottom_width").alias("bottom"), interactive(F.col("tag"), F.col("role"), F.col("cls")).alias("on"))
    area, on, no = F.col("area"), F.col("on"), F.lit(False)
    glyphs = F.col("text_len") * F.col("size") * 0.5
    seen = [
        (F.when(F.col("text_len") > 0, F.col("color")), F.least(glyphs, F.when(area > 0, area).otherwise(glyphs)), on),
        (F.col("background"), area, on),
        (F.when(F.col("top") > 0, F.col("border_color")), (F.col("width") + F.col("height")) * 2.0 * F.col("top"), no),
        (F.when(F.col("bottom") > 0, F.col("border_bottom_color")), F.col("width") * 2.0 * F.col("bottom"), no),
        (F.col("image"), area * 0.3, no),
        (F.col("shadow"), area * 0.05, no),
        (F.when(F.col("is_svg"), F.col("fill")), area, on),
        (F.when(F.col("is_svg"), F.col("stroke")), area, on),
    ]
    rows = [c for k, (raw, size_, on_) in enumerate(seen) for c in (F.lit(k), raw, size_.cast("double"), on_)]
    each = d.select(*by, "ord", F.stack(F.lit(len(seen)), *rows).alias("k", "raw", "area", "on_interactive")).where("area > 0 and raw <> ''")
    return each.select(*by, (F.col("ord") * 8192 + F.col("k") * 1024).alias("at"), "k", "raw", F.rint(F.col("area") * UNIT).cast("long").alias("units"), "on_interactive")


def _property(k: str) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PROPERTIES]), F.col(k) + 1)


def _colours(sources: DataFrame, *columns) -> DataFrame:
    """columns of sources, property, j and raw: each colour in a string, and its place there."""
    found = F.regexp_extract_all("raw", F.lit(notations.ANY), 0)
    raws = F.when(F.col("k") == PROPERTIES.index("gradient-stop"), found).when(F.col("k") == PROPERTIES.index("box-shadow"), F.slice(found, 1, 1)).otherwise(F.array("raw"))
    d = sources.select(*columns, _property("k").alias("property"), F.posexplode(raws).alias("j", "raw")).where("raw <> ''")
    return d.withColumn("j", F.least("j", F.lit(1023)))


def uses(df: DataFrame, by: list[str]) -> DataFrame:
    """by, ord, property, raw, area, on_interactive: each colour string of each element with what it covers.

    Text covers its glyphs (half the font size a character) but not more than its element, a background the element,
    borders their length and width by side, each stop of a gradient a part, a shadow's first colour a little, fill and
    stroke of a drawing the element. df has ord, tag, role, cls, area, width, height, text_len, font_size, color,
    background, border_color, border_width, border_bottom_color, border_bottom_width, image, shadow, is_svg, fill, stroke.
    """
    each = _colours(_sources(df, by), *by, "at", "units", "on_interactive")
    return each.select(*by, (F.col("at") + F.col("j")).alias("ord"), "property", "raw", (F.col("units") / UNIT).alias("area"), "on_interactive")


def observations(df: DataFrame, by: list[str]) -> DataFrame:
    """by, property, raw, on_interactive, n, area, largest, first, hex, alpha, l, c, h: the visible colours of each group.

    Equal strings of a group and property are added up before any is read, gradients and shadows as a whole, and each
    distinct colour is read once: n uses cover area, the largest of them `largest`, which `first` is the first place of.
    Areas have six places, places are below 10 ** 16; both make one number, whose greatest a hash aggregate can keep.
    """
    place, most = F.lit(10**16).cast("decimal(17,0)"), F.lit(10**16 - 1)
    key = F.col("units").cast("decimal(20,0)") * place + (most - F.col("at")).cast("decimal(17,0)")
    whole = _sources(df, by).groupBy(*by, "k", "raw", "on_interactive").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.max(key).alias("top"))
    each = _colours(whole, *by, "on_interactive", "n", "units", "top").withColumn("top", F.col("top") - F.col("j"))
    g = written(each.groupBy(*by, "property", "raw", "on_interactive").agg(F.sum("n").alias("n"), F.sum("units").alias("units"), F.max("top").alias("top")), "colours")
    # a table of files, so that its size is known before the join
    look = written(notations.parsed(g, "raw").select("raw", "hex", "alpha", *LCH), "look")
    g = g.select(*by, "property", "raw", "on_interactive", "n", (F.col("units") / UNIT).alias("area"), (F.floor(F.col("top") / place).cast("double") / UNIT).alias("largest"), (most - (F.col("top") % place).cast("long")).alias("first"))
    return g.join(look, "raw")


def _by_group(df: DataFrame, by: list[str], order: list, solve, schema: str) -> DataFrame:
    """solve for the rows of each group, in order, with what it gives under schema.

    solve takes the columns of several whole groups as arrays, and where each group begins and ends. A group is held
    whole, groups come one after another, and no table is made for each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = []

        def solved(p: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
            return solve({c: p[c].to_numpy() for c in p.columns}, first, np.r_[first[1:], len(p)])

        def begins(p: pd.DataFrame) -> np.ndarray:
            new = np.zeros(len(p), bool)
            new[0] = True
            for c in by:
                x, none = p[c].to_numpy(), p[c].isna().to_numpy()
                new[1:] |= (x[1:] != x[:-1]) & ~(none[1:] & none[:-1])
            return np.flatnonzero(new)

        for p in parts:
            if not len(p):
                continue
            if rest and len(begins(pd.concat([rest[-1].tail(1), p.head(1)]))) + len(begins(p)) == 2:
                rest.append(p)  # a group that fills this batch too
                continue
            p = pd.concat([*rest, p], ignore_index=True)
            first = begins(p)
            if len(first) > 1:
                yield solved(p[: first[-1]], first[:-1])
            rest = [p[first[-1] :].reset_index(drop=True)]
        if rest:
            yield solved(pd.concat(rest, ignore_index=True), np.array([0]))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def _flat(l: np.ndarray, c: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.stack([l, c * np.cos(np.radians(h)), c * np.sin(np.radians(h))], axis=-1)


def clusters(seen: DataFrame, by: list[str]) -> DataFrame:
    """seen's by, property, on_interactive, n and area with leader, l0, c0, h0, born: the first colour of the group, from
    the largest use on, within MERGE of it (its hex, lightness, chroma and hue), and that colour's place among the leaders.

    Equal colours always share a leader, as a later leader never comes before an earlier one.
    """
    kept = ["property", "on_interactive", "n", "area"]

    def lead(p: dict[str, np.ndarray], first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        x, y, z = np.ascontiguousarray(_flat(*(p[c] for c in LCH)).T)
        at, born = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for i, j in zip(first.tolist(), end.tolist()):
            # each leader takes what is near it of what earlier ones left
            free, n = np.arange(i, j), 0
            while len(free):
                k = free[0]
                near = np.sqrt((x[free] - x[k]) ** 2 + (y[free] - y[k]) ** 2 + (z[free] - z[k]) ** 2) < css.MERGE
                at[free[near]], born[free[near]] = k, n
                free, n = free[~near], n + 1
        return pd.DataFrame({**{c: p[c] for c in (*by, *kept)}, "leader": p["rgb"][at], **{f"{c}0": p[c][at] for c in LCH}, "born": born})

    # strings stay behind: properties by their place, colours as numbers
    code = F.coalesce(*[F.when(F.col("property") == q, k) for k, q in enumerate(PROPERTIES)]).cast("int").alias("property")
    t = seen.select(*by, code, *kept[1:], F.conv(F.substring("hex", 2, 6), 16, 10).cast("int").alias("rgb"), *LCH, "largest", "first")
    out = _by_group(t, by, [F.desc("largest"), "first"], lead, f"{_kinds(t, [*by, *kept])}, leader int, l0 double, c0 double, h0 double, born long")
    return out.withColumns({"property": _property("property"), "leader": F.concat(F.lit("#"), F.lower(F.lpad(F.hex("leader"), 6, "0")))})


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def palette(seen: DataFrame, by: list[str]) -> DataFrame:
    """by, hex, l, c, h, name, area, n, background_area, text_area, border_area, interactive_area, properties, rank of each
    cluster: by area, of equal ones the earlier leader."""
    of = clusters(seen, by)
    part = lambda p: F.sum(F.when(F.col("property") == p, F.col("area")).otherwise(0.0))
    t = of.groupBy(*by, "born", F.col("leader").alias("hex"), *[F.col(f"{c}0").alias(c) for c in LCH]).agg(F.sum("area").alias("area"), F.sum("n").alias("n"), part("background-color").alias("background_area"), part("color").alias("text_area"), part("border-color").alias("border_area"), F.sum(F.when(F.col("on_interactive"), F.col("area")).otherwise(0.0)).alias("interactive_area"), F.array_join(F.sort_array(F.collect_set("property")), ",").alias("properties"))
    t = t.withColumn("name", css.colour_name(*[F.col(c) for c in LCH]))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("area", 6)), "born"))).drop("born")


def body_colours(df: DataFrame, by: list[str]) -> DataFrame:
    """by, body_l, body_c, body_h of the text colour of each group's first body element, where it is visible."""
    b = df.where("tag = 'body'").groupBy(*by).agg(F.min(F.struct("ord", "color"))["color"].alias("raw"))
    return b.join(notations.parsed(b, "raw"), "raw").select(*by, *[F.col(c).alias(f"body_{c}") for c in LCH])


def roles(colours: DataFrame, by: list[str], body: DataFrame | None = None) -> DataFrame:
    """by, role, hex, is_dark: background, surface, foreground, muted, primary, accent and border of each group, and whether
    its background is dark.

    Each role is the first colour in its order; later ones look at what earlier ones took. The foreground is the cluster
    of body's colour where there is one. A group's colours are few (clusters of one page), and one page is one group.
    """
    if body is None:
        body = colours.select(*by).limit(0).select(*by, *[F.lit(None).cast("double").alias(f"body_{c}") for c in LCH])
    colours = colours.join(body, by, "left")

    def pick(p: dict[str, np.ndarray], first: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        every, of, role, dark = _flat(*(p[c] for c in LCH)), [], [], []
        bodies = _flat(*(p[f"body_{c}"] for c in LCH))
        for i, j in zip(first.tolist(), end.tolist()):
            given = _given({c: p[c][i:j] for c in ("l", "c", "area", "background_area", "text_area", "border_area", "interactive_area")}, every[i:j], bodies[i])
            of += [i + k for k in given.values()]
            role += given
            dark += [bool("background" in given and p["l"][i + given["background"]] < 0.5)] * len(given)
        return pd.DataFrame({**{c: p[c][of] for c in by}, "role": role, "hex": p["hex"][of], "is_dark": dark})

    t = colours.select(*by, "rank", "hex", *LCH, "area", "background_area", "text_area", "border_area", "interactive_area", *[f"body_{c}" for c in LCH])
    return _by_group(t, by, ["rank"], pick, f"{_kinds(colours, by)}, role string, hex string, is_dark boolean")


def _given(p: dict[str, np.ndarray], lab: np.ndarray, body: np.ndarray) -> dict[str, int]:
    """The places of a group's colours by role; p and lab are in the order of rank."""
    far = lambda i: np.sqrt(((lab - lab[i]) ** 2).sum(axis=1))
    ranked = lambda c: (o := np.argsort(-p[c], kind="stable"))[p[c][o] > 0]
    grounds, texts, borders = ranked("background_area"), ranked("text_area"), ranked("border_area")
    out: dict[str, int] = {}

    def assign(role: str, *options: np.ndarray) -> int | None:
        i = next((int(o[0]) for o in options if len(o)), None)
        if i is not None:
            out[role] = i
        return i

    free = lambda x: x[~np.isin(x, list(out.values()))]
    grey = lambda x: x[p["c"][x] < css.GREY]
    ground = assign("background", grounds)
    apart = grounds if ground is None else grounds[(grounds != ground) & (far(ground)[grounds] > css.MERGE * 1.5)]
    assign("surface", grey(apart), apart)
    of_body = np.flatnonzero(np.sqrt(((lab - body) ** 2).sum(axis=1)) < css.MERGE)  # none where body has no colour
    front = assign("foreground", of_body, texts)
    if ground is not None and front is not None:
        lo, hi = sorted((p["l"][ground], p["l"][front]))
        between = texts[(texts != front) & (lo + 0.05 < p["l"][texts]) & (p["l"][texts] < hi - 0.05)]
        assign("muted", grey(between), between)
    bright = np.flatnonzero(p["c"] >= css.GREY)
    used = bright[np.argsort(-p["interactive_area"][bright], kind="stable")]
    main = assign("primary", used if len(used) and p["interactive_area"][used[0]] > 0 else bright[np.argsort(-p["c"][bright] * p["area"][bright], kind="stable")])
    left = free(bright)
    assign("accent", left if main is None else left[far(main)[left] > 0.12])
    assign("border", free(borders), borders)
    return out


def tokens(colours: DataFrame, given: DataFrame, by: list[str], most: int = MOST_TOKENS) -> DataFrame:
    """by, rank, name, hex, area, n, roles, properties: the first clusters of each group. A name is the first role that the
    colour has, else the colour's own; roles are in the order of ROLES, `neutral` for none."""
    order = F.array(*[F.lit(r) for r in ROLES])
    has = given.groupBy(*by, "hex").agg(F.collect_set("role").alias("has"))
    t = colours.where(F.col("rank") <= most).join(has, [*by, "hex"], "left")
    mine = F.filter(order, lambda r: F.array_contains("has", r))
    return t.select(*by, "rank", F.coalesce(F.get(mine, F.lit(0)), "name").alias("name"), "hex", F.floor(F.round("area", 6) + 0.5).alias("area"), "n", F.coalesce(F.nullif(F.array_join(mine, ","), F.lit("")), F.lit("neutral")).alias("roles"), "properties")


def dark_roles(light: DataFrame, dark: DataFrame, by: list[str]) -> DataFrame:
    """by, role, light, dark: roles of a group's second capture beside the first's, of groups whose background changes;
    a page that looks the same in both has no dark palette."""
    ground = lambda d, n: d.where("role = 'background'").select(*by, F.col("hex").alias(n))
    changed = ground(dark, "d").join(ground(light, "l"), by, "left").where(~F.col("d").eqNullSafe(F.col("l"))).select(*by)
    d, l = dark.select(*by, "role", F.col("hex").alias("dark")), light.select(*by, "role", F.col("hex").alias("light"))
    return d.join(l, [*by, "role"], "full").join(changed, by, "left_semi").select(*by, "role", "light", "dark")
