"""Selectors and visibility of random pages against plain walks over the same elements."""

import random
import re

import pytest

from designlake.operators import selectors, visible

COLUMNS = "page_id long, i long, parent long, depth long, n_descendants long, tag string, id string, cls string, w int, h int, area long, display string, visibility string, opacity string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def page(rng, p, size):
    out = [{"parent": None, "depth": 1, "tag": "body" if p % 3 else "div"}]
    open_ = [0]
    while len(out) < size:
        # the next element goes below one of the open ones, so that parents stay in document order
        del open_[max(1, len(open_) - rng.choice([0, 0, 1, 2, 2, 6])) :]
        up = open_[-1]
        out.append({"parent": up, "depth": out[up]["depth"] + 1, "tag": rng.choice(["div", "p", "a", "svg", "body"] if rng.random() < 0.1 else ["div", "p", "a"])})
        open_.append(len(out) - 1)
    for i, e in enumerate(out):
        w, h = rng.choice([0, 10, 10, 20]), rng.choice([10, 10, 30])
        e |= {"page_id": p, "i": i, "id": rng.choice(["", "", "", "one", "two", f"x{i}", "9x", f"a b{i}", "ok\n"]), "cls": rng.choice(["", "card", " card  big ", "big", "card-x"]), "w": w, "h": h, "area": w * h}
        e |= {"display": rng.choice(["block"] * 12 + ["none", None]), "visibility": rng.choice(["visible"] * 12 + ["hidden"]), "opacity": rng.choice(["1", "1", "0.5", "", None, "1", "1", "1", "1", "0", "0.0"])}
    for e in reversed(out):
        e["n_descendants"] = sum(1 + k["n_descendants"] for k in out if k["parent"] == e["i"])
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    plain = {p: page(rng, p, rng.choice([1, 2, 30, 60, 90])) for p in range(24)}
    return plain, spark.createDataFrame([tuple(e[c] for c in NAMES) for t in plain.values() for e in t], COLUMNS).repartition(5).cache()


def selector(t, e):
    if re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", e["id"]) and sum(k["id"] == e["id"] for k in t) == 1:
        return "#" + e["id"]
    parts = []
    while e is not None and len(parts) < 8:
        like = [k["i"] for k in t if k["parent"] == e["parent"] and k["tag"] == e["tag"]]
        parts.insert(0, e["tag"] if len(like) == 1 or e["tag"] == "body" else f"{e['tag']}:nth-of-type({1 + like.index(e['i'])})")
        if e["tag"] == "body" or e["parent"] is None:
            break
        e = t[e["parent"]]
    return " > ".join(parts)


def test_stable_selectors_and_lookup(spark, pages):
    plain, n = pages
    got = {(r.page_id, r.i): r.selector for r in selectors.stable(n).collect()}
    want = {(p, e["i"]): selector(t, e) for p, t in plain.items() for e in t}
    assert got == want
    assert any(s.startswith("#") for s in want.values()) and any(s.count(">") == 7 for s in want.values()) and any(s.startswith("body >") for s in want.values())
    asks = ["#one", "#x3", " #two\t", ".card", ".big", ".card-x", ".nothing", "p", "", None, "#a b1", "body", "body > div", "#one"] + sorted(set(want.values()))[:60]
    asked = spark.createDataFrame([(p, a, k) for p in [*plain, 99] for k, a in enumerate(asks)], "page_id long, selector string, ask long")
    keyed = n.join(selectors.stable(n), ["page_id", "i"])
    found = {(r.page_id, r.ask): r.i for r in selectors.find(asked, keyed).collect()}
    assert len(found) == 25 * len(asks)

    def lookup(p, asked):
        t, a = plain.get(p, []), (asked or "").strip()
        for e in t:
            if a and want[p, e["i"]] == a:
                return e["i"]
        if a[:1] == "#":
            return next((e["i"] for e in t if e["id"] == a[1:]), -1)
        fits = [e for e in t if a[:1] == "." and a[1:] in re.split(r"\s+", e["cls"])]
        return max(fits, key=lambda e: (e["area"], -e["i"]))["i"] if fits else -1

    for (p, k), i in found.items():
        assert i == lookup(p, asks[k]), (p, asks[k])


def test_scoped_subtrees_may_overlap(spark, pages):
    plain, n = pages
    rows = [(p, f"s{k}", min(k, len(t) - 1)) for p, t in plain.items() for k in (0, 1, 1, 5, 40)] + [(p, "none", -1) for p in plain]
    got = sorted(map(tuple, selectors.scoped(n, spark.createDataFrame(rows, "page_id long, selector string, i long")).collect()))
    want = []
    for p, s, i in set(rows):
        for e in plain[p][i : i + 1 + plain[p][i]["n_descendants"]] if i >= 0 else []:
            want.append((p, s, e["i"] - i, -1 if e["i"] == i else e["parent"] - i, e["tag"], e["depth"] - plain[p][i]["depth"], e["i"]))
    assert got == sorted(want)


def seen(t, most):
    out, cut = [], [False]

    def zero(x):
        return x is not None and re.match(r"\s*0+(\.0*)?$", x)

    def visit(e, up):
        if len(out) >= most:
            cut[0] = True
            return
        kids = [k for k in t if k["parent"] == e["i"]]
        if e["display"] == "none" or e["visibility"] == "hidden" or zero(e["opacity"]) or e["area"] == 0 and not kids:
            return
        me = len(out)
        out.append([me, up, e["i"]])
        if e["tag"] != "svg":
            for k in kids:
                visit(k, me)

    visit(t[0], None)
    return [(*x, cut[0]) for x in out]


@pytest.mark.parametrize("most", [1, 7, 25, 3000])
def test_rendered_as_a_walk(spark, pages, most):
    plain, n = pages
    got = {}
    for r in visible.rendered(n, most).orderBy("page_id", "i").collect():
        got.setdefault(r.page_id, []).append(r)
    for p, t in plain.items():
        want, mine = seen(t, most), got.get(p, [])
        assert [(r.i, r.parent, r.was, r.truncated) for r in mine] == want, p
        for r in mine:
            below = {r.i}
            for k in mine:
                if k.parent in below:
                    below.add(k.i)
            assert r.n_descendants == len(below) - 1
    if most == 25:
        assert any(r[0].truncated for r in got.values()) and any(not r[0].truncated for r in got.values())


def test_empty_tables(spark, pages):
    none = pages[1].where("false")
    keyed = none.withColumn("selector", selectors.F.lit(""))
    assert selectors.stable(none).count() == 0 and visible.rendered(none).count() == 0
    asked = spark.createDataFrame([(1, "#a", "x")], "page_id long, selector string, note string")
    assert [(r.i, r.note) for r in selectors.find(asked, keyed).collect()] == [(-1, "x")]
    assert selectors.scoped(none, selectors.find(asked, keyed)).count() == 0
