"""Expressions over plain text: placeholders, names, escapes and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of placeholder text, and the constants of FNV-1a with 32 bits.
WORDS = ["build", "launch", "scale", "modern", "teams", "platform", "workflow", "faster", "simple", "powerful", "connect", "design", "ship", "product", "growth", "data", "secure", "flexible", "insight", "system", "craft", "signal", "clarity", "momentum"]
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF
# Reasons of failed requests, and the statuses where a browser may still see the page.
REASONS = {401: "requires sign-in", 403: "refused the request", 404: "has no page at that address", 429: "is rate-limiting requests", 451: "is blocked for legal reasons"}
ADVICE = (401, 403, 429)


def seed(text: Column) -> Column:
    """FNV-1a over the characters, as a signed 32-bit number without its sign."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * FNV_PRIME).bitwiseAND(F.lit(MASK))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_START).cast("long"), step)
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def placeholder(text: Column) -> Column:
    """Other words in the shape of a text: as many, with their capitals and the signs at their ends.

    Words and the blanks between them are numbered together; entries without a letter stay.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), 1)
    # a text that starts with a blank has an empty word before it
    lead = F.when(text.rlike(r"^\s"), 1).otherwise(0)
    s = seed(text)

    def swapped(p: Column, i: Column) -> Column:
        word = F.get(F.array(*[F.lit(w) for w in WORDS]), F.pmod(s + (i + lead) * 7, F.lit(len(WORDS))).cast("int"))
        word = F.when(p.rlike("^[A-Z]"), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))).otherwise(word)
        return F.when(p.rlike("[A-Za-z]"), F.concat(word, F.regexp_extract(p, r"([^A-Za-z0-9]*)$", 1))).otherwise(p)

    return F.when(F.trim(text) == "", text).otherwise(F.array_join(F.transform(parts, swapped), ""))


def looks_like_url(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"(?i)^https?://") | t.rlike(r"(?i)^[^\s/]+\.[a-z]{2,63}(/.*)?$")


def host_label(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9-]", "")


def html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cell(text: Column) -> Column:
    """A cell of a markdown table."""
    t = F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\n+", " ")
    return F.when(F.coalesce(t, F.lit("")) == "", "—").otherwise(t)


def pascal(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(text, r"[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")


def http_failure(status: Column, url: Column) -> Column:
    """Why a status leaves nothing to measure; null below 400."""
    reason = F.coalesce(*[F.when(status == k, v) for k, v in REASONS.items()], F.when(status >= 500, "returned a server error"), F.lit("refused the request"))
    tail = F.when(status.isin(*ADVICE), ' The page may load normally in your own browser — use "Run it in your own browser" to measure it there.').otherwise("")
    return F.when(status >= 400, F.concat(url, F.lit(" "), reason, F.lit(" (HTTP "), status.cast("string"), F.lit("). There is nothing to extract: any design system reported would describe the error page."), tail))
