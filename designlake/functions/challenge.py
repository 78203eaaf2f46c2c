"""Whether a page is an interstitial that a bot protection has put in the place of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of such pages, the first one counts; and how protections give themselves away.
PHRASES = [
    "verify you are human",
    "checking your browser",
    "just a moment",
    "performing security verification",
    "attention required",
    "ddos protection by",
    "enable javascript and cookies to continue",
    "please verify you are a human",
    "access denied",
    "why have i been blocked",
    "request blocked",
    "unusual traffic from your computer",
    "are you a robot",
]
VENDORS = [
    ("cloudflare|cf-ray|ray id", "Cloudflare"),
    (r"akamai|reference #\d", "Akamai"),
    ("perimeterx|px-captcha", "PerimeterX"),
    ("datadome", "DataDome"),
    ("imperva|incapsula", "Imperva"),
    ("hcaptcha", "hCaptcha"),
    ("recaptcha", "reCAPTCHA"),
]
# The name where no protection is known, and the elements from which on a page is a real one that only
# mentions a phrase.
OTHER = "a bot-protection service"
ELEMENTS = 60

UNSEEN = r"(?is)<!--.*?-->|<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<[^>]*>"


def visible_text(html: Column) -> Column:
    """Text outside of tags, styles and scripts, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), r"[ \t\r\n]+", " "))


def evidence(text: Column, n_elements: Column) -> Column:
    """The first phrase in the text (title included) of a small page, else null."""
    low = F.lower(text)
    return F.when(n_elements < ELEMENTS, F.coalesce(*[F.when(F.contains(low, F.lit(p)), p) for p in PHRASES]))


def vendor(text: Column, url: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", text, url))
    return F.coalesce(*[F.when(hay.rlike(r), v) for r, v in VENDORS], F.lit(OTHER))
