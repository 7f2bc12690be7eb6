"""Scalar functions on text: blank values, normal forms, domains, rounding. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as no value, after trimming and lower-casing.
BLANK_TOKENS = ["", "null", "none", "n/a", "unknown", "-"]
#: What extracted values are blank by, besides those.
EXTRACTION_BLANK_TOKENS = [*BLANK_TOKENS, "not specified", "not stated"]
#: Domains that are not fetched, matched as suffixes without a dot before them.
BLOCKED_DOMAINS = ["facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com"]
#: Ends of addresses of files that are not pages.
BINARY_SUFFIXES = [".pdf", ".docx", ".xlsx", ".zip"]
#: Editorially maintained sources, matched anywhere in a domain.
TRUSTED_DOMAINS = [
    "wikipedia.org", "britannica.com", "crunchbase.com", "github.com", "michelin.com", "yelp.com", "tripadvisor.com",
    "eater.com", "bostonmagazine.com", "timeout.com", "opentable.com", "resy.com", ".gov", ".edu",
]

_SPACE = r"\s\x1c-\x1f"


def trim_unicode(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def has_value(c: Column, tokens: list[str] = BLANK_TOKENS) -> Column:
    """False for null and for blank tokens."""
    return F.coalesce(~F.lower(trim_unicode(c)).isin(tokens), F.lit(False))


def name_norm(c: Column) -> Column:
    """Lower-case ASCII letters and digits; empty for names without any."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def value_norm(c: Column) -> Column:
    """Lower-case letters, digits and inner white space of any script."""
    return trim_unicode(F.regexp_replace(F.lower(c), rf"(?U)[^\p{{L}}\p{{N}}{_SPACE}]", ""))


def domain(url: Column) -> Column:
    """Network location with port and user, in its own case, without any `www.`; empty if there is none."""
    return F.replace(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("www."), F.lit(""))


def is_blocked(url: Column) -> Column:
    return F.exists(F.array(*map(F.lit, BLOCKED_DOMAINS)), lambda d: F.endswith(domain(url), d))


def is_binary(url: Column) -> Column:
    """By the end of the whole lower-cased address, so a query string hides it."""
    return F.exists(F.array(*map(F.lit, BINARY_SUFFIXES)), lambda s: F.endswith(F.lower(url), s))


def is_trusted(url: Column) -> Column:
    return F.exists(F.array(*map(F.lit, TRUSTED_DOMAINS)), lambda d: F.contains(F.lower(domain(url)), d))


def round_exact(c: Column, places: int = 2) -> Column:
    """Rounds the exact binary value, halves to even, as decimal printing does; round() works on a shortest decimal."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit("")).cast("double")


def strip_fences(c: Column) -> Column:
    """Without a Markdown code fence around it."""
    return trim_unicode(F.regexp_replace(F.regexp_replace(trim_unicode(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def redirect_target(href: Column) -> Column:
    """The address inside a search engine's redirect, an http address as it is, else empty; `+` stays."""
    inner = F.regexp_extract(href, r"uddg=([^&]+)", 1)
    decoded = F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return F.when(inner != "", decoded).when(F.startswith(href, F.lit("http")), href).otherwise(F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """In doubles, and divided by both norms; null where a norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
