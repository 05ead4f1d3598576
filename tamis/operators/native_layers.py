"""Detector layers as column expressions: text -> array of raw findings. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.spans import spans, values, window

RAW = "array<struct<raw_type:string,value:string,confidence:double>>"

# The patterns and windows of the layers.
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+1[-.\s]?)?(?:\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}|\b\d{3}[-.\s]\d{3}[-.\s]\d{4})\b"
PHONE_BARE = r"\b\d{10}\b"
PHONE_KEYWORDS = ("phone", "telephone", "tel", "mobile", "cell", "phane", "fone", "call", "fax")
DATE = r"\b(?:(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2})\b"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
URL = r"https?://[^\s<>\"']+"
PASSPORT_CA, PASSPORT_GENERIC = r"\b[A-Z]{2}\s?\d{6}\b", r"\b\d{9}\b"
UCI = (r"(?<![\d-])\d{2}-\d{4}-\d{4}(?![\d-])", r"(?<![\d-])\d{4}-\d{4}(?![\d-])", r"(?<!\d)\d{10}(?!\d)", r"(?<!\d)\d{8}(?!\d)")
UCI_CONTEXT = r"(?iU)\b(?:uci|client\s+id|client\s+identification\s+number)\b"
STATUS = r"(?<!\d)\d{10}(?!\d)"
STATUS_CONTEXT = r"(?iU)\b(?:certificate\s+of\s+indian\s+status|secure\s+certificate\s+of\s+indian\s+status|status\s+card|scis|registration\s+number|registry\s+number|indian\s+register)\b"

#: Credential formats, from their issuers' public documents: raw type, pattern, confidence. Group 1 is the value.
SECRETS = (
    ("aws_access_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 0.95),
    ("aws_secret_key", r"(?i:aws.{0,20}?secret.{0,20}?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])", 0.95),
    ("github_token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", 0.95),
    ("google_api_key", r"\b(AIza[0-9A-Za-z_-]{35})", 0.95),
    ("stripe_key", r"\b([sr]k_(?:live|test)_[0-9A-Za-z]{16,})\b", 0.95),
    ("slack_token", r"\b(xox[abprs]-[0-9A-Za-z-]{10,})", 0.95),
    ("private_key", r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", 0.95),
    ("jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0.95),
    ("access_token", r"(?i:\b(?:access_?)?token)[\"']?\s*[:=]\s*[\"']([0-9A-Za-z_\-]{20,})[\"']", 0.85),
    ("api_key", r"(?i:\bapi[_-]?key)[\"']?\s*[:=]\s*[\"']([0-9A-Za-z_\-]{16,})[\"']", 0.85),
    ("secret", r"(?i:\b(?:client_)?secret)[\"']?\s*[:=]\s*[\"']([^\s\"']{8,})[\"']", 0.80),
    ("password", r"(?i:\b(?:password|passwd|pwd))[\"']?\s*[:=]\s*[\"']([^\s\"']{4,})[\"']", 0.80),
    ("uri_password", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s@/]+)@", 0.90),
)


def raw(raw_type: Column | str, value: Column, confidence: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(raw_type).alias("raw_type"), value.alias("value"), lit(confidence).cast("double").alias("confidence"))


def each(found: Column, raw_type: str, confidence: float) -> Column:
    return F.transform(found, lambda v: raw(raw_type, v, confidence))


def near(text: Column, span: Column, width: int, words: tuple[str, ...]) -> Column:
    """Whether one of `words` stands in the window, as a part of it."""
    low = F.lower(window(text, span, width))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def hinted(text: Column, hint: str, found: Column) -> Column:
    """found where the text has what all its matches hold, a short pattern that is quickly looked for."""
    return F.when(text.rlike(hint), found).otherwise(F.expr(f"cast(array() as {RAW})"))


def emails(text: Column) -> Column:
    return hinted(text, "@", each(values(text, EMAIL), "email", 0.95))


def phones(text: Column) -> Column:
    bare = F.filter(spans(text, PHONE_BARE), lambda s: near(text, s, 30, PHONE_KEYWORDS))
    return F.concat(
        hinted(text, r"\p{Nd}[-.\s\x85\p{Z})]\p{Nd}|\)[-.\s\x85\p{Z}]\p{Nd}", each(values(text, PHONE), "phone", 0.95)),
        hinted(text, r"\p{Nd}{10}", each(F.transform(bare, lambda s: s["value"]), "phone", 0.95)),
    )


def dates(text: Column) -> Column:
    return hinted(text, r"\p{Nd}[-/]\p{Nd}", each(values(text, DATE), "date", 0.95))


def addresses(text: Column) -> Column:
    quads = each(F.filter(values(text, IPV4), checks.valid_ipv4), "ip_address", 0.95)
    return F.concat(hinted(text, r"\p{Nd}\.\p{Nd}", quads), hinted(text, ":[0-9A-Fa-f]{1,4}:", each(values(text, IPV6), "ip_address", 0.95)))


def urls(text: Column) -> Column:
    return hinted(text, "://", each(F.transform(values(text, URL), lambda v: F.regexp_replace(v, r"[.,;:)\]}\"']+$", "")), "url", 0.95))


def regex_native(text: Column, most: int | None = None) -> Column:
    """The regex layer without cards and SINs, whose context is fuzzy (context_layers has those). Of `most` characters, if given."""
    head = text if most is None else F.substring(text, 1, most)
    return F.concat(emails(head), phones(head), dates(head), addresses(head), urls(head))


def passports(text: Column) -> Column:
    words = ("passport", "travel document")
    ca = F.filter(spans(text, PASSPORT_CA), lambda s: near(text, s, 40, words))
    generic = F.filter(spans(text, PASSPORT_GENERIC), lambda s: near(text, s, 40, words))
    both = F.concat(
        each(F.transform(ca, lambda s: F.regexp_replace(s["value"], r"(?U)\s", "")), "passport_ca", 0.70),
        each(F.transform(generic, lambda s: s["value"]), "passport_generic", 0.60),
    )
    return hinted(text, "(?i)passport|travel document", both)


def _gated(text: Column, patterns: tuple[str, ...], context: str, raw_type: str) -> Column:
    parts = [F.transform(F.filter(spans(text, p), lambda s: window(text, s, 40).rlike(context)), lambda s: s["value"]) for p in patterns]
    return each(F.array_distinct(F.concat(*parts)), raw_type, 0.60)


def ucis(text: Column) -> Column:
    return hinted(text, r"(?iU)\b(?:uci|client)\b", _gated(text, UCI, UCI_CONTEXT, "uci"))


def status_cards(text: Column) -> Column:
    return hinted(text, r"(?iU)\b(?:status|scis|number|register)\b", _gated(text, (STATUS,), STATUS_CONTEXT, "status_card_registration"))


#: Strings without one of which a text (in lower case) has no credential of a type, and all of them as one pattern.
SECRET_HINTS = {
    "aws_access_key": ("akia", "asia"),
    "aws_secret_key": ("aws",),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "google_api_key": ("aiza",),
    "stripe_key": ("k_live_", "k_test_"),
    "slack_token": ("xox",),
    "private_key": ("private key-----",),
    "jwt": ("eyj",),
    "access_token": ("token",),
    "api_key": ("apikey", "api_key", "api-key"),
    "secret": ("secret",),
    "password": ("password", "passwd", "pwd"),
    "uri_password": ("://",),
}
_HINTED = "(?i)" + "|".join(sorted({h for hints in SECRET_HINTS.values() for h in hints}))


def secrets(text: Column) -> Column:
    """A text is looked at once for any of the hints, and then for the patterns whose own hints it has."""
    none = F.expr(f"cast(array() as {RAW})")

    def of(low: Column) -> Column:
        parts = []
        for kind, pattern, c in SECRETS:
            hinted = F.lit(False)
            for h in SECRET_HINTS[kind]:
                hinted = hinted | F.contains(low, F.lit(h))
            parts.append(F.when(hinted, each(F.regexp_extract_all(text, F.lit(pattern), 1), kind, c)).otherwise(none))
        return F.concat(*parts)

    return F.when(text.rlike(_HINTED), F.transform(F.array(F.lower(text)), of)[0]).otherwise(none)


NATIVE = {"secrets": secrets, "passport": passports, "uci": ucis, "status_card": status_cards}
