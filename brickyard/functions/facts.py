"""Facts in page sources and texts: closed-page marks, scalars in scripts, and checks before they are used."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_words, folded_title, squeeze

#: Names and patterns over lower-case text of pages that say their job or home is gone, or that ask who reads them.
CLOSED_JOB = {
    "no_longer_available": r"\b(?:this )?(?:job|position|role) (?:is )?no longer available\b",
    "no_longer_accepting_applications": r"\b(?:this )?(?:job|position|role) (?:is )?no longer accepting applications\b",
    "applications_closed": r"\bapplications? (?:are|is|have been) closed\b",
    "job_expired": r"\b(?:this )?(?:job|position|role) (?:has )?expired\b",
    "application_period_ended": r"\bapplication (?:period|window) (?:has )?ended\b",
    "stelle_nicht_mehr_verfuegbar": r"\b(?:diese )?(?:stelle|position|stellenanzeige|stellenangebot) ist nicht mehr verf(?:ü|ue)gbar\b",
    "bewerbung_nicht_mehr_moeglich": r"(?U)\bbewerb(?:ung|ungen)\w*[^.]{0,80}\bnicht mehr m(?:ö|oe)glich\b",
    "bewerbungsfrist_abgelaufen": r"(?U)\bbewerbungsfrist\w*[^.]{0,40}\babgelaufen\b",
}
CLOSED_HOME = {
    "dibeo_already_found": r"\bdiese immobilie wurde schon gefunden\b",
    "property_no_longer_available": r"\b(?:immobilie|objekt|inserat|anzeige|angebot|expos(?:é|e))[^.]{0,80}\bnicht mehr verf(?:ü|ue)gbar\b",
    "listing_deactivated": r"(?U)\b(?:inserat|anzeige|expos(?:é|e)|objekt)\w*[^.]{0,60}\b(?:deaktiviert|gel(?:ö|oe)scht|entfernt)\b",
}
ROBOT_CHECK = {"captcha": r"\bcaptcha\b", "cloudflare_challenge": r"\bjust a moment\b", "access_denied": r"\baccess denied\b"}


def marks(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text holds, in the order of the table."""
    low = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in patterns.items())))


def json_scalar(source: Column, key: str) -> Column:
    """The first value of a key in JSON inside a page source: a string without escapes or a number."""
    text = F.regexp_extract(source, rf'"{key}"\s*:\s*"([^"\\]*)"', 1)
    number = F.regexp_extract(source, rf'"{key}"\s*:\s*(-?\d+(?:\.\d+)?)', 1)
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(number, F.lit("")))


@F.pandas_udf(T.StringType())
def typed_object(source: pd.Series, key: pd.Series, kind: pd.Series) -> pd.Series:
    """The JSON object under ``key`` whose ``__typename`` is ``kind``, by balanced braces; null if there is none."""
    import json

    decoder = json.JSONDecoder()

    def one(text, k, t):
        at = -1
        while (at := (text or "").find(f'"{k}"', at + 1)) >= 0:
            start = text.find("{", at)
            if start < 0 or text[at + len(k) + 2 : start].strip() != ":":
                continue
            try:
                found, end = decoder.raw_decode(text, start)
            except ValueError:
                continue
            if found.get("__typename") == t:
                return text[start:end]
        return None

    return pd.Series([one(a, b, c) for a, b, c in zip(source, key, kind)])


def facts_match(number: Column, listing_number: Column, postal: Column, listing_postal: Column, title: Column, listing_title: Column) -> Column:
    """Whether a detail page speaks of the listing: no other number or code, and a title that holds the other or shares three words, 60 % of the shorter."""
    a, b = ascii_words(title, ampersand=False), ascii_words(listing_title, ampersand=False)
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared, short = F.size(F.array_intersect(wa, wb)), F.least(F.size(wa), F.size(wb))
    alike = a.contains(b) | b.contains(a) | ((shared >= 3) & (shared >= short * 0.6))
    differs = lambda x, y: F.coalesce(x != y, F.lit(False))
    return ~differs(number, listing_number) & ~differs(postal, listing_postal) & (a != "") & (b != "") & alike


def safer_title(current: Column, detail: Column) -> Column:
    """The detail page's title where it is longer and holds the current one (but for case and white space), else the current."""
    a, b = folded_title(current), folded_title(detail)
    return F.when((a != "") & (F.length(b) > F.length(a)) & b.contains(a), detail).otherwise(current)


def label_values(text: Column, labels: dict[str, str], number: str = r"([\d.]+(?:,\d+)?)") -> dict[str, Column]:
    """Values of labelled areas in visible text: after its label, else before it if no label's colon follows."""
    out = {}
    for name, label in labels.items():
        after = F.regexp_extract(text, rf"(?i)\b{label}\s*:?\s*(?:ca\.\s*)?{number}\s*m²", 1)
        before = F.regexp_extract(text, rf"(?i){number}\s*m²\s*{label}(?!\s*:)", 1)
        out[name] = F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")))
    return out
