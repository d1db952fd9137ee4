"""Text normalisers and small parsers, as column expressions unless said otherwise."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _fold_pairs() -> tuple[str, str]:
    pairs = {}
    for c in {chr(i) for i in range(0xC0, 0x250)}:
        low = c.casefold()
        bare = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
        if len(low) == 1 and len(bare) == 1 and bare != low:
            pairs[low] = bare
    ordered = sorted(pairs)
    return "".join(ordered), "".join(pairs[c] for c in ordered)


FOLD_FROM, FOLD_TO = _fold_pairs()


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ascii_words(text: Column, ampersand: bool = True) -> Column:
    """Lower case without accents, ``&`` as ``und`` if wanted, anything else than a-z and 0-9 as single spaces; null is empty."""
    low = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)
    if ampersand:
        low = F.replace(low, F.lit("&"), F.lit(" und "))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def ascii_words_reference(text: pd.Series) -> pd.Series:
    """The same by full Unicode decomposition, for texts beyond the Latin blocks."""

    def one(x: str | None) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", (x or "").casefold()) if not unicodedata.combining(c)).replace("&", " und ")
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())

    return text.map(one, na_action=None)


def locality_words(text: Column) -> Column:
    """Lower case with all letters kept and ß as ss, words apart by single spaces."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "))


def folded_title(text: Column) -> Column:
    """Lower case, ß as ss, white space squeezed."""
    return squeeze(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")))


def job_title(text: Column) -> Column:
    """A title without gender marks and the filler words ``at`` and ``bei``."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\([^)]*(?:[mwf]\s*[/|]\s*[mwf]|all genders)[^)]*\)|\ball genders\b", " ")
    bare = F.regexp_replace(bare, r"(?i)\b[mwfd](?:\s*[/|]\s*[mwfd]){1,3}\b", " ")
    words = F.split(ascii_words(bare), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("at", "bei")), " ")


def company_name(text: Column) -> Column:
    """A company without legal forms (fixed values), wherever they stand."""
    return squeeze(F.regexp_replace(ascii_words(text), r"\b(?:gmbh und co kg|gmbh co kg|gesmbh|gmbh|mbh|ag|kg|og)\b", " "))


#: Titles that say too little to tell jobs apart.
GENERIC_TITLES = ("konstrukteur", "mechanical engineer", "entwicklungsingenieur", "maschinenbautechniker", "projektingenieur", "projektleiter", "design engineer")


def is_generic(title: Column) -> Column:
    """Of a normalised title: empty, one of GENERIC_TITLES, or at most two words."""
    return (title == "") | title.isin(*GENERIC_TITLES) | (F.size(F.split(title, " ")) <= 2)


@F.pandas_udf(T.DoubleType())
def title_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two normalised titles: 1 if equal, 0 if one is empty, else the matching-blocks ratio."""
    return pd.Series([0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)])


def containment(left: Column, right: Column, least: int = 12) -> Column:
    """Shared distinct words of two word arrays over the smaller one; 0 if either has fewer than ``least``."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    small = F.least(F.size(a), F.size(b))
    return F.when(small < least, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def contains_alias(text: Column, alias: Column) -> Column:
    """Whether a normalised text has a normalised alias as whole words."""
    return (alias != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), alias, F.lit(" ")))


def german_decimal(text: Column, lone_dot: str = "thousands", lone_comma: str = "decimal") -> Column:
    """A decimal in German notation, or null.

    With both marks the last one is the decimal mark. A lone dot or comma
    before exactly three digits is a thousands mark where the source says
    so (``thousands``), and else the decimal mark.
    """
    bare = F.regexp_replace(text, r"[\s\x{00A0}]+", "")
    both = bare.contains(",") & bare.contains(".")
    german = F.locate(",", F.reverse(bare)) < F.locate(".", F.reverse(bare))
    comma_thousands = bare.rlike(r"^-?\d{1,3}(,\d{3})+$") if lone_comma == "thousands" else F.lit(False)
    dot_thousands = bare.rlike(r"^-?\d{1,3}(\.\d{3})+$") if lone_dot == "thousands" else bare.rlike(r"^-?\d{1,3}(\.\d{3}){2,}$")
    value = (
        F.when(both & german, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(bare, F.lit(","), F.lit("")))
        .when(bare.contains(","), F.when(comma_thousands, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit("."))))
        .when(dot_thousands, F.replace(bare, F.lit("."), F.lit("")))
        .otherwise(bare)
    )
    return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("decimal(14,2)"))


@F.pandas_udf(T.StringType())
def read_references(text: pd.Series) -> pd.Series:
    """Named and numeric character references as characters, read twice, since pages hold escaped mark-up; white space squeezed after the first time."""
    return pd.Series([x if x is None or "&" not in x else unescape(" ".join(unescape(x).split())) for x in text], dtype=object)


#: A comment, or a tag whose quoted values may hold ``>``.
TAG = r"""<!--.*?(?:-->|\z)|<[a-zA-Z/!?](?:[^>"']|"[^"]*+"|'[^']*+')*+>"""


def visible_text(html: Column) -> Column:
    """What a page shows: no scripts, styles, comments or tags, all character references read, white space squeezed.

    Tags go before references are read, so ``&lt;b&gt;`` stays as text. A
    script or style that isn't closed hides the rest of the page.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?(?:</\1\s*>|\z)", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, f"(?is){TAG}", " "), r"(?U)\s+", " "))
    return F.trim(F.when(bare.contains("&"), read_references(bare)).otherwise(bare))


def postal_beside(text: Column, locality: Column | str) -> Column:
    """The one four-digit code that stands before the locality, or null if there is none, more than one or no locality."""
    words = F.split(F.trim(F.lit(locality) if isinstance(locality, str) else locality), r"\s+")
    name = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")
    pattern = F.concat(F.lit(r"(?iu)(?<!\d)(?:A\s*[-–—]?\s*)?(\d{4})\s+"), name, F.lit(r"(?![\p{L}\d])"))
    found = F.array_distinct(F.regexp_extract_all(text, pattern, 1))
    return F.when((F.array_join(words, "") != "") & (F.size(found) == 1), F.get(found, F.lit(0)))


def provider_identity(url: Column, hosts: tuple[str, ...], path_pattern: str, name: str) -> Column:
    """``name:id`` for a URL of one of the hosts whose path begins as the pattern says (its first group is the id)."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    found = F.lower(F.regexp_extract(path, "(?i)" + path_pattern, 1))
    return F.when(host.isin(*hosts) & (found != ""), F.concat(F.lit(name + ":"), found))


def job_identity(payload: Column, keys: dict[str, str]) -> Column:
    """A job's lasting identity in a JSON payload, or null.

    The explicit one first, then tenant and ad id, then tenant, site and
    requisition; blank parts make an identity null. ``keys`` names the paths.
    """
    part = lambda k: F.nullif(F.trim(F.get_json_object(payload, keys[k])), F.lit(""))
    ad = F.concat(F.lit("smartrecruiters:"), part("ad_tenant"), F.lit(":jobad:"), part("ad_id"))
    requisition = F.concat(F.lit("workday:"), part("req_tenant"), F.lit(":"), part("req_site"), F.lit(":req:"), part("req_id"))
    return F.coalesce(part("explicit"), ad, requisition)


def json_true(payload: Column, field: str) -> Column:
    """Whether a field of a JSON object is the boolean true; a string "true" is not."""
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant")
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "boolean"), F.lit(False))


def eur_label(value: Column) -> Column:
    """Whole euros in German notation, null stays null."""
    return F.concat(F.translate(F.format_number(value.cast("decimal(14,0)"), 0), ",", "."), F.lit(" €"))
