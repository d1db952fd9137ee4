"""Home feeds and reference tables as transforms over raw payload rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.functions.facts import label_values
from brickyard.functions.text import ascii_words, german_decimal, read_references, squeeze, visible_text

from . import archives

HOME = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("listing_key", "title", "description")), T.StructField("price", T.DecimalType(12, 2)), T.StructField("living", T.DecimalType(10, 2)),
    T.StructField("plot", T.DecimalType(12, 2)), *(T.StructField(c, T.StringType()) for c in ("postal_code", "city")),
])


@F.pandas_udf(T.StructType([T.StructField("full", T.BooleanType()), T.StructField("homes", T.ArrayType(HOME))]))
def _openimmo(xml: pd.Series) -> pd.DataFrame:
    import xml.etree.ElementTree as ET
    from decimal import Decimal, InvalidOperation

    name = lambda e: e.tag.rsplit("}", 1)[-1]

    def first(e, key):
        return next((x for x in e.iter() if name(x) == key), None)

    def text(e, key):
        found = first(e, key)
        return (found.text or "").strip() or None if found is not None else None

    def number(raw):
        raw = (raw or "").replace(" ", "").replace(" ", "")
        if "," in raw or raw.count(".") != 1:
            raw = raw.replace(".", "").replace(",", ".")
        try:
            return Decimal(raw).quantize(Decimal("0.01")) if raw else None
        except InvalidOperation:
            return None

    def one(body):
        try:
            root = ET.fromstring(body or "")
        except ET.ParseError:
            return {"full": None, "homes": []}
        sent = first(root, "uebertragung")
        homes = []
        for e in (x for x in root.iter() if name(x) == "immobilie"):
            deal, kind = first(e, "vermarktungsart"), first(e, "objektart")
            buys = deal is not None and (deal.get("KAUF") or "").strip().lower() in ("1", "true", "ja", "yes")
            key = text(e, "objektnr_extern") or text(e, "objektnr_intern")
            if not buys or kind is None or first(kind, "haus") is None or not key:
                continue
            body = "\n\n".join(t for k in ("objektbeschreibung", "lage", "sonstige_angaben") if (t := text(e, k)))
            homes.append({"listing_key": key, "title": text(e, "objekttitel") or f"Haus {key}", "description": body or None, "price": number(text(e, "kaufpreis")), "living": number(text(e, "wohnflaeche")), "plot": number(text(e, "grundstuecksflaeche")), "postal_code": text(e, "plz"), "city": text(e, "ort")})
        return {"full": sent is not None and (sent.get("umfang") or "").lower() == "voll", "homes": homes}

    return pd.DataFrame([one(x) for x in xml], columns=["full", "homes"])


def openimmo(raw: DataFrame) -> DataFrame:
    """Houses for sale of OpenImmo documents in ``payload``; ``full`` tells a whole export from an update."""
    return raw.select(_openimmo("payload").alias("d")).select("d.full", F.inline("d.homes"))


def synthetic_key(postal: Column, city: Column, area: Column, price: Column, title: Column) -> Column:
    """A made-up identity for a card without a link of its own."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", part(postal), part(city), part(area), part(price), ascii_words(title, ampersand=False)), 256), 1, 32)


def _belongs(label: Column, title: Column) -> Column:
    """Whether a link's text is that of a card: it holds the title, or begins it with at least 12 characters and 35 % of it; a title under 8 characters never tells."""
    a, b = F.lower(squeeze(label)), F.lower(squeeze(title))
    part = b.startswith(a) & (F.length(a) >= 12) & (F.length(a) >= F.floor(F.length(b) * 0.35))
    return (F.length(b) >= 8) & (a != "") & (a.contains(b) | part)


def area_meaning(shown: Column, living: Column, plot: Column) -> Column:
    """What the area of a card's facts line is (fixed values), by the areas that its text states."""
    close = lambda x, y: F.coalesce(F.abs(x - y) <= F.greatest(F.lit(1.0), F.greatest(F.abs(x), F.abs(y)) * 0.01), F.lit(False))
    said = F.when(close(shown, living), "living_explicit_primary").when(close(shown, plot), "living_explicit_display_plot").otherwise("living_explicit_nonprimary")
    return F.when(living.isNotNull(), said).when(close(shown, plot), "plot_explicit_primary").otherwise("unknown")


AREA_LABELS = {"living": "(?:Wohnfläche|Wohnnutzfläche)", "plot": "(?:Grundstücksfläche|Grundstück|Grundfläche)"}


def search_cards(raw: DataFrame) -> DataFrame:
    """Cards of meta-search pages: a heading is the title, ``PLZ place / area`` the facts, the last price before them the price.

    A link around the heading or after it counts if its text belongs to the
    card (``_belongs``), that around it first; without one the identity is
    made up. ``area_kind`` tells what the area of the facts is. Later cards of
    one key win (``page`` is the order).
    """
    # The link that a heading lies in opens in the part before it.
    parts = F.split("payload", r"(?i)<h3\b")
    rows = raw.select("page", F.posexplode(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("block"), F.get(parts, i).alias("before")))).alias("at", "p")).select("page", "at", "p.*")
    title = visible_text(F.regexp_extract("block", r"(?is)^[^>]*>(.*?)</h3>", 1))
    rest = F.regexp_replace("block", r"(?is)^[^>]*>.*?</h3>", "")
    rows = rows.withColumn("title", title).withColumn("text", visible_text(rest))
    facts = r"(\d{4}) ([^/€\d]+?) / ([\d.,]+) ?m²"
    before = F.regexp_extract("text", r"(?s)^(.*?)\d{4} [^/€\d]+? / [\d.,]+ ?m²", 1)
    prices = F.regexp_extract_all(before, F.lit(r"€ ?([\d.]+(?:,\d{2})?)"), 1)
    around = F.regexp_extract("before", r"""(?is).*<a\b[^>]*href=["']([^"']+)["'][^>]*>(?:(?!</a).)*$""", 1)
    inside = F.struct(around.alias("url"), visible_text(F.concat(F.lit("<h3"), F.regexp_extract("block", r"(?is)^(.*?)</a", 1))).alias("label"))
    links = F.transform(F.regexp_extract_all(rest, F.lit(r"""(?is)<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>"""), 0), lambda a: F.struct(F.regexp_extract(a, r"""(?is)href=["']([^"']+)["']""", 1).alias("url"), squeeze(F.regexp_replace(a, r"<[^>]*>", " ")).alias("label")))
    rows = rows.withColumn("links", F.concat(F.array(inside), links))
    # All labels of a card are read at once, apart by a mark that no reference stands for.
    said = F.split(read_references(F.array_join(F.transform("links", lambda a: a["label"]), "\u0001")), "\u0001")
    known = F.transform(F.arrays_zip("links", said.alias("said")), lambda z: F.struct(z["links"]["url"].alias("url"), z["said"].alias("label")))
    good = F.filter(known, lambda a: a["url"].rlike("^https?://") & _belongs(a["label"], F.col("title")))
    # Texts first and numbers from them next, so that no pattern is looked for twice.
    texts = {f"_{k}": v for k, v in label_values(F.col("text"), AREA_LABELS).items()}
    texts |= {"_area": F.regexp_extract("text", facts, 3), "_price": F.element_at(F.when(F.size(prices) > 0, prices), -1)}
    rows = rows.withColumns({"postal_code": F.nullif(F.regexp_extract("text", facts, 1), F.lit("")), "city": F.nullif(F.trim(F.regexp_extract("text", facts, 2)), F.lit("")), "url": F.get(good, F.lit(0))["url"], **texts}).filter(F.col("title") != "")
    rows = rows.withColumns({c: german_decimal(F.col(f"_{c}")) for c in ("area", "price", *AREA_LABELS)})
    rows = rows.withColumn("area_kind", area_meaning(*(F.col(c).cast("double") for c in ("area", "living", "plot"))))
    made = synthetic_key(F.col("postal_code"), F.col("city"), F.col("area"), F.col("price"), F.col("title"))
    rows = rows.withColumn("identity_stable", F.col("url").isNotNull()).withColumn("listing_key", F.coalesce("url", made))
    last = rows.groupBy("listing_key").agg(F.max_by(F.struct("title", "url", "postal_code", "city", "area", "price", "area_kind", "identity_stable"), F.struct("page", "at")).alias("c"))
    return last.select("listing_key", "c.*")


def postal_names(raw: DataFrame) -> DataFrame:
    """Addressable codes of a JSON list, four digits wide; the last row of a code wins."""
    kind = "struct<data:array<struct<plz:string,ort:string,adressierbar:string>>>"
    rows = raw.select(F.posexplode(F.from_json("payload", kind)["data"]).alias("at", "r")).filter((F.lower("r.adressierbar") == "ja") & F.col("r.plz").rlike("^[0-9]{1,4}$"))
    return rows.groupBy(F.lpad("r.plz", 4, "0").alias("postal_code")).agg(F.max_by("r.ort", "at").alias("name"))


ADDRESS_COLUMNS = ("PLZ", "RW", "HW", "EPSG")


def address_rows(rows: DataFrame) -> DataFrame:
    """postal_code, easting, northing and epsg of rows of text in ADDRESS_COLUMNS; ``#`` is missing."""
    number = lambda c: F.replace(F.nullif(F.trim(F.col(c)), F.lit("#")), F.lit(","), F.lit(".")).try_cast("double")
    return rows.select(F.trim("PLZ").alias("postal_code"), number("RW").alias("easting"), number("HW").alias("northing"), F.trim("EPSG").try_cast("int").alias("epsg"))


def address_register(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a semicolon CSV, read by Spark in as many tasks as it has blocks (``address_rows``). A missing column is an error."""
    rows = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("\ufeff").strip('"') for c in rows.columns))
    if lost := [c for c in ADDRESS_COLUMNS if c not in rows.columns]:
        raise ValueError(f"the address register lacks {', '.join(lost)}")
    return address_rows(rows)


def archived_register(files: DataFrame) -> DataFrame:
    """Addresses of snapshots as they are published: archives (``archives.archives``) that hold one ADRESSE.csv, at any depth."""
    return address_rows(archives.tables(files, "adresse.csv", ADDRESS_COLUMNS))


def archived_homes(files: DataFrame) -> DataFrame:
    """``openimmo`` over archives or plain files; adds the path."""
    return archives.documents(files).select("path", _openimmo("payload").alias("d")).select("path", "d.full", F.inline("d.homes"))
