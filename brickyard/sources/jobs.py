"""Job feeds as transforms over raw payload rows (one JSON or HTML document in ``payload``).

All give job rows: listing_key, title, url, company, description, locations
(array of city and postal_code), currency, period, salary_min, salary_max,
identity. Rows without id, title or URL are left out. Fetching is not done
here.
"""

from __future__ import annotations

import json
import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.functions.salary import PLAUSIBLE
from brickyard.operators import locality

COLUMNS = ("listing_key", "title", "url", "company", "description", "locations", "currency", "period", "salary_min", "salary_max", "identity")
PLACE = "array<struct<city:string,postal_code:string>>"
#: How feeds name Austria.
AUSTRIA = ("at", "aut", "austria", "österreich", "oesterreich")


def _rows(rows: DataFrame, **values: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    kinds = {"locations": PLACE, "salary_min": "decimal(12,2)", "salary_max": "decimal(12,2)"}
    out = rows.select(*(values.get(c, null).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))
    return out.filter((F.trim(F.coalesce("listing_key", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "") & F.col("url").rlike("^https?://"))


def in_austria(*texts: Column) -> Column:
    """Whether any text is a name of Austria or has one as a word."""
    hit = F.lit(False)
    for t in texts:
        low = F.lower(F.trim(t))
        hit = hit | F.coalesce(low.isin(*AUSTRIA) | low.rlike(r"(^|[^\p{L}])(austria|österreich)([^\p{L}]|$)"), F.lit(False))
    return hit


def _place(city: Column, code: Column | None = None) -> Column:
    one = F.struct(F.nullif(F.trim(city), F.lit("")).alias("city"), (code if code is not None else F.lit(None).cast("string")).alias("postal_code"))
    return F.when(one["city"].isNotNull(), F.array(one)).otherwise(F.array().cast(PLACE))


def lever(raw: DataFrame) -> DataFrame:
    """Payload: an array of postings with categories and a salary range; only Austrian ones."""
    kind = "array<struct<id:string,text:string,hostedUrl:string,country:string,descriptionPlain:string,categories:struct<location:string,allLocations:array<string>>,salaryRange:struct<min:double,max:double,currency:string,interval:string>>>"
    rows = raw.select("company", F.explode(F.from_json("payload", kind)).alias("j"))
    places = F.coalesce(F.when(F.size("j.categories.allLocations") > 0, F.col("j.categories.allLocations")), F.array("j.categories.location"))
    rows = rows.filter(in_austria(F.col("j.country"), F.array_join(places, " ; ")))
    period = F.create_map(*(F.lit(x) for kv in {"per-year-salary": "year", "per-month-salary": "month", "per-hour-wage": "hour", "per-week-salary": "week"}.items() for x in kv))
    return _rows(
        rows, listing_key=F.col("j.id"), title=F.col("j.text"), url=F.col("j.hostedUrl"), company=F.col("company"), description=F.col("j.descriptionPlain"),
        locations=F.transform(F.array_distinct(places), lambda p: F.struct(F.trim(p).alias("city"), F.lit(None).cast("string").alias("postal_code"))),
        currency=F.col("j.salaryRange.currency"), period=F.element_at(period, F.col("j.salaryRange.interval")), salary_min=F.col("j.salaryRange.min"), salary_max=F.col("j.salaryRange.max"),
    )


def greenhouse(raw: DataFrame) -> DataFrame:
    """Payload: jobs with pay ranges in cents; one range counts if it is the only Austrian one, the only one, or all are equal."""
    kind = "struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,content:string,location:struct<name:string>,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string>>>>>"
    rows = raw.select("company", F.explode(F.from_json("payload", kind)["jobs"]).alias("j")).filter(in_austria(F.col("j.location.name")))
    none = F.array().cast("array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string>>")
    ranges = F.filter(F.transform(F.coalesce("j.pay_input_ranges", none), _pay_range), lambda r: r.isNotNull())
    local = F.filter(ranges, lambda r: in_austria(r["title"]))
    same = F.size(F.array_distinct(F.transform(ranges, lambda r: F.struct(r["low"], r["high"], r["period"])))) == 1
    pay = F.when(F.size(local) == 1, F.get(local, F.lit(0))).when((F.size(ranges) == 1) | same, F.get(ranges, F.lit(0)))
    return _rows(
        rows.withColumn("pay", pay), listing_key=F.col("j.id"), title=F.col("j.title"), url=F.col("j.absolute_url"), company=F.col("company"), description=F.col("j.content"), locations=_place(F.col("j.location.name")),
        currency=F.when(F.col("pay").isNotNull(), "EUR"), period=F.col("pay.period"), salary_min=F.col("pay.low"), salary_max=F.col("pay.high"),
    )


def _pay_range(r: Column) -> Column:
    """title, period, low and high of a pay range in EUR; null without a period or with an end that isn't plausible for it."""
    title = F.lower(r["title"])
    period = F.when(title.rlike("year|annual|jahr"), "year").when(title.rlike("month|monat"), "month").when(title.rlike("hour|stunde"), "hour")
    ends = F.array_sort(F.array_compact(F.array(*(F.when(r[c] >= 0, r[c] / 100) for c in ("min_cents", "max_cents")))))
    bound = lambda side: F.coalesce(*(F.when(period == k, F.lit(v[side])) for k, v in PLAUSIBLE.items() if k != "week"))
    good = (F.upper(r["currency_type"]) == "EUR") & (F.size(ends) > 0) & F.forall(ends, lambda x: x.between(bound(0), bound(1)))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(r["title"].alias("title"), period.alias("period"), F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high")))


def smartrecruiters(raw: DataFrame) -> DataFrame:
    kind = "struct<content:array<struct<id:string,name:string,ref:string,jobAdId:string,company:struct<identifier:string,name:string>,location:struct<country:string,city:string,postalCode:string>>>>"
    rows = raw.select(F.explode(F.from_json("payload", kind)["content"]).alias("j")).filter(F.lower("j.location.country").isin(*AUSTRIA))
    return _rows(
        rows, listing_key=F.col("j.id"), title=F.col("j.name"), url=F.col("j.ref"), company=F.col("j.company.name"), locations=_place(F.col("j.location.city"), F.col("j.location.postalCode")),
        identity=F.concat(F.lit("smartrecruiters:"), F.trim("j.company.identifier"), F.lit(":jobad:"), F.trim("j.jobAdId")),
    )


def workday(raw: DataFrame) -> DataFrame:
    """One posting a payload; the placeholder for several locations gives way to the list of them."""
    kind = "struct<jobPostingInfo:struct<title:string,location:string,additionalLocations:array<string>,jobReqId:string,externalUrl:string,jobDescription:string>>"
    rows = raw.select("company", "tenant", "site", F.from_json("payload", kind)["jobPostingInfo"].alias("j"))
    req = F.coalesce(F.nullif(F.trim("j.jobReqId"), F.lit("")), F.nullif(F.regexp_extract("j.externalUrl", r"_([A-Za-z0-9-]+)/?$", 1), F.lit("")))
    listed = F.array_distinct(F.array_compact(F.concat(F.array("j.location"), F.coalesce("j.additionalLocations", F.array().cast("array<string>")))))
    listed = F.filter(listed, lambda p: ~F.lower(p).rlike(r"^\d+ locations?$"))
    return _rows(
        rows, listing_key=req, title=F.col("j.title"), url=F.col("j.externalUrl"), company=F.col("company"), description=F.col("j.jobDescription"),
        locations=F.transform(listed, lambda p: F.struct(p.alias("city"), F.lit(None).cast("string").alias("postal_code"))), identity=F.concat(F.lit("workday:"), "tenant", F.lit(":"), "site", F.lit(":req:"), req),
    )


def adzuna(raw: DataFrame) -> DataFrame:
    """Results of a search; a predicted salary is an estimate. Adds provenance and confidence; the period stays unknown."""
    kind = "struct<results:array<struct<id:string,title:string,redirect_url:string,description:string,company:struct<display_name:string>,location:struct<display_name:string>,salary_min:double,salary_max:double,salary_is_predicted:string>>>"
    rows = raw.select(F.explode(F.from_json("payload", kind)["results"]).alias("j"))
    out = _rows(
        rows, listing_key=F.col("j.id"), title=F.col("j.title"), url=F.col("j.redirect_url"), company=F.col("j.company.display_name"), description=F.col("j.description"), locations=_place(F.col("j.location.display_name")),
        currency=F.when(F.col("j.salary_min").isNotNull(), "EUR"), salary_min=F.col("j.salary_min"), salary_max=F.col("j.salary_max"), identity=F.col("j.salary_is_predicted"),
    )
    predicted = F.col("identity") == "1"
    priced = F.col("salary_min").isNotNull()
    return out.withColumn("provenance", F.when(priced & predicted, "ESTIMATED").when(priced, "EXPLICIT")).withColumn("confidence", F.when(priced & predicted, 0.5).when(priced, 0.9)).withColumn("identity", F.lit(None).cast("string"))


def jooble(raw: DataFrame) -> DataFrame:
    """Results of a search; ``PLZ place`` is taken apart and pay stays text."""
    kind = "struct<jobs:array<struct<id:string,title:string,link:string,company:string,location:string,snippet:string,salary:string>>>"
    rows = raw.select(F.explode(F.from_json("payload", kind)["jobs"]).alias("j"))
    code = F.nullif(F.regexp_extract("j.location", r"^\s*(\d{4})\s+", 1), F.lit(""))
    city = F.regexp_replace("j.location", r"^\s*\d{4}\s+", "")
    return _rows(rows, listing_key=F.col("j.id"), title=F.col("j.title"), url=F.col("j.link"), company=F.col("j.company"), description=F.concat_ws("\n", "j.snippet", "j.salary"), locations=_place(city, code))


_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def _posting(node):
    """The first JobPosting anywhere in nested JSON, depth first."""
    if isinstance(node, dict):
        kind = node.get("@type")
        if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
            return node
        node = list(node.values())
    if isinstance(node, list):
        for x in node:
            if (found := _posting(x)) is not None:
                return found
    return None


_PLACES = T.ArrayType(T.StructType([T.StructField("city", T.StringType()), T.StructField("postal_code", T.StringType())]))
POSTING = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("title", "company", "description")), T.StructField("locations", _PLACES),
    T.StructField("currency", T.StringType()), T.StructField("period", T.StringType()), T.StructField("salary_min", T.DoubleType()), T.StructField("salary_max", T.DoubleType()),
])


@F.pandas_udf(POSTING)
def json_ld_posting(html: pd.Series) -> pd.DataFrame:
    """The JobPosting of a page's JSON-LD scripts, nulls if it has none."""
    out = []
    for page in html:
        found = None
        for m in _SCRIPT.finditer(page or ""):
            try:
                found = found or _posting(json.loads(m[1]))
            except ValueError:
                continue
        j = found or {}
        org, pay = j.get("hiringOrganization") or {}, j.get("baseSalary") or {}
        value = pay.get("value") if isinstance(pay, dict) else None
        value = value if isinstance(value, dict) else {"value": value}
        places = j.get("jobLocation") or []
        places = places if isinstance(places, list) else [places]
        address = [(p.get("address") or (p if "addressLocality" in p or "postalCode" in p else {})) for p in places if isinstance(p, dict)]
        address = [a if isinstance(a, dict) else {"addressLocality": a} for a in address]
        number = lambda x: float(x) if isinstance(x, (int, float)) or isinstance(x, str) and re.fullmatch(r"\d+(\.\d+)?", x) else None
        positive = lambda x: (lambda n: n if n is not None and n > 0 else None)(number(x))
        low = positive(value.get("minValue", value.get("value")))
        unit = str(value.get("unitText") or "").lower()
        out.append({
            "title": unescape(j["title"]) if isinstance(j.get("title"), str) else None, "company": org.get("name") if isinstance(org, dict) else None, "description": j.get("description"),
            "locations": [{"city": a.get("addressLocality"), "postal_code": a.get("postalCode")} for a in address] or None,
            "currency": pay.get("currency") if isinstance(pay, dict) and low is not None else None, "period": unit if unit in ("year", "month", "week", "day", "hour") else None,
            "salary_min": low, "salary_max": positive(value.get("maxValue")),
        })
    return pd.DataFrame(out, columns=["title", "company", "description", "locations", "currency", "period", "salary_min", "salary_max"])


#: Languages of the feeds, the primary one first, and names of Vienna inside office labels.
LANGUAGES = ("de", "en")
OFFICE_ALIASES = {"vienna": "wien"}
#: Fixed value: where a tenant's pages are if nothing else is known.
CAREER_BASE = ".jobs.personio.com"
OFFICE_FACTS = ("office", "subcompany", "department", "recruitingCategory", "employmentType", "seniority", "schedule", "yearsOfExperience")


def office_places(offices: DataFrame, localities: DataFrame) -> DataFrame:
    """office and its Austrian ``places`` (array of city and postal_code) of each distinct office label that is in Austria; others are left out.

    ``localities`` has ``name``, as postal tables write it. An office is in
    Austria if it says so or names a known locality; four digits alone are no
    proof, since other countries write them too. Every run of words of a
    label is looked up (an equi-join), the longest name first, and a name
    inside a longer one doesn't count. A postal code belongs to an office of
    one place only.
    """
    known = localities.select(locality.canonical(F.col("name")).alias("city")).filter(F.col("city").isNotNull()).distinct()
    words = known.agg(F.max(F.size(F.split("city", " ")))).first()[0] or 1
    rows = offices.select("office").filter(F.trim("office") != "").distinct().withColumn("text", F.trim(F.regexp_replace("office", r"(?U)\s+", " ")))
    low = F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))
    # Runs of words with one space between them, at every place and of every length a locality has.
    spans = F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+)*"), 0), lambda x: F.split(x, " "))
    runs = F.flatten(F.transform(spans, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), " "))))))
    parts = F.filter(F.transform(F.split("text", "[,;/|]"), lambda p: locality.canonical(p)), lambda p: p.isNotNull())
    alias = F.create_map(*(F.lit(x) for kv in OFFICE_ALIASES.items() for x in kv))
    entry = lambda order, place, city: F.struct(F.lit(order).alias("order"), place.alias("at"), city.alias("city"))
    tries = F.concat(
        F.filter(F.array(entry(0, F.lit(0), locality.canonical(F.col("text")))), lambda x: x["city"].isNotNull()),
        F.transform(F.filter(F.array_distinct(runs), lambda r: F.element_at(alias, r).isNotNull()), lambda r: entry(1, F.lit(0), F.element_at(alias, r))),
        F.transform(F.array_distinct(runs), lambda r: entry(2, -F.length(r), r)),
        F.transform(F.array_distinct(parts), lambda p: entry(3, F.array_position(F.array_distinct(parts), p).cast("int"), p)),
    )
    hits = rows.select("office", F.explode(tries).alias("t")).select("office", "t.*").join(known, "city")
    found = hits.groupBy("office").agg(F.array_sort(F.collect_list(F.struct("order", "at", "city"))).alias("m"))
    exact = F.filter("m", lambda x: x["order"] == 0)
    inside = lambda x, i: F.exists(F.slice("m", F.lit(1), i), lambda y: y["city"].contains(x["city"]))
    cities = F.transform(F.when(F.size(exact) > 0, exact).otherwise(F.filter("m", lambda x, i: ~inside(x, i))), lambda x: x["city"])
    joined = rows.join(found.select("office", cities.alias("cities")), "office", "left")
    says = low.contains("austria") | low.contains("österreich")
    ends = lambda c, more="": F.regexp_replace(c, rf"^[ ,\-–—{more}]+|[ ,\-–—{more}]+$", "")
    bare = ends(F.regexp_replace("text", r"(?<!\d)\d{4}(?!\d)", ""))
    bare = ends(F.regexp_replace(bare, r"(?iU)\b(?:austria|österreich)\b", ""), "()")
    bare = F.trim(F.when(bare.contains(","), F.substring_index(bare, ",", 1)).otherwise(bare))
    tail = F.trim(F.substring_index(bare, " - ", -1))
    rest = F.nullif(F.when(bare.contains(" - ") & (tail != ""), tail).otherwise(bare), F.lit(""))
    code = F.nullif(F.regexp_extract("text", r"(?<!\d)(\d{4})(?!\d)", 1), F.lit(""))
    cities = F.coalesce("cities", F.array(rest))
    places = F.transform(cities, lambda c: F.struct(c.alias("city"), F.when(F.size(cities) == 1, code).alias("postal_code")))
    return joined.filter(F.col("cities").isNotNull() | says).select("office", places.cast(PLACE).alias("places"))


def personio(raw: DataFrame, localities: DataFrame) -> DataFrame:
    """Payload: one XML feed of a ``tenant`` in ``language``. Positions outside Austria are left out (``office_places``).

    The languages of a position are one listing: German if it is described,
    else the first described one, else German. What other languages say
    differently stays in ``extra_texts``. Further columns: languages,
    described and facts (department, seniority and the like). A null base_url
    is the tenant's usual one; a feed that is no XML has no positions.
    """
    base = F.coalesce(F.regexp_replace(F.nullif(F.trim("base_url"), F.lit("")), "/+$", ""), F.concat(F.lit("https://"), "tenant", F.lit(CAREER_BASE)))
    rows = raw.select("tenant", "company", base.alias("base"), F.lower("language").alias("language"), F.explode(position_rows("payload")).alias("j")).select("tenant", "company", "base", "language", "j.*")
    place = office_places(rows, localities)
    rows = rows.filter((F.trim(F.coalesce("id", F.lit(""))) != "") & F.col("name").isNotNull()).join(place, "office")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("language")), F.lit(0))
    rows = rows.withColumn("rank", F.when(rank > 0, rank).otherwise(len(LANGUAGES) + 1).cast("int"))
    variant = F.struct("rank", "language", "description", F.struct("name", "places", "facts").alias("j"))
    # One row for each language, then as many as there are languages.
    each = rows.groupBy("tenant", "company", "base", "id", "rank", "language").agg(F.min(variant).alias("variant"))
    one = each.groupBy("tenant", "company", "base", "id").agg(F.array_sort(F.collect_list("variant")).alias("v"))
    described = F.filter("v", lambda x: x["description"].isNotNull())
    best = F.when(F.size(described) > 0, described).otherwise(F.col("v"))
    one = one.withColumns({"described": described, "first": F.get(best, F.lit(0))})
    extra = F.array_distinct(F.filter(F.transform("described", lambda x: x["description"]), lambda t: t != F.col("first.description")))
    listing = F.concat("tenant", F.lit(":"), "id")
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["language"]))
    flat = one.select(
        listing.alias("listing_key"), F.col("first.j.name").alias("title"), F.concat("base", F.lit("/job/"), "id", F.lit("?language="), "first.language").alias("url"), "company", F.col("first.description").alias("description"),
        F.col("first.j.places").alias("locations"), names("v").alias("languages"), names("described").alias("described"), extra.alias("extra_texts"), F.col("first.j.facts").alias("facts"),
    )
    more = ("languages", "described", "extra_texts", "facts")
    jobs = _rows(flat, **{c: F.col(c) for c in ("listing_key", "title", "url", "company", "description", "locations")})
    return jobs.join(flat.select("listing_key", *more), "listing_key")


POSITION = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "name", "office", "description")), T.StructField("facts", T.StructType([T.StructField(c, T.StringType()) for c in OFFICE_FACTS]))])
_MARKUP = re.compile(r"(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>")


def plain_text(html: str | None) -> str | None:
    """Text of a piece of HTML in one line, references read twice, or None."""
    text = " ".join(unescape(_MARKUP.sub(" ", html or "")).split())
    return unescape(text) or None


@F.pandas_udf(T.ArrayType(POSITION))
def position_rows(xml: pd.Series) -> pd.Series:
    """Positions of an XML feed; a description has its blocks' headings and texts, blocks apart by an empty line."""
    import xml.etree.ElementTree as ET

    def one(text: str | None):
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return []
        take = lambda p, k: (p.findtext(k) or "").strip() or None

        def said(p) -> str | None:
            blocks = p.findall("jobDescriptions/jobDescription")
            texts = ("\n".join(x for x in (take(b, "name"), plain_text(b.findtext("value"))) if x) for b in blocks)
            return "\n\n".join(t for t in texts if t) or None

        facts = lambda p: {k: take(p, k) for k in OFFICE_FACTS}
        return [{"id": take(p, "id"), "name": take(p, "name"), "office": take(p, "office"), "description": said(p), "facts": facts(p)} for p in root.findall("position")]

    return xml.map(one)


def cards(raw: DataFrame, base: str) -> DataFrame:
    """Search result pages: each link with text is a card; its lines are title, company and place, and the longest is the description."""
    found = F.regexp_extract_all("payload", F.lit(r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>.*?</a>'), 0)
    rows = raw.select(F.explode(found).alias("card")).withColumn("href", F.regexp_extract("card", r'(?is)href="([^"]+)"', 1))
    parts = F.filter(F.transform(F.split(F.regexp_replace("card", r"<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("parts", parts).filter(F.size("parts") >= 3)
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base), "href"))
    text = F.filter("parts", lambda x: F.length(x) >= 60)
    return _rows(rows, listing_key=F.regexp_extract("href", r"([A-Za-z0-9-]+)/?(?:[?#].*)?$", 1), title=F.get("parts", F.lit(0)), url=url, company=F.get("parts", F.lit(1)), description=F.get(text, F.lit(0)), locations=_place(F.get("parts", F.lit(2))))
