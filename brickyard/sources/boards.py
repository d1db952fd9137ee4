"""Job boards and brokers whose pages are cards and labelled blocks, as transforms over raw pages in ``payload``.

A page is taken as the list of its text nodes; the rules below read places,
companies and descriptions from their order. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions.salary import salary_of
from brickyard.functions.text import TAG, german_decimal, postal_beside, read_references, visible_text
from brickyard.operators import locality

from .jobs import PLACE, json_ld_posting

#: Words that are a region, an employment, a badge or an age and so no place, company or description, and places abroad.
REGIONS = (
    "burgenland", "kärnten", "kaernten", "niederösterreich", "niederoesterreich", "oberösterreich", "oberoesterreich", "salzburg", "steiermark", "tirol", "vorarlberg", "wien", "österreich", "oesterreich",
    "österreichweit", "oesterreichweit", "ostösterreich", "ostoesterreich", "westösterreich", "westoesterreich", "südösterreich", "suedoesterreich",
)
EMPLOYMENTS = ("vollzeit", "teilzeit", "freiberuflich", "geringfügig", "geringfuegig", "lehre", "praktikum", "traineeship")
STEPSTONE_NOISE = ("mehr", "neu", "schnelle bewerbung", "teilweise home-office")
WILLHABEN_NOISE = ("neu - bewirb dich gleich", "schnelle bewerbung", "merken", "mehr")
STYLE_NOISE = r"(?i)(?:box-sizing:|@media\b|#no-js-image|data-genesis-element|display\s*:\s*none|\.res-[a-z0-9_-]+\s*\{|\}\s*\.res-)"
AGE = r"(?i)^(?:vor\s+\d+\s+(?:Stunden?|Tagen?|Wochen?|Monaten?)|heute|gestern)$"
ABROAD = r"(?iU)\b(?:deutschland|germany|schweiz|switzerland|italien|italy|tschechien|czech(?:ia| republic)?|slowakei|slovakia|ungarn|hungary|slowenien|slovenia)\b"
CITIES_ABROAD = (
    "berlin", "bratislava", "budapest", "dresden", "düsseldorf", "duesseldorf", "frankfurt am main", "hamburg", "köln", "koeln", "ljubljana", "münchen", "munich", "nürnberg", "nuernberg", "prag", "prague", "stuttgart", "zürich", "zurich",
)
STEPSTONE_LINK = r"(?:https?://(?:www\.)?stepstone\.at)?/stellenangebote--[^\"'?#]+--(\d+)-inline\.html"
WILLHABEN_LINK = r"(?:https?://(?:www\.)?willhaben\.at)?/jobs/job/[^\"'?#]+/(\d+)(?=[/?#\"']|$)"
META = r"^(\d{2}\.\d{2}\.)\s*\|\s*(.+)$"
WILLHABEN_CUE = r"(?i)(?:brutto(?:monats|jahres)?gehalt|mindestgehalt|mindestentgelt|\bgehalt\b|salary)"
WILLHABEN_PAY = r"(?i)(?:(?:€|\bEUR\b).{0,60}(?:monatlich|jährlich|jaehrlich|pro\s+monat|pro\s+jahr|/\s*monat|/\s*jahr|p\.?\s*a\.?)|(?:monatlich|jährlich|jaehrlich|pro\s+monat|pro\s+jahr).{0,60}(?:€|\bEUR\b))"
HEADER_AGE = r"(?i)^(?:heute|gestern|vor\s+\d+\s*t|vor\s+\d+\s+Tag|online\s+gestellt\s+vor)"
AUSTRIAN = r"(?iU)(?:\baustria\b|\bösterreich\b|\boesterreich\b|,\s*at\b|^at$)"
REQUISITION = ("job requisition id:", "stellenanforderungs-id:")
DESCRIPTION = ("description:", "job description:", "beschreibung:")
AFTER_DESCRIPTION = ("contact person:", "ansprechperson:", *REQUISITION, "similar jobs", "ähnliche stellen")
PAY_CUE, PAY_VALUE = r"(?i)gehalt|entgelt|lohn|vergütung|brutto|salary", r"(?i)€|\beuro?\b"


def text_nodes(html: Column) -> Column:
    """The texts between a page's tags in order, squeezed, with character references read; scripts, styles and comments are left out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\z)", "\u0001")
    # Tags become a mark that no reference stands for, so what references spell isn't taken for tags.
    bare = F.regexp_replace(bare, f"(?is){TAG}", "\u0001")
    bare = F.when(bare.contains("&"), read_references(bare)).otherwise(bare)
    return F.filter(F.transform(F.split(bare, "\u0001"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _first(values: Column, good) -> Column:
    return F.get(F.filter(values, good), F.lit(0))


def _one_of(value: Column, words: tuple[str, ...]) -> Column:
    return F.lower(value).isin(*words)


def linked_cards(raw: DataFrame, link: str) -> DataFrame:
    """One row per link to a job: job_id (the group of ``link``), inside (nodes of the link) and after (nodes up to the next such link)."""
    opening = rf"(?i)<a\b(?=[^>]*\bhref\s*=\s*[\"']{link})"
    blocks = F.split("payload", opening)
    rows = raw.select(F.explode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("card"))
    inside = F.concat(F.lit("<a"), F.regexp_extract("card", r"(?is)^(.*?)(?:</a\s*>|\z)", 1))
    after = F.regexp_replace("card", r"(?is)^.*?(?:</a\s*>|\z)", "")
    return rows.select(F.regexp_extract("card", f"(?i){link}", 1).alias("job_id"), text_nodes(inside).alias("inside"), text_nodes(after).alias("after"))


def place_of(text: Column, regions: tuple[str, ...] = ()) -> Column:
    """postal_code and city of a place like "4020 Linz, Urfahr" or "Region, Linz": the first part, or the second if the first is a region."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")

    def read(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        code = F.nullif(F.regexp_extract(first, r"^(\d{4})(?:\s+.+)?$", 1), F.lit(""))
        plain = F.when(~_one_of(first, regions), first).when(~_one_of(second, regions), second) if regions else first
        city = F.when(code.isNotNull(), F.nullif(F.trim(F.regexp_replace(first, r"^\d{4}", "")), F.lit(""))).otherwise(plain)
        return F.struct(code.alias("postal_code"), city.alias("city"))

    return F.when(text.isNotNull(), _let(parts, read))


def stepstone(raw: DataFrame) -> DataFrame:
    """job_id, title, company, place, postal_code, city and description of search pages; cards that are surely abroad are left out.

    The title is the first node of the link that people read (what follows
    the last style block, where one stands in a node). Of the next nodes,
    without noise and repetitions, the first is the company and the second
    the place; the description is the first further one of 60 characters that
    is no age. Links without a title end the card before them and give none.
    """
    noise = lambda x: _one_of(x, STEPSTONE_NOISE) | x.rlike(STYLE_NOISE)
    shown = F.transform("inside", lambda x: F.when(x.rlike(STYLE_NOISE), F.trim(F.when(x.contains("}"), F.substring_index(x, "}", -1)))).otherwise(x))
    human = F.transform(shown, lambda x: F.when((x != "") & (F.length(x) <= 500) & ~noise(x), x))
    rows = linked_cards(raw, STEPSTONE_LINK).withColumn("human", human).withColumn("at", F.array_position(F.transform("human", lambda x: x.isNotNull()), True)).filter("at > 0")
    rest = F.filter(F.concat(F.slice("inside", F.col("at").cast("int") + 1, F.size("inside")), F.col("after")), lambda x: ~noise(x))
    rows = rows.select("job_id", F.get("human", F.col("at").cast("int") - 1).alias("title"), F.slice(F.array_distinct(rest), 1, 12).alias("tail"))
    short = lambda n, most: _let(F.get("tail", F.lit(n)), lambda x: F.when(F.length(x) <= most, x))
    rows = rows.withColumn("company", short(0, 300)).withColumn("place", short(1, 500))
    described = _first(F.slice("tail", 3, F.size("tail") + 1), lambda x: (F.length(x) >= 60) & ~x.rlike(AGE))
    abroad = F.col("place").rlike(ABROAD) | _one_of(F.trim(F.substring_index("place", ",", 1)), CITIES_ABROAD)
    rows = rows.filter(~F.coalesce(abroad, F.lit(False))).withColumn("p", place_of(F.col("place"), REGIONS))
    return rows.select("job_id", "title", "company", "place", "p.postal_code", "p.city", described.alias("description"))


def willhaben(raw: DataFrame) -> DataFrame:
    """job_id, title, company, published, place, postal_code, city and description of search pages.

    The title is the link's first node. The company is the node that ends
    with " Jobs", else the first one under 180 characters that is no noise;
    the place is what a node like "12.03. | Vollzeit, 4020 Linz" names after
    its kinds of employment; the description is the longest node of 100
    characters or more.
    """
    rows = linked_cards(raw, WILLHABEN_LINK).filter(F.size("inside") > 0)
    tail = F.slice(F.array_distinct(F.concat(F.slice("inside", F.lit(2), F.size("inside")), F.col("after"))), 1, 16)
    rows = rows.select("job_id", F.get("inside", F.lit(0)).alias("title"), tail.alias("tail")).filter(F.length("title") <= 500)
    rows = rows.withColumn("plain", F.filter("tail", lambda x: ~x.rlike(META) & ~_one_of(x, WILLHABEN_NOISE)))
    company = F.coalesce(F.regexp_replace(_first(F.col("plain"), lambda x: x.endswith(" Jobs")), " Jobs$", ""), _first(F.col("plain"), lambda x: F.length(x) < 180))
    rows = rows.withColumn("company", company).withColumn("meta", _first(F.col("tail"), lambda x: x.rlike(META)))
    tokens = F.filter(F.transform(F.split(F.regexp_extract("meta", META, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    begins = lambda t: F.array_position(F.transform(t, lambda x: _one_of(x, EMPLOYMENTS)), False)
    place = _let(tokens, lambda t: F.when(begins(t) > 0, F.array_join(F.slice(t, F.greatest(begins(t), F.lit(1)).cast("int"), F.size(t)), ", ")))
    rows = rows.withColumn("place", F.when(F.col("meta").isNotNull(), place)).withColumn("p", place_of(F.col("place")))
    long = F.filter("plain", lambda x: (F.length(x) >= 100) & ~x.eqNullSafe(F.col("company")) & ~x.eqNullSafe(F.concat("company", F.lit(" Jobs"))))
    longest = F.get(F.array_sort(F.transform(long, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), F.lit(0))["x"]
    return rows.select("job_id", "title", "company", F.nullif(F.regexp_extract("meta", META, 1), F.lit("")).alias("published"), "place", "p.postal_code", "p.city", longest.alias("description"))


def willhaben_pay(raw: DataFrame) -> DataFrame:
    """Detail pages with ``pay_text``: the node with a pay cue and two after it that state euros and a period, else what follows the first cue in the page."""
    rows = raw.withColumn("nodes", text_nodes(F.col("payload")))
    near = pay_snippet(F.col("nodes"), WILLHABEN_CUE, WILLHABEN_PAY)
    page = F.array_join(F.slice("nodes", 1, 250), " ")
    window = F.substring(F.regexp_extract(page, f"(?s)({WILLHABEN_CUE}.*)$", 1), 1, 500)
    return rows.withColumn("pay_text", F.coalesce(near, F.when(window.rlike(WILLHABEN_PAY), window))).drop("nodes")


def header_place(nodes: Column) -> Column:
    """postal_code, city and text of the line "place - age" among the first 100 nodes, or null."""
    lines = F.transform(F.slice(nodes, 1, 100), lambda x: F.when(F.trim(F.substring_index(x, " - ", -1)).rlike(HEADER_AGE) & x.contains(" - "), F.trim(F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, " - ", -1)) - 3))))
    text = _first(lines, lambda x: x.isNotNull() & (x != ""))
    return F.when(text.isNotNull(), F.struct(place_of(text)["postal_code"].alias("postal_code"), place_of(text)["city"].alias("city"), text.alias("text")))


def detail_places(raw: DataFrame) -> DataFrame:
    """Detail pages with ``places`` (array of city and postal_code): those of their JSON-LD, else of the page.

    A place without a code gets the one that the page prints right before
    it, if there is just one. Without places in the data, the node after
    "Dienstort" is one, else the line "place - age" of the header.
    """
    rows = raw.withColumns({"nodes": text_nodes(F.col("payload")), "shown": visible_text(F.col("payload")), "posting": json_ld_posting(F.col("payload"))})
    known = F.filter("posting.locations", lambda p: (F.trim(F.coalesce(p["city"], F.lit(""))) != "") | (F.trim(F.coalesce(p["postal_code"], F.lit(""))) != ""))
    rows = rows.withColumn("known", known)
    at = F.array_position(F.transform("nodes", lambda x: F.lower(x) == "dienstort"), True)
    beside = F.when(at > 0, F.get("nodes", at.cast("int")))
    header = header_place(F.col("nodes"))
    one = lambda city, code: F.array(F.struct(city.alias("city"), code.cast("string").alias("postal_code")))
    found = F.when(F.size("known") > 0, F.col("known")).when(beside.isNotNull(), one(beside, F.lit(None))).when(header.isNotNull(), one(header["city"], header["postal_code"])).otherwise(F.array().cast(PLACE))
    rows = rows.withColumn("found", found)
    coded = F.transform("found", lambda p: F.struct(p["city"].alias("city"), F.coalesce(F.nullif(F.trim(p["postal_code"]), F.lit("")), postal_beside(F.col("shown"), p["city"])).alias("postal_code")))
    return rows.withColumn("places", F.array_distinct(coded)).drop("nodes", "shown", "posting", "known", "found")


def repaired_places(locations: DataFrame, pages: DataFrame) -> DataFrame:
    """Locations (job_id, city, postal_code, location_text, lon) with what their page's header names, where they have no point and no city that is one.

    ``pages``: job_id and payload; of several pages of a job the smallest
    payload counts. A header that names a region or nothing changes nothing,
    and a concrete city is never replaced. Adds ``repaired``.
    """
    shown = pages.groupBy("job_id").agg(F.min("payload").alias("payload")).select("job_id", header_place(text_nodes(F.col("payload"))).alias("_h"))
    joined = locations.join(shown, "job_id", "left")
    open_row = F.col("lon").isNull() & locality.canonical(F.col("city")).isNull()
    fix = open_row & locality.canonical(F.col("_h.city")).isNotNull()
    new = {"city": F.col("_h.city"), "postal_code": F.coalesce("_h.postal_code", "postal_code"), "location_text": F.coalesce("_h.text", "_h.city")}
    return joined.select(*(F.when(fix, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in locations.columns), fix.alias("repaired"))


def label_value(nodes: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first node that begins with a label: the rest of it, or the next node."""

    def value(x: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for label in reversed(labels):
            rest = F.nullif(F.trim(F.substring(x, F.lit(len(label) + 1), F.length(x))), F.lit(""))
            found = F.when(F.lower(x).startswith(label), F.coalesce(rest, F.get(nodes, i + 1))).otherwise(found)
        return found

    return _first(F.transform(nodes, value), lambda x: x.isNotNull())


def between(nodes: Column, starts: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """The nodes after the first that is (or begins with) a start label and before the next that begins with a stop label, by lines; null if there are none."""
    begins = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(x).startswith(w))
    at = F.array_position(F.transform(nodes, lambda x: begins(x, starts)), True)

    def body(n: Column) -> Column:
        rest = F.slice(nodes, n + 1, F.size(nodes))
        own = _first(F.transform(F.slice(nodes, n, F.lit(1)), lambda x: F.nullif(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), F.lit(""))), lambda x: x.isNotNull())
        return _let(F.array_position(F.transform(rest, lambda x: begins(x, stops)), True), lambda e: F.concat(F.array_compact(F.array(own)), F.when(e > 0, F.slice(rest, F.lit(1), e - 1)).otherwise(rest)))

    text = F.when(at > 0, _let(F.greatest(at, F.lit(1)).cast("int"), lambda n: F.array_join(body(n), "\n")))
    return F.nullif(text, F.lit(""))


def successfactors(raw: DataFrame) -> DataFrame:
    """posting_id, requisition, cities (Austrian ones in order) and description of detail pages (``url`` and ``payload``); rows without any id are an error.

    The lasting id is the requisition, else the posting id in the URL.
    """
    rows = raw.withColumn("nodes", text_nodes(F.col("payload")))
    requisition = label_value(F.col("nodes"), REQUISITION)
    posting = F.nullif(F.regexp_extract("url", r"/(\d+)/?(?:[?#].*)?$", 1), F.lit(""))
    place = label_value(F.col("nodes"), ("location:", "arbeitsort:", "standort:"))
    parts = F.filter(F.transform(F.split(F.coalesce(place, F.lit("")), r"\s*[;|]\s*"), lambda x: F.trim(x)), lambda x: x.rlike(AUSTRIAN))
    names = F.array_distinct(F.transform(parts, lambda x: F.trim(F.get(F.split(x, ","), F.lit(0)))))
    cities = F.filter(names, lambda x: ~_one_of(x, ("austria", "österreich", "oesterreich", "at")))
    identity = F.coalesce(F.concat(F.lit("req:"), requisition), F.concat(F.lit("posting:"), posting))
    return rows.select("url", identity.alias("identity"), cities.alias("cities"), between(F.col("nodes"), DESCRIPTION, AFTER_DESCRIPTION).alias("description"), F.when(identity.isNull(), "no_id").alias("error"))


def windows_from_end(nodes: Column, most: int = 3) -> Column:
    """Runs of one to ``most`` neighbouring nodes as one text each, those that end last first."""
    run = lambda end, n: F.array_join(F.slice(nodes, F.greatest(end - n + 1, F.lit(1)), F.least(end, F.lit(n))), " ")
    return F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1)))), lambda end: F.array(*(run(end, n) for n in range(1, most + 1)))))


def pay_snippet(nodes: Column, cue: str = PAY_CUE, value: str = PAY_VALUE) -> Column:
    """The first node with a pay cue that, with up to two after it, names an amount's currency."""
    run = F.transform(nodes, lambda x, i: F.when(x.rlike(cue), F.array_join(F.slice(nodes, i + 1, F.lit(3)), " ")))
    return F.substring(_first(run, lambda x: x.isNotNull() & x.rlike(value)), 1, 500)


def with_detail_pay(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates with the salary (``pay``, a struct) that their detail page states in visible text; null if it has none or wasn't fetched.

    ``pages``: source_id, listing_key and payload; of several pages the
    smallest payload counts.
    """
    shown = pages.groupBy("source_id", "listing_key").agg(F.min("payload").alias("_payload"))
    joined = candidates.join(shown, ["source_id", "listing_key"], "left").withColumn("pay", salary_of(F.array_join(text_nodes(F.col("_payload")), "\n")))
    return joined.withColumn("pay", F.when(F.col("pay.currency").isNotNull(), F.col("pay"))).drop("_payload")


def company_pages(raw: DataFrame, *, site: str, starts: tuple[str, ...], stops: tuple[str, ...], title: str | None = None) -> DataFrame:
    """Detail pages of a company's own site (``job_id``, ``payload``): identity, postal_code, city, description, pay_text and error.

    With ``title`` (lower case) the place is the first "city, Austria" node
    between that node and the description, and pages without one are left
    out; else it is the last "code city ... AT" in a window of up to three
    nodes, and a missing place or description is an error.
    """
    # Behind a generator the filter below isn't pushed to where the pages are read, which would read each twice, and once in the tasks of a compact file.
    rows = raw.withColumn("_nodes", text_nodes(F.col("payload"))).select(*raw.columns, F.explode(F.array("_nodes")).alias("nodes")).withColumn("description", between(F.col("nodes"), starts, stops))
    identity = F.concat(F.lit(f"direct:{site}:"), "job_id")
    if title is not None:
        near = between(F.col("nodes"), (title,), starts)
        place = _first(F.split(F.coalesce(near, F.lit("")), "\n"), lambda x: x.rlike(r"(?i)^.+,\s*(?:austria|österreich|at)$"))
        rows = rows.withColumn("city", F.trim(F.regexp_extract(place, r"^(.+),[^,]*$", 1))).filter(F.coalesce(F.col("city"), F.lit("")) != "").withColumn("postal_code", F.lit(None).cast("string"))
    else:
        pattern = r"(?i)\b(\d{4})\s+([\p{L}][\p{L}\s./-]*?),?\s+(?:AT|Austria|Österreich)\b"
        place = _first(windows_from_end(F.col("nodes")), lambda x: x.rlike(pattern))
        rows = rows.withColumn("postal_code", F.nullif(F.regexp_extract(place, pattern, 1), F.lit(""))).withColumn("city", F.nullif(F.trim(F.regexp_extract(place, pattern, 2)), F.lit("")))
    error = F.when(F.col("city").isNull(), "no_place").when(F.col("description").isNull(), "no_description")
    return rows.select(identity.alias("identity"), "postal_code", "city", "description", pay_snippet(F.col("nodes")).alias("pay_text"), error.alias("error"))


CARD_AREA = r"(?i)([\d.]+(?:,\d+)?)\s*m²\s*(wohnfläche|grundfläche|nutzfläche)"
PRICE = r"€\s*([\d.]+(?:,\d{2})?)"


def broker_cards(raw: DataFrame, link: str) -> DataFrame:
    """One row per listing of search pages: listing_id, title, postal_code, city, price, living, plot, usable and ``whole``.

    A listing's links (``link``: a pattern whose group is its id) are one
    card; the longest text that can be read counts. The place is the last
    code before the area and what stands between, the price what follows the
    area, else any; its label says which area it is. Unreadable cards keep
    their longest text as title, and ``whole`` is false.
    """
    found = F.regexp_extract_all("payload", F.lit(r'(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>'), 0)
    rows = raw.select(F.explode(found).alias("a")).select(F.regexp_extract("a", link, 1).alias("listing_id"), F.array_join(text_nodes(F.col("a")), " ").alias("text")).filter("listing_id <> ''")
    head = r"(?is)^(.*\b|)(\d{4})\s+([^\d]+?)\s*[\d.]+(?:,\d+)?\s*m²\s*(?:wohnfläche|grundfläche|nutzfläche)"
    read = rows.withColumn("whole", F.col("text").rlike(head))
    best = read.groupBy("listing_id").agg(F.max_by("text", F.struct("whole", F.length("text"), "text")).alias("text"), F.bool_or("whole").alias("whole"), F.count("*").alias("n_links"))
    best = best.withColumn("head", F.when(F.col("whole"), F.struct(*(F.trim(F.regexp_extract("text", head, n)).alias(c) for n, c in enumerate(("title", "code", "city"), 1)))))
    best = best.withColumn("area", german_decimal(F.regexp_extract("text", CARD_AREA, 1))).withColumn("kind", F.when(F.col("whole"), F.lower(F.regexp_extract("text", CARD_AREA, 2))))
    after = F.regexp_extract("text", r"(?is)m²\s*(?:wohnfläche|grundfläche|nutzfläche)(.*)$", 1)
    best = best.withColumn("amount", F.coalesce(F.nullif(F.regexp_extract(after, PRICE, 1), F.lit("")), F.regexp_extract("text", PRICE, 1)))
    title = F.coalesce(F.nullif(F.regexp_replace("head.title", r"[\s–-]+$", ""), F.lit("")), F.lit("Haus zum Kauf"))
    return best.select(
        "listing_id", F.when(F.col("whole"), title).otherwise(F.col("text")).alias("title"), F.col("head.code").alias("postal_code"), F.regexp_replace("head.city", r"^[\s,]+|[\s,]+$", "").alias("city"),
        F.when(F.col("whole"), german_decimal(F.col("amount"))).alias("price"),
        *(F.when(F.col("kind") == label, F.col("area")).alias(name) for name, label in (("living", "wohnfläche"), ("plot", "grundfläche"), ("usable", "nutzfläche"))), "n_links", "whole",
    )


def enough_parsed(cards: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: cards, whole ones, and whether these are at least the share ``least``; false for no cards."""
    rows = cards.agg(F.count("*").alias("cards"), F.count_if("whole").alias("whole"))
    return rows.withColumn("sound", (F.col("cards") > 0) & (F.col("whole") >= F.col("cards") * least))


def with_details(cards: DataFrame, details: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """Cards with what their detail pages state (``listing_id``, ``shown_id`` and facts): it wins where it isn't null; a page of another id is an error and adds nothing."""
    d = details.select("listing_id", "shown_id", *(F.col(c).alias(f"_{c}") for c in facts))
    joined = cards.join(d, "listing_id", "left").withColumn("error", F.when(F.col("shown_id") != F.col("listing_id"), "other_id"))
    columns = [F.when(F.col("error").isNull(), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in facts else F.col(c) for c in cards.columns]
    return joined.select(*columns, "error")


def comparable_url(url: Column) -> Column:
    """A URL by which two are the same: lower-case scheme and host, no fragment and no slash at the end."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.regexp_replace(F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), r"#.*$", ""), r"/+$", "")))


def with_images(cards: DataFrame, images: DataFrame) -> DataFrame:
    """Cards with ``image``: of the first captured image (page, url, image) of exactly their URL, null if there is none."""
    first = images.groupBy(comparable_url(F.col("url")).alias("_url")).agg(F.min_by("image", "page").alias("image"))
    return cards.withColumn("_url", comparable_url(F.col("url"))).join(first, "_url", "left").drop("_url")


def seeded_tenants(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """Tenants (namespace, tenant_key, company, enabled, config as a map) after seeding: new ones are added, known ones only get the settings they lack."""
    keys = ["namespace", "tenant_key"]
    s = seeds.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("company", "enabled", "config")))
    joined = stored.withColumn("_known", F.lit(True)).join(s, keys, "full")
    own, new = F.coalesce("config", F.create_map().cast("map<string,string>")), F.coalesce("_config", F.create_map().cast("map<string,string>"))
    config = F.map_concat(own, F.map_filter(new, lambda k, _: ~F.array_contains(F.map_keys(own), k)))
    known = F.coalesce("_known", F.lit(False))
    return joined.select(*keys, F.when(known, F.col("company")).otherwise(F.col("_company")).alias("company"), F.when(known, F.col("enabled")).otherwise(F.col("_enabled")).alias("enabled"), config.alias("config"), (~known).alias("created"))
