"""Queries on feeds: each row of a table becomes a raw payload as a source would send it, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions import facts, geo, labels, salary, text
from brickyard.operators import sync
from brickyard.sources import boards, homes, jobs

from .registry import dealt, query, table


def _parts(spark, d) -> DataFrame:
    return dealt(spark, d, "part", "p_partkey")


def _part() -> Column:
    return F.col("p_partkey")


def _size() -> Column:
    return F.col("p_size")



def _s(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(x)


def _cat(*parts) -> Column:
    return F.concat(*(_s(x) for x in parts))


def _json(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _payload(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "true"})


def _of(rows: DataFrame) -> DataFrame:
    """The columns that are compared: places as one text, pay as doubles."""
    place = F.array_join(F.transform("locations", lambda p: F.concat(F.coalesce(p["city"], F.lit("")), F.lit("/"), F.coalesce(p["postal_code"], F.lit("")))), ";")
    return rows.select("listing_key", "title", "url", "company", place.alias("places"), "currency", "period", F.col("salary_min").cast("double"), F.col("salary_max").cast("double"), "identity")


NONE = "NULL::VARCHAR AS currency, NULL::VARCHAR AS period, NULL::DOUBLE AS salary_min, NULL::DOUBLE AS salary_max, NULL::VARCHAR AS identity"


@query("""SELECT 'l' || p_partkey AS listing_key, p_name AS title, 'https://l/' || p_partkey AS url, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Wien, Austria/;Graz/' ELSE 'Linz/' END AS places,
CASE WHEN p_size % 3 <> 2 THEN 'EUR' END AS currency, CASE p_size % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' END AS period, CASE WHEN p_size % 3 <> 2 THEN p_size * 100 END::DOUBLE AS salary_min, CASE WHEN p_size % 3 <> 2 THEN p_size * 200 END::DOUBLE AS salary_max, NULL::VARCHAR AS identity
FROM part WHERE p_size % 5 <> 0 OR p_size % 2 = 0""")
def lever_postings(spark, d):
    pay = F.when(_size() % 3 != 2, _json(min=_size() * 100.0, max=_size() * 200.0, currency=F.lit("EUR"), interval=F.when(_size() % 3 == 0, "per-year-salary").otherwise("per-month-salary")))
    places = F.when(_size() % 2 == 0, _json(allLocations=F.array(F.lit("Wien, Austria"), F.lit("Graz")), location=F.lit("x"))).otherwise(_json(allLocations=F.array().cast("array<string>"), location=F.lit("Linz")))
    posting = _json(id=_cat("l", _part()), text=F.col("p_name"), hostedUrl=_cat("https://l/", _part()), country=F.when(_size() % 5 == 0, "DE").otherwise("AT"), descriptionPlain=F.lit("d"), categories=places, salaryRange=pay)
    return _of(jobs.lever(_parts(spark, d).select(F.col("p_brand").alias("company"), _payload(F.array(posting)).alias("payload"))))


# Two ranges, of which one is Austrian (size % 3 = 0), both are equal (1), or they differ (2); pay under 10,000 a year isn't plausible.
@query("""WITH p AS (SELECT *, p_size * 1000.0 AS low FROM part) SELECT p_partkey::VARCHAR AS listing_key, p_name AS title, 'https://g/' || p_partkey AS url, p_brand AS company, 'Vienna, Austria/' AS places,
CASE WHEN low >= 10000 AND p_size % 3 < 2 THEN 'EUR' END AS currency, CASE WHEN low >= 10000 AND p_size % 3 < 2 THEN 'year' END AS period, CASE WHEN low >= 10000 AND p_size % 3 < 2 THEN low END::DOUBLE AS salary_min,
CASE WHEN low >= 10000 AND p_size % 3 < 2 THEN low + 5000 END::DOUBLE AS salary_max, NULL::VARCHAR AS identity FROM p WHERE p_size < 10 OR p_size % 3 < 2 OR p_size % 3 = 2""")
def greenhouse_postings(spark, d):
    def pay(title, more):
        return _json(min_cents=((_size() * 1000 + 5000 + more) * 100).cast("long"), max_cents=((_size() * 1000 + more) * 100).cast("long"), currency_type=F.lit("EUR"), title=title)

    pair = F.array(pay(F.when(_size() % 3 == 0, "Annual pay Austria").otherwise("Annual pay"), F.lit(0)), pay(F.lit("Yearly pay range"), F.when(_size() % 3 == 1, 0).otherwise(F.when(_size() < 10, -100_000).otherwise(500))))
    posting = _json(id=_part().cast("long"), title=F.col("p_name"), absolute_url=_cat("https://g/", _part()), content=F.lit("c"), location=_json(name=F.lit("Vienna, Austria")), pay_input_ranges=pair)
    return _of(jobs.greenhouse(_parts(spark, d).select(F.col("p_brand").alias("company"), _payload(_json(jobs=F.array(posting))).alias("payload"))))


@query(f"""SELECT 's' || p_partkey AS listing_key, p_name AS title, 'https://s/' || p_partkey AS url, p_brand AS company, 'Linz/4020' AS places, {NONE.replace("NULL::VARCHAR AS identity", "'smartrecruiters:k' || p_size || ':jobad:' || p_partkey AS identity")} FROM part WHERE p_size % 4 <> 0""")
def smartrecruiters_postings(spark, d):
    posting = _json(id=_cat("s", _part()), name=F.col("p_name"), ref=_cat("https://s/", _part()), jobAdId=_s(_part()), company=_json(identifier=_cat(" k", _size()), name=F.col("p_brand")), location=_json(country=F.when(_size() % 4 == 0, "de").otherwise("AT"), city=F.lit("Linz"), postalCode=F.lit("4020")))
    return _of(jobs.smartrecruiters(_parts(spark, d).select(_payload(_json(content=F.array(posting))).alias("payload"))))


@query(f"""SELECT 'R-' || p_partkey AS listing_key, p_name AS title, 'https://w/job/x_R-' || p_partkey AS url, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Wien/;Linz/' ELSE 'Graz/;Wien/;Linz/' END AS places, {NONE.replace("NULL::VARCHAR AS identity", "'workday:t:s' || p_size || ':req:R-' || p_partkey AS identity")} FROM part""")
def workday_postings(spark, d):
    info = _json(title=F.col("p_name"), location=F.when(_size() % 2 == 0, "2 Locations").otherwise("Graz"), additionalLocations=F.array(F.lit("Wien"), F.lit("Linz"), F.lit("Wien")), jobReqId=F.when(_size() % 3 == 0, _cat("R-", _part())).otherwise(" "), externalUrl=_cat("https://w/job/x_R-", _part()))
    return _of(jobs.workday(_parts(spark, d).select(F.col("p_brand").alias("company"), F.lit("t").alias("tenant"), _cat("s", _size()).alias("site"), _payload(_json(jobPostingInfo=info)).alias("payload"))))


@query("""SELECT p_partkey::VARCHAR AS listing_key, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_retailprice::DECIMAL(12,2)::DOUBLE END AS salary_min, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'ESTIMATED' ELSE 'EXPLICIT' END END AS provenance,
CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 0.9 END END::DOUBLE AS confidence FROM part""")
def adzuna_results(spark, d):
    result = _json(id=_s(_part()), title=F.col("p_name"), redirect_url=_cat("https://a/", _part()), company=_json(display_name=F.col("p_brand")), location=_json(display_name=F.lit("Wien")), salary_min=F.when(_size() % 2 == 0, F.col("p_retailprice")), salary_is_predicted=F.when(_size() % 3 == 0, "1").otherwise("0"))
    rows = jobs.adzuna(_parts(spark, d).select(_payload(_json(results=F.array(result))).alias("payload")))
    return rows.select("listing_key", "title", F.col("salary_min").cast("double"), "provenance", F.col("confidence").cast("double"))


@query(f"SELECT p_partkey::VARCHAR AS listing_key, p_name AS title, 'https://j/' || p_partkey AS url, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Linz/4020' ELSE 'Wels/' END AS places, {NONE} FROM part")
def jooble_results(spark, d):
    result = _json(id=_s(_part()), title=F.col("p_name"), link=_cat("https://j/", _part()), company=F.col("p_brand"), location=F.when(_size() % 2 == 0, "4020 Linz").otherwise("Wels"), snippet=F.lit("s"), salary=F.lit("3.000 EUR"))
    return _of(jobs.jooble(_parts(spark, d).select(_payload(_json(jobs=F.array(result))).alias("payload"))))


# Offices by p_partkey % 8: a known place; Vienna inside a venue's name; abroad with four digits; a place inside a longer known one, with a code;
# Austria by name only; two places; a district that says Austria; a known name inside a longer word.
@query(f"""WITH o AS (SELECT *, p_partkey % 150 AS m, 'ort' || (p_partkey % 150) AS one, 'ort' || (p_partkey % 150 + 1) AS two FROM part),
k AS (SELECT o.*, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = m) AS k1, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = m + 1) AS k2, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = m AND s_suppkey % 2 = 0) AS bad FROM o),
p AS (SELECT *, CASE p_partkey % 8 WHEN 0 THEN CASE WHEN k1 THEN one || '/' END WHEN 1 THEN 'wien/' WHEN 3 THEN CASE WHEN bad THEN 'bad ' || one || '/4820' WHEN k1 THEN one || '/4820' END WHEN 4 THEN 'Hohenberg/3192'
  WHEN 5 THEN CASE WHEN k1 AND k2 THEN CASE WHEN length(two) > length(one) OR length(two) = length(one) AND two < one THEN two || '/;' || one || '/' ELSE one || '/;' || two || '/' END WHEN k1 THEN one || '/8010' WHEN k2 THEN two || '/8010' END WHEN 6 THEN 'Linz-Land/' END AS places FROM k)
SELECT 'p:' || p_partkey AS listing_key, CASE WHEN p_size % 2 = 0 THEN 'de ' ELSE 'en ' END || p_partkey AS title, 'https://p.jobs.personio.com/job/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '?language=de' ELSE '?language=en' END AS url, p_brand AS company,
CASE WHEN p_size % 2 = 0 THEN 'Aufgaben' || chr(10) || 'Geräte & Maße <b>' || chr(10) || chr(10) || 'Mehr' ELSE 'Tasks' END AS description, CASE WHEN p_size % 2 = 0 THEN 'Tasks' ELSE '' END AS extra, 'de,en' AS languages, p_type AS department, places, {NONE} FROM p WHERE places IS NOT NULL""")
def personio_positions(spark, d):
    m = _part() % 150
    offices = (
        _cat("Ort", m), "Austria Center Vienna", "Berlin 1010", _cat("Bad  Ort", m, " - 4820"), "Hohenberg, Österreich 3192", _cat("ORT", m, " / Ort", m + 1, " 8010"), "Linz-Land (Austria)", _cat("Neuort", m, "x Berlin"),
    )
    office = F.element_at(F.array(*(_s(x) for x in offices)), (_part() % 8 + 1).cast("int"))

    def feed(language, texts):
        head = _cat("<w><position><id>", _part(), f"</id><name>{language} ", _part(), "</name><department>", F.col("p_type"), "</department><office>", office, "</office><jobDescriptions>")
        return _parts(spark, d).select(F.lit("p").alias("tenant"), F.col("p_brand").alias("company"), F.lit(None).cast("string").alias("base_url"), F.lit(language).alias("language"), _cat(head, texts, "</jobDescriptions></position></w>").alias("payload"))

    block = "<jobDescription><name>Aufgaben</name><value><![CDATA[<p>Ger&auml;te &amp;amp; Ma&#223;e</p> &amp;lt;b&amp;gt;]]></value></jobDescription><jobDescription><name> Mehr </name><value/></jobDescription>"
    german = F.when(_size() % 2 == 0, block).otherwise("")
    known = table(spark, d, "supplier").select(F.explode(F.array(_cat("Ort", F.col("s_suppkey")), F.when(F.col("s_suppkey") % 2 == 0, _cat("Bad Ort", F.col("s_suppkey"))), F.lit("Wien"))).alias("name"))
    rows = jobs.personio(feed("de", german).unionByName(feed("en", "<jobDescription><value>Tasks</value></jobDescription>")), known)
    more = rows.select("listing_key", "description", F.array_join("extra_texts", "|").alias("extra"), F.array_join("languages", ",").alias("languages"), F.col("facts.department").alias("department"))
    return _of(rows).join(more, "listing_key")


@query(f"SELECT 'e-' || p_partkey AS listing_key, p_name AS title, 'https://c/job/e-' || p_partkey || '?x' AS url, p_brand AS company, 'Linz/' AS places, {NONE} FROM part")
def job_cards(spark, d):
    page = _cat('<a href="/job/e-', _part(), '?x"><h2>', F.col("p_name"), "</h2><p>", F.col("p_brand"), "</p> <span>Linz</span></a><a href='/y'>more</a>")
    return _of(jobs.cards(_parts(spark, d).select(page.alias("payload")), "https://c"))


@query("""SELECT p_partkey, p_name AS title, p_brand AS company, 'Linz/4020' AS places, CASE WHEN p_size % 3 <> 0 THEN 'EUR' END AS currency, CASE WHEN p_size % 2 = 0 THEN 'month' END AS period, CASE WHEN p_size % 3 <> 0 THEN p_size * 100 END::DOUBLE AS salary_min,
CASE WHEN p_size % 3 = 1 THEN p_size * 200 END::DOUBLE AS salary_max FROM part""")
def json_ld_postings(spark, d):
    value = F.when(_size() % 3 == 1, _cat('"minValue":', _size() * 100, ',"maxValue":"', _size() * 200, '"')).when(_size() % 3 == 2, _cat('"value":', _size() * 100)).otherwise('"minValue":0,"maxValue":-1')
    unit = F.when(_size() % 2 == 0, ',"unitText":"MONTH"').otherwise(',"unitText":"piece"')
    posting = _cat('{"@type":["JobPosting"],"title":"', F.col("p_name"), '","hiringOrganization":{"name":"', F.col("p_brand"), '"},"jobLocation":{"address":{"addressLocality":"Linz","postalCode":"4020"}},"baseSalary":{"currency":"EUR","value":{', value, unit, "}}}")
    page = _cat('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},', posting, "]}</script>")
    rows = _parts(spark, d).select("p_partkey", jobs.json_ld_posting(page).alias("j"))
    place = F.array_join(F.transform("j.locations", lambda p: F.concat(p["city"], F.lit("/"), p["postal_code"])), ";")
    return rows.select("p_partkey", "j.title", "j.company", place.alias("places"), "j.currency", "j.period", "j.salary_min", "j.salary_max")


@query("""SELECT 'o' || p_partkey AS listing_key, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Haus o' || p_partkey END AS title, (p_size * 10000 + 0.5)::DOUBLE AS price, p_size::DOUBLE AS living, '4020' AS postal_code, p_size % 4 <> 0 AS "full" FROM part WHERE p_size % 3 <> 0""")
def openimmo_homes(spark, d):
    head = _cat('<openimmo xmlns="x"><uebertragung umfang="', F.when(_size() % 4 == 0, "TEIL").otherwise("VOLL"), '"/><anbieter><immobilie><objektkategorie><vermarktungsart KAUF="', F.when(_size() % 3 == 0, "0").otherwise("true"), '"/><objektart><haus/></objektart></objektkategorie>')
    body = _cat("<geo><plz>4020</plz><ort>Linz</ort></geo><preise><kaufpreis>", _size() * 10000, ",50</kaufpreis></preise><flaechen><wohnflaeche>", _size(), "</wohnflaeche></flaechen>", F.when(_size() % 2 == 0, _cat("<freitexte><objekttitel>", F.col("p_name"), "</objekttitel></freitexte>")).otherwise(""))
    raw = _cat(head, body, "<verwaltung_techn><objektnr_extern>o", _part(), "</objektnr_extern></verwaltung_techn></immobilie></anbieter></openimmo>")
    rows = homes.openimmo(_parts(spark, d).select(raw.alias("payload")))
    return rows.select("listing_key", "title", F.col("price").cast("double"), F.col("living").cast("double"), "postal_code", "full")


# By p_size % 6: the link holds more than the title, it lies around the heading, it begins the title, it begins it with too little, it is another card's, and the price is missing.
# The area of the facts is the living area (p_size % 5 = 1), the plot while the text names another living area (2), the plot (3), or not known.
@query("""SELECT CASE WHEN p_size % 6 IN (0, 1, 2, 5) THEN 'https://h/' || p_partkey END AS url, 'Schönes Haus & Garten Nummer ' || p_partkey AS title, '4020' AS postal_code, 'Linz' AS city, p_size + 0.5::DOUBLE AS area, CASE WHEN p_size % 6 <> 5 THEN p_size * 1000 END::DOUBLE AS price,
CASE p_size % 5 WHEN 1 THEN 'living_explicit_primary' WHEN 2 THEN 'living_explicit_display_plot' WHEN 3 THEN 'plot_explicit_primary' ELSE 'unknown' END AS area_kind, p_size % 6 IN (0, 1, 2, 5) AS identity_stable FROM part""")
def home_cards(spark, d):
    name = _cat("Schönes Haus &amp; Garten Nummer ", _part())
    link = lambda label: _cat('<a href="https://h/', _part(), '">', label, "</a>")
    kind = _size() % 6
    after = F.when(kind == 0, link(_cat("Neu: ", name, " ansehen"))).when(kind == 2, link("Schönes <b>Haus</b> &amp; Garten")).when(kind == 3, link("Schönes")).when(kind == 4, link("Ein ganz anderes Haus am See")).when(kind == 5, link(name)).otherwise(link("mehr"))
    head = F.when(kind == 1, _cat('<a href="https://h/', _part(), '"><h3 class="t">', name, "</h3></a>")).otherwise(_cat("<h3>", name, "</h3>"))
    shown = _cat(_size(), ",5")
    areas = F.when(_size() % 5 == 1, _cat("<p>Wohnfläche: ", shown, " m²</p>")).when(_size() % 5 == 2, _cat("<p>Wohnfläche: ", _size() + 500, " m² Grundstück: ", shown, " m²</p>")).when(_size() % 5 == 3, _cat("<p>Grundstücksfläche ", shown, " m²</p>")).otherwise("")
    price = F.when(kind != 5, _cat("€ 50.000 geschenkt € ", F.translate(F.format_number(_size() * 1000, 0), ",", "."))).otherwise("auf Anfrage")
    card = _cat(head, "<p>", price, "</p><p>4020 Linz / ", shown, " m²</p>", areas, "<p>Miete € 900</p>", after)
    rows = homes.search_cards(_parts(spark, d).select(_part().alias("page"), _cat("<div>", card).alias("payload")))
    return rows.select("url", "title", "postal_code", "city", F.col("area").cast("double"), F.col("price").cast("double"), "area_kind", "identity_stable")


@query("SELECT lpad((p_partkey % 9999)::VARCHAR, 4, '0') AS postal_code, arg_max(p_name, p_partkey) AS name FROM part WHERE p_size % 4 <> 0 AND p_partkey % 9999 > 0 GROUP BY 1")
def postal_names(spark, d):
    entry = _json(plz=_s(_part() % 9999), ort=F.col("p_name"), adressierbar=F.when(_size() % 4 == 0, "Nein").otherwise("Ja"))
    listed = _parts(spark, d).filter("p_partkey % 9999 > 0").select(F.struct(_part().alias("k"), entry.alias("e")).alias("x")).groupBy((F.col("x.k") % 9999).alias("code")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("e"))
    return homes.postal_names(listed.select(_payload(_json(data=F.col("e"))).alias("payload")))


@query("""SELECT p_partkey, 'Gehälter ab ' || p_size || ' € – <b>brutto</b> & mehr' AS shown, CASE p_partkey % 3 WHEN 0 THEN '4020' WHEN 1 THEN '4021' END AS code, CASE WHEN p_size % 2 = 0 THEN 'is24:x' || p_partkey END AS provider FROM part""")
def page_texts(spark, d):
    page = _cat("<style>p{}</style><script>var a='<b>';</script> <p title='a > b'>Geh&auml;lter ab&nbsp;", _size(), " &euro; &#8211;</p><!-- x > y --> &lt;b&gt;brutto&amp;lt;/b&amp;gt; &amp; <b>mehr</b><script>rest")
    name = F.when(_part() % 2 == 0, "bad ischl").otherwise("St. Johann (Tirol)")
    shown = F.when(_part() % 2 == 0, "Bad Ischl").otherwise("St. Johann  (Tirol)")
    where = F.when(_part() % 3 == 0, _cat("A-4020 ", shown, ", 4020  ", shown)).when(_part() % 3 == 1, _cat("In 4021 ", shown, ".")).otherwise(_cat("4020 ", shown, " 4021 ", shown))
    url = _cat(F.when(_size() % 2 == 0, "https://www.IS24.at/expose/X").otherwise("https://other.at/expose/X"), _part(), "?q=1")
    return _parts(spark, d).select("p_partkey", text.visible_text(page).alias("shown"), text.postal_beside(where, name).alias("code"), text.provider_identity(url, ("www.is24.at",), r"^/expose/([a-z0-9]+)", "is24").alias("provider"))


KEYS = {"explicit": "$.id", "ad_tenant": "$.t", "ad_id": "$.ad", "req_tenant": "$.t", "req_site": "$.s", "req_id": "$.r"}


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'x' || p_partkey WHEN 1 THEN 'smartrecruiters:t:jobad:' || p_partkey WHEN 2 THEN 'workday:t:s:req:' || p_partkey END AS identity, p_size % 3 <> 0 AND p_size % 7 <> 0 AS stable, p_size % 5 = 0 AS is_true, p_size % 2 = 0 AS has_alias FROM part""")
def payload_facts(spark, d):
    payload = _payload(_json(
        id=F.when(_size() % 4 == 0, _cat("x", _part())).when(_size() % 4 == 1, " "), t=F.lit("t"), ad=F.when(_size() % 4 == 1, _s(_part())), s=F.lit("s"), r=F.when(_size() % 4 == 2, _s(_part())), identity_stable=F.when(_size() % 3 == 0, False), original_url_missing=F.when(_size() % 7 == 0, True),
    ))
    flag = F.when(_size() % 5 == 0, '{"f":true}').otherwise('{"f":"true"}')
    said = F.when(_size() % 2 == 0, "we use c plus plus here").otherwise("we use c plusplus")
    return _parts(spark, d).select("p_partkey", text.job_identity(payload, KEYS).alias("identity"), sync.stable(payload).alias("stable"), text.json_true(flag, "f").alias("is_true"), text.contains_alias(said, F.lit("c plus plus")).alias("has_alias"))


@query("""SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS same, CASE WHEN p_size % 2 = 0 THEN 'Haus mit Garten in Linz ' || p_partkey ELSE 'Haus mit Garten' END AS title, replace(format('{:,}', p_size * 1000), ',', '.') || ' €' AS price, 'strasse ' || p_size AS folded FROM part""")
def detail_facts(spark, d):
    detail = F.when(_size() % 2 == 0, _cat("Haus mit Garten in Linz ", _part())).otherwise("Wohnung")
    same = facts.facts_match(F.lit("1"), F.lit("1"), F.lit("4020"), F.when(_size() % 3 == 0, "4021"), detail, F.lit("Haus mit Garten"))
    return _parts(spark, d).select("p_partkey", same.alias("same"), facts.safer_title(F.lit("Haus mit Garten"), detail).alias("title"), text.eur_label(_size() * 1000).alias("price"), text.folded_title(_cat(" Straße  ", _size())).alias("folded"))


@query("""SELECT p_partkey, p_size || ',5' AS living, CASE WHEN p_size % 2 = 0 THEN '1.' || lpad(p_size::VARCHAR, 3, '0') END AS plot, CASE WHEN p_size % 3 = 0 THEN '{"__typename": "A", "n": ' || p_size || '}' END AS found FROM part""")
def page_areas(spark, d):
    said = _cat("Wohnfläche: ", _size(), ",5 m² ", F.when(_size() % 2 == 0, _cat("1.", F.lpad(_s(_size()), 3, "0"), " m² Grundstück")).otherwise("77 m² Garten"))
    areas = facts.label_values(said, {"living": "Wohnfläche", "plot": "Grundstück"})
    source = _cat('x "k": {"__typename": "B", "n": {"a": "}"}}, "k": {"__typename": "', F.when(_size() % 3 == 0, "A").otherwise("C"), '", "n": ', _size(), "}")
    return _parts(spark, d).select("p_partkey", *(v.alias(k) for k, v in areas.items()), facts.typed_object(source, F.lit("k"), F.lit("A")).alias("found"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 2000 WHEN 1 THEN 3000 END::DOUBLE AS minimum, CASE WHEN p_size % 3 = 0 THEN 4000 END::DOUBLE AS maximum, CASE WHEN p_size % 3 = 0 THEN 'EUR' END AS currency FROM part""")
def salary_enriched(spark, d):
    # A stored minimum of 3,000 contradicts the text, so that row stays as it is; where there is no salary in the text there is nothing to add.
    said = salary.salary_of(F.when(_size() % 3 < 2, "Monatsgehalt von 2.000 EUR bis 4.000 EUR").otherwise("Gehalt nach Vereinbarung"))
    rows = _parts(spark, d).select("p_partkey", F.when(_size() % 3 == 1, 3000).cast("decimal(12,2)").alias("old"), said.alias("s"))
    none = F.lit(None)
    new = salary.enriched({"minimum": F.col("old"), "maximum": none.cast("decimal(12,2)"), "currency": none.cast("string")}, {"minimum": F.col("s.minimum"), "maximum": F.col("s.maximum"), "currency": F.col("s.currency")})
    return rows.select("p_partkey", new["minimum"].cast("double").alias("minimum"), new["maximum"].cast("double").alias("maximum"), new["currency"].alias("currency"))


# Great-circle series on the ellipsoid, written out in SQL from the published formula.
@query("""WITH p AS (SELECT c_custkey, radians(9.5 + c_custkey % 70 / 10.0) AS o1, radians(46.5 + c_custkey % 25 / 10.0) AS a1, radians(9.5 + c_custkey % 67 / 10.0) AS o2, radians(46.5 + c_custkey % 23 / 10.0) AS a2 FROM customer),
b AS (SELECT *, atan((1 - 1 / 298.257223563) * tan(a1)) AS b1, atan((1 - 1 / 298.257223563) * tan(a2)) AS b2 FROM p),
s AS (SELECT *, 2 * asin(sqrt(sin((b2 - b1) / 2) ^ 2 + cos(b1) * cos(b2) * sin((o2 - o1) / 2) ^ 2)) AS s FROM b),
q AS (SELECT *, (s - sin(s)) * sin((b1 + b2) / 2) ^ 2 * cos((b2 - b1) / 2) ^ 2 / cos(s / 2) ^ 2 AS x, (s + sin(s)) * cos((b1 + b2) / 2) ^ 2 * sin((b2 - b1) / 2) ^ 2 / sin(s / 2) ^ 2 AS y FROM s)
SELECT c_custkey, CASE WHEN s = 0 THEN 0 ELSE round(6378137.0 * (s - 1 / 298.257223563 / 2 * (x + y)), 1) END AS metres FROM q""")
def ellipsoid_metres(spark, d):
    c = F.col("c_custkey")
    at = lambda base, n: F.lit(base) + c % n / 10.0
    return table(spark, d, "customer").select("c_custkey", F.round(geo.geodesic_m(at(9.5, 70), at(46.5, 25), at(9.5, 67), at(46.5, 23)), 1).alias("metres"))


LONG = "lange Beschreibung einer Stelle mit vielen Aufgaben und noch mehr Wörtern"


# Places by p_size % 9: a city and its region, a region and its city, a country, two sources' words for abroad, a code, two regions, a city that has a region's name after another.
@query(f"""SELECT p_partkey, 'Job & ' || p_name AS title, p_brand AS company, CASE p_size % 9 WHEN 0 THEN 'Linz' WHEN 1 THEN 'Wels' WHEN 5 THEN 'Steyr' WHEN 7 THEN 'Linz' WHEN 8 THEN 'Klagenfurt am Wörthersee' END AS city, CASE p_size % 9 WHEN 5 THEN '4400' END AS postal_code,
CASE p_partkey % 3 WHEN 0 THEN 'vor 3 Tagen ' || '{LONG}' WHEN 1 THEN 'Heute suchen wir: ' || '{LONG}' WHEN 2 THEN '{LONG} ' || p_partkey END AS description FROM part WHERE p_size % 9 NOT IN (3, 4)""")
def stepstone_cards(spark, d):
    places = ("Linz, Oberösterreich", "Oberösterreich, Wels", "Österreich", "Brno, Tschechien", "München", "4400 Steyr, OÖ", "Wien, Salzburg", "Wien, Linz", "Klagenfurt am W&ouml;rthersee, Kärnten")
    place = F.element_at(F.array(*map(F.lit, places)), (_size() % 9 + 1).cast("int"))
    text = F.when(_part() % 3 == 0, f"vor 3 Tagen {LONG}").when(_part() % 3 == 1, f"Heute suchen wir: {LONG}").otherwise(_cat(f"{LONG} ", _part()))
    link = _cat('href="/stellenangebote--', F.lit("x-y"), "--", _part(), '-inline.html?a=1"')
    page = _cat("<a ", link, "><div>.res-1a {display: none}</div></a><span>lost</span><a class=t ", link, "><div>@media x {a:b} Job &amp; ", F.col("p_name"), "</div></a><span>Neu</span><b>", F.col("p_brand"), "</b><a href='/x'>Mehr</a><i>", place, "</i><i>vor 3 Tagen</i><p>kurz</p><p>", text, "</p>")
    rows = boards.stepstone(_parts(spark, d).select(_cat("<div>", page).alias("payload")))
    return rows.select(F.col("job_id").cast("long").alias("p_partkey"), "title", "company", "city", "postal_code", "description")


@query(f"""SELECT p_partkey, p_name AS title, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN '4020' END AS postal_code, CASE p_size % 4 WHEN 0 THEN 'Linz' WHEN 1 THEN 'Wels' WHEN 2 THEN 'Linz' END AS city, '12.03.' AS published,
'{LONG * 2} ' || p_partkey AS description FROM part""")
def willhaben_cards(spark, d):
    name = F.when(_size() % 3 == 0, _cat(F.col("p_brand"), " Jobs")).otherwise(F.col("p_brand"))
    metas = ("12.03. | Vollzeit, Freiberuflich, 4020 Linz, Teilzeit", "12.03. |Wels, Geringfügig", "12.03. | 4020 Linz", "12.03. | Traineeship, Vollzeit")
    meta = F.element_at(F.array(*map(F.lit, metas)), (_size() % 4 + 1).cast("int"))
    page = _cat('<a href="https://www.willhaben.at/jobs/job/a-b/', _part(), '">', F.col("p_name"), "<em>Neu - bewirb dich gleich</em></a><i>Merken</i><b>", name, "</b><p>", meta, f"</p><p>{LONG * 2} ", _part(), f"</p><p>{LONG * 2}</p>")
    rows = boards.willhaben(_parts(spark, d).select(page.alias("payload")))
    return rows.select(F.col("job_id").cast("long").alias("p_partkey"), "title", "company", "postal_code", "city", "published", "description")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Bruttogehalt ' || p_partkey || ' EUR pro Monat' WHEN 1 THEN 'Gehalt laut KV € ' || p_partkey || ' / Jahr x' WHEN 3 THEN 'Mindestentgelt: siehe a b € ' || p_partkey || ' jährlich' END AS pay_text FROM part""")
def board_pay(spark, d):
    texts = (
        _cat("<p>Gehalt nach Vereinbarung</p><p>ok</p><p>ok</p><b>Bruttogehalt</b> <i>", _part(), "&nbsp;EUR pro Monat</i>"), _cat("<p>Gehalt laut KV</p><p>€ ", _part(), "</p><p>/ Jahr x</p>"),
        _cat("<script>Gehalt 1 EUR monatlich</script><p>", _part(), " EUR monatlich</p>"), _cat("<p>Mindestentgelt: siehe</p><p>a</p><p>b</p><p>€ ", _part(), "</p><p>j&auml;hrlich</p>"),
    )
    rows = boards.willhaben_pay(_parts(spark, d).select("p_partkey", F.element_at(F.array(*texts), (_size() % 4 + 1).cast("int")).alias("payload")))
    return rows.select("p_partkey", "pay_text")


# By p_size % 6: a place of the data without a code that the page prints, two codes on the page, no data but a Dienstort, no data but a header line, none of these, a place with a code.
@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Bad Ischl/4820' WHEN 1 THEN 'Linz/' WHEN 2 THEN 'Steyr/4400' WHEN 3 THEN 'Klagenfurt/9020' WHEN 4 THEN '' ELSE 'Wels/4600' END AS places FROM part""")
def detail_places(spark, d):
    data = lambda city, code="": f'<script type="application/ld+json">{{"@type":"JobPosting","title":"x","jobLocation":[{{"address":{{"addressLocality":"{city}"{code}}}}}]}}</script>'
    bare = '<script type="application/ld+json">{"@type":"JobPosting","title":"x","jobLocation":[]}</script>'
    texts = (
        data("Bad Ischl") + "<p>Kommen Sie nach A-4820 Bad&nbsp;Ischl!</p>", data("Linz") + "<p>4020 Linz oder 4030 Linz</p>", bare + "<p>Dienstort</p><p>Steyr</p><p>4400 Steyr</p>",
        bare + "<h2>Maler - 3 - Team</h2><p>9020 Klagenfurt, Kärnten - vor 2 Tagen</p>", "<p>Maler - Anstreicher</p>", data("Wels", ',"postalCode":"4600"') + "<p>4020 Wels</p>",
    )
    rows = boards.detail_places(_parts(spark, d).select("p_partkey", F.element_at(F.array(*map(F.lit, texts)), (_size() % 6 + 1).cast("int")).alias("payload")))
    return rows.select("p_partkey", F.array_join(F.transform("places", lambda p: F.concat(F.coalesce(p["city"], F.lit("")), F.lit("/"), F.coalesce(p["postal_code"], F.lit("")))), ";").alias("places"))


# A region without a point is repaired unless the header names a region too; a concrete city and a row with a point stay.
@query("""SELECT p_partkey AS job_id, CASE WHEN p_size % 5 < 2 AND p_partkey % 3 <> 1 THEN 'Klagenfurt' WHEN p_size % 5 = 0 THEN 'Kärnten' WHEN p_size % 5 = 2 THEN 'Villach' WHEN p_size % 5 = 3 THEN 'Tirol' END AS city,
CASE WHEN p_size % 5 < 2 AND p_partkey % 3 = 0 THEN '9020' END AS postal_code, p_size % 5 < 2 AND p_partkey % 3 <> 1 AS repaired FROM part WHERE p_size % 5 <> 4""")
def repaired_places(spark, d):
    size, k = _size(), _part()
    rows = _parts(spark, d).filter("p_size % 5 <> 4").select(k.alias("job_id"), F.when(size % 5 == 0, "Kärnten").when(size % 5 == 2, "Villach").when(size % 5 == 3, "Tirol").alias("city"), F.lit(None).cast("string").alias("postal_code"), F.lit("Kärnten").alias("location_text"), F.when(size % 5 == 3, 14.0).alias("lon"))
    line = F.when(k % 3 == 0, "9020 Klagenfurt, Kärnten - gestern").when(k % 3 == 1, "Kärnten - heute").otherwise("Klagenfurt - Online gestellt vor 1 Tag")
    pages = _parts(spark, d).select(k.alias("job_id"), _cat("<h1>x</h1><p>", line, "</p>").alias("payload"))
    return boards.repaired_places(rows, pages).select("job_id", "city", "postal_code", "repaired")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'req:R' || p_partkey WHEN p_size % 3 = 0 THEN 'posting:' || p_partkey END AS identity, CASE WHEN p_size % 5 = 0 THEN 'Linz;Wels' ELSE 'Graz' END AS cities, 'Wir suchen' || chr(10) || p_name AS description,
CASE WHEN p_size % 2 <> 0 AND p_size % 3 <> 0 THEN 'no_id' END AS error FROM part""")
def successfactors_pages(spark, d):
    place = F.when(_size() % 5 == 0, "Linz, AT; München, DE; Wels, Austria; Linz, AT").otherwise("Graz, Österreich")
    page = _cat("<h1>x</h1><p>Arbeitsort: ", place, "</p><p>Beschreibung:</p><p>Wir suchen</p><p>", F.col("p_name"), "</p>", F.when(_size() % 2 == 0, _cat("<b>Stellenanforderungs-ID:</b><i>R", _part(), "</i>")).otherwise("<b>Similar Jobs</b>"))
    rows = boards.successfactors(_parts(spark, d).select(_cat("https://sf/job/", F.when(_size() % 3 == 0, _s(_part())).otherwise(_cat("p", _part())), "#", _part()).alias("url"), page.alias("payload")))
    return rows.select(F.regexp_extract("url", r"#(\d+)$", 1).cast("long").alias("p_partkey"), "identity", F.array_join("cities", ";").alias("cities"), "description", "error")


@query("""SELECT 'direct:a:' || p_partkey AS identity, 'Marchtrenk' AS city, p_name AS description, CASE WHEN p_size % 2 = 0 THEN 'Gehalt ab 3.000 Euro' END AS pay_text FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT 'direct:b:' || p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'Elsbethen/Glasenbach' END, CASE WHEN p_size % 5 <> 0 THEN p_name END, NULL FROM part""")
def company_site_jobs(spark, d):
    first = _cat("<h1>Join Team Possible!</h1><h2>Title</h2><p>", F.when(_size() % 3 == 0, "Worldwide").otherwise("Marchtrenk, Austria"), "</p><h3>Your tasks:</h3><p>", F.col("p_name"), "</p><h3>Offer</h3>", F.when(_size() % 2 == 0, "<b>Gehalt</b><i>ab 3.000</i><i>Euro</i>").otherwise("<b>gratis Obst</b>"))
    second = _cat(F.when(_size() % 5 == 0, "").otherwise(_cat("<h3>Your tasks:</h3><p>", F.col("p_name"), "</p>")), "<h3>Offer</h3>", F.when(_size() % 3 == 0, "").otherwise("<p>Moosstraße 1, 5061 Elsbethen/Glasenbach</p><p>AT</p>"), "<p>footer</p>")
    pages = lambda x: _parts(spark, d).select(_s(_part()).alias("job_id"), x.alias("payload"))
    labels = {"starts": ("your tasks:",), "stops": ("offer",)}
    both = boards.company_pages(pages(first), site="a", title="join team possible", **labels).unionByName(boards.company_pages(pages(second), site="b", **labels))
    return both.select("identity", "city", "description", "pay_text")


@query("""SELECT p_partkey AS listing_id, CASE WHEN p_size % 3 <> 0 THEN 'Haus ' || p_partkey || ' mit Garten' ELSE 'Haus ohne Angaben' END AS title, CASE WHEN p_size % 3 <> 0 THEN '4020' END AS postal_code, CASE WHEN p_size % 3 <> 0 THEN 'Linz' END AS city, CASE WHEN p_size % 3 <> 0 THEN p_size * 1000 END::DOUBLE AS price,
CASE WHEN p_size % 3 = 1 THEN p_size + 0.5 END::DOUBLE AS living, CASE WHEN p_size % 3 = 2 THEN p_size + 0.5 END::DOUBLE AS plot, 2 AS n_links, p_size % 3 <> 0 AS whole FROM part""")
def broker_cards(spark, d):
    return _cards(spark, d).select(F.col("listing_id").cast("long"), "title", "postal_code", "city", *(F.col(c).cast("double") for c in ("price", "living", "plot")), "n_links", "whole")


def _cards(spark, d) -> DataFrame:
    facts = F.when(_size() % 3 == 0, "Haus ohne Angaben").otherwise(_cat("Haus ", _part(), " mit Garten – 4020 Linz ", _size(), ",5 m² ", F.when(_size() % 3 == 1, "Wohnfläche").otherwise("Grundfläche"), " € ", F.translate(F.format_number(_size() * 1000, 0), ",", ".")))
    link = lambda x: _cat('<a class="c" href="/haus/id-', _part(), '">', x, "</a>")
    return boards.broker_cards(_parts(spark, d).select(_cat(link(F.lit("<img> mehr")), link(facts), '<a href="/kontakt">Kontakt</a>').alias("payload")), r"(?is)/haus/id-(\d+)")


@query("SELECT count(*) AS cards, count(*) FILTER (p_size % 3 <> 0) AS whole, count(*) FILTER (p_size % 3 <> 0) >= count(*) * 0.9 AS sound FROM part")
def broker_scan(spark, d):
    return boards.enough_parsed(_cards(spark, d))


@query("""SELECT p_partkey AS listing_id, CASE WHEN p_size % 2 = 0 THEN 99 WHEN p_size % 3 = 1 THEN p_size + 0.5 END::DOUBLE AS living, CASE WHEN p_size % 4 = 1 THEN 'other_id' END AS error FROM part""")
def broker_details(spark, d):
    details = _parts(spark, d).select(_s(_part()).alias("listing_id"), F.when(_size() % 4 == 1, "0").otherwise(_s(_part())).alias("shown_id"), F.when((_size() % 2 == 0) | (_size() % 4 == 1), 99).cast("decimal(14,2)").alias("living"))
    rows = boards.with_details(_cards(spark, d), details, ("living",))
    return rows.select(F.col("listing_id").cast("long"), F.col("living").cast("double"), "error")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'i' || p_partkey END AS image FROM part")
def card_images(spark, d):
    part = _parts(spark, d)
    cards = part.select("p_partkey", _cat("https://H.at/x/", _part(), "/#top").alias("url"))
    shots = lambda page, of: part.filter(_size() % 2 == 0).select(F.lit(page).alias("page"), _cat("HTTPS://h.at/x/", _part()).alias("url"), of.alias("image"))
    return boards.with_images(cards, shots(1, _cat("i", _part())).unionByName(shots(2, F.lit("later")))).select("p_partkey", "image")


@query("""SELECT 't' || p_partkey AS tenant_key, p_size % 2 = 0 AS known, CASE WHEN p_size % 2 = 0 THEN 'mine' ELSE p_brand END AS company, CASE WHEN p_size % 2 = 0 THEN 'own' ELSE 'seed' END AS a, CASE WHEN p_size % 3 <> 0 THEN 'seed' END AS b FROM part WHERE p_size % 2 = 0 OR p_size % 3 <> 0""")
def seeded_tenants(spark, d):
    part, key = _parts(spark, d), _cat("t", _part())
    stored = part.filter(_size() % 2 == 0).select(F.lit("n").alias("namespace"), key.alias("tenant_key"), F.lit("mine").alias("company"), F.lit(False).alias("enabled"), F.create_map(F.lit("a"), F.lit("own")).alias("config"))
    seeds = part.filter(_size() % 3 != 0).select(F.lit("n").alias("namespace"), key.alias("tenant_key"), F.col("p_brand").alias("company"), F.lit(True).alias("enabled"), F.create_map(F.lit("a"), F.lit("seed"), F.lit("b"), F.lit("seed")).alias("config"))
    rows = boards.seeded_tenants(stored, seeds)
    return rows.select("tenant_key", (~F.col("created")).alias("known"), "company", F.element_at("config", "a").alias("a"), F.element_at("config", "b").alias("b"))


# Pay of a year, a month (with 14 payments) or an hour, bounds, one bound, decimals, another currency with annual bounds; places and filters in words.
@query("""WITH v AS (SELECT *, p_size * 1000 AS a, p_size * 1000 + 500 AS b FROM part)
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN {a} || ' € – ' || {b} || ' € / Jahr' WHEN 1 THEN 'ab ' || {a} || ' € / Monat · 14×' WHEN 2 THEN 'bis ' || {b} || ' € / Stunde' WHEN 3 THEN {a} || ',50 € / Jahr' WHEN 4 THEN 'ab ' || {a} || ' € / Jahr' END AS pay,
CASE p_partkey % 4 WHEN 0 THEN '4020 Linz' WHEN 1 THEN 'Raum Linz · Remote' WHEN 2 THEN 'Remote' END AS place, CASE WHEN p_size % 3 = 0 THEN 'Preis auf Anfrage' ELSE '€ ' || {b} END AS price,
CASE WHEN p_size % 3 = 0 THEN 'Keine zusätzlichen Filter' WHEN p_size % 3 = 1 THEN 'Linz · Umkreis 25 km · Preis ' || {a} || '–' || {b} || ' € · Wohnfläche ab ' || {a} || ' m²' ELSE 'Linz · Umkreis 2.5 km · Preis ab ' || {a} || ' € · Grundstück bis ' || {b} || ' m²' END AS filters FROM v""".replace("{a}", "replace(format('{:,}', a), ',', '.')").replace("{b}", "replace(format('{:,}', b), ',', '.')"))
def labels_for_readers(spark, d):
    a, b, kind = _size() * 1000, _size() * 1000 + 500, _size() % 6
    pay = labels.salary_label(
        currency=F.when(kind == 4, "CHF").otherwise("EUR"), period=F.when(kind == 1, "month").when(kind == 2, "hour").otherwise("YEAR"), low=F.when(kind.isin(0, 1), a).when(kind == 3, a + F.lit(0.5)), high=F.when(kind.isin(0, 2), b), least=kind.isin(1, 4),
        payments=F.when(kind <= 1, 14), year_low=F.when(kind == 4, a), year_high=F.lit(None).cast("double"),
    )
    k = _part() % 4
    place = labels.place_label(F.when(k == 0, "4020"), F.when(k == 0, "Linz").otherwise(""), F.when(k <= 1, "Raum Linz "), k.isin(1, 2))
    third = _size() % 3
    some = lambda n, x: F.when(third == n, x)
    filters = labels.filter_summary(place=F.when(third > 0, "Linz").otherwise(""), radius_km=F.when(third == 1, 25.0).when(third == 2, 2.5), price=(F.when(third > 0, a), some(1, b)), areas={"Wohnfläche": (some(1, a), F.lit(None).cast("long")), "Grundstück": (F.lit(None).cast("long"), some(2, b))})
    return _parts(spark, d).select("p_partkey", pay.alias("pay"), place.alias("place"), labels.price_label(F.when(third != 0, b)).alias("price"), filters.alias("filters"))
