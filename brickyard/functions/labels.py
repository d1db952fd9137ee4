"""How amounts, places and filters are written for readers, in German notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the labels.
PERIODS = {"month": "Monat", "year": "Jahr", "hour": "Stunde", "week": "Woche", "day": "Tag"}
ON_REQUEST = "Preis auf Anfrage"
NO_FILTER = "Keine zusätzlichen Filter"


def _german(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def whole(value: Column) -> Column:
    """A number without decimals (half to even, as in 2,5 and 3,5 to 2 and 4), thousands apart by dots."""
    return _german(F.format_number(F.bround(value.cast("decimal(18,4)"), 0).cast("decimal(18,0)"), 0))


def euros(value: Column) -> Column:
    """Euros without decimals where there are none, else with two."""
    exact = value.cast("decimal(18,4)")
    return F.concat(F.when(exact == F.floor(exact), whole(value)).otherwise(_german(F.format_number(F.bround(exact, 2).cast("decimal(18,2)"), 2))), F.lit(" €"))


def price_label(price: Column) -> Column:
    return F.when(price.isNull(), ON_REQUEST).otherwise(F.concat(F.lit("€ "), whole(price)))


def area_label(area: Column) -> Column:
    return F.concat(whole(area), F.lit(" m²"))


def salary_label(*, currency: Column, period: Column, low: Column, high: Column, least: Column, payments: Column, year_low: Column, year_high: Column) -> Column:
    """Pay in its own period, never multiplied; the annual bounds only where the source's own are unknown, null without any.

    ``least``: whether the low bound is all that is promised.
    """
    name = F.element_at(F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv)), F.lower(period))
    own = (F.upper(currency) == "EUR") & name.isNotNull() & (low.isNotNull() | high.isNotNull())
    ab = F.when(F.coalesce(least, F.lit(False)), "ab ").otherwise("")
    both = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    span = lambda a, b: F.concat(euros(a), F.lit(" – "), euros(b))
    amount = F.when(both(low, high), span(low, high)).when(low.isNotNull(), F.concat(ab, euros(low))).otherwise(F.concat(F.lit("bis "), euros(high)))
    times = F.when((F.lower(period) == "month") & (F.coalesce(payments, F.lit(0)) != 0), F.concat(F.lit(" · "), payments.cast("string"), F.lit("×"))).otherwise("")
    year = F.coalesce(year_low, year_high)
    annual = F.concat(F.when(both(year_low, year_high), span(year_low, year_high)).otherwise(F.concat(ab, euros(year))), F.lit(" / Jahr"))
    return F.when(F.coalesce(own, F.lit(False)), F.concat(amount, F.lit(" / "), name, times)).when(year.isNotNull(), annual)


def place_label(postal_code: Column, city: Column, text: Column, remote: Column) -> Column:
    """"Code city", else the text as the source has it, with "Remote" where it is; null without anything."""
    given = lambda c: F.nullif(c, F.lit(""))
    base = F.coalesce(given(F.concat_ws(" ", given(postal_code), given(city))), given(F.trim(text)))
    return F.when(F.coalesce(remote, F.lit(False)), F.concat_ws(" · ", base, F.lit("Remote"))).otherwise(base)


def filter_summary(*, place: Column, radius_km: Column, price: tuple[Column, Column], areas: dict[str, tuple[Column, Column]]) -> Column:
    """The chosen filters in one line; ``areas`` names each area's bounds."""
    km = radius_km.cast("decimal(9,3)")
    # Decimals of a distance stand as they are, with a point.
    distance = F.when(km == F.floor(km), whole(radius_km)).otherwise(F.regexp_replace(km.cast("string"), "0+$", ""))
    where = F.when(F.coalesce(place, F.lit("")) != "", F.concat(place, F.coalesce(F.concat(F.lit(" · Umkreis "), distance, F.lit(" km")), F.lit(""))))
    low, high = price
    cost = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("Preis "), whole(low), F.lit("–"), whole(high), F.lit(" €"))).when(low.isNotNull(), F.concat(F.lit("Preis ab "), whole(low), F.lit(" €"))).when(high.isNotNull(), F.concat(F.lit("Preis bis "), whole(high), F.lit(" €")))
    bound = lambda name, word, c: F.concat(F.lit(f"{name} {word} "), whole(c), F.lit(" m²"))
    sizes = [bound(name, word, c) for name, (a, b) in areas.items() for word, c in (("ab", a), ("bis", b))]
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(where, cost, *sizes)), " · "), F.lit("")), F.lit(NO_FILTER))
