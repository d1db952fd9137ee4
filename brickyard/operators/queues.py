"""Work queues, guards over scanned pages, filters from requests, and the order of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest place name, and the radius in km, that a filter takes.
PLACE_LENGTH, RADIUS_KM = 120, (1, 250)
#: A page before the last is at least this full, and this share of its items has a postal code.
PAGE_FILL, CODE_SHARE = 0.75, 0.90


def detail_queue(listings: DataFrame, *, policy: str, now: Column, recheck_hours: int) -> DataFrame:
    """Active listings whose details are to be fetched, with ``position`` to be taken by: other policies first, then those longest unchecked, then the newest.

    ``listings``: listing_id, status, url_missing, policy, state, checked_at,
    first_seen_at. Those of the policy come again only where they failed or
    were missing, and were checked long enough ago.
    """
    due = F.col("checked_at").isNull() | (F.col("checked_at") <= now - F.expr(f"interval {recheck_hours} hours"))
    current = F.coalesce(F.col("policy") == policy, F.lit(False))
    rows = listings.filter((F.col("status") == "ACTIVE") & ~F.coalesce("url_missing", F.lit(False)))
    return rows.filter(~current | (F.col("state").isin("failed", "missing") & due)).withColumn("of_policy", current)


def detail_order() -> list[Column]:
    return [F.col("of_policy").asc(), F.col("checked_at").asc_nulls_first(), F.col("first_seen_at").desc(), F.col("listing_id").desc()]


def stale_pages(listings: DataFrame, *, now: Column, stale_minutes: int, limit: int) -> DataFrame:
    """The first ``limit`` shown listings by id whose page was last checked long ago or never."""
    rows = listings.filter((F.col("status") == "ACTIVE") & ~F.coalesce("url_missing", F.lit(False)) & F.coalesce("visible", F.lit(False)))
    old = F.col("checked_at").isNull() | (F.col("checked_at") <= now - F.expr(f"interval {max(1, stale_minutes)} minutes"))
    return rows.filter(old).orderBy("listing_id").limit(max(1, limit))


def source_order() -> list[Column]:
    """Enabled sources first, then by what they alone have, by what they have, and by name."""
    return [F.col("enabled").desc(), F.col("exclusive").desc(), F.col("entities").desc(), F.col("name").asc()]


def probe_state(public: Column, apply: Column) -> Column:
    """Of a job by its page and its form: dead if either is, live_confirmed if both are live, live_partial if one is, else unknown."""
    return F.when((public == "dead") | (apply == "dead"), "dead").when((public == "live") & (apply == "live"), "live_confirmed").when((public == "live") | (apply == "live"), "live_partial").otherwise("unknown")


def page_fault(*, seen: Column, parsed: Column, with_code: Column, page: Column, pages: Column, page_size: int) -> Column:
    """What is wrong with a scanned page, the first of: no_cards, not_all_parsed, short_page, few_codes; null if nothing is."""
    return (
        F.when(seen == 0, "no_cards").when(parsed != seen, "not_all_parsed").when((page < pages) & (seen < F.ceil(F.lit(page_size * PAGE_FILL))), "short_page")
        .when(with_code / parsed < CODE_SHARE, "few_codes")
    )


def parsed_filters(requests: DataFrame, *, place: str, radius: str, bounds: tuple[str, ...]) -> DataFrame:
    """Filter columns as requests give them in text, made safe: bounds that are negative or no number are null, the place is trimmed and cut, and a radius needs a place and a value within RADIUS_KM."""
    number = lambda c: (lambda v: F.when(v >= 0, v))(F.trim(F.col(c)).try_cast("decimal(18,2)"))
    named = F.substring(F.trim(F.coalesce(F.col(place), F.lit(""))), 1, PLACE_LENGTH)
    km = number(radius)
    others = [c for c in requests.columns if c not in (place, radius, *bounds)]
    return requests.select(*others, named.alias(place), F.when((named != "") & km.between(*RADIUS_KM), km).alias(radius), *(number(c).alias(c) for c in bounds))


def chosen_filters(request: Column, saved: Column, reset: Column, submitted: Column) -> Column:
    """Which filters (structs of the same fields) count: none after a reset, else the request's as a whole if it names any field, else the saved ones."""
    return F.when(F.coalesce(reset, F.lit(False)), F.lit(None)).when(F.coalesce(submitted, F.lit(False)), request).otherwise(saved)


def saved_filters(payload: Column, bounds: tuple[str, ...]) -> Column:
    """The filters of a saved JSON object as text columns in a struct, for ``parsed_filters``; null if it isn't an object."""
    fields = ("ort", "radius_km", *bounds)
    known = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>").isNotNull()
    return F.when(known, F.struct(*(F.get_json_object(payload, f"$.{c}").alias(c) for c in fields)))
