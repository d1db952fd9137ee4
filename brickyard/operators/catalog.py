"""Catalogue filters, visibility, sorting and counters over homes and jobs.

Whatever is unknown fails a bound; nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.checkpoints import kept

#: Prices in EUR between which a home is in the budget, both included.
BUDGET = (30_000, 300_000)


def between(column: Column, low=None, high=None) -> Column:
    """Inclusive bounds; a null value fails any bound that is set."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (column >= low)
    if high is not None:
        ok = ok & (column <= high)
    return F.coalesce(ok, F.lit(False))


def place_matches(text: str, *columns: str) -> Column:
    """Case-blind substring in any column; % and _ in ``text`` keep their meaning in LIKE."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return found


def with_usable_area(homes: DataFrame, listings: DataFrame, low=None, high=None) -> DataFrame:
    """Homes with an active listing whose usable area (detail, explicit, search) lies in both bounds."""
    area = F.coalesce("detail_area", "explicit_area", "search_area")
    good = listings.filter((F.col("status") == "ACTIVE") & between(area, low, high))
    return homes.join(good.select("home_id").distinct(), "home_id", "left_semi")


def visible(homes: DataFrame, listings: DataFrame) -> DataFrame:
    """Homes the product shows.

    One with active listings under a policy needs one of them to be visible
    with its source page known; one without is judged by its price.
    """
    policy = (F.col("status") == "ACTIVE") & F.col("policy").isNotNull()
    shown = policy & F.coalesce(F.col("product_visible"), F.lit(False)) & ~F.coalesce(F.col("url_missing"), F.lit(False))
    flags = listings.groupBy("home_id").agg(F.bool_or(policy).alias("_policy"), F.bool_or(shown).alias("_shown"))
    joined = homes.join(flags, "home_id", "left")
    by_price = ~F.coalesce(F.col("_policy"), F.lit(False)) & between(F.col("price"), *BUDGET)
    return joined.filter(F.coalesce(F.col("_shown"), F.lit(False)) | by_price).drop("_policy", "_shown")


def curated(rows: DataFrame, states: DataFrame, view: str, key: str = "home_id") -> DataFrame:
    """Rows of a curation view: ``hidden``, ``favorites`` (hidden ones too), or anything else: all that isn't hidden."""
    if view == "hidden":
        return rows.join(states.filter("hidden").select(key), key, "left_semi")
    if view == "favorites":
        return rows.join(states.filter("favorite").select(key), key, "left_semi")
    return rows.join(states.filter("hidden").select(key), key, "left_anti")


def novel(rows: DataFrame, views: DataFrame, baseline: Column, key: str = "home_id") -> DataFrame:
    """Rows first seen after the baseline (strictly) and never viewed."""
    return rows.filter(F.col("first_seen_at") > baseline).join(views.filter(F.col("viewed_at").isNotNull()).select(key), key, "left_anti")


def eligible_jobs(jobs: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Active jobs with an active listing of an enabled source that the gate accepted."""
    good = listings.filter((F.col("status") == "ACTIVE") & F.col("gate_accepted")).join(sources.filter("enabled").select("source_id"), "source_id", "left_semi")
    return jobs.filter(F.col("status") == "ACTIVE").join(good.select("job_id"), "job_id", "left_semi")


def job_view(rows: DataFrame, view: str) -> DataFrame:
    """Rows (score, hard, favorite, hidden, is_new) of a view; only ``favorites`` and ``hidden`` show hidden rows."""
    open_rows = ~F.col("hidden")
    conditions = {
        "fitting": open_rows & F.col("score").isNotNull() & ~F.col("hard"),
        "new": open_rows & F.col("is_new"),
        "favorites": F.col("favorite"),
        "all": open_rows,
        "incompatible": open_rows & F.col("hard"),
        "unscored": open_rows & F.col("score").isNull(),
        "hidden": F.col("hidden"),
    }
    return rows.filter(conditions[view])


def job_text_search(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose title, company or any label of ``places`` holds the text, whatever its case."""
    needle = text.lower()
    hit = F.coalesce(F.lower("title").contains(needle), F.lit(False)) | F.coalesce(F.lower("company").contains(needle), F.lit(False))
    return rows.filter(hit | F.coalesce(F.exists("places", lambda p: F.lower(p).contains(needle)), F.lit(False)))


def budget_state(price: Column) -> Column:
    return F.when(price.isNull(), "unknown").when(price < BUDGET[0], "below").when(price > BUDGET[1], "above").otherwise("accepted")


def visibility_reason(price: Column, url_missing: Column, liveness: Column) -> Column:
    """Why a home is shown or not: price first, then the source page, then liveness."""
    state = budget_state(price)
    return (
        F.when(state != "accepted", F.concat(F.lit("price_"), state))
        .when(F.coalesce(url_missing, F.lit(False)), "source_url_missing")
        .when(liveness == "dead", "source_dead")
        .when(liveness == "live", "visible")
        .otherwise("source_unverified")
    )


def due_images(homes: DataFrame, images: DataFrame, now: Column, limit: int) -> DataFrame:
    """Homes without a cached image whose retry time has come, the oldest id first."""
    joined = homes.join(images, "home_id", "left")
    due = F.col("image_status").isNull() | ((F.col("image_status") != "cached") & (F.col("retry_after").isNull() | (F.col("retry_after") <= now)))
    return joined.filter(due).orderBy("home_id").limit(limit)


def stale_listings(listings: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """Active listings in the budget checked before the cutoff or never, never-checked ones first."""
    old = F.col("checked_at").isNull() | (F.col("checked_at") <= cutoff)
    rows = listings.filter((F.col("status") == "ACTIVE") & old & (budget_state(F.col("price")) == "accepted"))
    return rows.orderBy(F.col("checked_at").asc_nulls_first(), "listing_id").limit(limit)


def unique_links(links: DataFrame) -> DataFrame:
    """The first link of each URL of an entity, by source name and id."""
    from .radius import first_of_each

    return first_of_each(links, ["entity_id", "url"], [F.col("source_name"), F.col("link_id")])


def display_areas(homes: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds neutral_area, usable_area and plot_area for display.

    The neutral area stands in for a missing living area if the sources give
    exactly one value; a plot that equals it (within 1 or 1 %) is not shown.
    """
    usable = F.coalesce(F.when(F.col("detail_area") != 0, F.col("detail_area")), F.when(F.col("explicit_area") != 0, F.col("explicit_area")))
    found = listings.groupBy("home_id").agg(F.collect_set("display_area").alias("_areas"), F.max(usable).alias("usable_area"))
    joined = homes.join(found, "home_id", "left")
    joined = joined.withColumn("neutral_area", F.when(F.col("living").isNull() & (F.size("_areas") == 1), F.get("_areas", F.lit(0))))
    near = F.abs(F.col("plot") - F.col("neutral_area")) <= F.greatest(F.lit(1.0), F.greatest("plot", "neutral_area") * 0.01)
    return joined.withColumn("plot_area", F.when(~F.coalesce(near, F.lit(False)), F.col("plot"))).drop("_areas")


def house_order(sort: str = "novelty", direction: str = "desc") -> list[Column]:
    """Total order of houses: missing prices last both ways, ids in the direction; unknown names fall back."""
    sort = sort if sort in ("price", "viewed", "novelty") else "novelty"
    down = direction != "asc"
    tie = F.col("home_id").desc() if down else F.col("home_id").asc()
    if sort == "price":
        return [F.col("price").desc_nulls_last() if down else F.col("price").asc_nulls_last(), tie]
    if sort == "viewed":
        seen = F.col("viewed_at").isNotNull()
        return [seen.desc() if down else seen.asc(), tie]
    return [F.col("first_seen_at").desc() if down else F.col("first_seen_at").asc(), tie]


def salary_sort_value() -> Column:
    """Annual pay to sort by: stored annual bounds, else EUR amounts of a year or months (12 if unknown), else null."""
    eur = F.col("currency") == "EUR"
    amount = F.coalesce("amount_min", "amount_max")
    return F.coalesce(
        F.col("year_min"), F.col("year_max"),
        F.when(eur & (F.col("period") == "year"), amount),
        F.when(eur & (F.col("period") == "month"), amount * F.coalesce("payments", F.lit(12))),
    )


def job_order(sort: str, direction: str = "desc") -> list[Column]:
    """Missing values last both ways, then the id; jobs with a hard constraint sort as score -1."""
    value = salary_sort_value() if sort == "salary" else F.when(F.col("hard"), F.lit(-1)).otherwise(F.col("score"))
    if direction == "asc":
        return [value.asc_nulls_last(), F.col("job_id").asc()]
    return [value.desc_nulls_last(), F.col("job_id").desc()]


def live_fit_order() -> list[Column]:
    """Hidden last, favorites first, scored before unscored, no hard constraint first, then the best."""
    return [F.col("hidden").asc(), F.col("favorite").desc(), F.col("score").isNull().asc(), F.col("hard").asc(), F.col("score").desc(), F.col("coverage").desc(), F.col("job_id").asc()]


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds position (from 1) in ``order``, whose last key must be unique: a sort by ranges, then the rows before each range."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = kept(parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before, starts = 0, []
    for part, n in sorted(parts.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _before long"))
    return parts.join(offsets, "_part").withColumn("position", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def match_jobs(rows: DataFrame, limit: int) -> DataFrame:
    """Jobs to match homes to: not hidden, scored and without a hard constraint; favorites don't count."""
    rows = rows.filter(~F.col("hidden") & F.col("score").isNotNull() & ~F.col("hard"))
    return rows.orderBy(F.col("score").desc(), F.col("coverage").desc(), F.col("job_id")).limit(limit)


def bounded_sample(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` distinct (title, reason) in order of arrival."""
    first = rows.groupBy("title", "reason").agg(F.min("position").alias("position"))
    return first.orderBy("position", "title", "reason").limit(limit)


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the total and a count for each condition, in one pass."""
    counts = [F.coalesce(F.count_if(c), F.lit(0)).cast("long").alias(k) for k, c in conditions.items()]
    return rows.agg(F.count("*").alias("total"), *counts)
