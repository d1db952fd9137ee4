"""Counts for operations: contributions of sources, unresolved labels, geo coverage, overlaps and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickyard.checkpoints import kept


def geo_coverage(rows: DataFrame, key: str) -> DataFrame:
    """Rows, rows with a point, their share (0.0 for no rows) and distinct keys with a point."""
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    out = rows.agg(F.count("*").alias("n"), F.count_if(located).alias("located"), F.count_distinct(F.when(located, F.col(key))).alias("entities"))
    return out.withColumn("ratio", F.when(F.col("n") > 0, F.col("located") / F.col("n")).otherwise(F.lit(0.0)))


def contributions(listings: DataFrame) -> DataFrame:
    """Per source: accepted listings, entities, and how many of those it alone or shares.

    Entities are first reduced to their set of sources, so no distinct count
    runs over a hot source's rows.
    """
    pairs = listings.groupBy("entity_id", "source_id").agg(F.count("*").alias("n"))
    sources = pairs.groupBy("entity_id").agg(F.count("*").alias("n_sources"), F.collect_list(F.struct("source_id", "n")).alias("s"))
    rows = sources.select("n_sources", F.inline("s"))
    return rows.groupBy("source_id").agg(
        F.sum("n").alias("listings"), F.count("*").alias("entities"), F.count_if(F.col("n_sources") == 1).alias("exclusive"), F.count_if(F.col("n_sources") > 1).alias("shared")
    )


def overlap(listings: DataFrame, n_sources: int = 2) -> DataFrame:
    """Entities that exactly ``n_sources`` sources list."""
    pairs = listings.select("entity_id", "source_id").distinct()
    return pairs.groupBy("entity_id").agg(F.count("*").alias("n_sources")).filter(F.col("n_sources") == n_sources)


def unresolved_labels(locations: DataFrame, is_scope, k: int = 20) -> DataFrame:
    """The ``k`` most frequent unresolved labels among points and among wider scopes, with the totals over all labels.

    Totals are an aggregate of two rows, and the rank cuts to ``k`` inside
    each task, so the labels themselves never meet in one.
    """
    from pyspark.sql import Window

    counts = locations.filter(F.col("lon").isNull() & F.col("city").isNotNull()).groupBy("city").agg(F.count("*").alias("n")).withColumn("scope", is_scope(F.col("city")))
    totals = counts.groupBy("scope").agg(F.count("*").alias("labels"), F.sum("n").alias("locations"))
    order = Window.partitionBy("scope").orderBy(F.col("n").desc(), F.col("city"))
    first = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # Two rows, so it is safe to broadcast.
    return first.join(F.broadcast(totals), "scope").select("city", "n", "scope", "labels", "locations", "rank")


def json_totals(rows: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """Sums of whole numbers in a JSON column: all null if no row has any of them, else missing ones count as 0."""
    values = [F.get_json_object(payload, f"$.{f}").try_cast("long") for f in fields]
    any_found = F.bool_or(F.coalesce(*values).isNotNull())
    sums = rows.agg(any_found.alias("_any"), *(F.sum(v).alias(f) for v, f in zip(values, fields)))
    return sums.select(*(F.when(F.col("_any"), F.coalesce(f, F.lit(0))).alias(f) for f in fields))


def concept_counts(concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each concept: jobs with evidence, and evidence rows by scope; 0 where there is none."""
    rows = evidence.groupBy("kind", "slug").agg(
        F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("scope") == "primary").alias("primary_rows"), F.count_if(F.col("scope") == "context").alias("context_rows")
    )
    joined = concepts.join(rows, ["kind", "slug"], "left")
    return joined.select("kind", "slug", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("jobs", "primary_rows", "context_rows")))


def exact_median(rows: DataFrame, column: str) -> DataFrame:
    """One row with ``median``, exact: the mean of the two middle values; null without values.

    Equal values become one with a count, the distinct ones are sorted by
    ranges, and the ranges' counts tell which one or two hold the middle, so
    only those are put in order.
    """
    value = F.col(f"`{column}`")
    counts = rows.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    parts = kept(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    # One row for each range.
    ranges = parts.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"before": before, "all": F.sum("n").over(Window.partitionBy())})
    ranges = ranges.withColumns({"low": F.floor((F.col("all") - 1) / 2), "high": F.floor(F.col("all") / 2)})
    middle = ranges.filter((F.col("before") <= F.col("high")) & (F.col("before") + F.col("n") > F.col("low"))).select("part", "before", "low", "high")
    inside = parts.join(F.broadcast(middle), "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
    return inside.agg(((at("low").cast("double") + at("high").cast("double")) / 2).alias("median"))


def distribution(rows: DataFrame, *columns: str) -> DataFrame:
    """Mean and exact median of columns over rows that have them, and the number of rows."""
    out = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_mean") for c in columns))
    for c in columns:
        out = out.unionByName(exact_median(rows, c).withColumnRenamed("median", f"{c}_median"), allowMissingColumns=True)
    # Each value stands in one of the rows.
    return out.agg(*(F.max(c).alias(c) for c in ("n", *(f"{c}_{what}" for c in columns for what in ("mean", "median")))))


def purge_check(listings: DataFrame, source_id) -> DataFrame:
    """Entities a purge of a source touches: its listings, all listings, and whether others share the entity."""
    own = F.col("source_id") == source_id
    rows = listings.groupBy("entity_id").agg(F.count_if(own).alias("purged"), F.count("*").alias("listings"))
    return rows.filter(F.col("purged") > 0).withColumn("shared", F.col("listings") > F.col("purged"))


def high_water(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("high_water"))


def source_stats(listings: DataFrame) -> DataFrame:
    """Per source: listings, active and relevant ones, their jobs, what the latest run saw, and how many relevant jobs have pay.

    ``listings``: source_id, job_id, status, accepted, seen_run_id,
    latest_run_id, structured_pay, annual_pay, pay_text (booleans of the job).
    """
    active = F.col("status") == "ACTIVE"
    accepted = F.coalesce("accepted", F.lit(False))
    relevant = active & accepted
    now = F.coalesce(F.col("seen_run_id") == F.col("latest_run_id"), F.lit(False))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    # Each job once for a source, so that jobs are counted without a set of them.
    jobs = listings.groupBy("source_id", "job_id").agg(
        F.count("*").alias("listings"), F.count_if(active).alias("active"), F.count_if(relevant).alias("relevant"), F.count_if(now).alias("seen"), F.count_if(now & accepted).alias("seen_relevant"),
        some(active).alias("j_active"), some(relevant).alias("j_relevant"), *(some(relevant & F.col(c)).alias(f"j_{c}") for c in ("structured_pay", "annual_pay", "pay_text")),
    )
    count = lambda c, name: F.count_if(F.col(c) & F.col("job_id").isNotNull()).alias(name)
    return jobs.groupBy("source_id").agg(
        *(F.sum(c).alias(c) for c in ("listings", "active", "relevant")), count("j_active", "active_jobs"), count("j_relevant", "relevant_jobs"), F.sum("seen").alias("seen"), F.sum("seen_relevant").alias("seen_relevant"),
        *(count(f"j_{c}", c) for c in ("structured_pay", "annual_pay", "pay_text")),
    )


def tenant_counts(listings: DataFrame) -> DataFrame:
    """source_id, tenant, active and relevant listings of each tenant that has active ones.

    A listing's tenant is ``region:site`` of its feed, or its feed's tenant,
    or ``unknown``. ``listings``: source_id, status, accepted, site, region, tenant.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    site = F.concat(F.coalesce(given("region"), F.lit("unknown")), F.lit(":"), given("site"))
    rows = listings.filter(F.col("status") == "ACTIVE").withColumn("tenant", F.coalesce(site, given("tenant"), F.lit("unknown")))
    return rows.groupBy("source_id", "tenant").agg(F.count("*").alias("active"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("relevant"))


def location_coverage(listings: DataFrame, locations: DataFrame) -> DataFrame:
    """Per source, of the places of its relevant jobs: places, with a point, with a code, by city alone, and without a point.

    ``listings`` as for ``source_stats``; ``locations``: job_id, postal_code,
    city, lon. A job counts once for a source.
    """
    relevant = listings.filter((F.col("status") == "ACTIVE") & F.coalesce("accepted", F.lit(False))).select("source_id", "job_id").distinct()
    point = F.col("lon").isNotNull()
    return relevant.join(locations, "job_id").groupBy("source_id").agg(
        F.count("*").alias("places"), F.count_if(point).alias("geo_resolved"), F.count_if(F.coalesce("postal_code", F.lit("")) != "").alias("postal_resolved"),
        F.count_if(point & F.col("postal_code").isNull() & F.col("city").isNotNull()).alias("city_approx"), F.count_if(~point).alias("unresolved"),
    )


def unresolved_texts(listings: DataFrame, locations: DataFrame, k: int = 30) -> DataFrame:
    """Per source the ``k`` texts that most places of relevant jobs without a point have (ties by the text): source_id, rank, location_text and n."""
    relevant = listings.filter((F.col("status") == "ACTIVE") & F.coalesce("accepted", F.lit(False))).select("source_id", "job_id").distinct()
    rows = relevant.join(locations.filter(F.col("lon").isNull() & (F.coalesce("location_text", F.lit("")) != "")), "job_id")
    counts = rows.groupBy("source_id", "location_text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source_id").orderBy(F.col("n").desc(), "location_text")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("source_id", "rank", "location_text", "n")


def top_concepts(evidence: DataFrame, k: int) -> DataFrame:
    """The ``k`` concepts of each kind with most jobs: kind, slug, jobs and rank."""
    counts = evidence.groupBy("kind", "slug").agg(F.count_distinct("job_id").alias("jobs"))
    order = Window.partitionBy("kind").orderBy(F.col("jobs").desc(), F.col("slug"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evidence_audit(evidence: DataFrame, family: str) -> DataFrame:
    """Per version of an extractor family: rows, jobs, rows by scope, and rows of a scope that isn't known."""
    rows = evidence.filter(F.col("version").startswith(family))
    known = F.col("scope").isin("primary", "context")
    return rows.groupBy("version").agg(
        F.count("*").alias("n_rows"), F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("scope") == "primary").alias("primary_rows"),
        F.count_if(F.col("scope") == "context").alias("context_rows"), F.count_if(~F.coalesce(known, F.lit(False))).alias("invalid_rows"),
    )


def area_audit(homes: DataFrame, listings: DataFrame) -> DataFrame:
    """Per kind of area that the listings state: homes, those whose stored area differs from it, and those that several sources list.

    ``homes``: home_id, living. ``listings``: home_id, source_id, kind, area.
    """
    one = listings.groupBy("home_id", "kind").agg(F.max("area").alias("stated"), F.count_distinct("source_id").alias("n_sources"))
    rows = one.join(homes.select("home_id", "living"), "home_id")
    differs = F.coalesce(F.abs(F.col("living") - F.col("stated")) > 0.5, F.lit(False))
    return rows.groupBy("kind").agg(F.count("*").alias("homes"), F.count_if(differs).alias("mismatched"), F.count_if(differs & (F.col("n_sources") == 1)).alias("suspicious"), F.count_if(F.col("n_sources") > 1).alias("shared"))


def stable_overlap(own: DataFrame, shown: DataFrame, pattern: str) -> DataFrame:
    """One row: of a source's own listings (listing_key, entity_id) and another's (row_id, entity_id, url) the lasting ids that both have.

    ``pattern`` finds the id in a URL (first group); of several URLs of an id
    the smallest row_id counts. Columns: pointing (ids the other shows),
    overlap, merged (both are one entity) and duplicates.
    """
    key = F.nullif(F.regexp_extract("url", pattern, 1), F.lit(""))
    other = shown.withColumn("listing_key", key).filter(F.col("listing_key").isNotNull()).groupBy("listing_key").agg(F.min_by("entity_id", "row_id").alias("_entity"))
    mine = own.groupBy("listing_key").agg(F.min("entity_id").alias("entity_id"))
    both = other.join(mine, "listing_key", "left")
    found = F.col("entity_id").isNotNull()
    same = found & (F.col("entity_id") == F.col("_entity"))
    return both.agg(F.count("*").alias("pointing"), F.count_if(found).alias("overlap"), F.count_if(same).alias("merged"), F.count_if(found & ~same).alias("duplicates"))
