"""Keeping stored tables in step with what comes in: shards, evidence, marks, locations, tenants and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.functions.salary import salary_of

from .radius import first_of_each


def updated(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the new values of their keys; keys that only ``new`` has are left out."""
    fresh = [c for c in new.columns if c not in keys]
    b = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in fresh), F.lit(True).alias("_hit"))
    joined = old.join(b, keys, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in old.columns))


def synced_shards(stored: DataFrame, specs: DataFrame) -> DataFrame:
    """Shards after a sync with their specs: priorities follow the spec, missing ones are disabled, cursors stay."""
    keys = ["source_id", "key"]
    b = specs.select(*keys, F.col("priority").alias("_priority"), F.lit(True).alias("_hit"))
    joined = stored.select(*keys, "priority", "cursor").join(b, keys, "full")
    return joined.select(*keys, F.coalesce("_priority", "priority").alias("priority"), "cursor", F.coalesce("_hit", F.lit(False)).alias("enabled"))


def replaced_evidence(stored: DataFrame, fresh: DataFrame, family: str) -> DataFrame:
    """Stored evidence without any version of an extractor family, and the fresh rows."""
    return stored.filter(~F.col("version").startswith(family)).unionByName(fresh)


def saved_marks(stored: DataFrame, changes: DataFrame, keys: list[str], sparse: bool) -> DataFrame:
    """Marks after changes (null leaves a mark as it is), with ``changed`` for the rows to report.

    Sparse tables drop rows without a mark; dense ones keep them. The first
    view time stays.
    """
    b = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("favorite", "hidden", "viewed_at")))
    joined = stored.join(b, keys, "full")
    mark = lambda c: F.coalesce(f"_{c}", c, F.lit(False))
    out = joined.select(
        *keys, mark("favorite").alias("favorite"), mark("hidden").alias("hidden"), F.coalesce("viewed_at", "_viewed_at").alias("viewed_at"),
        (~mark("favorite").eqNullSafe(F.coalesce("favorite", F.lit(False))) | ~mark("hidden").eqNullSafe(F.coalesce("hidden", F.lit(False))) | (F.col("viewed_at").isNull() & F.col("_viewed_at").isNotNull())).alias("changed"),
    )
    return out.filter(F.col("favorite") | F.col("hidden")) if sparse else out


def enriched_locations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Locations of jobs after an ingest: one row for each code, city, text and remote flag, and no unresolved twin of a resolved text."""
    keys = ["job_id", "postal_code", "city", "location_text", "remote"]
    both = stored.select(*keys, "location_id", F.lit(0).alias("_new")).unionByName(incoming.select(*keys, F.lit(None).cast("long").alias("location_id"), F.lit(1).alias("_new")))
    one = first_of_each(both, keys, [F.col("_new"), F.col("location_id").asc_nulls_last()]).drop("_new")
    twins = Window.partitionBy("job_id", "location_text", "remote")
    resolved = F.bool_or(F.col("postal_code").isNotNull()).over(twins)
    return one.withColumn("_r", resolved).filter(F.col("postal_code").isNotNull() | ~F.col("_r") | F.col("location_text").isNull()).drop("_r")


def tenant_of(tenants: DataFrame, candidates: DataFrame) -> DataFrame:
    """tenant_key for each candidate: an equal key, else the longest one of which it is ``key:...``, if that is the only one of its length.

    A key has few parts, so a candidate meets tenants by its own prefixes in
    an equi-join.
    """
    parts = F.split("candidate", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    rows = candidates.select("candidate", F.explode(prefixes).alias("tenant_key")).join(tenants.select("tenant_key", "tenant_id"), "tenant_key")
    ranked = rows.withColumn("n", F.length("tenant_key")).withColumn("top", F.max("n").over(Window.partitionBy("candidate"))).filter("n = top")
    return ranked.groupBy("candidate").agg(F.min("tenant_id").alias("tenant_id"), F.first("tenant_key").alias("tenant_key"), F.count("*").alias("k")).filter("k = 1").drop("k")


def promotable(runs: DataFrame, shards: DataFrame) -> DataFrame:
    """Runs that may be called ok in hindsight: all shards succeeded and are complete, and the source has no earlier ok run."""
    sound = shards.groupBy("run_id").agg(F.bool_and((F.col("status") == "SUCCESS") & F.coalesce("complete", F.lit(False))).alias("sound")).filter("sound")
    earlier = runs.filter(F.col("coverage_status") == "OK").groupBy("source_id").agg(F.min("started_at").alias("first_ok"))
    rows = runs.filter(F.col("coverage_status") != "OK").join(sound, "run_id", "left_semi").join(earlier, "source_id", "left")
    return rows.filter(F.col("first_ok").isNull() | (F.col("first_ok") > F.col("started_at"))).drop("first_ok")


def area_repairs(homes: DataFrame, listings: DataFrame) -> DataFrame:
    """Homes of a single source whose living area no listing states: the area is to be cleared."""
    facts = listings.groupBy("home_id").agg(F.count_distinct("source_id").alias("n"), F.bool_or(F.col("explicit_living").isNotNull()).alias("said"))
    return homes.filter(F.col("living").isNotNull()).join(facts.filter((F.col("n") == 1) & ~F.col("said")).select("home_id"), "home_id", "left_semi")


def salary_candidates(rows: DataFrame) -> DataFrame:
    """The first row of each listing that the gate accepted and that states no pay, to look up in its detail page.

    Pay is stated by amount, currency and period together, by a pay text that
    can be read, or by a description that names a salary. ``rows`` has these
    and position, gate_accepted; the unread texts stay in Spark.
    """
    first = first_of_each(rows, ["source_id", "listing_key"], [F.col("position")]).filter("gate_accepted")
    structured = F.col("salary_min").isNotNull() & F.col("salary_currency").isNotNull() & F.col("salary_period").isNotNull()
    said = first.filter(~structured).withColumns({"_text": salary_of(F.col("salary_text"), True), "_description": salary_of(F.col("description"))})
    none = F.col("_text.currency").isNull() & F.col("_description.currency").isNull()
    return said.filter(none).drop("_text", "_description")


def stable(payload: Column) -> Column:
    """Whether a listing's identity lasts: stated so (or not stated), and its source page known."""
    flag = lambda k, default: F.coalesce(F.lower(F.get_json_object(payload, f"$.{k}")), F.lit(default))
    return (flag("identity_stable", "true") == "true") & (flag("original_url_missing", "false") != "true")
