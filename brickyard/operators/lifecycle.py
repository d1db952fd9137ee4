"""Coverage of scans, what may be deactivated after them, and when the next one is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .radius import first_of_each


def coverage(runs: DataFrame, shards: DataFrame) -> DataFrame:
    """One row per run with summed counters, status and coverage_status.

    ``shards``: run_id, status, items_seen, source_reported_count, complete,
    cap_hit. A run without shards has failed; one whose shards all succeeded
    is ok only if each is complete and met no cap.
    """
    ok, failed = F.col("status") == "SUCCESS", F.col("status") == "FAILED"
    sums = shards.groupBy("run_id").agg(
        F.count("*").alias("shards_total"), F.count_if(ok).alias("shards_completed"), F.count_if(failed).alias("shards_failed"),
        F.sum("items_seen").alias("items_seen"), F.sum("source_reported_count").alias("reported"),
        F.bool_and(ok).alias("_all_ok"), F.bool_and(failed).alias("_all_failed"),
        F.bool_and(F.coalesce("complete", F.lit(False)) & ~F.coalesce("cap_hit", F.lit(False))).alias("_whole"),
    )
    rows = runs.select("run_id").join(sums, "run_id", "left")
    none = F.coalesce("shards_total", F.lit(0)) == 0
    status = F.when(none | F.col("_all_failed"), "FAILED").when(F.col("_all_ok"), "SUCCESS").otherwise("PARTIAL")
    quality = F.when(none | F.col("_all_failed"), "FAILED").when(F.col("_all_ok") & F.col("_whole"), "OK").otherwise("DEGRADED")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("run_id", zero("shards_total"), zero("shards_completed"), zero("shards_failed"), zero("items_seen"), "reported", status.alias("status"), quality.alias("coverage_status"))


def latest_run(runs: DataFrame) -> DataFrame:
    return first_of_each(runs, ["source_id"], [F.col("started_at").desc(), F.col("run_id").desc()])


def latest_attempt(runs: DataFrame, mode: str) -> DataFrame:
    """source_id and last_attempt: when the latest run of a mode began, however it went."""
    return runs.filter(F.col("mode") == mode).groupBy("source_id").agg(F.max("started_at").alias("last_attempt"))


def previous_ok(runs: DataFrame, run: DataFrame, offset: int = 0) -> DataFrame:
    """For each row of ``run`` the reconciliation before it that went well, ``offset`` further back.

    A running count along each source tells how many went well before a
    run, and so the number of the one that is wanted: no run meets more than
    one other.
    """
    good = runs.filter((F.col("mode") == "reconciliation") & (F.col("coverage_status") == "OK"))
    along = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    numbered = good.select("source_id", F.row_number().over(along).alias("n"), F.col("run_id").alias("prev_id"), F.col("started_at").alias("prev_started"), F.col("finished_at").alias("prev_finished"))
    asked = run.select("source_id", "run_id", "started_at")
    both = asked.withColumn("good", F.lit(0)).unionByName(good.select("source_id", "run_id", "started_at").withColumn("good", F.lit(1)))
    # At equal times the run itself comes first: only what began before it counts.
    before = F.sum("good").over(Window.partitionBy("source_id").orderBy("started_at", "good").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = both.withColumn("n", before.cast("int") - offset).filter("good = 0 AND n > 0").drop("good")
    return wanted.join(numbered, ["source_id", "n"]).select("source_id", "run_id", "started_at", "prev_id", "prev_started", "prev_finished")


def missing(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Active listings that the reconciliations in ``runs`` (one for each source) may deactivate.

    ``runs``: source_id, run_id, mode, coverage_status, prev_started (of the
    ok run before) and prev2_started (of the one before that). Only a run
    that went well, with one before it, deactivates; listings without a
    lasting identity need two.
    """
    good = runs.filter((F.col("mode") == "reconciliation") & (F.col("coverage_status") == "OK") & F.col("prev_started").isNotNull())
    rows = listings.filter(F.col("status") == "ACTIVE").join(good.drop("mode", "coverage_status"), "source_id")
    unseen = ~F.col("last_run_id").eqNullSafe(F.col("run_id"))
    limit = F.when(F.col("stable"), F.col("prev_started")).otherwise(F.col("prev2_started"))
    return rows.filter(unseen & (F.col("last_seen_at") < limit)).select(*listings.columns)


def orphaned(entities: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """Active entities that no active listing stands for any more."""
    return entities.filter(F.col("status") == "ACTIVE").join(listings.filter(F.col("status") == "ACTIVE").select(key), key, "left_anti")


def _seconds_since(t: Column, now: Column) -> Column:
    """From ``t`` to ``now``, to the microsecond: whole seconds would make something due a part of a second too early."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / F.lit(1e6)


def run_kind(now: Column, *, interval_hours: Column, poll_minutes: Column, last_attempt: Column, last_reconciliation: Column, last_incremental: Column, enabled: Column | None = None, retry_minutes: int = 180) -> Column:
    """``reconciliation``, ``incremental`` or null for a source at ``now``.

    A disabled source has none. A reconciliation is due if its interval has
    passed and its last attempt is long enough ago; an interval that is null,
    0 or less means that the source has no reconciliations. Else the poll
    interval (a minute at least) counts from the later scan.
    """
    minutes = lambda t: _seconds_since(t, now) / 60
    over = F.coalesce(interval_hours > 0, F.lit(False)) & (last_reconciliation.isNull() | (minutes(last_reconciliation) >= interval_hours * 60))
    rested = last_attempt.isNull() | (minutes(last_attempt) >= max(1, retry_minutes))
    last = F.greatest(last_reconciliation, last_incremental)
    kind = F.when(over & rested, "reconciliation").when(last.isNull() | (minutes(last) >= F.greatest(F.lit(1), poll_minutes)), "incremental")
    return kind if enabled is None else F.when(F.coalesce(enabled, F.lit(False)), kind)


def source_state(now: Column, *, enabled: Column, run_status: Column, run_coverage: Column, failing_shards: Column, last_success: Column, poll_minutes: Column) -> Column:
    """disabled, warning, never_succeeded, stale or ok, in this order."""
    age = F.greatest(F.lit(0.0), _seconds_since(last_success, now) / 60)
    bad = (failing_shards > 0) | F.coalesce(run_status.isin("FAILED", "PARTIAL"), F.lit(False)) | F.coalesce(run_coverage.isin("FAILED", "DEGRADED"), F.lit(False))
    return F.when(~enabled, "disabled").when(bad, "warning").when(last_success.isNull(), "never_succeeded").when(age > F.greatest(F.lit(180), poll_minutes * 3), "stale").otherwise("ok")


def page_state(status: Column, closed: Column, blocked: Column | None = None) -> Column:
    """Of a probed page: dead if gone or closed whatever its status, live from 200 to 399 unless a robot check shows, else unknown."""
    blocked = blocked if blocked is not None else F.lit(False)
    return F.when(status.isNull(), "unknown").when(status.isin(404, 410) | closed, "dead").when(blocked, "unknown").when(status.between(200, 399), "live").otherwise("unknown")


def after_probe(state: Column, was_visible: Column, last_live: Column) -> Column:
    """Whether a listing is shown after a probe; one that once was live and visible outlasts an unknown answer."""
    return F.when(state == "live", True).when(state == "dead", False).otherwise(was_visible & last_live.isNotNull())


def churn_coverage(structural: Column, new_synthetic: Column, cards: Column) -> Column:
    """Whether a scan counts as whole: sound pages, and no more new made-up identities than 3 or 1 % of the cards."""
    return structural & (new_synthetic <= F.greatest(F.lit(3), F.ceil(cards * 0.01)))


def synthetic_coverage(structural: Column, synthetic: Column, cards: Column, share: float) -> Column:
    """Whether sound pages have few made-up identities: no more than 3 or ``share`` of the cards."""
    return structural & (synthetic <= F.greatest(F.lit(3), F.ceil(cards * share)))


def plausible_count(seen: Column, reported: Column, page_size: Column) -> Column:
    """Whether the seen count is within two pages or 1 % of what the source reports."""
    return F.abs(seen - reported) <= F.greatest(page_size * 2, F.ceil(reported * 0.01))


def released_age(text: Column, now: Column) -> Column:
    """Whole days of 24 hours since an ISO time (without a zone: UTC), at least 0; null if unreadable."""
    at = F.try_to_timestamp(text)
    return F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.floor(_seconds_since(at, now) / 86400)))


def age_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 30, "0-30").when(days <= 90, "31-90").when(days <= 180, "91-180").when(days <= 365, "181-365").otherwise(">365")
