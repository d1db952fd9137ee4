"""Observed listings against stored ones: re-pointing, orphans, continuity of rotated listings, and rejected sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import merged_map

#: Earlier addresses that a listing's history keeps.
HISTORY = 50


def repointed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """listing_id, entity_id and target of stored listings that are seen again.

    ``incoming`` has source_id, listing_key and identity; ``stored``
    listing_id and entity_id too. A listing whose lasting identity already
    belongs to another entity moves there: to that of the smallest listing id.
    """
    owner = stored.filter(F.col("identity").isNotNull()).groupBy("identity").agg(F.min_by("entity_id", "listing_id").alias("_owner"))
    seen = incoming.groupBy("source_id", "listing_key").agg(F.min("identity").alias("identity"))
    rows = stored.select("source_id", "listing_key", "listing_id", "entity_id").join(seen, ["source_id", "listing_key"]).join(owner, "identity", "left")
    return rows.select("listing_id", "entity_id", F.coalesce("_owner", "entity_id").alias("target"))


def left_behind(moves: DataFrame, stored: DataFrame) -> DataFrame:
    """entity_id of the entities that lose their last listing by ``moves``; they are to be deleted."""
    after = stored.select("listing_id", "entity_id").join(moves.select("listing_id", "target"), "listing_id", "left").select(F.coalesce("target", "entity_id").alias("entity_id"))
    return moves.filter(F.col("target") != F.col("entity_id")).select("entity_id").distinct().join(after, "entity_id", "left_anti")


def continuity_sides(listings: DataFrame, *, run_id: int, run_started: Column, cutoff: Column) -> DataFrame:
    """Listings with ``side``: current ones came up after the last whole scan and in this run, previous ones were there before and aren't seen any more."""
    seen = F.coalesce(F.col("seen_run_id") == run_id, F.lit(False))
    side = F.when((F.col("first_seen_at") > cutoff) & seen, "current").when((F.col("first_seen_at") <= cutoff) & ~seen & (F.col("last_seen_at") < run_started), "previous")
    return listings.withColumn("side", side).filter(F.col("side").isNotNull())


def rotated(pairs: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """The previous listing of each pair (prev_token, cur_token, strategy), gone on under the current one's address.

    Both sides have token, listing_key, url, title, description, price,
    living, plot, postal_code, city, first_seen_at, last_seen_at; the
    previous one also rotations and history (array of listing_key, url,
    first_seen_at, last_seen_at). What the current one knows wins, the oldest
    first and the latest last sighting stay.
    """
    p, c = previous.alias("p"), current.alias("c")
    joined = pairs.join(p, F.col("prev_token") == F.col("p.token")).join(c, F.col("cur_token") == F.col("c.token"))
    text = lambda n: F.coalesce(F.nullif(F.col(f"c.{n}"), F.lit("")), F.col(f"p.{n}")).alias(n)
    known = lambda n: F.coalesce(f"c.{n}", f"p.{n}").alias(n)
    one = F.array(F.struct(*(F.col(f"p.{n}").alias(n) for n in ("listing_key", "url", "first_seen_at", "last_seen_at"))))
    past = F.coalesce("p.history", F.slice(one, 1, 0))
    history = F.when(F.col("p.url") != F.col("c.url"), F.concat(past, one)).otherwise(past)
    return joined.select(
        "prev_token", "cur_token", F.col("c.listing_key").alias("listing_key"), F.col("c.url").alias("url"), text("title"), known("description"), known("price"), known("living"), known("plot"),
        known("postal_code"), text("city"), F.least("p.first_seen_at", "c.first_seen_at").alias("first_seen_at"), F.greatest("p.last_seen_at", "c.last_seen_at").alias("last_seen_at"),
        F.lit("ACTIVE").alias("status"), "strategy", (F.coalesce("p.rotations", F.lit(0)) + 1).alias("rotations"),
        F.slice(history, F.greatest(F.lit(1), F.size(history) - HISTORY + 1), F.lit(HISTORY)).alias("history"),
    )


def rejected_sightings(stored: DataFrame, rejected: DataFrame, now: Column) -> DataFrame:
    """Stored listings that today's gate rejects but that were seen: active and refreshed, with gate false; ``reactivated`` tells which weren't active.

    Rejected rows that aren't stored stay unstored. Both have source_id,
    listing_key, url and payload; ``stored`` listing_id, job_id and status.
    """
    new = rejected.groupBy("source_id", "listing_key").agg(F.max("url").alias("new_url"), F.max("payload").alias("new_payload"))
    rows = stored.join(new, ["source_id", "listing_key"])
    payload = F.to_json(F.map_concat(F.map_filter(merged_map("payload", "new_payload"), lambda k, _: k != "gate_accepted"), F.create_map(F.lit("gate_accepted"), F.parse_json(F.lit("false")))))
    return rows.select("listing_id", "job_id", F.col("new_url").alias("url"), payload.alias("payload"), F.lit("ACTIVE").alias("status"), now.alias("last_seen_at"), (F.col("status") != "ACTIVE").alias("reactivated"))


def seen_jobs(sightings: DataFrame) -> DataFrame:
    """Jobs that are active because one of their listings was seen, whatever the gate says: job_id, status and last_seen_at."""
    return sightings.groupBy("job_id").agg(F.lit("ACTIVE").alias("status"), F.max("last_seen_at").alias("last_seen_at"))
