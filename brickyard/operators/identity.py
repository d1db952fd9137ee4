"""Which stored entity an incoming listing belongs to, and continuity between two scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.checkpoints import kept

from .components import components
from .radius import first_of_each


#: Which columns must agree, first rule first: jobs have identities of their source, homes those of a provider that any source may show.
JOB_RULES = {"listing": ["source_id", "listing_key"], "identity": ["source_id", "identity"], "url": ["url"]}
HOME_RULES = {"listing": ["source_id", "listing_key"], "url": ["url"], "identity": ["identity"]}


def resolved(incoming: DataFrame, stored: DataFrame, rules: dict[str, list[str]] = JOB_RULES) -> DataFrame:
    """Adds entity_id (null: new) and ``by``, the first of ``rules`` that finds a stored listing.

    ``incoming`` and ``stored`` have source_id, listing_key, identity and
    url; ``stored`` listing_id and entity_id too. The smallest listing id
    wins inside a rule. What a batch says about itself is settled by
    ``batch_entities``.
    """
    def on(rule: int, name: str, keys: list[str]) -> DataFrame:
        left = incoming.select("row_id", *keys).dropna(subset=keys)
        # Only the smallest listing of a key can win, so a key of many stored rows meets each incoming row once.
        right = stored.dropna(subset=keys).groupBy(*keys).agg(F.min("listing_id").alias("listing_id"), F.min_by("entity_id", "listing_id").alias("entity_id"))
        return left.join(right, keys).select("row_id", F.lit(rule).alias("rule"), F.lit(name).alias("by"), "listing_id", "entity_id")

    found = reduce(DataFrame.unionByName, (on(n, name, keys) for n, (name, keys) in enumerate(rules.items())))
    best = first_of_each(found, ["row_id"], [F.col("rule"), F.col("listing_id")]).select("row_id", "entity_id", "by")
    return incoming.join(best, "row_id", "left")


def chains(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """row_id and chain of each row: rows that share the values of any of ``keys`` are in one chain, over any number of steps.

    A chain is named by its smallest row_id. A key with a null doesn't link.
    Each key links its rows to the smallest of them, so a key of n rows gives
    n edges, and the chains are the connected components of these.
    """
    rows = kept(rows.select("row_id", *dict.fromkeys(c for k in keys for c in k)))
    edges = None
    for k in keys:
        own = rows.select("row_id", *k).dropna(subset=k)
        least = own.groupBy(*k).agg(F.min("row_id").alias("a"), F.max("row_id").alias("_z")).filter("a < _z").drop("_z")
        linked = own.join(least, k).select("a", F.col("row_id").alias("b")).filter("a <> b")
        edges = linked if edges is None else edges.unionByName(linked)
    roots = components(edges).select(F.col("v").alias("row_id"), "root")
    return rows.select("row_id").join(roots, "row_id", "left").select("row_id", F.coalesce("root", "row_id").alias("chain"))


#: What makes two listings of one batch the same entity: a lasting identity of the source, or the URL.
BATCH_KEYS = [["source_id", "identity"], ["url"]]


def new_keys(rows: DataFrame) -> DataFrame:
    """The key of each new entity of a batch: rows linked by lasting identities or URLs, over any number of steps, share the smallest row_id."""
    fresh = rows.filter(F.col("entity_id").isNull())
    named = chains(fresh, BATCH_KEYS).select("row_id", F.col("chain").alias("new_key"))
    return fresh.join(named, "row_id")


def batch_entities(resolved_rows: DataFrame, keys: list[list[str]] = BATCH_KEYS) -> DataFrame:
    """Settles a batch of ``resolved`` rows: adds entity (stored, or null), new_key (or null) and ``via`` (stored, batch, new).

    Rows that no rule found but that a chain links to a resolved row of the
    batch take its entity (of several, that of the smallest row_id); chains
    without one become new entities. Rows that a rule found keep theirs.
    """
    rows = resolved_rows.join(chains(resolved_rows, keys), "row_id")
    known = rows.filter(F.col("entity_id").isNotNull()).groupBy("chain").agg(F.min_by("entity_id", "row_id").alias("_entity"))
    rows = rows.join(known, "chain", "left")
    entity = F.coalesce("entity_id", "_entity")
    via = F.when(F.col("entity_id").isNotNull(), "stored").when(F.col("_entity").isNotNull(), "batch").otherwise("new")
    return rows.select(*resolved_rows.columns, entity.alias("entity"), F.when(entity.isNull(), F.col("chain")).alias("new_key"), via.alias("via"))


def home_entities(incoming: DataFrame, stored: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """``batch_entities`` of homes: a listing that goes on under another token keeps its entity before any other rule but the listing's own.

    ``previous`` and ``current`` are the sides of ``continued``; a row's token
    is its listing_key, and the stored listing of the same source with the
    earlier token gives the entity.
    """
    on = continued(previous, current).select(F.col("cur_token").alias("listing_key"), F.col("prev_token").alias("_earlier"))
    old = stored.select("source_id", F.col("listing_key").alias("_earlier"), F.col("entity_id").alias("_entity"), "listing_id")
    found = incoming.select("row_id", "source_id", "listing_key").join(on, "listing_key").join(old, ["source_id", "_earlier"])
    goes_on = first_of_each(found, ["row_id"], [F.col("listing_id")]).select("row_id", "_entity")
    rows = resolved(incoming, stored, HOME_RULES).join(goes_on, "row_id", "left")
    own = F.col("by") == "listing"
    entity = F.when(own, F.col("entity_id")).otherwise(F.coalesce("_entity", "entity_id"))
    by = F.when(own, F.col("by")).when(F.col("_entity").isNotNull(), "continuity").otherwise(F.col("by"))
    return batch_entities(rows.select(*incoming.columns, entity.alias("entity_id"), by.alias("by")), [["url"], ["identity"]])


def continued(previous: DataFrame, current: DataFrame) -> DataFrame:
    """prev_token, cur_token and strategy of listings that go on under another token.

    First by postal code, title, price and area (equal nulls match, but
    price and area can't both be null), then what is left by postal code,
    title of at least 16 characters and area. Only groups of one row on each
    side match; anything ambiguous stays unmatched.
    """
    def stage(p: DataFrame, c: DataFrame, keys: list[str], name: str) -> DataFrame:
        side = lambda rows, token, n: rows.groupBy(*keys).agg(F.min("token").alias(token), F.count("*").alias(n)).filter(F.col(n) == 1)
        a = side(p, "prev_token", "n1")
        b = side(c, "cur_token", "n2")
        b = b.select("cur_token", *(F.col(k).alias(f"c_{k}") for k in keys))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"c_{k}"))
        return a.join(b, match).select("prev_token", "cur_token", F.lit(name).alias("strategy"))

    base = lambda rows: rows.filter(F.col("postal_code").isNotNull() & F.col("title").isNotNull() & (F.col("title") != ""))
    p, c = base(previous), base(current)
    known = F.col("price").isNotNull() | F.col("area").isNotNull()
    exact = stage(p.filter(known), c.filter(known), ["postal_code", "title", "price", "area"], "exact")
    rest_p = p.join(exact.select(F.col("prev_token").alias("token")), "token", "left_anti")
    rest_c = c.join(exact.select(F.col("cur_token").alias("token")), "token", "left_anti")
    long = (F.length("title") >= 16) & F.col("area").isNotNull()
    return exact.unionByName(stage(rest_p.filter(long), rest_c.filter(long), ["postal_code", "title", "area"], "title_area"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a new value wins where it isn't null, and columns that ``new`` lacks stay."""
    a, b = old.alias("o"), new.alias("n")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    columns = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns]
    return a.join(b, match, "full").select(*columns)


def merged_map(old: str = "old_payload", new: str = "new_payload") -> Column:
    """``merged_payload`` as a map of variants."""
    kind = "map<string,variant>"
    empty = F.create_map().cast(kind)
    a, b = F.coalesce(F.from_json(old, kind), empty), F.coalesce(F.from_json(new, kind), empty)
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    true = lambda m: F.coalesce(F.to_json(F.element_at(m, "detail_enriched")) == "true", F.lit(False))
    was, now = true(a), true(b)
    error = F.element_at(b, "detail_enrichment_error")
    failed = F.coalesce(~F.to_json(error).isin("null", '""', "false", "0", "[]", "{}"), F.lit(False))
    without = lambda *keys: F.map_filter(both, lambda k, _: ~k.isin(*keys))
    flag = F.create_map(F.lit("detail_enriched"), F.parse_json(F.lit("true")))
    kept = F.when(failed, F.map_concat(without("detail_enriched", "detail_enrichment_error", "detail_enrichment_last_error"), flag, F.create_map(F.lit("detail_enrichment_last_error"), error)))
    kept = kept.otherwise(F.map_concat(without("detail_enriched", "detail_enrichment_error"), flag))
    return F.when(was & ~now, kept).when(now, without("detail_enrichment_error", "detail_enrichment_last_error")).otherwise(both)


def merged_payload(old: str = "old_payload", new: str = "new_payload") -> Column:
    """The JSON object of both, the new value winning; values keep their kinds, and what is no object is empty.

    A stored ``detail_enriched`` of true stays; what then went wrong in the
    new run is kept as ``detail_enrichment_last_error``. A run that enriches
    clears both errors.
    """
    return F.to_json(merged_map(old, new))


def synced_seed(rows: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Preference rows after a sync: manual rows stay, seed rows follow the seed, seed rows that left it go."""
    a = rows.select(*keys, F.col("state").alias("old"), F.col("source").alias("old_source"))
    b = seed.select(*keys, F.col("state").alias("fresh"))
    joined = a.join(b, keys, "full")
    manual = F.coalesce(F.col("old_source") == "manual", F.lit(False))
    state = F.when(manual, F.col("old")).otherwise(F.col("fresh"))
    return joined.select(*keys, state.alias("state"), F.when(manual, "manual").otherwise("seed").alias("source")).filter(F.col("state").isNotNull())
