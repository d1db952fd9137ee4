"""Concept evidence in job texts and the fit score of a preference profile."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Fixed values of the score: weights by kind and scope, the worth of each state, and the bounds."""

    kind: dict[str, float] = field(default_factory=lambda: {"role": 1.15, "domain": 1.25, "task": 1.0, "method": 0.75, "tool": 0.75})
    scope: dict[str, float] = field(default_factory=lambda: {"primary": 1.0, "context": 0.35})
    state: dict[str, float] = field(default_factory=lambda: {"can_want": 1.0, "can_not_want": -0.2, "cannot_want": 0.2, "cannot_not_want": -1.0})
    least_weight: float = 3.0
    hard_most: float = -0.5


#: Confidence of evidence from a description, by kind; a title always gives 1.
DESCRIPTION_CONFIDENCE = {"role": 0.45, "domain": 0.55, "task": 0.80, "method": 0.85, "tool": 0.85}


def _lookup(values: dict[str, float], key: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


#: Vocabularies of up to so many aliases are looked for one by one; up to BROADCAST_ALIASES they are broadcast, and beyond it texts and aliases are shuffled by alias.
FEW_ALIASES = 64
BROADCAST_ALIASES = 100_000


def extract(jobs: DataFrame, vocabulary: DataFrame, few: int = FEW_ALIASES) -> DataFrame:
    """Evidence rows job_id, kind, slug, field and alias: the longest alias of each concept in a field.

    ``jobs`` has normalised title and description; ``vocabulary`` normalised
    aliases. A few aliases are looked for in each text, and only what is
    found becomes a row. Of larger vocabularies, a field's runs of as many
    words as aliases have meet the aliases in an equi-join, so no row carries
    a text.
    """
    aliases = vocabulary.filter(F.col("alias") != "")
    n_words = F.size(F.split("alias", " "))
    seen = aliases.agg(F.collect_set(n_words).alias("lengths"), F.count("*").alias("n")).first()
    fields = jobs.select("job_id", F.explode(F.create_map(F.lit("title"), "title", F.lit("description"), "description")).alias("field", "text")).withColumn("w", F.split("text", " "))
    best = F.max_by("alias", F.struct(F.length("alias"), "alias"))
    if seen["n"] <= few:
        # Spaces around both make whole words; the text gets its spaces once, not for each alias.
        words = F.array(*(F.lit(f" {r['alias']} ") for r in aliases.select("alias").distinct().collect())).cast("array<string>")
        hits = F.get(F.transform(F.array(F.concat(F.lit(" "), "text", F.lit(" "))), lambda t: F.filter(words, lambda a: t.contains(a))), F.lit(0))
        found = fields.select("job_id", "field", F.explode(F.transform(hits, lambda a: F.trim(a))).alias("alias")).join(F.broadcast(aliases), "alias")
        return found.groupBy("job_id", "kind", "slug", "field").agg(best.alias("alias"))
    runs = lambda n: F.col("w") if n == 1 else F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    every = F.flatten(F.array(*(runs(n) for n in sorted(seen["lengths"]) or [1])))
    grams = fields.select("job_id", "field", F.explode(F.array_distinct(every)).alias("alias"))
    found = grams.join(F.broadcast(aliases) if seen["n"] <= BROADCAST_ALIASES else aliases, "alias")
    return found.groupBy("job_id", "kind", "slug", "field").agg(best.alias("alias"))


def semantics(evidence: DataFrame) -> DataFrame:
    """Adds scope and confidence by the field that an alias stands in."""
    title = F.col("field") == "title"
    return evidence.withColumn("scope", F.when(title, "primary").otherwise("context")).withColumn("confidence", F.when(title, F.lit(1.0)).otherwise(_lookup(DESCRIPTION_CONFIDENCE, F.col("kind"))))


def weighted(evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The strongest evidence of each concept of a job: norm (kind weight by confidence) and eff (by scope too)."""
    scope = _lookup(policy.scope, F.col("scope"))
    norm = F.when(F.col("confidence").isNotNull(), _lookup(policy.kind, F.col("kind")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    rows = evidence.withColumn("norm", norm).withColumn("eff", norm * scope).filter(F.col("eff").isNotNull())
    # The stronger scope stands first among equals.
    return rows.groupBy("job_id", "kind", "slug").agg(F.max(F.struct("eff", "scope", "norm")).alias("best")).select("job_id", "kind", "slug", "best.*")


def score(evidence: DataFrame, preferences: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """job_id, score (0 to 100, null if nothing is rated), coverage and hard.

    Preferences are few, so Spark broadcasts them; sums are two small
    aggregates by job.
    """
    rows = weighted(evidence, policy).join(preferences.select("kind", "slug", "state"), ["kind", "slug"], "left")
    worth = _lookup(policy.state, F.col("state"))
    hard = (F.col("scope") == "primary") & F.col("kind").isin("role", "domain") & (F.col("state") == "cannot_not_want")
    sums = rows.groupBy("job_id").agg(
        F.sum("norm").alias("total"), F.coalesce(F.sum(F.when(worth.isNotNull(), F.col("norm"))), F.lit(0.0)).alias("rated"),
        F.sum(F.col("eff") * worth).alias("signed"), F.coalesce(F.bool_or(hard), F.lit(False)).alias("hard"),
    )
    below = F.when(F.col("signed") > 0, F.greatest("rated", F.lit(policy.least_weight))).otherwise(F.col("rated"))
    share = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("signed") / below))
    share = F.when(F.col("hard"), F.least(share, F.lit(policy.hard_most))).otherwise(share)
    return sums.select(
        "job_id",
        F.when(F.col("rated") > 0, F.bround(F.lit(50.0) + F.lit(50.0) * share)).cast("int").alias("score"),
        F.when(F.col("total") > 0, F.col("rated") / F.col("total")).otherwise(F.lit(0.0)).alias("coverage"),
        "hard",
    )


def drivers(evidence: DataFrame, preferences: DataFrame, policy: Policy = Policy(), k: int = 4) -> DataFrame:
    """The ``k`` concepts of each job that move its score most, with their contribution and rank."""
    from .radius import first_of_each

    rows = weighted(evidence, policy).join(preferences.select("kind", "slug", "state"), ["kind", "slug"])
    rows = rows.withColumn("contribution", F.col("eff") * _lookup(policy.state, F.col("state")))
    return first_of_each(rows, ["job_id"], [F.abs("contribution").desc(), F.col("kind"), F.col("slug")], k, "rank").select("job_id", "rank", "kind", "slug", "contribution")


def views(jobs: DataFrame, evidence: DataFrame, preferences: DataFrame, concepts: DataFrame, states: DataFrame, places: DataFrame, links: DataFrame, baseline: Column, policy: Policy = Policy()) -> DataFrame:
    """The fit list: each job with score, coverage, labels of its drivers and hard constraints, places, links, curation and its position.

    ``jobs``: job_id and first_seen_at; ``concepts``: kind, slug and label
    (a concept without one shows its slug); ``states``: job_id, favorite,
    hidden and viewed; ``places``: job_id, at and label; ``links``: job_id,
    at and url. Labels and links stand in the order of ``at``, each once. A
    job without evidence has no score; coverage is rounded to nine digits, so
    that the order doesn't hang on how sums were split. ``is_new``: first seen after the
    baseline and never viewed.
    """
    from .catalog import live_fit_order, positions

    labels = concepts.select("kind", "slug", F.col("label").alias("_label"))
    named = lambda rows: rows.join(labels, ["kind", "slug"], "left").withColumn("label", F.coalesce("_label", "slug"))
    moves = named(drivers(evidence, preferences, policy)).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "contribution"))).alias("d"))
    hard = weighted(evidence, policy).filter((F.col("scope") == "primary") & F.col("kind").isin("role", "domain")).join(preferences.filter(F.col("state") == "cannot_not_want").select("kind", "slug"), ["kind", "slug"], "left_semi")
    # A job has few concepts, places and sources.
    blocks = named(hard).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("kind", "slug", "label"))).alias("h"))
    listed = lambda rows, c, name: rows.filter(F.coalesce(c, F.lit("")) != "").groupBy("job_id", c).agg(F.min("at").alias("at")).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias(name))
    none = F.array().cast("array<string>")
    rows = jobs.join(score(evidence, preferences, policy), "job_id", "left").join(moves, "job_id", "left").join(blocks, "job_id", "left").join(listed(places, "label", "places"), "job_id", "left").join(listed(links, "url", "links"), "job_id", "left").join(states, "job_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.select(
        "job_id", "score", F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"), no("hard"), F.coalesce(F.transform("d", lambda x: x["label"]), none).alias("drivers"), F.coalesce(F.transform("h", lambda x: x["label"]), none).alias("hard_labels"),
        F.coalesce("places", none).alias("places"), F.coalesce("links", none).alias("links"), no("favorite"), no("hidden"), no("viewed"), (F.coalesce(F.col("first_seen_at") > baseline, F.lit(False)) & ~F.coalesce("viewed", F.lit(False))).alias("is_new"),
    )
    return positions(rows, live_fit_order())
