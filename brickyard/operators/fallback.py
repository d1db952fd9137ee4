"""What the ladder of places leaves: a cascade of exact rules over the residue.

Each label gets a short list of attempts, in order; each attempt is one
equi-join with the runs of words that postal names begin with, or with a
table of official memberships. The first attempt that finds a point counts.
Nothing is matched by similarity, and no region gets a centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.checkpoints import kept

from .locality import Places, canonical, let, prefixes, resolve, weighted_centroids

#: How a point was found, and where from.
METHOD = "locality_weighted_postal_centroid"
OFFICIAL_METHOD = "statistics_austria_locality_postal_centroid"
VERIFIED_METHOD = "verified_sublocality_postal_centroid"
SOURCE = "RTR postal names + BEV postal centroids"
VERIFIED_SOURCE = "verified Austrian sublocality postal membership + BEV postal centroids"
#: Localities that aren't names of delivery places, and their postal codes.
OFFICIAL = {
    "blaindorf": ("8224", "8265"),
    "ebenthal in kärnten": ("9065",),
    "premstätten": ("8141",),
    "ranshofen": ("5280", "5282"),
    "traboch": ("8770", "8772", "8792"),
}
VERIFIED = {"puntigam": ("8055",), "schaftenau": ("6336",)}

DIRECT, SAINT, DISTRICT, TOWN, BESIDE, MEMBER, PART = range(1, 8)


def memberships(spark: SparkSession, official: dict[str, tuple[str, ...]] = OFFICIAL, verified: dict[str, tuple[str, ...]] = VERIFIED) -> DataFrame:
    """locality, step and postal_code of the two tables of memberships."""
    rows = [(k, step, code) for step, known in ((MEMBER, official), (PART, verified)) for k, codes in known.items() for code in codes]
    return spark.createDataFrame(rows, "locality string, step int, postal_code string")


def attempts(label: Column, places: Places = Places()) -> Column:
    """The attempts by name of a label as an array of step and locality, null for a scope.

    ``Sankt`` at the beginning is tried as ``St``. A district of Vienna is
    Vienna and "X Stadt" is X, and both end there; "X bei Y" is X only if
    postal names know one X.
    """
    step = lambda n, name: F.struct(F.lit(n).alias("step"), name.alias("locality"))

    def rules(words: Column) -> Column:
        saint = F.regexp_replace(words, "^sankt ", "st ")
        district = words.rlike(r"^wien \d{1,2} ?bezirk( .*)?$")
        town = F.regexp_extract(words, "^(.+?) stadt$", 1)
        beside = canonical(F.regexp_extract(words, "^(.+?) bei .+$", 1), places)
        last = F.when(district, step(DISTRICT, F.lit("wien"))).when(town != "", step(TOWN, town)).otherwise(step(BESIDE, beside))
        tries = F.array(step(DIRECT, words), step(SAINT, F.when(saint != words, saint)), last)
        return F.when(words.isNotNull(), F.filter(tries, lambda x: x["locality"].isNotNull()))

    return let(canonical(label, places), rules)


def fall_back(labels: DataFrame, postal: DataFrame, members: DataFrame | None = None, places: Places = Places()) -> DataFrame:
    """label, locality, lon, lat, samples, codes, method and source of each label that an attempt resolves; others are left out.

    ``postal`` has postal_code, name, lon, lat and samples; rows without a
    point don't count. ``members`` has locality, step and postal_code
    (default: ``memberships``); it is asked last, and not for what ends at a
    district or "X Stadt". Labels repeat without effect; null is no label.
    """
    members = memberships(labels.sparkSession) if members is None else members
    rows = labels.select("label").filter(F.col("label").isNotNull()).distinct().withColumn("tries", attempts(F.col("label"), places)).filter(F.col("tries").isNotNull())
    tries = rows.select("label", F.explode("tries").alias("t")).select("label", "t.step", "t.locality")
    by_name = tries.join(prefixes(postal), "locality").withColumn("family", canonical(F.col("name"), places))
    ends = F.exists("tries", lambda t: t["step"].isin(DISTRICT, TOWN))
    asked = rows.filter(~ends).select("label", canonical(F.col("label"), places).alias("locality"))
    named = postal.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    by_code = asked.join(members, "locality").join(named, "postal_code").withColumn("family", F.lit(None).cast("string"))
    columns = ["label", "step", "locality", "family", "postal_code", "lon", "lat", "samples"]
    hits = by_name.select(*columns).unionByName(by_code.select(*columns))
    key = ["label", "step", "locality"]
    families = hits.groupBy(*key).agg(F.count_distinct("family").alias("families"))
    points = weighted_centroids(hits, key).join(families, key).filter((F.col("step") != BESIDE) | (F.col("families") == 1))
    best = points.groupBy("label").agg(F.min(F.struct("step", "locality", "lon", "lat", "samples", "codes")).alias("b")).select("label", "b.*")
    method = F.when(F.col("step") == MEMBER, OFFICIAL_METHOD).when(F.col("step") == PART, VERIFIED_METHOD).otherwise(METHOD)
    source = F.when(F.col("step") == PART, VERIFIED_SOURCE).otherwise(SOURCE)
    return best.select("label", "locality", "lon", "lat", "samples", "codes", method.alias("method"), source.alias("source"))


def resolve_all(labels: DataFrame, postal: DataFrame, members: DataFrame | None = None, places: Places = Places()) -> DataFrame:
    """label, lon, lat, samples, codes and ``by`` (ladder or fallback): the ladder first, and the cascade over what it leaves."""
    columns = ["label", "lon", "lat", "samples", "codes"]
    found = kept(resolve(labels, postal, places))
    rest = labels.select("label").distinct().join(found.select("label"), "label", "left_anti")
    more = fall_back(rest, postal, members, places)
    return found.select(*columns, F.lit("ladder").alias("by")).unionByName(more.select(*columns, F.lit("fallback").alias("by")))
