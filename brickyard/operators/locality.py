"""From place labels to points: scopes, anchors, postal centroids and the ladder of rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.checkpoints import kept
from brickyard.functions.text import locality_words


@dataclass(frozen=True)
class Places:
    """Fixed values of the ladder: labels that are no point, aliases, and regions that mean several places."""

    scopes: tuple[str, ...] = (
        "austria", "österreich", "remote", "home office", "homeoffice", "remote austria", "home office austria", "burgenland", "kärnten", "kaernten", "niederösterreich", "niederoesterreich", "oberösterreich", "oberoesterreich", "steiermark", "tirol", "vorarlberg",
        "ostösterreich", "ostoesterreich", "westösterreich", "westoesterreich", "südösterreich", "suedoesterreich",
        "österreichweit", "oesterreichweit", "austriawide", "austria wide", "wels land", "graz umgebung west",
    )
    aliases: dict[str, str] = field(default_factory=lambda: {
        "vienna": "wien", "vienna austria": "wien", "wien austria": "wien", "graz austria": "graz", "linz austria": "linz", "salzburg austria": "salzburg", "innsbruck austria": "innsbruck",
        "klagenfurt": "klagenfurt am wörthersee", "klagenfurt austria": "klagenfurt am wörthersee", "klagenfurt am worthersee": "klagenfurt am wörthersee",
    })
    regions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "oberösterreich zentralraum": ("linz", "wels", "steyr"), "oberoesterreich zentralraum": ("linz", "wels", "steyr"),
        "zentralraum oberösterreich": ("linz", "wels", "steyr"), "zentralraum oberoesterreich": ("linz", "wels", "steyr"),
    })


def is_scope(label: Column, places: Places = Places()) -> Column:
    """Whether a label names a country, region or district and so no point."""
    words = locality_words(label)
    return words.isin(*places.scopes) | words.rlike("^bezirk ")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, so that nested rules don't repeat each other's expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(label: Column, places: Places = Places()) -> Column:
    """A label's locality in normal words, or null for a scope."""
    known = F.create_map(*(F.lit(x) for pair in places.aliases.items() for x in pair))
    scope = lambda w: w.isin(*places.scopes) | w.rlike("^bezirk ")
    return let(locality_words(label), lambda w: F.when((w != "") & ~scope(w), F.coalesce(F.element_at(known, w), w)))


def components_of(label: Column, places: Places = Places()) -> Column:
    """The localities a label stands for, null if it is none: anchors ("südlich von X", "X Umgebung"), named regions, "Großraum A, B"."""
    raw = F.trim(F.regexp_replace(F.lower(F.trim(label)), r"(?:\s*,\s*|\s+)(?:austria|österreich)$", ""))
    region = F.create_map(*(x for name, members in places.regions.items() for x in (F.lit(name), F.array(*map(F.lit, members)))))
    none = F.lit(None).cast("array<string>")
    one = lambda x: let(canonical(x, places), lambda c: F.when(c.isNotNull(), F.array(c)))

    def several(area: Column) -> Column:
        parts = F.transform(F.split(area, r"\s*[,;/]\s*"), lambda x: canonical(x, places))
        return let(parts, lambda p: F.when((F.size(p) >= 2) & ~F.exists(p, lambda x: x.isNull()), F.array_distinct(p)).otherwise(none))

    def rules(r: Column) -> Column:
        direction = F.regexp_extract(r, r"^(?:nördlich|südlich|östlich|westlich|noerdlich|suedlich|oestlich) von (.+)$", 1)
        around = F.regexp_extract(r, r"^(?:raum\s+)?(.+?)\s+(?:und\s+)?umgebung$", 1)
        room = F.regexp_extract(r, r"^raum\s+(.+)$", 1)
        area = F.regexp_extract(r, r"^(?:großraum|grossraum)\s+(.+)$", 1)
        named = F.element_at(region, locality_words(r))
        return F.when(direction != "", one(direction)).when(named.isNotNull(), named).when(around != "", one(around)).when(room != "", one(room)).when(area != "", several(area)).otherwise(none)

    single = r"^(?:(?:nördlich|südlich|östlich|westlich|noerdlich|suedlich|oestlich) von .+|.+\s+umgebung|raum\s+.+|(?:großraum|grossraum)\s+.+)$"
    return let(raw, lambda r: F.when(r.rlike(single) | F.element_at(region, locality_words(r)).isNotNull(), rules(r)).otherwise(one(label)))


def name_matches(name: Column, locality: Column) -> Column:
    """Equal, or the locality and a further word: wien is not wiener neustadt."""
    return (name == locality) | name.startswith(F.concat(locality, F.lit(" ")))


def weighted_centroids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean point of each key weighted by samples (at least 1 each), with the codes and the samples' sum."""
    w = F.greatest(F.lit(1), F.coalesce("samples", F.lit(0)))
    return rows.groupBy(*keys).agg(
        (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"),
        F.sum(F.greatest(F.lit(0), F.coalesce("samples", F.lit(0)))).alias("samples"), F.array_sort(F.collect_set("postal_code")).alias("codes"),
    )


def prefixes(postal: DataFrame) -> DataFrame:
    """Postal rows with a point, once for each run of words that their name begins with (``locality``): what ``name_matches`` finds is equality with one."""
    words = F.split(locality_words(F.col("name")), " ")
    rows = postal.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("_words", words)
    runs = F.transform(F.sequence(F.lit(1), F.size("_words")), lambda n: F.array_join(F.slice("_words", F.lit(1), n), " "))
    return rows.withColumn("locality", F.explode(runs)).filter(F.col("locality") != "").drop("_words")


def resolve(labels: DataFrame, postal: DataFrame, places: Places = Places()) -> DataFrame:
    """label, lon, lat, codes and samples of each label all of whose localities are known; others are left out.

    A label's localities meet the runs of words that postal names begin with,
    so the join is an equi-join however long the table of names is. A label
    of several localities is the plain mean of their centroids.
    """
    rows = labels.select("label").distinct().withColumn("parts", components_of(F.col("label"), places)).filter(F.col("parts").isNotNull())
    parts = rows.select("label", F.size("parts").alias("n"), F.explode("parts").alias("locality"))
    points = weighted_centroids(parts.join(prefixes(postal), "locality"), ["label", "n", "locality"])
    return points.groupBy("label", "n").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.sum("samples").alias("samples"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"), F.count("*").alias("found")
    ).filter(F.col("found") == F.col("n")).drop("found", "n")


def filter_centres(filters: DataFrame, postal: DataFrame, places: Places = Places()) -> DataFrame:
    """Adds centre_lon, centre_lat and ``unknown`` to filters with a ``place``: a code's own point first, else what the ladder knows of its words.

    A blank or null place is no filter: it has no centre and isn't unknown.
    """
    place = F.trim("place")
    wanted = filters.select(place.alias("label")).filter(F.col("label") != "").distinct()
    code = postal.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy(F.col("postal_code").alias("label")).agg(F.min(F.struct("lon", "lat")).alias("p")).select("label", "p.*")
    by_code = wanted.filter(F.col("label").rlike(r"^\d{4}$")).join(code, "label")
    found = kept(by_code.unionByName(resolve(wanted.join(by_code, "label", "left_anti"), postal, places).select("label", "lon", "lat")))
    centre = found.select(F.col("label").alias("_label"), F.col("lon").alias("centre_lon"), F.col("lat").alias("centre_lat"))
    rows = filters.join(centre, place == F.col("_label"), "left").drop("_label")
    return rows.withColumn("unknown", (F.coalesce(place, F.lit("")) != "") & F.col("centre_lon").isNull())


def propagated(locations: DataFrame) -> DataFrame:
    """Fills postal_code, lon and lat of unresolved rows from resolved rows of the same job, city and remote flag that agree on one code."""
    key = ["job_id", "remote", "city"]
    peers = locations.filter(F.col("postal_code").isNotNull()).groupBy(*key).agg(F.count_distinct("postal_code").alias("n"), F.min("postal_code").alias("p"), F.min_by("lon", "location_id").alias("x"), F.min_by("lat", "location_id").alias("y")).filter("n = 1")
    joined = locations.join(peers, key, "left")
    fill = lambda c, by: F.when(F.col("postal_code").isNull(), F.coalesce(F.col(by), F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*(fill(c, {"postal_code": "p", "lon": "x", "lat": "y"}[c]) if c in ("postal_code", "lon", "lat") else F.col(c) for c in locations.columns))


def without_country_codes(locations: DataFrame) -> DataFrame:
    """Rows but for unresolved country codes of jobs that have another row with a code or point."""
    bare = F.lower(F.trim(F.coalesce("city", F.lit("")))).isin("at", "aut") & F.col("postal_code").isNull() & F.col("lon").isNull() & ~F.col("remote")
    known = F.col("postal_code").isNotNull() | F.col("lon").isNotNull()
    better = F.coalesce(F.bool_or(known).over(Window.partitionBy("job_id")), F.lit(False))
    return locations.withColumn("_better", better).filter(~(bare & F.col("_better"))).drop("_better")


def projected_means(addresses: DataFrame) -> DataFrame:
    """Mean easting and northing of each postal code and zone, with the count; rows without coordinates are left out."""
    rows = addresses.filter(F.col("easting").isNotNull() & F.col("northing").isNotNull() & F.col("epsg").isNotNull())
    return rows.groupBy("postal_code", "epsg").agg(F.avg("easting").alias("easting"), F.avg("northing").alias("northing"), F.count("*").alias("samples"))


def merged_zones(means: DataFrame) -> DataFrame:
    """One point for each code: its zones' points weighted by their counts. ``means`` has lon and lat by now."""
    return means.groupBy("postal_code").agg(
        (F.sum(F.col("lon") * F.col("samples")) / F.sum("samples")).alias("lon"), (F.sum(F.col("lat") * F.col("samples")) / F.sum("samples")).alias("lat"), F.sum("samples").alias("samples")
    )
