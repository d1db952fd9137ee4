"""Queries on state and archives: the numbered journal, last sightings, members of archives, and counts by tenant and place."""

from __future__ import annotations

from io import BytesIO
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.operators import locality, rollups
from brickyard.sources import homes
from brickyard.streaming import journal, lastseen

from .registry import dealt, query, table

# Topic and kind of events: of every 7 one has a topic that isn't known, of every 11 one a blank kind.
TOPIC = "CASE WHEN event_id % 7 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN 'jobs' ELSE 'houses' END"
KIND = "CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END"


@query(f"""WITH e AS (SELECT event_id AS source_event, ts, {TOPIC} AS topic, {KIND} AS kind, event_id % 2 AS half FROM events)
SELECT row_number() OVER (ORDER BY half, ts, source_event) AS event_id, source_event, topic, kind FROM e WHERE topic <> 'other' AND trim(kind) <> ''""")
def appended_journal(spark, d):
    """Two batches appended one after the other; the second run of each finds nothing to do."""
    path = journal.shared_folder(spark, "events")
    events = table(spark, d, "events").select(F.col("event_id").alias("source_event"), "ts", F.expr(TOPIC).alias("topic"), F.expr(KIND).alias("kind"), (F.col("event_id") % 2).alias("half"))
    schema = events.schema
    apply = journal.append(f"{path}/journal", [F.col("ts"), F.col("source_event")])
    for half in (0, 1):
        events.filter(F.col("half") == half).write.parquet(f"{path}/raw/half-{half}")
        for _ in range(2):
            journal.run_once(journal.follow(spark, f"{path}/raw/*", schema), f"{path}/cursor", apply)
    stored = journal.stored(spark, f"{path}/journal", T.StructType([*schema.fields, T.StructField("event_id", T.LongType())]))
    return stored.select("event_id", "source_event", "topic", "kind")


@query("""WITH o AS (SELECT o_custkey % 300 AS source, o_orderkey % 40 AS "key", o_orderkey AS k, o_totalprice AS price, o_orderkey % 2 AS half FROM orders WHERE o_orderkey % 13 <> 0)
SELECT half AS batch, source, "key", max(k) AS "at", arg_max(price, k) AS price FROM o GROUP BY 1, 2, 3""")
def ingested_batches(spark, d):
    """Raw JSON rows taken in as two micro-batches: the latest of each key in a batch, broken rows left out; a second run of each finds nothing."""
    path = journal.shared_folder(spark, "ingest")
    k = F.col("o_orderkey")
    raw = F.when(k % 13 == 0, "{broken").otherwise(F.to_json(F.struct((F.col("o_custkey") % 300).alias("source"), (k % 40).alias("key"), k.alias("at"), F.col("o_totalprice").alias("price"))))
    rows = table(spark, d, "orders").select(raw.alias("payload"), (k % 2).alias("half"))

    def parse(batch):
        return batch.select(F.from_json("payload", "source long, key long, at long, price double").alias("r")).select("r.*").filter("key IS NOT NULL")

    apply = journal.ingest(f"{path}/rows", parse, ["source", "key"], ["at"])
    schema = T.StructType([T.StructField("payload", T.StringType())])
    for half in (0, 1):
        rows.filter(F.col("half") == half).select("payload").write.parquet(f"{path}/raw/half-{half}")
        for _ in range(2):
            journal.run_once(journal.follow(spark, f"{path}/raw/*", schema), f"{path}/cursor", apply)
    return spark.read.parquet(f"{path}/rows").select(F.col("batch").cast("long").alias("batch"), "source", "key", "at", "price")


@query("""WITH w AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS mark FROM events)
SELECT user_id AS entity, CASE WHEN epoch_us(max(ts)) // 1000 + 43200000 <= any_value(mark) THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n FROM events, w WHERE user_id IS NOT NULL GROUP BY 1""")
def last_seen_stream(spark, d):
    """The journal as a stream; users that aren't seen for half a day before the watermark are inactive."""
    schema = table(spark, d, "events").schema
    stream = journal.follow(spark, d, schema, "events.parquet*")
    out = journal.shared_folder(spark, "seen")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, lastseen.STORE)
    try:
        journal.run_once(lastseen.last_seen(stream, entity="user_id", delay="1 day", expiry_days=0.5), f"{out}/cursor", lastseen.into(f"{out}/rows"), mode="update")
    finally:
        spark.conf.set(key, before)
    rows = lastseen.current(spark.read.parquet(f"{out}/rows"))
    return rows.select("entity", "status", F.unix_millis("first_seen_at").alias("first_ms"), F.unix_millis("last_seen_at").alias("last_ms"), "n")


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of a group's lines: odd groups hold their table in an inner archive, beside a file of another name."""
    lines = "\ufeff" + "\r\n".join(["ADRCD;PLZ;RW;HW;EPSG", *rows["line"]]) + "\r\n"
    inner = BytesIO()
    with ZipFile(inner, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("data/Adresse.CSV", lines.encode())
    group = int(rows["g"].iloc[0])
    if group % 2:
        outer = BytesIO()
        with ZipFile(outer, "w") as z:
            z.writestr("GEBAEUDE.csv", "x;y")
            z.writestr("snapshot.zip", inner.getvalue())
        inner = outer
    return pd.DataFrame({"path": [f"{group}.zip"], "content": [inner.getvalue()]})


@query("""WITH a AS (SELECT lpad((c_custkey % 90 + 1000)::VARCHAR, 4, '0') AS postal_code, (c_custkey % 3 + 31254)::INT AS epsg, c_custkey % 997 + 0.5 AS easting, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 991 END AS northing FROM customer)
SELECT postal_code, epsg, round(avg(easting), 4)::DOUBLE AS easting, round(avg(northing), 4)::DOUBLE AS northing, count(*) AS samples FROM a WHERE northing IS NOT NULL GROUP BY 1, 2""")
def archived_addresses(spark, d):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    line = F.concat_ws(";", text(k), F.lpad(text(k % 90 + 1000), 4, "0"), F.concat(text(k % 997), F.lit(",5")), F.when(k % 5 != 0, text(k % 991)).otherwise("#"), text(k % 3 + 31254))
    files = table(spark, d, "customer").select(F.floor(k / 100).alias("g"), line.alias("line")).groupBy("g").applyInPandas(_zipped, "path string, content binary")
    means = locality.projected_means(homes.archived_register(files))
    return means.select("postal_code", "epsg", F.round("easting", 4).alias("easting"), F.round("northing", 4).alias("northing"), "samples")


def _exports(rows: pd.DataFrame) -> pd.DataFrame:
    """Each export alone, or in an archive beside a longer name and a file of another kind."""
    out = []
    for k, xml in zip(rows["k"], rows["xml"]):
        if k % 3 == 0:
            out.append((f"{k}.xml", xml.encode()))
            continue
        box = BytesIO()
        with ZipFile(box, "w") as z:
            z.writestr("a.xml" if k % 3 == 1 else "longer name.xml", "<openimmo/>" if k % 3 == 1 else "<x/>")
            z.writestr("export-OpenImmo.XML" if k % 3 == 1 else "e.xml", xml)
            z.writestr("i.jpg", "x")
        out.append((f"{k}.zip", box.getvalue()))
    return pd.DataFrame(out, columns=["path", "content"])


@query("""SELECT 'o' || p_partkey AS listing_key, p_name AS title, p_size * 1000::DOUBLE AS price, '4020' AS postal_code, p_size % 2 = 0 AS "full", p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.xml' ELSE '.zip' END AS path FROM part""")
def archived_exports(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    head = F.concat(F.lit('<openimmo><uebertragung umfang="'), F.when(size % 2 == 0, "VOLL").otherwise("TEIL"), F.lit('"/><anbieter><immobilie><objektkategorie><vermarktungsart KAUF="1"/><objektart><haus/></objektart></objektkategorie><geo><plz>4020</plz></geo><preise><kaufpreis>'))
    xml = F.concat(head, size.cast("string"), F.lit("000</kaufpreis></preise><freitexte><objekttitel>"), F.col("p_name"), F.lit("</objekttitel></freitexte><verwaltung_techn><objektnr_extern>o"), k.cast("string"), F.lit("</objektnr_extern></verwaltung_techn></immobilie></anbieter></openimmo>"))
    files = dealt(spark, d, "part", "p_partkey").select(k.alias("k"), xml.alias("xml")).mapInPandas(lambda parts: (_exports(p) for p in parts), "path string, content binary")
    return homes.archived_homes(files).select("listing_key", "title", F.col("price").cast("double"), "postal_code", "full", "path")


LISTINGS = """l AS (SELECT o_custkey % 20 AS source_id, o_orderkey // 3 AS job_id, o_orderstatus = 'O' AS active, o_orderkey % 3 <> 0 AS ok, CASE WHEN o_orderkey % 4 = 0 THEN 's' || o_orderkey % 6 END AS site, CASE WHEN o_orderkey % 8 = 0 THEN 'eu' ELSE '' END AS region,
  CASE WHEN o_orderkey % 5 = 0 THEN 't' || o_orderkey % 3 END AS tenant FROM orders),
r AS (SELECT DISTINCT source_id, job_id FROM l WHERE active AND ok),
p AS (SELECT l_orderkey // 3 AS job_id, CASE WHEN l_linenumber % 3 = 0 THEN '4020' END AS postal_code, CASE WHEN l_linenumber % 2 = 0 THEN 'Linz' END AS city, CASE WHEN l_linenumber <= 4 THEN 14.3 END AS lon, CASE WHEN l_linenumber > 5 THEN 'Raum ' || l_suppkey % 60 END AS location_text FROM lineitem)"""


def _listings(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return table(spark, d, "orders").select((c % 20).alias("source_id"), F.expr("o_orderkey div 3").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"), (k % 3 != 0).alias("accepted"), F.when(k % 4 == 0, of("s", k % 6)).alias("site"), F.when(k % 8 == 0, "eu").otherwise("").alias("region"), F.when(k % 5 == 0, of("t", k % 3)).alias("tenant"))


def _places(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.expr("l_orderkey div 3").alias("job_id"), F.when(n % 3 == 0, "4020").alias("postal_code"), F.when(n % 2 == 0, "Linz").alias("city"), F.when(n <= 4, 14.3).alias("lon"), F.when(n > 5, F.concat(F.lit("Raum "), (F.col("l_suppkey") % 60).cast("string"))).alias("location_text"))


@query(f"WITH {LISTINGS} SELECT source_id, CASE WHEN site IS NOT NULL THEN CASE region WHEN '' THEN 'unknown' ELSE region END || ':' || site ELSE coalesce(tenant, 'unknown') END AS tenant, count(*) AS active, count(*) FILTER (ok) AS relevant FROM l WHERE active GROUP BY 1, 2")
def tenant_counts(spark, d):
    return rollups.tenant_counts(_listings(spark, d))


@query(f"""WITH {LISTINGS} SELECT source_id, count(*) AS places, count(lon) AS geo_resolved, count(postal_code) AS postal_resolved, count(*) FILTER (lon IS NOT NULL AND postal_code IS NULL AND city IS NOT NULL) AS city_approx, count(*) FILTER (lon IS NULL) AS unresolved
FROM r JOIN p USING (job_id) GROUP BY 1""")
def location_coverage(spark, d):
    return rollups.location_coverage(_listings(spark, d), _places(spark, d))


@query(f"""WITH {LISTINGS}, c AS (SELECT source_id, location_text, count(*) AS n FROM r JOIN p USING (job_id) WHERE lon IS NULL AND location_text IS NOT NULL GROUP BY 1, 2)
SELECT source_id, rank::INT AS rank, location_text, n FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, location_text) AS rank FROM c) WHERE rank <= 30""")
def unresolved_texts(spark, d):
    return rollups.unresolved_texts(_listings(spark, d), _places(spark, d))
