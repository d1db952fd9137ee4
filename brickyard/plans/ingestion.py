"""Queries on what scans bring in: identity, continuity, queues, guards, audits, and merges of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.operators import catalog, dedupe, identity, lifecycle, observations, queues, rollups, sync

from .registry import query, table


def _key() -> Column:
    return F.col("o_orderkey")


STORED = "st AS (SELECT o_orderkey AS listing_id, o_custkey % 5 AS source_id, o_orderkey AS listing_key, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_custkey % 500) END AS identity, CASE WHEN o_orderkey % 8 < 4 THEN o_orderkey // 2 ELSE o_orderkey + 10000000 END AS entity_id FROM orders)"
SEEN = "seen AS (SELECT o_custkey % 5 AS source_id, o_orderkey AS listing_key, CASE WHEN o_orderkey % 4 <> 0 THEN 'p' || (o_custkey % 500) END AS identity FROM orders WHERE o_orderkey % 2 = 0)"
MOVES = f"""{STORED}, {SEEN}, own AS (SELECT identity, arg_min(entity_id, listing_id) AS owner FROM st WHERE identity IS NOT NULL GROUP BY 1),
mv AS (SELECT listing_id, entity_id, coalesce(owner, entity_id) AS target FROM st JOIN seen USING (source_id, listing_key) LEFT JOIN own ON seen.identity = own.identity)"""


def _stored(spark, d) -> DataFrame:
    person = F.concat(F.lit("p"), (F.col("o_custkey") % 500).cast("string"))
    return table(spark, d, "orders").select(_key().alias("listing_id"), (F.col("o_custkey") % 5).alias("source_id"), _key().alias("listing_key"), F.when(_key() % 3 == 0, person).alias("identity"), F.when(_key() % 8 < 4, F.expr("o_orderkey div 2")).otherwise(_key() + 10_000_000).alias("entity_id"))


def _moves(spark, d) -> DataFrame:
    person = F.concat(F.lit("p"), (F.col("o_custkey") % 500).cast("string"))
    seen = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select((F.col("o_custkey") % 5).alias("source_id"), _key().alias("listing_key"), F.when(_key() % 4 != 0, person).alias("identity"))
    return observations.repointed(seen, _stored(spark, d))


@query(f"WITH {MOVES} SELECT * FROM mv")
def repointed_listings(spark, d):
    return _moves(spark, d)


@query(f"WITH {MOVES} SELECT DISTINCT entity_id FROM mv WHERE target <> entity_id AND entity_id NOT IN (SELECT coalesce(target, st.entity_id) FROM st LEFT JOIN mv USING (listing_id))")
def entities_left_behind(spark, d):
    return observations.left_behind(_moves(spark, d), _stored(spark, d))


CUTOFF, STARTED = "1995-06-01", "1996-01-01"
DATED = "o_orderdate::TIMESTAMP AS first_seen_at, o_orderdate::TIMESTAMP + to_days((o_orderkey % 400)::INT) AS last_seen_at, (o_orderkey % 3)::INT AS seen_run_id"


@query(f"""WITH l AS (SELECT o_orderkey AS listing_id, {DATED} FROM orders)
SELECT listing_id, CASE WHEN first_seen_at > TIMESTAMP '{CUTOFF}' THEN 'current' ELSE 'previous' END AS side FROM l
WHERE first_seen_at > TIMESTAMP '{CUTOFF}' AND seen_run_id = 1 OR first_seen_at <= TIMESTAMP '{CUTOFF}' AND seen_run_id <> 1 AND last_seen_at < TIMESTAMP '{STARTED}'""")
def continuity_sides(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(_key().alias("listing_id"), at.alias("first_seen_at"), (at + F.make_dt_interval((_key() % 400).cast("int"))).alias("last_seen_at"), (_key() % 3).cast("int").alias("seen_run_id"))
    moment = lambda x: F.expr(f"timestamp_ntz '{x}'")
    return observations.continuity_sides(rows, run_id=1, run_started=moment(STARTED), cutoff=moment(CUTOFF)).select("listing_id", "side")


LISTING = """SELECT l_orderkey AS token, 'k' || l_partkey AS listing_key, 'https://h/' || (l_suppkey % 4) AS url, CASE WHEN l_linenumber = 1 THEN 'old' WHEN l_partkey % 3 = 0 THEN '' ELSE 'new' END AS title,
CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS price, CASE WHEN l_linenumber = 1 OR l_partkey % 2 = 0 THEN l_quantity END AS living, l_shipdate::TIMESTAMP AS first_seen_at, l_shipdate::TIMESTAMP + INTERVAL 5 DAY AS last_seen_at FROM lineitem WHERE l_linenumber = {n}"""


@query(f"""WITH p AS ({LISTING.format(n=1)}), c AS ({LISTING.format(n=2)})
SELECT p.token AS prev_token, c.listing_key, c.url, coalesce(nullif(c.title, ''), p.title) AS title, coalesce(c.price, p.price) AS price, coalesce(c.living, p.living) AS living,
least(p.first_seen_at, c.first_seen_at) AS first_seen_at, greatest(p.last_seen_at, c.last_seen_at) AS last_seen_at, 3 AS rotations, CASE WHEN p.url <> c.url THEN 1 ELSE 0 END AS n_history FROM p JOIN c USING (token)""")
def rotated_listings(spark, d):
    def side(n):
        k = F.col("l_partkey")
        at = F.col("l_shipdate").cast("timestamp_ntz")
        title = F.when(F.col("l_linenumber") == 1, "old").when(k % 3 == 0, "").otherwise("new")
        return table(spark, d, "lineitem").filter(F.col("l_linenumber") == n).select(
            F.col("l_orderkey").alias("token"), F.concat(F.lit("k"), k.cast("string")).alias("listing_key"), F.concat(F.lit("https://h/"), (F.col("l_suppkey") % 4).cast("string")).alias("url"), title.alias("title"),
            F.lit(None).cast("string").alias("description"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("price"), F.when((F.col("l_linenumber") == 1) | (k % 2 == 0), F.col("l_quantity")).alias("living"),
            *(F.lit(None).cast("string").alias(c) for c in ("plot", "postal_code", "city")), at.alias("first_seen_at"), (at + F.expr("interval 5 days")).alias("last_seen_at"),
            F.lit(2).alias("rotations"), F.lit(None).cast("array<struct<listing_key:string,url:string,first_seen_at:timestamp_ntz,last_seen_at:timestamp_ntz>>").alias("history"),
        )

    p, c = side(1), side(2).drop("rotations", "history")
    pairs = p.select(F.col("token").alias("prev_token"), F.col("token").alias("cur_token"), F.lit("exact").alias("strategy")).distinct()
    return observations.rotated(pairs, p, c).select(
        "prev_token", "listing_key", "url", "title", "price", "living", "first_seen_at", "last_seen_at", "rotations", F.size("history").alias("n_history")
    )


REJECTED = "r AS (SELECT l_suppkey % 5 AS source_id, l_orderkey AS listing_key, max('https://j/' || l_partkey) AS url FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2), s AS (SELECT o_orderkey AS listing_id, o_custkey AS job_id, o_custkey % 5 AS source_id, o_orderkey AS listing_key, o_orderstatus = 'O' AS active FROM orders)"


def _rejected(spark, d) -> DataFrame:
    stored = table(spark, d, "orders").select(_key().alias("listing_id"), F.col("o_custkey").alias("job_id"), (F.col("o_custkey") % 5).alias("source_id"), _key().alias("listing_key"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"), F.lit('{"detail_enriched":true,"gate_accepted":true}').alias("payload"))
    rows = table(spark, d, "lineitem").filter("l_linenumber > 3").select((F.col("l_suppkey") % 5).alias("source_id"), F.col("l_orderkey").alias("listing_key"), F.concat(F.lit("https://j/"), F.col("l_partkey").cast("string")).alias("url"), F.lit('{"detail_enrichment_error":"timeout"}').alias("payload"))
    return observations.rejected_sightings(stored, rows, F.expr("timestamp_ntz '2024-01-01'"))


@query(f"WITH {REJECTED} SELECT listing_id, r.url, 'ACTIVE' AS status, NOT active AS reactivated, 'timeout' AS last_error, 'true' AS enriched, 'false' AS gate FROM s JOIN r USING (source_id, listing_key)")
def rejected_sightings(spark, d):
    of = lambda k: F.get_json_object("payload", f"$.{k}")
    return _rejected(spark, d).select("listing_id", "url", "status", "reactivated", of("detail_enrichment_last_error").alias("last_error"), of("detail_enriched").alias("enriched"), of("gate_accepted").alias("gate"))


@query(f"WITH {REJECTED} SELECT DISTINCT job_id, 'ACTIVE' AS status FROM s JOIN r USING (source_id, listing_key)")
def jobs_seen_though_rejected(spark, d):
    return observations.seen_jobs(_rejected(spark, d)).select("job_id", "status")


FACTS = """q AS (SELECT o_orderkey AS listing_id, o_orderstatus <> 'F' AS active, o_orderkey % 11 = 0 AS missing, CASE WHEN o_orderkey % 3 <> 0 THEN 'v' || (o_orderkey % 2) END AS policy,
CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' WHEN 2 THEN 'missing' END AS state, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::TIMESTAMP END AS checked_at, o_orderdate::TIMESTAMP AS first_seen_at FROM orders)"""


@query(f"""WITH {FACTS}, w AS (SELECT *, coalesce(policy = 'v1', false) AS cur FROM q WHERE active AND NOT missing)
SELECT listing_id, row_number() OVER (ORDER BY cur, checked_at NULLS FIRST, first_seen_at DESC, listing_id DESC) AS position FROM w
WHERE NOT cur OR state IN ('failed', 'missing') AND (checked_at IS NULL OR checked_at <= TIMESTAMP '1996-01-01' - INTERVAL 48 HOUR)""")
def detail_queue(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(
        _key().alias("listing_id"), F.when(F.col("o_orderstatus") != "F", "ACTIVE").otherwise("INACTIVE").alias("status"), (_key() % 11 == 0).alias("url_missing"), F.when(_key() % 3 != 0, F.concat(F.lit("v"), (_key() % 2).cast("string"))).alias("policy"),
        F.when(_key() % 4 == 0, "failed").when(_key() % 4 == 1, "ok").when(_key() % 4 == 2, "missing").alias("state"), F.when(_key() % 5 != 0, at).alias("checked_at"), at.alias("first_seen_at"),
    )
    due = queues.detail_queue(rows, policy="v1", now=F.expr("timestamp_ntz '1996-01-01'"), recheck_hours=48)
    return catalog.positions(due, queues.detail_order()).select("listing_id", "position")


@query("""SELECT o_orderkey AS listing_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderdate::TIMESTAMP <= TIMESTAMP '1996-01-01' - INTERVAL 30 MINUTE) ORDER BY 1 LIMIT 24""")
def stale_shown_pages(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(_key().alias("listing_id"), F.when(F.col("o_orderstatus") != "F", "ACTIVE").alias("status"), (_key() % 11 == 0).alias("url_missing"), (_key() % 2 == 0).alias("visible"), F.when(_key() % 5 != 0, at).alias("checked_at"))
    return queues.stale_pages(rows, now=F.expr("timestamp_ntz '1996-01-01'"), stale_minutes=30, limit=24).select("listing_id")


@query("""WITH s AS (SELECT l_suppkey AS id, count(*) FILTER (l_returnflag = 'N') AS exclusive, count(*) AS entities FROM lineitem GROUP BY 1)
SELECT id, row_number() OVER (ORDER BY id % 4 = 0, exclusive DESC, entities DESC, lpad(id::VARCHAR, 8, '0')) AS position FROM s""")
def sources_by_value(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "N").alias("exclusive"), F.count("*").alias("entities"))
    rows = rows.withColumn("enabled", F.col("id") % 4 != 0).withColumn("name", F.lpad(F.col("id").cast("string"), 8, "0"))
    return catalog.positions(rows, queues.source_order()).select("id", "position")


STATE = "CASE {c} % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'dead' ELSE 'unknown' END"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {STATE.format(c="l_partkey")} AS p, {STATE.format(c="l_suppkey")} AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN 'dead' IN (p, a) THEN 'dead' WHEN p = 'live' AND a = 'live' THEN 'live_confirmed' WHEN 'live' IN (p, a) THEN 'live_partial' ELSE 'unknown' END AS state FROM s""")
def probe_states(spark, d):
    of = lambda c: F.when(F.col(c) % 3 == 0, "live").when(F.col(c) % 3 == 1, "dead").otherwise("unknown")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", queues.probe_state(of("l_partkey"), of("l_suppkey")).alias("state"))


@query("""WITH p AS (SELECT o_orderkey, count(*) * 5 AS seen, count(*) * 5 - count(*) FILTER (l_linenumber = 6) AS parsed, (count(*) * 5) - 2 * count(*) FILTER (l_returnflag = 'R' AND l_linenumber < 3) AS with_code, any_value(o_custkey % 4 + 1) AS page
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey % 5 > 1 GROUP BY 1), q AS (SELECT o_orderkey, CASE WHEN seen = 5 AND o_orderkey % 7 = 0 THEN 0 ELSE seen END AS seen, parsed, with_code, page FROM p)
SELECT o_orderkey, CASE WHEN seen = 0 THEN 'no_cards' WHEN parsed <> seen THEN 'not_all_parsed' WHEN page < 4 AND seen < 15 THEN 'short_page' WHEN with_code / parsed < 0.9 THEN 'few_codes' END AS fault FROM q""")
def page_faults(spark, d):
    lines = table(spark, d, "lineitem").filter("l_partkey % 5 > 1").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left").groupBy("o_orderkey").agg(
        (F.count("*") * 5).alias("seen"), (F.count("*") * 5 - F.count_if(F.col("l_linenumber") == 6)).alias("parsed"), (F.count("*") * 5 - 2 * F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 3))).alias("with_code"), F.first(F.col("o_custkey") % 4 + 1).alias("page"),
    )
    seen = F.when((F.col("seen") == 5) & (F.col("o_orderkey") % 7 == 0), 0).otherwise(F.col("seen"))
    return rows.select("o_orderkey", queues.page_fault(seen=seen, parsed=F.col("parsed"), with_code=F.col("with_code"), page=F.col("page"), pages=F.lit(4), page_size=20).alias("fault"))


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '  Linz  ' WHEN 1 THEN '' WHEN 2 THEN repeat('ab', 100) WHEN 3 THEN NULL ELSE c_name END AS p, CASE c_custkey % 6 WHEN 0 THEN '25' WHEN 1 THEN '0.5' WHEN 2 THEN '251' WHEN 3 THEN 'x' WHEN 4 THEN '250' END AS km,
CASE c_custkey % 4 WHEN 0 THEN '-1' WHEN 1 THEN ' 1000.5 ' WHEN 2 THEN 'abc' END AS low FROM customer), s AS (SELECT c_custkey, substr(trim(coalesce(p, '')), 1, 120) AS place, try_cast(km AS DECIMAL(18,2)) AS km, try_cast(trim(low) AS DECIMAL(18,2)) AS low FROM r)
SELECT c_custkey, place, CASE WHEN place <> '' AND km BETWEEN 1 AND 250 THEN km END::DOUBLE AS km, CASE WHEN low >= 0 THEN low END::DOUBLE AS low FROM s""")
def parsed_filters(spark, d):
    c = F.col("c_custkey")
    place = F.when(c % 5 == 0, "  Linz  ").when(c % 5 == 1, "").when(c % 5 == 2, "ab" * 100).when(c % 5 == 4, F.col("c_name"))
    km = F.when(c % 6 == 0, "25").when(c % 6 == 1, "0.5").when(c % 6 == 2, "251").when(c % 6 == 3, "x").when(c % 6 == 4, "250")
    low = F.when(c % 4 == 0, "-1").when(c % 4 == 1, " 1000.5 ").when(c % 4 == 2, "abc")
    rows = queues.parsed_filters(table(spark, d, "customer").select("c_custkey", place.alias("place"), km.alias("km"), low.alias("low")), place="place", radius="km", bounds=("low",))
    return rows.select("c_custkey", "place", F.col("km").cast("double"), F.col("low").cast("double"))


@query("""WITH l AS (SELECT o_custkey % 20 AS source_id, o_orderkey // 3 AS job_id, o_orderstatus = 'O' AS active, o_orderkey % 3 <> 0 AS ok, o_orderkey % 8 = 1 AS now, o_custkey % 2 = 0 AS sp, o_custkey % 3 = 0 AS ap, o_custkey % 5 = 0 AS tx FROM orders)
SELECT source_id, count(*) AS listings, count(*) FILTER (active) AS active, count(*) FILTER (active AND ok) AS relevant, count(DISTINCT job_id) FILTER (active) AS active_jobs, count(DISTINCT job_id) FILTER (active AND ok) AS relevant_jobs, count(*) FILTER (now) AS seen,
count(*) FILTER (now AND ok) AS seen_relevant, count(DISTINCT job_id) FILTER (active AND ok AND sp) AS structured_pay, count(DISTINCT job_id) FILTER (active AND ok AND ap) AS annual_pay, count(DISTINCT job_id) FILTER (active AND ok AND tx) AS pay_text FROM l GROUP BY 1""")
def source_stats(spark, d):
    c = F.col("o_custkey")
    return rollups.source_stats(table(spark, d, "orders").select((c % 20).alias("source_id"), F.expr("o_orderkey div 3").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"), (_key() % 3 != 0).alias("accepted"), (_key() % 8).alias("seen_run_id"), F.lit(1).alias("latest_run_id"), (c % 2 == 0).alias("structured_pay"), (c % 3 == 0).alias("annual_pay"), (c % 5 == 0).alias("pay_text")))


EVIDENCE = "e AS (SELECT l_orderkey AS job_id, l_returnflag || l_linestatus AS kind, 'c' || (l_partkey % 40) AS slug, CASE l_returnflag WHEN 'N' THEN 'primary' WHEN 'A' THEN 'context' ELSE 'other' END AS scope, CASE WHEN l_suppkey % 4 = 0 THEN 'manual-1' ELSE 'seed-' || (l_suppkey % 3) END AS version FROM lineitem)"


def _evidence(spark, d) -> DataFrame:
    s = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("slug"), F.when(F.col("l_returnflag") == "N", "primary").when(F.col("l_returnflag") == "A", "context").otherwise("other").alias("scope"),
        F.when(s % 4 == 0, "manual-1").otherwise(F.concat(F.lit("seed-"), (s % 3).cast("string"))).alias("version"),
    )


@query(f"WITH {EVIDENCE}, c AS (SELECT kind, slug, count(DISTINCT job_id) AS jobs FROM e GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY jobs DESC, slug)::INT AS rank FROM c) WHERE rank <= 5")
def top_concepts(spark, d):
    return rollups.top_concepts(_evidence(spark, d), 5)


@query(f"WITH {EVIDENCE} SELECT version, count(*) AS n_rows, count(DISTINCT job_id) AS jobs, count(*) FILTER (scope = 'primary') AS primary_rows, count(*) FILTER (scope = 'context') AS context_rows, count(*) FILTER (scope NOT IN ('primary', 'context')) AS invalid_rows FROM e WHERE version LIKE 'seed-%' GROUP BY 1")
def evidence_audit(spark, d):
    return rollups.evidence_audit(_evidence(spark, d), "seed-")


@query(f"WITH {EVIDENCE} SELECT job_id, kind, slug, version FROM e WHERE version NOT LIKE 'seed-%' UNION ALL SELECT o_orderkey, 'role', o_orderpriority, 'seed-9' FROM orders")
def replaced_evidence(spark, d):
    fresh = table(spark, d, "orders").select(_key().alias("job_id"), F.lit("role").alias("kind"), F.col("o_orderpriority").alias("slug"), F.lit("seed-9").alias("version"))
    return sync.replaced_evidence(_evidence(spark, d).drop("scope"), fresh, "seed-")


@query("""WITH o AS (SELECT l_orderkey AS home_id, l_returnflag AS kind, max(l_quantity) AS stated, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT kind, n, abs(o_orderkey % 50 - stated) > 0.5 AS d FROM o JOIN orders ON o_orderkey = home_id)
SELECT kind, count(*) AS homes, count(*) FILTER (d) AS mismatched, count(*) FILTER (d AND n = 1) AS suspicious, count(*) FILTER (n > 1) AS shared FROM r GROUP BY 1""")
def area_audit(spark, d):
    homes = table(spark, d, "orders").select(_key().alias("home_id"), (_key() % 50).cast("double").alias("living"))
    return rollups.area_audit(homes, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("home_id"), F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("double").alias("area")))


@query("""WITH p AS (SELECT l_orderkey AS group_id, l_suppkey % 2 AS source_id, l_linenumber AS job_id, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 3 END AS place FROM lineitem),
s AS (SELECT group_id, source_id, job_id, list(DISTINCT place) AS p FROM p WHERE place IS NOT NULL GROUP BY 1, 2, 3)
SELECT DISTINCT a.group_id, a.source_id FROM s a JOIN s b ON a.group_id = b.group_id AND a.source_id = b.source_id AND a.job_id < b.job_id AND NOT list_has_any(a.p, b.p)""")
def location_conflicts(spark, d):
    p = F.col("l_partkey")
    return dedupe.location_conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), (F.col("l_suppkey") % 2).alias("source_id"), F.col("l_linenumber").alias("job_id"), F.when(p % 4 != 0, p % 3).alias("place")))


@query("""SELECT p_partkey // 10 AS group_id, count(*) FILTER (p_partkey % 10 = 0 OR p_size % 4 = 0) AS parts FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 10 = 0 OR p_size % 4 = 0) > 1""")
def disconnected_groups(spark, d):
    parts, k = table(spark, d, "part"), F.col("p_partkey")
    edges = parts.filter((k % 10 != 0) & (F.col("p_size") % 4 != 0)).select((k - 1).alias("left_id"), k.alias("right_id"))
    return dedupe.disconnected_groups(parts.select(k.alias("job_id"), F.expr("p_partkey div 10").alias("group_id")), edges)


@query("""WITH l AS (SELECT o_custkey AS group_id, o_orderkey AS location_id, CASE WHEN o_orderkey % 2 = 0 THEN lpad((o_orderkey // 2 % 3)::VARCHAR, 4, '1') END AS code, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS city, 't' || (o_orderkey % 4) AS txt, o_orderstatus = 'F' AS remote FROM orders),
k AS (SELECT *, CASE WHEN city IS NOT NULL THEN 'c' || city ELSE 't' || txt END AS key FROM l), c AS (SELECT *, coalesce(code, min(code) OVER (PARTITION BY group_id, remote, key)) AS full_code FROM k)
SELECT group_id, remote, min(location_id) AS location_id, min(full_code) AS postal_code, arg_min(city, location_id) FILTER (city IS NOT NULL) AS city, arg_min(txt, location_id) AS location_text, count(*) AS n_merged FROM c GROUP BY group_id, remote, coalesce(full_code, key)""")
def merged_locations(spark, d):
    code = F.when(_key() % 2 == 0, F.lpad((F.expr("o_orderkey div 2") % 3).cast("string"), 4, "1"))
    return dedupe.merged_locations(table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), _key().alias("location_id"), code.alias("postal_code"), F.when(_key() % 5 != 0, F.col("o_orderpriority")).alias("city"), F.concat(F.lit("t"), (_key() % 4).cast("string")).alias("location_text"), (F.col("o_orderstatus") == "F").alias("remote")))


@query("""SELECT o_orderkey, o_orderstatus IN ('O', 'P') AND (o_orderstatus = 'O' OR o_orderkey % 2 = 0 AND o_custkey % 3 <> 0) AS shown, o_orderkey % 5 <> 0 AND o_custkey % 40 <= greatest(3, ceil(o_custkey % 1000 * 0.01)) AS whole,
abs(o_custkey - o_orderkey % 1500) <= greatest(40, ceil((o_orderkey % 1500) * 0.01)) AS plausible, o_orderkey % 5 <> 0 AND o_custkey % 40 <= greatest(3, ceil(o_custkey % 1000 * 0.05)) AS few_made_up FROM orders""")
def scan_verdicts(spark, d):
    c, state = F.col("o_custkey"), F.when(F.col("o_orderstatus") == "O", "live").when(F.col("o_orderstatus") == "P", "unknown").otherwise("dead")
    shown = lifecycle.after_probe(state, _key() % 2 == 0, F.when(c % 3 != 0, 1))
    return table(spark, d, "orders").select(
        "o_orderkey", shown.alias("shown"), lifecycle.churn_coverage(_key() % 5 != 0, c % 40, c % 1000).alias("whole"), lifecycle.plausible_count(c, _key() % 1500, F.lit(20)).alias("plausible"),
        lifecycle.synthetic_coverage(_key() % 5 != 0, c % 40, c % 1000, 0.05).alias("few_made_up"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 2 = 0 THEN 'true' END AS enriched, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 1 AND p_size % 5 = 0 THEN 'timeout' END AS last_error, 'new' AS title, CASE WHEN p_size % 3 = 0 THEN '{"a":[1,"1",null]}' ELSE '2.5' END AS kept FROM part""")
def merged_payloads(spark, d):
    s = F.col("p_size")
    old = F.when(s % 3 == 0, '{"detail_enriched":true,"title":"old","kept":{"a":[1,"1",null]}}').otherwise('{"title":"old","kept":2.5,"detail_enrichment_last_error":null}')
    new = F.when(s % 2 == 0, '{"title":"new","detail_enriched":true}').when(s % 5 == 0, '{"title":"new","detail_enrichment_error":"timeout"}').otherwise('{"title":"new"}')
    rows = table(spark, d, "part").select("p_partkey", old.alias("old_payload"), new.alias("new_payload"))
    of = lambda k: F.get_json_object("m", f"$.{k}")
    return rows.select("p_partkey", identity.merged_payload().alias("m")).select("p_partkey", of("detail_enriched").alias("enriched"), of("detail_enrichment_last_error").alias("last_error"), of("title").alias("title"), of("kept").alias("kept"))



@query("""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'can' END AS old, CASE WHEN c_custkey % 2 = 0 THEN 'manual' ELSE 'seed' END AS src FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS k, 'want' AS fresh FROM customer WHERE c_custkey % 5 <> 0)
SELECT * FROM (SELECT k, CASE WHEN coalesce(src = 'manual', false) THEN old ELSE fresh END AS state, CASE WHEN coalesce(src = 'manual', false) THEN 'manual' ELSE 'seed' END AS source FROM r FULL JOIN s USING (k)) WHERE state IS NOT NULL""")
def synced_seed(spark, d):
    c, t = F.col("c_custkey"), table(spark, d, "customer")
    rows = t.filter(c % 3 != 0).select(c.alias("k"), F.lit("can").alias("state"), F.when(c % 2 == 0, "manual").otherwise("seed").alias("source"))
    return identity.synced_seed(rows, t.filter(c % 5 != 0).select(c.alias("k"), F.lit("want").alias("state")), ["k"])
