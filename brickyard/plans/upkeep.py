"""Queries on stored tables that follow what comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.functions import facts
from brickyard.operators import queues, sync
from brickyard.sources import boards

from .registry import query, table


@query("""SELECT s_suppkey, CASE WHEN n.s_suppkey IS NOT NULL THEN n.v ELSE s_acctbal END AS s_acctbal FROM supplier LEFT JOIN (SELECT l_suppkey AS s_suppkey, max(l_extendedprice) AS v FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) n USING (s_suppkey)""")
def updated_by_key(spark, d):
    new = table(spark, d, "lineitem").filter("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("s_acctbal"))
    return sync.updated(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), new, ["s_suppkey"])


@query("""WITH a AS (SELECT DISTINCT l_suppkey % 10 AS source_id, l_shipdate::DATE::VARCHAR AS key FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_suppkey % 10 AS source_id, l_shipdate::DATE::VARCHAR AS key, max(l_linenumber) AS p FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2)
SELECT source_id, key, coalesce(b.p, 1) AS priority, CASE WHEN a.key IS NOT NULL THEN 'c' END AS cursor, b.key IS NOT NULL AS enabled FROM a FULL JOIN b USING (source_id, key)""".replace("b.key IS NOT NULL AS enabled", "b.p IS NOT NULL AS enabled"))
def synced_shards(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("source_id"), F.col("l_shipdate").cast("date").cast("string").alias("key"), "l_linenumber")
    stored = rows.filter("l_linenumber = 1").select("source_id", "key").distinct().withColumn("priority", F.lit(1)).withColumn("cursor", F.lit("c"))
    specs = rows.filter("l_linenumber > 1").groupBy("source_id", "key").agg(F.max("l_linenumber").alias("priority"))
    return sync.synced_shards(stored, specs)


@query("""WITH s AS (SELECT o_custkey AS home_id, bool_or(o_orderkey % 3 = 0) AS f, bool_or(o_orderkey % 5 = 0) AS h, min(o_orderdate) FILTER (o_orderkey % 2 = 0) AS v FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
c AS (SELECT c_custkey AS home_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 END AS f, CASE WHEN c_custkey % 7 = 0 THEN false END AS h, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2020-01-01' END AS v FROM customer),
j AS (SELECT home_id, coalesce(c.f, s.f, false) AS favorite, coalesce(c.h, s.h, false) AS hidden, coalesce(s.v, c.v) AS viewed_at, coalesce(s.f, false) AS f0, coalesce(s.h, false) AS h0, s.v IS NULL AND c.v IS NOT NULL AS nv FROM s FULL JOIN c USING (home_id))
SELECT home_id, favorite, hidden, viewed_at, favorite <> f0 OR hidden <> h0 OR nv AS changed FROM j WHERE favorite OR hidden""")
def saved_marks(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    stored = table(spark, d, "orders").filter("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("home_id")).agg(F.bool_or(k % 3 == 0).alias("favorite"), F.bool_or(k % 5 == 0).alias("hidden"), F.min(F.when(k % 2 == 0, F.col("o_orderdate"))).alias("viewed_at"))
    at = F.when(c % 5 == 0, F.expr("timestamp_ntz '2020-01-01'"))
    changes = table(spark, d, "customer").select(c.alias("home_id"), F.when(c % 2 == 0, c % 3 == 0).alias("favorite"), F.when(c % 7 == 0, False).alias("hidden"), at.alias("viewed_at"))
    return sync.saved_marks(stored, changes, ["home_id"], sparse=True)


@query("""WITH s AS (SELECT o_orderkey AS location_id, o_custkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN '1010' END AS postal_code, 'x' AS city, o_orderpriority AS location_text, false AS remote FROM orders WHERE o_orderkey % 2 = 0),
i AS (SELECT NULL::BIGINT AS location_id, o_custkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN '1010' END AS postal_code, 'x' AS city, o_orderpriority AS location_text, false AS remote FROM orders WHERE o_orderkey % 2 = 1),
b AS (SELECT job_id, postal_code, location_text, min(location_id) AS location_id FROM (SELECT * FROM s UNION ALL SELECT * FROM i) GROUP BY 1, 2, 3)
SELECT job_id, location_text, postal_code, location_id FROM (SELECT *, bool_or(postal_code IS NOT NULL) OVER (PARTITION BY job_id, location_text) AS r FROM b) WHERE postal_code IS NOT NULL OR NOT r""")
def enriched_locations(spark, d):
    k = F.col("o_orderkey")
    rows = lambda n, every: table(spark, d, "orders").filter(k % 2 == n).select(k.alias("location_id"), F.col("o_custkey").alias("job_id"), F.when(k % every == 0, "1010").alias("postal_code"), F.lit("x").alias("city"), F.col("o_orderpriority").alias("location_text"), F.lit(False).alias("remote"))
    return sync.enriched_locations(rows(0, 3), rows(1, 5).drop("location_id")).select("job_id", "location_text", "postal_code", "location_id")


@query("""WITH t AS (SELECT s_suppkey AS tenant_id, 'a' || (s_suppkey % 40) || CASE WHEN s_suppkey % 3 = 0 THEN ':b' || (s_suppkey % 7) ELSE '' END AS tenant_key FROM supplier),
c AS (SELECT DISTINCT 'a' || (p_partkey % 50) || ':b' || (p_partkey % 7) || ':c' AS candidate FROM part),
m AS (SELECT candidate, tenant_id, tenant_key, max(length(tenant_key)) OVER (PARTITION BY candidate) AS n FROM c JOIN t ON candidate = tenant_key OR starts_with(candidate, tenant_key || ':'))
SELECT candidate, min(tenant_id) AS tenant_id, min(tenant_key) AS tenant_key FROM m WHERE length(tenant_key) = n GROUP BY 1 HAVING count(*) = 1""")
def tenant_prefixes(spark, d):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    tenants = table(spark, d, "supplier").select(k.alias("tenant_id"), F.concat(F.lit("a"), text(k % 40), F.when(k % 3 == 0, F.concat(F.lit(":b"), text(k % 7))).otherwise("")).alias("tenant_key"))
    candidates = table(spark, d, "part").select(F.concat(F.lit("a"), text(p % 50), F.lit(":b"), text(p % 7), F.lit(":c")).alias("candidate")).distinct()
    return sync.tenant_of(tenants, candidates)


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS source_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 6 = 0 THEN 'OK' ELSE 'DEGRADED' END AS c FROM orders),
s AS (SELECT l_orderkey AS run_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R'))
SELECT run_id, source_id FROM r WHERE c <> 'OK' AND run_id IN (SELECT run_id FROM s) AND NOT EXISTS (SELECT 1 FROM r o WHERE o.source_id = r.source_id AND o.c = 'OK' AND o.started_at <= r.started_at)""")
def promotable_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderkey") % 6 == 0, "OK").otherwise("DEGRADED").alias("coverage_status"))
    shards = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") != "R", "SUCCESS").otherwise("FAILED").alias("status"), F.lit(True).alias("complete"))
    return sync.promotable(runs, shards).select("run_id", "source_id")


@query("""SELECT c_custkey AS home_id FROM customer JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1 AND NOT bool_or(o_orderkey % 4 = 0)) ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def area_repairs(spark, d):
    homes = table(spark, d, "customer").select(F.col("c_custkey").alias("home_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("living"))
    listings = table(spark, d, "orders").select(F.col("o_custkey").alias("home_id"), F.col("o_orderpriority").alias("source_id"), F.when(F.col("o_orderkey") % 4 == 0, 1).alias("explicit_living"))
    return sync.area_repairs(homes, listings).select("home_id")


# Pay by o_orderkey % 6: stated whole; an amount without a period; a blank text; a text that can be read; a description that names a salary; texts that name none.
CANDIDATES = """c AS (SELECT source_id, listing_key FROM (SELECT o_custkey % 9 AS source_id, o_orderkey % 2000 AS listing_key, o_orderkey % 5 <> 0 AS ok, o_orderkey % 6 IN (0, 3, 4) AS paid,
row_number() OVER (PARTITION BY o_custkey % 9, o_orderkey % 2000 ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 AND ok AND NOT paid)"""


def _candidates(spark, d):
    k = F.col("o_orderkey")
    kind = k % 6
    rows = table(spark, d, "orders").select(
        (F.col("o_custkey") % 9).alias("source_id"), (k % 2000).alias("listing_key"), k.alias("position"), (k % 5 != 0).alias("gate_accepted"), F.when(kind <= 1, 3000).alias("salary_min"), F.when(kind <= 1, "EUR").alias("salary_currency"), F.when(kind == 0, "month").alias("salary_period"),
        F.when(kind == 2, " ").when(kind == 3, "3.000 € pro Monat").when(kind == 5, "nach Vereinbarung").alias("salary_text"), F.when(kind == 4, "Bruttogehalt ab 3.000 € pro Monat").when(kind == 5, "Budget 3.000 € pro Monat").alias("description"),
    )
    return sync.salary_candidates(rows)


@query(f"WITH {CANDIDATES} SELECT * FROM c")
def salary_candidates(spark, d):
    return _candidates(spark, d).select("source_id", "listing_key")


@query(f"WITH {CANDIDATES} SELECT source_id, listing_key, CASE WHEN listing_key % 3 = 0 THEN 2500 END::DOUBLE AS minimum, CASE WHEN listing_key % 3 = 0 THEN 'month' END AS period FROM c")
def detail_pay(spark, d):
    key = F.col("o_orderkey") % 2000
    page = F.when(key % 3 == 0, "<script>Gehalt 9.000 € pro Monat</script><p>Bruttogehalt</p><p>ab 2.500&nbsp;&euro; pro Monat</p>").otherwise("<p>Gehalt nach Vereinbarung</p>")
    pages = table(spark, d, "orders").filter(key % 3 < 2).select((F.col("o_custkey") % 9).alias("source_id"), key.alias("listing_key"), page.alias("payload"))
    return boards.with_detail_pay(_candidates(spark, d), pages).select("source_id", "listing_key", F.col("pay.minimum").cast("double").alias("minimum"), "pay.period")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Wien' WHEN c_custkey % 4 = 0 THEN 'Linz' END AS ort, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 > 0 AND c_custkey % 4 = 0 THEN 25 END::DOUBLE AS km,
CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 = 0 THEN 1000.5 END::DOUBLE AS low FROM customer""")
def chosen_filters(spark, d):
    c = F.col("c_custkey")
    saved = queues.saved_filters(F.when(c % 4 == 0, '{"ort":"Linz","radius_km":"25"}').when(c % 4 == 1, '["x"]').when(c % 4 == 2, "{broken"), ("low",))
    request = F.struct(F.lit("Wien").alias("ort"), F.lit(None).cast("string").alias("radius_km"), F.lit("1000.5").alias("low"))
    rows = table(spark, d, "customer").select("c_custkey", queues.chosen_filters(request, saved, c % 5 == 0, c % 3 == 0).alias("f")).select("c_custkey", "f.*")
    rows = queues.parsed_filters(rows, place="ort", radius="radius_km", bounds=("low",))
    return rows.select("c_custkey", F.nullif("ort", F.lit("")).alias("ort"), F.col("radius_km").cast("double").alias("km"), F.col("low").cast("double"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS value FROM events""")
def page_scalars(spark, d):
    return table(spark, d, "events").select("event_id", facts.json_scalar(F.col("props"), "k").alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['no_longer_available'] WHEN 1 THEN ['bewerbungsfrist_abgelaufen'] WHEN 2 THEN [] ELSE ['applications_closed', 'job_expired'] END::VARCHAR[] AS marks FROM part""".replace("::VARCHAR[] AS marks", " AS marks").replace("SELECT p_partkey, CASE", "SELECT p_partkey, array_to_string(CASE").replace("END AS marks", "END, ',') AS marks"))
def closed_page_marks(spark, d):
    k = F.col("p_partkey")
    said = (F.lit("This job is  no longer available."), F.lit("Die Bewerbungsfrist ist leider abgelaufen"), F.lit("Apply now"), F.lit("Applications are closed. The position has expired"))
    text = F.concat(F.col("p_name"), F.lit(". "), F.element_at(F.array(*said), (k % 4 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", F.array_join(facts.marks(text, facts.CLOSED_JOB), ",").alias("marks"))
