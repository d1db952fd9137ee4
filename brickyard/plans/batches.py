"""Queries on what a batch says about itself: chains of identities and URLs, and homes that go on under another token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.operators import identity

from .registry import query, table

# Five rows of a block are a chain over identities (0-1, 2-3) and URLs (1-2, 3-4), out of the order of ids. Blocks whose number is divisible
# by 7 lack an identity in the middle, and in those divisible by 3 the second row is of another source, so that its identity doesn't link.
BATCH = """inc AS (SELECT o_orderkey AS row_id, o_orderkey // 5 AS b, (o_orderkey * 2) % 5 AS p FROM orders),
rows_ AS (SELECT row_id, CASE WHEN b % 3 = 0 AND p = 1 THEN 2 ELSE 1 END AS source_id, 'k' || row_id AS listing_key, CASE WHEN p <= 1 THEN 'a' || b WHEN p <= 3 AND b % 7 <> 0 THEN 'b' || b END AS identity,
  CASE WHEN p = 0 THEN 'o' || row_id WHEN p <= 2 THEN 'u' || b ELSE 'v' || b END AS url FROM inc),
known AS (SELECT c_custkey AS listing_id, c_custkey + 1000000 AS entity_id, 1 AS source_id, 'k' || (c_custkey * 11) AS listing_key FROM customer),
r AS (SELECT x.*, entity_id FROM rows_ x LEFT JOIN known USING (source_id, listing_key))"""
LINKS = """keys AS (SELECT row_id, 'i' || source_id || ':' || identity AS k FROM {t} WHERE identity IS NOT NULL UNION ALL SELECT row_id, 'u' || url FROM {t}),
links AS (SELECT a.row_id AS a, b.row_id AS b FROM keys a JOIN keys b USING (k) WHERE a.row_id <> b.row_id),
reach AS (SELECT row_id AS v, row_id AS g FROM {t} UNION SELECT links.b, reach.g FROM reach JOIN links ON links.a = reach.v), chain AS (SELECT v AS row_id, min(g) AS chain FROM reach GROUP BY v)"""


def batch(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    b, p, text = F.floor(k / 5), k * 2 % 5, lambda c: c.cast("string")
    ident = F.when(p <= 1, F.concat(F.lit("a"), text(b))).when((p <= 3) & (b % 7 != 0), F.concat(F.lit("b"), text(b)))
    url = F.when(p == 0, F.concat(F.lit("o"), text(k))).when(p <= 2, F.concat(F.lit("u"), text(b))).otherwise(F.concat(F.lit("v"), text(b)))
    rows = table(spark, d, "orders").select(k.alias("row_id"), F.when((b % 3 == 0) & (p == 1), 2).otherwise(1).alias("source_id"), F.concat(F.lit("k"), text(k)).alias("listing_key"), ident.alias("identity"), url.alias("url"))
    c = F.col("c_custkey")
    none = F.lit(None).cast("string")
    stored = table(spark, d, "customer").select(c.alias("listing_id"), (c + 1000000).alias("entity_id"), F.lit(1).alias("source_id"), F.concat(F.lit("k"), text(c * 11)).alias("listing_key"), none.alias("identity"), none.alias("url"))
    return identity.resolved(rows, stored)


@query(f"WITH RECURSIVE {BATCH}, n AS (SELECT * FROM r WHERE entity_id IS NULL), {LINKS.format(t='n')} SELECT row_id, chain AS new_key FROM chain")
def new_entity_keys(spark, d):
    return identity.new_keys(batch(spark, d)).select("row_id", "new_key")


@query(f"""WITH RECURSIVE {BATCH}, {LINKS.format(t='r')}, e AS (SELECT chain, arg_min(entity_id, row_id) AS e FROM r JOIN chain USING (row_id) WHERE entity_id IS NOT NULL GROUP BY 1)
SELECT row_id, coalesce(entity_id, e) AS entity, CASE WHEN coalesce(entity_id, e) IS NULL THEN chain END AS new_key, CASE WHEN entity_id IS NOT NULL THEN 'stored' WHEN e IS NOT NULL THEN 'batch' ELSE 'new' END AS via
FROM r JOIN chain USING (row_id) LEFT JOIN e USING (chain)""")
def batch_entities(spark, d):
    return identity.batch_entities(batch(spark, d)).select("row_id", "entity", "new_key", "via")


# By o_orderkey % 4: the same home under another token (though its URL is that of another home), the same listing, the URL of a stored
# home (though its identity is another's), and pairs of new rows that share a URL.
@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, coalesce(lag(o_custkey) OVER (ORDER BY o_orderkey), -1) AS before FROM orders), n AS (SELECT max(o_orderkey) AS last FROM orders)
SELECT k AS row_id, CASE k % 4 WHEN 2 THEN before WHEN 3 THEN NULL ELSE c END AS entity, CASE k % 4 WHEN 0 THEN 'continuity' WHEN 1 THEN 'listing' WHEN 2 THEN 'url' END AS "by",
CASE WHEN k % 4 = 3 THEN k // 8 * 8 + 3 END AS new_key, CASE WHEN k % 4 = 3 THEN 'new' ELSE 'stored' END AS via FROM o""")
def home_entities(spark, d):
    k = F.col("o_orderkey")
    of = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    orders = table(spark, d, "orders")
    stored = orders.select(k.alias("listing_id"), F.col("o_custkey").alias("entity_id"), F.lit(1).alias("source_id"), of("o", k).alias("listing_key"), of("s", k).alias("identity"), of("u", k).alias("url"))
    token = F.when(k % 4 == 0, of("r", k)).when(k % 4 == 1, of("o", k)).otherwise(of("x", k))
    url = F.when(k % 4 == 0, of("u", k + 1)).when(k % 4 == 1, of("new", k)).when(k % 4 == 2, of("u", k - 1)).otherwise(of("n", F.floor(k / 8)))
    incoming = orders.select(k.alias("row_id"), F.lit(1).alias("source_id"), token.alias("listing_key"), F.when(k % 4 == 2, of("s", k + 1)).alias("identity"), url.alias("url"))
    side = lambda title, token: orders.select(token.alias("token"), F.lit("4020").alias("postal_code"), of(title, k).alias("title"), F.lit(1.0).alias("price"), F.lit(None).cast("double").alias("area"))
    previous = side("ein schoenes haus ", of("o", k)).filter(k % 4 != 1)
    current = side("ein schoenes haus ", token).filter(k % 4 == 0).unionByName(side("ein anderes haus ", token).filter(k % 4 >= 2))
    return identity.home_entities(incoming, stored, previous, current).select("row_id", "entity", "by", "new_key", "via")
