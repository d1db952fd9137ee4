"""Queries on texts, scores, duplicates, identity, life cycle and operations of adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions import salary, text
from brickyard.operators import dedupe, fit, gate, identity, lifecycle, locality, rollups
from brickyard.streaming import journal

from .registry import query, table



def _ascii(x: str, amp: bool = True) -> str:
    inner = f"strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss'))"
    inner = f"replace({inner}, '&', ' und ')" if amp else inner
    return f"trim(regexp_replace({inner}, '[^a-z0-9]+', ' ', 'g'))"


def docs(spark, d) -> DataFrame:
    lines = F.split("text", "\n", 2)
    return table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.get(lines, F.lit(0)).alias("title"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("body"), "text", "lang", "source")


DOCS = "docs AS (SELECT doc_id AS job_id, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body, text, lang, source FROM documents)"


@query(f"SELECT doc_id, md5({_ascii('text')}) AS words FROM documents")
def ascii_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.ascii_words(F.col("text"))).alias("words"))


@query("WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (m/w/d)' ELSE ' at ' || p_brand END AS t FROM part) "
       "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') ELSE regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g') END AS title FROM part JOIN t USING (p_partkey)")
def job_titles(spark, d):
    raw = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (m/w/d)").otherwise(F.concat(F.lit(" at "), "p_brand")))
    return table(spark, d, "part").select("p_partkey", text.job_title(raw).alias("title"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS company FROM supplier")
def company_names(spark, d):
    forms = F.element_at(F.array(*(F.lit(x) for x in (" GmbH & Co KG", " AG", " GesmbH", " OG"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", text.company_name(F.concat("s_name", forms)).alias("company"))


@query("SELECT o_orderkey, o_totalprice AS value FROM orders")
def german_decimals(spark, d):
    raw = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, d, "orders").select("o_orderkey", text.german_decimal(raw).cast("double").alias("value"))


#: Sentences around an amount {a} (and 1000 more, {b}); what they state is in the SQL below. Some are traps: no cue, no period, or words that only look like one.
SENTENCES = (
    "Wir bieten ein Jahresbruttogehalt ab € {a}, je nach Erfahrung.", "Jahresgehalt von € {a} bis € {b} brutto.", "Gehalt {a} Euro, dazu ein Monatsticket.", "Bezahlung {a} EUR. 25 Tage Jahresurlaub.",
    "Das Gehalt beträgt {a} EUR monatlich, 14x im Jahr.", "Stundenlohn: {a} €", "Budget {a} EUR pro Jahr", "Entgelt mindestens {a} EUR brutto pro Monat", "Salary: EUR {a} per year", "Vergütung für 40 Std./Woche: {a} EUR",
)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_totalprice AS a, (o_totalprice + 1000)::DECIMAL(12,2)::DOUBLE AS b FROM orders),
p AS (SELECT *, CASE WHEN k IN (0, 1, 8) AND a BETWEEN 10000 AND 500000 THEN 'year' WHEN k IN (4, 7) AND a BETWEEN 800 AND 30000 THEN 'month' WHEN k = 5 AND a BETWEEN 5 AND 500 THEN 'hour' END AS period FROM o)
SELECT o_orderkey, CASE WHEN period IS NOT NULL THEN a WHEN k = 1 AND b BETWEEN 10000 AND 500000 THEN b END AS minimum, CASE WHEN k = 1 AND period IS NOT NULL AND b <= 500000 THEN b END AS maximum,
coalesce(period, CASE WHEN k = 1 AND b BETWEEN 10000 AND 500000 THEN 'year' END) AS period,
CASE WHEN period IS NOT NULL THEN k IN (0, 7) WHEN k = 1 AND b BETWEEN 10000 AND 500000 THEN false END AS minimum_only, CASE WHEN k = 4 AND period IS NOT NULL THEN 14 END AS payments FROM p""")
def salary_texts(spark, d):
    german = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    price = F.col("o_totalprice")
    sentence = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("o_orderkey") % len(SENTENCES) + 1).cast("int"))
    raw = F.replace(F.replace(sentence, F.lit("{a}"), german(price)), F.lit("{b}"), german(price + 1000))
    rows = table(spark, d, "orders").select("o_orderkey", salary.salary_of(raw).alias("s"))
    return rows.select("o_orderkey", F.col("s.minimum").cast("double").alias("minimum"), F.col("s.maximum").cast("double").alias("maximum"), "s.period", "s.minimum_only", F.col("s.payment_count").alias("payments"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_extendedprice WHEN l_returnflag = 'A' AND l_linenumber > 1 THEN l_extendedprice * l_linenumber END AS annual FROM lineitem")
def annual_pay(spark, d):
    period = F.when(F.col("l_returnflag") == "N", "year").when(F.col("l_returnflag") == "A", "month").otherwise("hour")
    payments = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", salary.annual_eur(F.col("l_extendedprice"), F.lit("EUR"), period, payments).alias("annual"))


VOCABULARY = [("role", "the", "the"), ("role", "of_the", "of the"), ("domain", "and", "and"), ("domain", "schen", "der"), ("task", "est", "est"), ("task", "ing", "in the"), ("method", "les", "les"), ("tool", "los", "los"), ("tool", "con", "con")]
PREFERENCES = [("role", "the", "can_want"), ("role", "of_the", "can_not_want"), ("domain", "and", "cannot_want"), ("domain", "schen", "cannot_not_want"), ("task", "est", "can_want"), ("method", "les", "cannot_not_want"), ("tool", "los", "can_want")]
VALUES = ", ".join(f"('{k}', '{s}', '{a}')" for k, s, a in VOCABULARY)
WANTS = ", ".join(f"('{k}', '{s}', '{a}')" for k, s, a in PREFERENCES)
EVIDENCE = f"""{DOCS}, n AS (SELECT job_id, {_ascii('title')} AS title, {_ascii('body')} AS description FROM docs), v(kind, slug, alias) AS (VALUES {VALUES}),
f AS (SELECT job_id, 'title' AS field, title AS t FROM n UNION ALL SELECT job_id, 'description', description FROM n),
e AS (SELECT job_id, kind, slug, field, alias, CASE field WHEN 'title' THEN 'primary' ELSE 'context' END AS scope,
  CASE field WHEN 'title' THEN 1.0e0 ELSE CASE kind WHEN 'role' THEN 0.45e0 WHEN 'domain' THEN 0.55e0 WHEN 'task' THEN 0.8e0 ELSE 0.85e0 END END AS confidence
  FROM f JOIN v ON contains(' ' || t || ' ', ' ' || alias || ' '))"""


def _evidence(spark, d) -> DataFrame:
    rows = docs(spark, d).select("job_id", text.ascii_words(F.col("title")).alias("title"), text.ascii_words(F.col("body")).alias("description"))
    return fit.semantics(fit.extract(rows, spark.createDataFrame(VOCABULARY, "kind string, slug string, alias string")))


@query(f"WITH {EVIDENCE} SELECT job_id, kind, slug, field, alias, scope, confidence FROM e")
def concept_evidence(spark, d):
    return _evidence(spark, d)


W = f"""{EVIDENCE}, k AS (SELECT *, CASE kind WHEN 'role' THEN 1.15e0 WHEN 'domain' THEN 1.25e0 WHEN 'task' THEN 1e0 ELSE 0.75e0 END * confidence AS norm FROM e),
x AS (SELECT *, norm * CASE scope WHEN 'primary' THEN 1e0 ELSE 0.35e0 END AS eff FROM k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, kind, slug ORDER BY eff DESC, scope DESC) AS r FROM x) WHERE r = 1),
p(kind, slug, state) AS (VALUES {WANTS}),
j AS (SELECT b.*, state, CASE state WHEN 'can_want' THEN 1e0 WHEN 'can_not_want' THEN -0.2e0 WHEN 'cannot_want' THEN 0.2e0 WHEN 'cannot_not_want' THEN -1e0 END AS worth FROM b LEFT JOIN p USING (kind, slug))"""


@query(f"""WITH {W}, s AS (SELECT job_id, sum(norm) AS total, coalesce(sum(norm) FILTER (worth IS NOT NULL), 0) AS rated, sum(eff * worth) AS signed,
  bool_or(scope = 'primary' AND kind IN ('role', 'domain') AND coalesce(state = 'cannot_not_want', false)) AS hard FROM j GROUP BY 1),
t AS (SELECT *, greatest(-1e0, least(1e0, signed / CASE WHEN signed > 0 THEN greatest(rated, 3e0) ELSE rated END)) AS share FROM s)
SELECT job_id, CASE WHEN rated > 0 THEN round_even(50e0 + 50e0 * CASE WHEN hard THEN least(share, -0.5e0) ELSE share END, 0)::INT END AS score, round(rated / total, 6) AS coverage, hard FROM t""")
def fit_scores(spark, d):
    wants = spark.createDataFrame(PREFERENCES, "kind string, slug string, state string")
    return fit.score(_evidence(spark, d), wants).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {W}, r AS (SELECT *, eff * worth AS c, row_number() OVER (PARTITION BY job_id ORDER BY abs(eff * worth) DESC, kind, slug) AS rank FROM j WHERE worth IS NOT NULL)
SELECT job_id, rank::INT AS rank, kind, slug, round(c, 6) AS contribution FROM r WHERE rank <= 4""")
def fit_drivers(spark, d):
    wants = spark.createDataFrame(PREFERENCES, "kind string, slug string, state string")
    return fit.drivers(_evidence(spark, d), wants).withColumn("contribution", F.round("contribution", 6))


@query(f"""WITH {EVIDENCE} SELECT v.kind, v.slug, count(DISTINCT job_id) AS jobs, count(*) FILTER (scope = 'primary') AS primary_rows, count(*) FILTER (scope = 'context') AS context_rows
FROM (SELECT DISTINCT kind, slug FROM v) v LEFT JOIN e USING (kind, slug) GROUP BY 1, 2""")
def concept_counts(spark, d):
    concepts = spark.createDataFrame([x[:2] for x in VOCABULARY], "kind string, slug string")
    return rollups.concept_counts(concepts, _evidence(spark, d))


#: A small vocabulary over the words of the driver's texts.
GATE = gate.Patterns(
    exclusion={"that": "^that "}, strong={"the_of": "the .* of "}, adjacent={"project_manager": "and", "controls": "der", "electrical": "les"}, low_relevance={"los": "los"},
    domain={"industrial": "est", "machines": "ing "}, method={"on": " on ", "in": " in ", "is": " is "}, negative={"sales": "sales", "finance": "ung", "hr": "ir"},
)


@query(f"""WITH {DOCS}, m AS (SELECT job_id, lower(title) AS t, lower(body) || ' ' AS b, lower(title) || ' ' || lower(body) || ' ' AS e FROM docs),
n AS (SELECT *, (regexp_matches(t, 'est'))::INT + regexp_matches(t, 'ing ')::INT AS td, regexp_matches(e, 'est')::INT + regexp_matches(e, 'ing ')::INT AS dom, regexp_matches(b, 'est') OR regexp_matches(b, 'ing ') AS bd,
  regexp_matches(e, ' on ')::INT + regexp_matches(e, ' in ')::INT + regexp_matches(e, ' is ')::INT AS met, replace(t, 'after sales', ' ') AS mt, replace(e, 'after sales', ' ') AS me FROM m),
f AS (SELECT *, contains(mt, 'sales') AS ts, contains(mt, 'ung') AS tf, contains(mt, 'ir') AS th, contains(me, 'sales') OR contains(me, 'ung') OR contains(mt, 'ir') AS blk,
  contains(t, 'and') AS pm, contains(t, 'der') AS ctl, contains(t, 'les') AS ele FROM n)
SELECT CASE WHEN starts_with(t, 'that ') OR ts OR (ctl AND td = 0) THEN 'structural_title_exclusion' WHEN regexp_matches(t, 'the .* of ') THEN 'strong_mechanical_title'
 WHEN ele AND td = 0 THEN 'insufficient_base_relevance' WHEN contains(t, 'los') THEN 'low_relevance_operational_title' WHEN ts OR tf OR th THEN 'insufficient_base_relevance'
 WHEN pm AND contains(t, 'est') AND NOT (ts OR tf) THEN 'industrial_project_title' WHEN pm AND bd AND NOT (ts OR tf) THEN 'technical_project_management_body'
 WHEN (pm OR ctl OR ele) AND dom >= 1 AND (NOT blk OR met >= 1) THEN 'engineering_role_with_domain' WHEN (pm OR ctl OR ele) AND met >= 1 AND NOT blk THEN 'engineering_role_with_method'
 WHEN dom >= 2 AND met >= 1 THEN 'multiple_domains_with_method' WHEN met >= 3 AND NOT blk THEN 'multiple_engineering_methods' ELSE 'insufficient_base_relevance' END AS reason, count(*) AS n
FROM f GROUP BY 1""")
def gate_reasons(spark, d):
    rows = gate.decide(gate.matches(docs(spark, d).withColumn("extra", F.lit("")), GATE))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


# Titles that differ by a letter, a word or a mark, descriptions that hold each other's words in part, and too short ones.
ENDINGS = (" engineer berlin", " engineers berlin", " engineer in berlin", " enginer berlim", " (m/w/d)")
WORDS = [f"w{i}" for i in range(16)]
DESCRIPTIONS = (WORDS[:14], WORDS[:11] + ["x", "y", "z"], WORDS[:5], WORDS)
SNAPSHOT = f"""s AS (SELECT p_partkey AS job_id, CASE WHEN p_partkey % 6 = 5 THEN 'senior ' || p_name || '{ENDINGS[0]}' ELSE p_name || [{", ".join(f"'{e}'" for e in ENDINGS)}][p_partkey % 6 + 1] END AS title, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand || ' ' || (p_size % 8) END AS company,
  [{", ".join(f"'{' '.join(w)}'" for w in DESCRIPTIONS)}][p_size % 4 + 1] AS description, CASE WHEN p_size % 3 > 0 THEN [(p_partkey % 2)::VARCHAR] ELSE []::VARCHAR[] END AS postal, [p_type] AS cities, ['s' || (p_partkey % 3)] AS sources FROM part),
n AS (SELECT *, trim(regexp_replace(replace(lower(title), '(m/w/d)', ' '), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS c, list_distinct(string_split(description, ' ')) AS w FROM s)"""
# The longest common block of two ranges (the first in the left, then in the right text), then the same left and right of it; the ratio is twice all blocks over both lengths.
BLOCK = """list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: struct_pack(k := len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda x: substr(a, i + 1, x) = substr(b, j + 1, x))), i := -i, j := -j)))))"""
RATIOS = f"""u AS (SELECT DISTINCT l.t AS a, r.t AS b FROM n l JOIN n r ON l.c = r.c AND l.c <> '' AND l.job_id < r.job_id AND l.t <> r.t AND l.t <> '' AND r.t <> ''),
seg AS (SELECT a, b, alo, ahi, blo, bhi, {BLOCK} AS m FROM (SELECT a, b, 0::BIGINT AS alo, length(a) AS ahi, 0::BIGINT AS blo, length(b) AS bhi FROM u)
UNION ALL SELECT a, b, alo, ahi, blo, bhi, {BLOCK} AS m FROM (SELECT a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': -m.i + m.k, 'ahi': ahi, 'blo': -m.j + m.k, 'bhi': bhi}}], recursive := true) FROM seg WHERE m.k > 0) WHERE alo < ahi AND blo < bhi),
ratio AS (SELECT a, b, 2e0 * sum(m.k) / (length(a) + length(b)) AS sim FROM seg GROUP BY a, b)"""


def snapshots(spark, d) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    title = F.when(k % 6 == 5, F.concat(F.lit("senior "), "p_name", F.lit(ENDINGS[0]))).otherwise(F.concat("p_name", of((*ENDINGS, ""), k % 6)))
    return table(spark, d, "part").select(
        k.alias("job_id"), title.alias("title"), F.when(size % 10 == 0, "").otherwise(F.concat("p_brand", F.lit(" "), (size % 8).cast("string"))).alias("company"), of([" ".join(w) for w in DESCRIPTIONS], size % 4).alias("description"),
        F.when(size % 3 > 0, F.array((k % 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("postal"), F.array("p_type").alias("cities"), F.array(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("sources"),
    )


@query(f"""WITH RECURSIVE {SNAPSHOT}, {RATIOS},
p AS (SELECT l.job_id AS left_id, r.job_id AS right_id, l.c <> '' AS cm, CASE WHEN l.t = r.t THEN 1e0 ELSE sim END AS sim, len(list_intersect(l.postal, r.postal)) > 0 OR len(list_intersect(l.cities, r.cities)) > 0 AS loc,
  CASE WHEN least(len(l.w), len(r.w)) < 12 THEN 0e0 ELSE len(list_intersect(l.w, r.w))::DOUBLE / least(len(l.w), len(r.w)) END AS d,
  len(string_split(l.t, ' ')) <= 2 AND len(string_split(r.t, ' ')) <= 2 AS generic, l.sources = r.sources AS same,
  (len(l.postal) > 0 AND len(r.postal) > 0 AND len(list_intersect(l.postal, r.postal)) = 0) OR (len(l.postal) = 0 AND len(r.postal) = 0 AND len(list_intersect(l.cities, r.cities)) = 0) AS conflict
  FROM n l JOIN n r ON l.job_id < r.job_id AND l.c = r.c AND (l.c <> '' OR l.t = r.t) LEFT JOIN ratio ON a = l.t AND b = r.t),
k AS (SELECT *, CASE WHEN cm AND same AND sim >= 0.94 AND d >= CASE WHEN generic THEN 0.95 ELSE 0.82 END THEN 'high' WHEN cm AND NOT same AND ((sim >= 0.94 AND loc) OR (sim >= 0.98 AND d >= 0.72) OR (sim = 1 AND NOT generic)) THEN 'high'
  WHEN (cm AND sim >= 0.88) OR (NOT cm AND sim = 1 AND loc) THEN 'medium' END AS confidence FROM p WHERE NOT conflict)
SELECT left_id, right_id, confidence, round(sim, 6) AS sim, round(d, 6) AS desc_sim FROM k WHERE confidence IS NOT NULL""")
def duplicate_pairs(spark, d):
    return dedupe.evidence(snapshots(spark, d)).select("left_id", "right_id", "confidence", F.round("sim", 6).alias("sim"), F.round("desc_sim", 6).alias("desc_sim"))


@query(f"""WITH RECURSIVE {SNAPSHOT}, {RATIOS}, p AS (SELECT DISTINCT l.c AS company, l.t AS a, r.t AS b FROM n l JOIN n r ON l.c = r.c AND l.c <> '' AND l.t < r.t AND l.t <> ''),
v AS (SELECT company, p.a, p.b, round(x.sim, 6) AS ab FROM p JOIN (SELECT a, b, sim FROM ratio UNION SELECT b, a, sim FROM ratio) x ON x.a = p.a AND x.b = p.b)
SELECT company, a, b FROM v GROUP BY ALL HAVING max(ab) >= 0.88""")
def alike_titles(spark, d):
    rows = dedupe.prepared(snapshots(spark, d)).filter("norm_company <> '' AND norm_title <> ''")
    return dedupe.similar_titles(rows.select(F.col("norm_company").alias("company"), F.col("norm_title").alias("title")).distinct()).select("company", "a", "b")


@query()
def duplicate_pairs_fuzzy(spark, d):
    # Texts as the table has them: each brand's names in 40 companies.
    size, k = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("job_id"), F.col("p_name").alias("title"), F.when(size % 10 == 0, "").otherwise(F.concat("p_brand", F.lit(" "), (k % 40).cast("string"))).alias("company"), F.col("p_type").alias("description"),
        F.when(size % 3 > 0, F.array((size % 5).cast("string"))).otherwise(F.array().cast("array<string>")).alias("postal"), F.array("p_type").alias("cities"), F.array(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("sources"),
    )
    return dedupe.evidence(rows)


# Chains of 50 customers at most, as many as the table has.
LINKED = "c_custkey % 7 < 3 AND c_custkey // 7 % 50 < 49"


@query(f"""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE {LINKED}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS v, a AS g FROM u UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.v) SELECT v AS job_id, min(g) AS group_id FROM r GROUP BY v""")
def merge_groups(spark, d):
    edges = table(spark, d, "customer").filter(LINKED.replace("//", "div")).select(F.col("c_custkey").alias("left_id"), (F.col("c_custkey") + 7).alias("right_id"))
    return dedupe.merge_groups(edges)


MEMBERS = """m AS (SELECT o_orderkey AS job_id, o_custkey AS group_id, o_orderpriority AS description, CASE WHEN o_orderkey % 3 = 0 THEN 'Acme GmbH' ELSE 'acme' END AS company, o_orderkey % 2 = 0 AS structured_salary,
  o_orderkey % 4 AS n_postal, o_orderkey % 5 AS n_points, o_orderkey % 6 AS n_listings, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 100000) END AS salary_min, o_orderdate AS first_seen_at, o_orderdate AS last_seen_at,
  CASE WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, (o_orderkey % 2)::INT AS fit FROM orders)"""


def _members(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("job_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("description"), F.when(k % 3 == 0, "Acme GmbH").otherwise("acme").alias("company"), (k % 2 == 0).alias("structured_salary"),
        (k % 4).alias("n_postal"), (k % 5).alias("n_points"), (k % 6).alias("n_listings"), F.when(k % 2 == 0, F.floor(F.col("o_totalprice") / 100000)).alias("salary_min"), F.lit(None).cast("long").alias("salary_max"), F.lit("year").alias("salary_period"),
        F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderdate").alias("last_seen_at"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"), (k % 2).cast("int").alias("fit"),
    )


@query(f"WITH {MEMBERS} SELECT group_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY structured_salary DESC, n_postal DESC, n_points DESC, length(description) DESC, n_listings DESC, job_id) AS r FROM m) WHERE r = 1")
def merge_survivors(spark, d):
    return dedupe.survivors(_members(spark, d)).select("group_id", "job_id")


@query(f"WITH {MEMBERS} SELECT group_id, count(DISTINCT salary_min) > 1 AS blocked FROM m GROUP BY 1")
def merge_blockers(spark, d):
    return dedupe.merge_blockers(_members(spark, d)).select("group_id", (F.size("blockers") > 0).alias("blocked"))


@query(f"""WITH {MEMBERS}, b AS (SELECT group_id, salary_min FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY salary_min IS NOT NULL DESC, structured_salary DESC, job_id) AS r FROM m) WHERE r = 1),
l AS (SELECT group_id, description FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY length(description) DESC, job_id) AS r FROM m) WHERE r = 1)
SELECT group_id, l.description, b.salary_min::BIGINT AS salary_min, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, CASE WHEN bool_or(status = 'ACTIVE') THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
CASE WHEN count(DISTINCT fit) = 1 THEN max(fit) END AS fit, count(*) AS n_merged FROM m JOIN b USING (group_id) JOIN l USING (group_id) GROUP BY ALL""")
def merged_jobs(spark, d):
    return dedupe.merged(_members(spark, d)).select("group_id", "description", "salary_min", "first_seen_at", "last_seen_at", "status", "fit", "n_merged")


@query("SELECT o_custkey AS group_id, bool_or(o_orderkey % 13 = 0) AS favorite, bool_or(o_orderkey % 17 = 0) AS hidden, min(o_orderdate) FILTER (o_orderkey % 2 = 0) AS viewed_at FROM orders GROUP BY 1")
def merged_states(spark, d):
    k = F.col("o_orderkey")
    return dedupe.merged_states(table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), (k % 13 == 0).alias("favorite"), (k % 17 == 0).alias("hidden"), F.when(k % 2 == 0, F.col("o_orderdate")).alias("viewed_at")))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS home_id, 's' || (l_linenumber % 3) AS source, lpad((l_partkey % 50)::VARCHAR, 4, '0') AS postal_code, (l_quantity * 10000)::DECIMAL(12,2) AS price,
  'haus mit garten und grosser terrasse ' || l_suppkey AS t, l_discount * 1000 AS living FROM lineitem),
o AS (SELECT home_id, postal_code, price, t, list_sort(list_distinct(list(source))) AS s, max(living) AS living FROM r GROUP BY 1, 2, 3, 4),
g AS (SELECT postal_code, price, t, list(home_id ORDER BY home_id) AS h, list(s ORDER BY home_id) AS s, list(living ORDER BY home_id) AS a FROM o GROUP BY 1, 2, 3 HAVING count(*) = 2)
SELECT h[1] AS left_id, h[2] AS right_id, postal_code, price::DOUBLE AS price FROM g WHERE len(s[1]) = 1 AND len(s[2]) = 1 AND s[1] <> s[2] AND abs(a[1] - a[2]) <= greatest(1e0, greatest(a[1], a[2]) * 0.01e0)""")
def twin_homes(spark, d):
    # As many houses as the table has suppliers, so that pairs don't drown in equal rows as the tables grow.
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("home_id"), F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("source"), F.lpad((F.col("l_partkey") % 50).cast("string"), 4, "0").alias("postal_code"),
        (F.col("l_quantity") * 10000).cast("decimal(12,2)").alias("price"), F.concat(F.lit("Haus mit Garten & großer Terrasse "), F.col("l_suppkey").cast("string")).alias("title"),
        (F.col("l_discount") * 1000).alias("living"), F.lit(None).cast("double").alias("plot"),
    )
    return dedupe.twin_homes(rows.withColumn("title", F.replace("title", F.lit("&"), F.lit("und")))).withColumn("price", F.col("price").cast("double"))


@query("SELECT l_suppkey AS identity, count(DISTINCT l_partkey) AS n_entities, min(l_partkey) AS keep_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def split_identities(spark, d):
    return dedupe.split_identities(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("identity"), F.col("l_partkey").alias("entity_id")))


STORED = "st AS (SELECT o_orderkey AS listing_id, o_custkey AS entity_id, o_custkey % 5 AS source_id, o_orderkey % 3000 AS listing_key, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 700 END AS identity, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 900 END AS url FROM orders WHERE o_orderkey % 4 <> 1)"
INCOMING = "inc AS (SELECT o_orderkey AS row_id, o_orderkey % 5 AS source_id, o_orderkey % 4000 AS listing_key, CASE WHEN o_orderkey % 8 = 1 THEN o_custkey % 900 END AS identity, o_orderkey % 1800 + 1 AS url FROM orders WHERE o_orderkey % 4 = 1)"


def _stored(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").filter(k % 4 != 1).select(k.alias("listing_id"), c.alias("entity_id"), (c % 5).alias("source_id"), (k % 3000).alias("listing_key"), F.when(k % 3 == 0, c % 700).alias("identity"), F.when(k % 4 == 0, k % 900).alias("url"))


def _incoming(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").filter(k % 4 == 1).select(k.alias("row_id"), (k % 5).alias("source_id"), (k % 4000).alias("listing_key"), F.when(k % 8 == 1, F.col("o_custkey") % 900).alias("identity"), (k % 1800 + 1).alias("url"))


@query(f"""WITH {STORED}, {INCOMING}, f AS (SELECT row_id, 1 AS rule, 'listing' AS "by", listing_id, entity_id FROM inc JOIN st USING (source_id, listing_key) UNION ALL
SELECT row_id, 2, 'identity', listing_id, entity_id FROM inc JOIN st USING (source_id, identity) UNION ALL SELECT row_id, 3, 'url', listing_id, entity_id FROM inc JOIN st USING (url)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rule, listing_id) AS r FROM f) WHERE r = 1) SELECT row_id, entity_id, "by" FROM inc LEFT JOIN b USING (row_id)""")
def resolved_identities(spark, d):
    return identity.resolved(_incoming(spark, d), _stored(spark, d)).select("row_id", "entity_id", "by")


SIDE = "SELECT l_orderkey * 10 + l_linenumber AS token, (l_partkey % 20)::VARCHAR AS postal_code, 'ein schoenes haus ' || l_suppkey AS title, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS price, CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_tax * 50) END AS area FROM lineitem WHERE l_orderkey % 2 = {n}"


def side(lines: DataFrame) -> DataFrame:
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("token"), (F.col("l_partkey") % 20).cast("string").alias("postal_code"), F.concat(F.lit("ein schoenes haus "), F.col("l_suppkey").cast("string")).alias("title"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("price"), F.when(F.col("l_linenumber") % 3 != 0, F.floor(F.col("l_tax") * 50)).alias("area"),
    )


@query(f"""WITH p AS ({SIDE.format(n=1)}), c AS ({SIDE.format(n=0)}),
p1 AS (SELECT postal_code, title, price, area, min(token) AS token FROM p WHERE price IS NOT NULL OR area IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
c1 AS (SELECT postal_code, title, price, area, min(token) AS token FROM c WHERE price IS NOT NULL OR area IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
e AS (SELECT p1.token AS prev_token, c1.token AS cur_token FROM p1 JOIN c1 ON p1.postal_code = c1.postal_code AND p1.title = c1.title AND p1.price IS NOT DISTINCT FROM c1.price AND p1.area IS NOT DISTINCT FROM c1.area),
p2 AS (SELECT postal_code, title, area, min(token) AS token FROM p WHERE area IS NOT NULL AND token NOT IN (SELECT prev_token FROM e) GROUP BY 1, 2, 3 HAVING count(*) = 1),
c2 AS (SELECT postal_code, title, area, min(token) AS token FROM c WHERE area IS NOT NULL AND token NOT IN (SELECT cur_token FROM e) GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT prev_token, cur_token, 'exact' AS strategy FROM e UNION ALL SELECT p2.token, c2.token, 'title_area' FROM p2 JOIN c2 USING (postal_code, title, area)""")
def continued_listings(spark, d):
    lines = table(spark, d, "lineitem")
    return identity.continued(side(lines.filter("l_orderkey % 2 = 1")), side(lines.filter("l_orderkey % 2 = 0")))


@query("""SELECT c_custkey, coalesce(n.acctbal, c_acctbal) AS c_acctbal, c_name FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS acctbal FROM orders GROUP BY 1) n ON c_custkey = o_custkey""")
def upserted_customers(spark, d):
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("c_acctbal"))
    return identity.upserted(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name"), new, ["c_custkey"])


SHARDS = """r AS (SELECT dayofmonth(ts) AS run_id, event_type, CASE WHEN max(value) > 99.9 THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS items, CASE WHEN event_type <> 'error' THEN count(*) END AS reported, min(value) < 1 AS complete FROM events GROUP BY 1, 2)"""


@query(f"""WITH {SHARDS}, s AS (SELECT run_id, count(*) AS t, count(*) FILTER (status = 'SUCCESS') AS c, count(*) FILTER (status = 'FAILED') AS f, sum(items)::BIGINT AS items_seen, sum(reported)::BIGINT AS reported,
 bool_and(status = 'SUCCESS') AS ok, bool_and(status = 'FAILED') AS bad, bool_and(complete) AS whole FROM r GROUP BY 1)
SELECT run_id, coalesce(t, 0) AS shards_total, coalesce(c, 0) AS shards_completed, coalesce(f, 0) AS shards_failed, coalesce(items_seen, 0) AS items_seen, reported,
CASE WHEN t IS NULL OR bad THEN 'FAILED' WHEN ok THEN 'SUCCESS' ELSE 'PARTIAL' END AS status, CASE WHEN t IS NULL OR bad THEN 'FAILED' WHEN ok AND whole THEN 'OK' ELSE 'DEGRADED' END AS coverage_status
FROM (SELECT unnest(range(1, 32))::INT AS run_id) LEFT JOIN s USING (run_id)""")
def coverage_summary(spark, d):
    rows = table(spark, d, "events").groupBy(F.dayofmonth("ts").alias("run_id"), "event_type").agg(F.max("value").alias("m"), F.min("value").alias("l"), F.count("*").alias("items_seen"))
    shards = rows.select("run_id", F.when(F.col("m") > 99.9, "FAILED").otherwise("SUCCESS").alias("status"), "items_seen", F.when(F.col("event_type") != "error", F.col("items_seen")).alias("source_reported_count"), (F.col("l") < 1).alias("complete"), F.lit(False).alias("cap_hit"))
    return lifecycle.coverage(spark.range(1, 32).select(F.col("id").cast("int").alias("run_id")), shards)


@query("SELECT o_custkey AS source_id, o_orderkey AS run_id, o_orderdate AS started_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_runs(spark, d):
    return lifecycle.latest_run(table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at")))


RUNS = "runs AS (SELECT o_custkey AS source_id, o_orderkey AS run_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN 'reconciliation' ELSE 'incremental' END AS mode, CASE WHEN o_orderstatus = 'F' THEN 'DEGRADED' ELSE 'OK' END AS coverage_status FROM orders)"


def _runs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"),
        F.when(F.col("o_orderkey") % 2 == 0, "reconciliation").otherwise("incremental").alias("mode"), F.when(F.col("o_orderstatus") == "F", "DEGRADED").otherwise("OK").alias("coverage_status"),
    )


@query(f"""WITH {RUNS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1),
p AS (SELECT l.source_id, l.run_id, g.run_id AS prev_id, row_number() OVER (PARTITION BY l.run_id ORDER BY g.started_at DESC, g.run_id DESC) AS n FROM l JOIN runs g ON g.source_id = l.source_id AND g.mode = 'reconciliation' AND g.coverage_status = 'OK' AND g.started_at < l.started_at)
SELECT source_id, run_id, prev_id FROM p WHERE n = 2""")
def second_previous_ok(spark, d):
    return lifecycle.previous_ok(_runs(spark, d), lifecycle.latest_run(_runs(spark, d)), 1).select("source_id", "run_id", "prev_id")


@query("""WITH l AS (SELECT user_id AS listing_id, user_id % 4 AS source_id, max(ts) AS last_seen_at, max_by(dayofmonth(ts), ts) AS last_run, user_id % 3 <> 0 AS stable FROM events GROUP BY 1)
SELECT listing_id FROM l WHERE last_run <> 29 AND source_id <> 3 AND last_seen_at < CASE WHEN stable THEN TIMESTAMP '2024-01-30 06:00:00' ELSE TIMESTAMP '2024-01-30' END""")
def missing_listings(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("listing_id")).agg(F.max("ts").alias("last_seen_at"), F.max_by(F.dayofmonth("ts"), "ts").alias("last_run_id"))
    rows = rows.withColumn("source_id", F.col("listing_id") % 4).withColumn("stable", F.col("listing_id") % 3 != 0).withColumn("status", F.lit("ACTIVE"))
    runs = spark.range(4).select(
        F.col("id").alias("source_id"), F.lit(29).alias("run_id"), F.lit("reconciliation").alias("mode"), F.when(F.col("id") == 3, "DEGRADED").otherwise("OK").alias("coverage_status"),
        F.expr("timestamp '2024-01-30 06:00:00'").alias("prev_started"), F.expr("timestamp '2024-01-30'").alias("prev2_started"),
    )
    return lifecycle.missing(rows, runs).select("listing_id")


@query("SELECT c_custkey AS home_id FROM customer WHERE c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def orphaned_homes(spark, d):
    homes = table(spark, d, "customer").select(F.col("c_custkey").alias("home_id"), F.when(F.col("c_custkey") % 2 == 0, "ACTIVE").otherwise("INACTIVE").alias("status"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("home_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"))
    return lifecycle.orphaned(homes, rows, "home_id").select("home_id")


SCANS = "u AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS rec, max(ts) FILTER (event_type = 'click') AS inc, max(ts) FILTER (event_type IN ('purchase', 'error')) AS att FROM events GROUP BY 1)"


# Intervals of 48 hours, none, 0 and less, and disabled sources.
@query(f"""WITH {SCANS}, a AS (SELECT *, TIMESTAMP '2024-01-31' AS now, CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -5 ELSE 48 END AS hours FROM u)
SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN hours > 0 AND (rec IS NULL OR epoch(now) - epoch(rec) >= hours * 3600) AND (att IS NULL OR epoch(now) - epoch(att) >= 3 * 3600) THEN 'reconciliation'
WHEN coalesce(greatest(rec, inc), rec, inc) IS NULL OR epoch(now) - epoch(greatest(rec, inc)) >= 360 * 60 THEN 'incremental' END AS kind FROM a""")
def due_runs(spark, d):
    of = lambda *kinds: F.max(F.when(F.col("event_type").isin(*kinds), F.col("ts")))
    rows = table(spark, d, "events").groupBy("user_id").agg(of("purchase").alias("rec"), of("click").alias("inc"), of("purchase", "error").alias("att"))
    u = F.col("user_id")
    hours = F.when(u % 6 == 1, 0).when(u % 6 == 2, -5).when(u % 6 > 2, 48)
    kind = lifecycle.run_kind(F.expr("timestamp '2024-01-31'"), interval_hours=hours, poll_minutes=F.lit(360), last_attempt=F.col("att"), last_reconciliation=F.col("rec"), last_incremental=F.col("inc"), enabled=u % 7 != 0)
    return rows.select("user_id", kind.alias("kind"))


@query(f"WITH {RUNS} SELECT source_id, max(started_at) AS last_attempt FROM runs WHERE mode = 'reconciliation' GROUP BY 1")
def latest_attempts(spark, d):
    return lifecycle.latest_attempt(_runs(spark, d), "reconciliation")


@query(f"""WITH {SCANS} SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'disabled' WHEN user_id % 7 = 0 OR user_id % 11 = 0 THEN 'warning' WHEN rec IS NULL THEN 'never_succeeded'
WHEN epoch(TIMESTAMP '2024-01-31') - epoch(rec) > 3 * 1440 * 60 THEN 'stale' ELSE 'ok' END AS state FROM u""")
def source_states(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("rec"))
    u = F.col("user_id")
    state = lifecycle.source_state(F.expr("timestamp '2024-01-31'"), enabled=u % 10 != 0, run_status=F.when(u % 7 == 0, "FAILED"), run_coverage=F.lit(None).cast("string"), failing_shards=F.when(u % 11 == 0, 1).otherwise(0), last_success=F.col("rec"), poll_minutes=F.lit(1440))
    return rows.select("user_id", state.alias("state"))


@query("""SELECT CASE WHEN k % 5 = 0 THEN 'unknown' WHEN 200 + k % 300 IN (404, 410) OR k % 13 = 0 THEN 'dead' WHEN k % 17 = 0 THEN 'unknown' WHEN 200 + k % 300 BETWEEN 200 AND 399 THEN 'live' ELSE 'unknown' END AS state, count(*) AS n
FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1""")
def page_states(spark, d):
    k = F.col("o_orderkey")
    state = lifecycle.page_state(F.when(k % 5 != 0, F.lit(200) + k % 300), k % 13 == 0, k % 17 == 0)
    return table(spark, d, "orders").select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN a <= 30 THEN '0-30' WHEN a <= 90 THEN '31-90' WHEN a <= 180 THEN '91-180' WHEN a <= 365 THEN '181-365' WHEN a > 365 THEN '>365' ELSE 'unknown' END AS bucket, count(*) AS n
FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE greatest(0, floor((epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate)) / 86400)) END AS a FROM orders) GROUP BY 1""")
def release_ages(spark, d):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = table(spark, d, "orders").select(lifecycle.age_bucket(lifecycle.released_age(raw, F.expr("timestamp '1998-08-01'"))).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_partkey AS e, l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), c AS (SELECT e, count(*) AS k FROM p GROUP BY 1)
SELECT s AS source_id, sum(n)::BIGINT AS listings, count(*) AS entities, count(*) FILTER (k = 1) AS exclusive, count(*) FILTER (k > 1) AS shared FROM p JOIN c USING (e) GROUP BY 1""")
def source_contributions(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("source_id"))
    return rollups.contributions(rows)


@query("SELECT l_orderkey AS entity_id, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def source_overlap(spark, d):
    return rollups.overlap(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_suppkey").alias("source_id")))


@query("SELECT count(*) AS n, count(*) FILTER (c_acctbal > 0) AS located, count(DISTINCT c_nationkey) FILTER (c_acctbal > 0) AS entities, count(*) FILTER (c_acctbal > 0) / count(*) AS ratio FROM customer")
def geo_coverage(spark, d):
    point = F.when(F.col("c_acctbal") > 0, F.lit(1.0))
    return rollups.geo_coverage(table(spark, d, "customer").select("c_nationkey", point.alias("lon"), point.alias("lat")), "c_nationkey")


@query("""WITH c AS (SELECT p_type AS city, p_type LIKE '%1%' AS scope, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2), r AS (SELECT *, count(*) OVER w AS labels, sum(n) OVER w AS locations,
row_number() OVER (PARTITION BY scope ORDER BY n DESC, city) AS rank FROM c WINDOW w AS (PARTITION BY scope)) SELECT city, scope, n, labels, locations::BIGINT AS locations, rank::INT AS rank FROM r WHERE rank <= 20""")
def unresolved_labels(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("city"), F.when(F.col("p_size") % 2 != 0, F.lit(1.0)).alias("lon"))
    return rollups.unresolved_labels(rows, lambda c: c.like("%1%"))


@query("SELECT sum(coalesce(json_extract_string(props, '$.k')::BIGINT, 0))::BIGINT AS k, sum(coalesce(json_extract_string(props, '$.none')::BIGINT, 0))::BIGINT AS none FROM events")
def json_totals(spark, d):
    return rollups.json_totals(table(spark, d, "events"), "props", ["k", "none"])


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice_mean, median(o_totalprice) AS o_totalprice_median FROM orders")
def value_distribution(spark, d):
    return rollups.distribution(table(spark, d, "orders"), "o_totalprice").withColumn("o_totalprice_mean", F.round("o_totalprice_mean", 4))


@query("SELECT l_orderkey AS entity_id, count(*) FILTER (l_suppkey = 5) AS purged, count(*) AS listings, count(*) > count(*) FILTER (l_suppkey = 5) AS shared FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_suppkey = 5) > 0")
def purge_check(spark, d):
    return rollups.purge_check(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_suppkey").alias("source_id")), 5)


@query("SELECT coalesce(max(event_id), 0) AS high_water FROM events")
def journal_high_water(spark, d):
    return rollups.high_water(table(spark, d, "events"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 120 ORDER BY event_id LIMIT 100")
def journal_replay(spark, d):
    return journal.replay(table(spark, d, "events"), 120, 100).select("event_id", "event_type", "user_id")


@query("SELECT date_trunc('day', ts) AS day, user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS n FROM events GROUP BY 1, 2")
def journal_stream(spark, d):
    """The journal read as a stream to its end, counted by entity and day."""
    events = table(spark, d, "events")
    stream = journal.follow(spark, d, events.schema, "events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = journal.shared_folder(spark, "journal")
    journal.run_once(journal.sightings(stream), f"{out}/cursor", lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows"), mode="complete")
    return spark.read.parquet(f"{out}/rows").select(F.col("window.start").alias("day"), "user_id", "first_seen_at", "last_seen_at", "n")
