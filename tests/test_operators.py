"""Operator semantics on small fixtures of our own."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brickyard.functions import geo, salary, text
from brickyard.operators import catalog, dedupe, fit, gate, identity, lifecycle, locality, radius, rollups
from brickyard.operators.components import components
from brickyard.sources import homes, jobs
from brickyard.streaming import journal


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(1).alias("_"))
    return row.select(column.alias("x")).first()[0]


def score_of(spark, evidence, preferences):
    e = spark.createDataFrame(evidence, "job_id int, kind string, slug string, scope string, confidence double")
    p = spark.createDataFrame(preferences, "kind string, slug string, state string")
    r = fit.score(e, p).first()
    return r.score, r.hard


def test_fit_score_anchors(spark):
    assert score_of(spark, [(1, "role", "a", "primary", 1.0)], [("role", "a", "can_want")]) == (69, False)
    assert score_of(spark, [(1, "domain", "a", "primary", 1.0)], [("domain", "a", "can_want")]) == (71, False)
    # -0.35 of the rated weight is 32.5, which rounds to even.
    assert score_of(spark, [(1, "task", "a", "context", 1.0)], [("task", "a", "cannot_not_want")]) == (32, False)
    assert score_of(spark, [(1, "domain", "a", "primary", 1.0)], [("domain", "a", "cannot_not_want")]) == (0, True)
    assert score_of(spark, [(1, "role", "a", "primary", 1.0)], [("role", "b", "can_want")]) == (None, False)
    hard = [(1, "role", "a", "primary", 1.0), *((1, "task", f"t{i}", "primary", 1.0) for i in range(9))]
    assert score_of(spark, hard, [("role", "a", "cannot_not_want"), *(("task", f"t{i}", "can_want") for i in range(9))]) == (25, True)


def test_longest_alias_wins_in_a_field(spark):
    rows = spark.createDataFrame([(1, "cad engineer", "cads"), (2, None, "cad")], "job_id int, title string, description string")
    words = spark.createDataFrame([("tool", "cad", "cad"), ("tool", "cad", "cad engineer")], "kind string, slug string, alias string")
    got = {(r.job_id, r.field, r.alias) for r in fit.extract(rows, words).collect()}
    assert got == {(r.job_id, r.field, r.alias) for r in fit.extract(rows, words, few=0).collect()}
    assert got == {(1, "title", "cad engineer"), (2, "description", "cad")}


@pytest.mark.parametrize(("raw", "want"), [("4.673,74", "4673.74"), ("1.234", "1234.00"), ("1.234.567", "1234567.00"), ("12,5", "12.50"), ("1,234.50", "1234.50"), ("12.5", "12.50"), ("abc", None), ("", None), (None, None)])
def test_german_decimals(spark, raw, want):
    got = one(spark, text.german_decimal(F.lit(raw).cast("string")))
    assert got == (Decimal(want) if want else None)


def test_lone_marks_follow_the_source(spark):
    assert one(spark, text.german_decimal(F.lit("1,234"), lone_comma="thousands")) == 1234
    assert one(spark, text.german_decimal(F.lit("1.234"), lone_dot="decimal")) == Decimal("1.23")


def test_salaries():
    assert salary.parse("Das Mindestgehalt beträgt ab 4.673,74 EUR brutto monatlich, 14x jährlich") == (Decimal("4673.74"), None, "EUR", "month", 14, True)
    assert salary.parse("Jahresgehalt € 65.000 – € 80.000")[:4] == (Decimal(65000), Decimal(80000), "EUR", "year")
    assert salary.parse("Gehalt: 80.000 Euro bis 65.000 Euro pro Jahr")[:2] == (Decimal(65000), Decimal(80000))
    assert salary.parse("Preis 300 EUR monatlich") is None and salary.parse("EUR 5000") is None and salary.parse(None) is None
    assert salary.parse("3.500 EUR pro Monat") is None and salary.parse("3.500 EUR pro Monat", trusted=True)[0] == 3500
    assert salary.parse("Gehalt 12 Euro pro Monat") is None


def test_salary_udf_and_annual_pay(spark):
    row = spark.createDataFrame([("Gehalt 3.000 EUR monatlich", False), (None, False)], "t string, k boolean").select(salary.parse_salary("t", "k").alias("s")).select("s.*").collect()
    assert (row[0].minimum, row[0].period, row[1].minimum) == (3000, "month", None)
    annual = lambda p, n: one(spark, salary.annual_eur(F.lit(1000), F.lit("EUR"), F.lit(p), F.lit(n)))
    assert (annual("year", None), annual("month", 14), annual("month", None), annual("hour", 12)) == (1000, 14000, None, None)


def test_titles_and_companies(spark):
    assert one(spark, text.job_title(F.lit("Konstrukteur (m/w/d) bei Über & Söhne"))) == "konstrukteur uber und sohne"
    assert one(spark, text.company_name(F.lit("Müller GmbH & Co KG Holding AG"))) == "muller holding"
    assert one(spark, text.ascii_words(F.lit("Weißenbach-Ñandú"))) == "weissenbach nandu"
    words = spark.createDataFrame([("Weißenbach-Ñandú & Co",), (None,)], "t string")
    assert [tuple(r) for r in words.select(text.ascii_words("t"), text.ascii_words_reference("t")).collect()] == [("weissenbach nandu und co",) * 2, ("", "")]


def test_aliases_are_bounded(spark):
    hit = lambda t, a: one(spark, text.contains_alias(F.lit(t), F.lit(a)))
    assert hit("senior cad engineer", "cad") and not hit("cadence", "cad") and not hit("x", "")


def test_postal_code_beside_a_place(spark):
    beside = lambda t: one(spark, text.postal_beside(F.lit(t), "Bad Ischl"))
    assert beside("Ort: A-4820 Bad  Ischl.") == "4820" and beside("4820 Bad Ischl, 4821 Bad Ischl") is None and beside("14820 Bad Ischl") is None


def test_identities(spark):
    url = lambda u: one(spark, text.provider_identity(F.lit(u), ("b.example", "www.b.example"), "^/de/home/([^/]+)/", "b"))
    assert url("https://www.b.example/de/home/AB-1/x?y") == "b:ab-1" and url("https://other/de/home/AB-1/") is None
    keys = {"explicit": "$.id", "ad_tenant": "$.t", "ad_id": "$.a", "req_tenant": "$.w", "req_site": "$.s", "req_id": "$.r"}
    of = lambda p: one(spark, text.job_identity(F.lit(p), keys))
    assert of('{"id":" x "}') == "x" and of('{"t":"k","a":"1"}') == "smartrecruiters:k:jobad:1" and of('{"w":"a","s":"b","r":" "}') is None
    assert one(spark, text.json_true(F.lit('{"g":true}'), "g")) and not one(spark, text.json_true(F.lit('{"g":"true"}'), "g")) and not one(spark, text.json_true(F.lit("x"), "g"))


def test_distances(spark):
    km = one(spark, geo.haversine_km(F.lit(16.3738), F.lit(48.2082), F.lit(13.055), F.lit(47.8095)))
    m = one(spark, geo.geodesic_m(F.lit(16.3738), F.lit(48.2082), F.lit(13.055), F.lit(47.8095)))
    assert 250 < km < 253 and abs(m / 1000 - km) < 0.004 * km
    assert one(spark, geo.geodesic_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0.0
    with pytest.raises(ValueError):
        geo.radius_metres(0)


def test_grid_coordinates(spark):
    rows = spark.createDataFrame([(0.0, 340_000.0, 31256), (0.0, 340_000.0, 1)], "e double, n double, epsg int")
    (x, y), other = [(r.lon, r.lat) for r in geo.grid_to_wgs84(rows, "e", "n", "epsg").orderBy(F.col("epsg").desc()).collect()]
    # The zone's meridian, moved by the datum shift alone.
    assert abs(x - 16.3324) < 0.002 and abs(y - 48.2) < 0.2
    assert other[0] is None


def test_radius_join_equals_all_pairs(spark):
    a = spark.range(300).select(F.col("id").alias("home_id"), (F.lit(9.5) + (F.col("id") * 7919 % 1009) / 131).alias("lon"), (F.lit(46.3) + (F.col("id") * 104729 % 1013) / 362).alias("lat"))
    b = a.select(F.col("home_id").alias("location_id"), F.col("lon").alias("job_lon"), F.col("lat").alias("job_lat"))
    got = radius.radius_join(a, b, 40).count()
    want = a.crossJoin(b).filter(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("job_lon"), F.col("job_lat")) <= 40).count()
    assert got == want
    assert radius.within_radius(a, None, None, 5).count() == 0


def test_unknown_fails_bounds(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "id int, v double")
    assert [r.id for r in rows.filter(catalog.between(F.col("v"), 5, 8)).collect()] == [1]
    assert rows.filter(catalog.between(F.col("v"))).count() == 3


def test_visibility(spark):
    h = spark.createDataFrame([(1, 1.0), (2, 100_000.0), (3, None), (4, 100_000.0)], "home_id int, price double")
    rows = [(1, "ACTIVE", "p", True, None), (2, "ACTIVE", "p", False, False), (4, "INACTIVE", "p", False, False)]
    listings = spark.createDataFrame(rows, "home_id int, status string, policy string, product_visible boolean, url_missing boolean")
    assert sorted(r.home_id for r in catalog.visible(h, listings).collect()) == [1, 4]


def test_sorting_puts_missing_last_both_ways(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0)], "home_id int, price double").withColumn("first_seen_at", F.current_timestamp())
    order = lambda d: [r.home_id for r in rows.orderBy(*catalog.house_order("price", d)).collect()]
    assert order("asc") == [1, 3, 2] and order("desc") == [3, 1, 2]


def test_gate_rules(spark):
    p = gate.Patterns({"trainee": "trainee"}, {"designer": "mechanical designer"}, {"project_manager": "project manager", "controls": "controls", "engineer": "engineer"}, {"driver": "driver"}, {"industrial": "plant", "machines": "machine"}, {"cad": "cad", "fem": "fem", "lean": "lean"}, {"sales": "sales", "hr": r"\bhr\b"})
    rows = [
        ("Trainee mechanical designer", ""), ("Mechanical designer", "sales"), ("Project manager plant", ""), ("Project manager", "machine tools"), ("Engineer", "machine"), ("Engineer", "machine, sales"),
        ("Engineer", "machine, sales, cad"), ("Engineer", "cad"), ("Clerk", "plant machine cad"), ("Clerk", "cad fem lean"), ("Clerk", "cad"), ("Controls", ""), ("After sales engineer", "machine"), ("Engineer", "machine. contact hr"), ("Driver", "cad fem lean"),
    ]
    data = spark.createDataFrame([(i, t, b, None) for i, (t, b) in enumerate(rows)], "i int, title string, body string, extra string")
    got = [(r.accepted, r.reason) for r in gate.decide(gate.matches(data, p)).orderBy("i").collect()]
    assert got == [
        (False, "structural_title_exclusion"), (True, "strong_mechanical_title"), (True, "industrial_project_title"), (True, "technical_project_management_body"), (True, "engineering_role_with_domain"), (False, "insufficient_base_relevance"),
        (True, "engineering_role_with_domain"), (True, "engineering_role_with_method"), (True, "multiple_domains_with_method"), (True, "multiple_engineering_methods"), (False, "insufficient_base_relevance"), (False, "structural_title_exclusion"), (True, "engineering_role_with_domain"),
        (True, "engineering_role_with_domain"), (False, "low_relevance_operational_title"),
    ]


def test_duplicate_evidence(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [
        (1, "Konstrukteur Stahlbau Wien", "Acme GmbH", words, ["1010"], [], ["a"]), (2, "Konstrukteur (m/w/d) Stahlbau Wien", "ACME", words, ["1010"], [], ["b"]), (3, "Konstrukteur Stahlbau Wien", "Acme", words, ["8010"], [], ["b"]),
        (4, "Konstrukteur Stahlbau Wien", "Other", words, ["1010"], [], ["c"]), (5, "Projektleiter", "", "", [], ["linz"], ["a"]), (6, "Projektleiter", None, "", [], ["linz"], ["b"]),
    ]
    data = spark.createDataFrame(rows, "job_id int, title string, company string, description string, postal array<string>, cities array<string>, sources array<string>")
    got = {(r.left_id, r.right_id): r.confidence for r in dedupe.evidence(data).collect()}
    assert got == {(1, 2): "high", (5, 6): "medium"}
    edges = spark.createDataFrame([(1, 2), (2, 5), (8, 9)], "left_id int, right_id int")
    assert {(r.job_id, r.group_id) for r in dedupe.merge_groups(edges).collect()} == {(1, 1), (2, 1), (5, 1), (8, 8), (9, 8)}


def test_areas_agree(spark):
    agree = lambda a, b, u: one(spark, dedupe.areas_agree(F.lit(a).cast("double"), F.lit(b).cast("double"), u))
    assert agree(763, 764, True) and agree(1000, 1010, True) and not agree(763, 900, True) and agree(None, 900, True) and not agree(None, 900, False)


def test_continuity(spark):
    schema = "token string, postal_code string, title string, price double, area double"
    prev = spark.createDataFrame([("p1", "4020", "a house with garden", 1.0, 90.0), ("p2", "4020", "an older long title", 2.0, None), ("p3", "1010", "twins on one side ok", 3.0, 50.0), ("p4", "1010", "no facts at all here", None, None)], schema)
    cur = spark.createDataFrame([("c1", "4020", "a house with garden", 9.0, 90.0), ("c2", "4020", "an older long title", 2.0, None), ("c3", "1010", "twins on one side ok", 3.0, 50.0), ("c4", "1010", "twins on one side ok", 3.0, 50.0), ("c5", "1010", "no facts at all here", None, None)], schema)
    got = {(r.prev_token, r.cur_token, r.strategy) for r in identity.continued(prev, cur).collect()}
    assert got == {("p2", "c2", "exact"), ("p1", "c1", "title_area")}


def test_payloads_and_seeds(spark):
    payloads = [('{"a":"1","c":[1,{"d":null}],"detail_enriched":true}', '{"a":2,"detail_enriched":false,"detail_enrichment_error":"e"}'), (None, '{"b":"1"}'), ('{"x":1.5}', "[1]"), ('{"detail_enriched":"true"}', '{"detail_enriched":false}')]
    rows = spark.createDataFrame(payloads, "old_payload string, new_payload string")
    merged = [json.loads(r.p) for r in rows.select(identity.merged_payload().alias("p")).collect()]
    assert merged == [{"a": 2, "c": [1, {"d": None}], "detail_enriched": True, "detail_enrichment_last_error": "e"}, {"b": "1"}, {"x": 1.5}, {"detail_enriched": False}]
    old = spark.createDataFrame([("a", "x", "seed"), ("b", "x", "manual"), ("c", "x", "seed")], "slug string, state string, source string")
    seed = spark.createDataFrame([("a", "y"), ("b", "y"), ("d", "y")], "slug string, state string")
    got = {(r.slug, r.state, r.source) for r in identity.synced_seed(old, seed, ["slug"]).collect()}
    assert got == {("a", "y", "seed"), ("b", "x", "manual"), ("d", "y", "seed")}


def test_coverage(spark):
    schema = "run_id int, status string, items_seen int, source_reported_count int, complete boolean, cap_hit boolean"
    shards = spark.createDataFrame([(1, "SUCCESS", 5, None, True, False), (2, "SUCCESS", 5, 7, False, False), (3, "SUCCESS", 1, 1, True, False), (3, "FAILED", 0, None, False, False), (4, "FAILED", 0, None, None, None), (5, "SUCCESS", 1, 1, True, True), (6, "RUNNING", 1, 1, True, False)], schema)
    runs = spark.range(8).select(F.col("id").cast("int").alias("run_id"))
    got = {r.run_id: (r.status, r.coverage_status, r.reported) for r in lifecycle.coverage(runs, shards).collect()}
    assert got[1] == ("SUCCESS", "OK", None) and got[2] == ("SUCCESS", "DEGRADED", 7) and got[3] == ("PARTIAL", "DEGRADED", 1)
    assert got[4] == ("FAILED", "FAILED", None) and got[5][1] == "DEGRADED" and got[6] == ("PARTIAL", "DEGRADED", 1) and got[7] == ("FAILED", "FAILED", None)


def test_reconciliation(spark):
    day = lambda d: F.expr(f"timestamp '2024-01-{d:02d}'")
    rows = spark.createDataFrame([(1, 7, True, 5), (2, None, True, 5), (3, 7, True, 15), (4, 7, False, 5), (5, 9, True, 5), (6, 7, False, 12)], "listing_id int, last_run_id int, stable boolean, seen int")
    rows = rows.withColumn("source_id", F.lit(1)).withColumn("status", F.lit("ACTIVE")).withColumn("last_seen_at", F.expr("timestamp '2024-01-01' + make_dt_interval(seen - 1)"))
    run = lambda q, prev2: spark.range(1).select(F.lit(1).alias("source_id"), F.lit(9).alias("run_id"), F.lit("reconciliation").alias("mode"), F.lit(q).alias("coverage_status"), day(14).alias("prev_started"), prev2.alias("prev2_started"))
    ids = lambda r: sorted(x.listing_id for x in lifecycle.missing(rows, r).collect())
    assert ids(run("OK", day(10))) == [1, 2, 4] and ids(run("OK", F.lit(None).cast("timestamp"))) == [1, 2] and ids(run("DEGRADED", day(10))) == []


def test_due_runs_and_states(spark):
    at = lambda h: F.expr(f"timestamp '2024-01-02 12:00:00' - interval {h} hours") if h is not None else F.lit(None).cast("timestamp")
    kind = lambda rec, att, inc: one(spark, lifecycle.run_kind(at(0), interval_hours=F.lit(24), poll_minutes=F.lit(60), last_attempt=at(att), last_reconciliation=at(rec), last_incremental=at(inc)))
    assert kind(30, 30, 30) == "reconciliation" and kind(30, 0, 2) == "incremental"
    assert kind(1, 1, None) == "incremental" and kind(0, 0, 5) is None and kind(None, None, None) == "reconciliation"
    state = lambda hours, fails=0: one(spark, lifecycle.source_state(at(0), enabled=F.lit(True), run_status=F.lit("SUCCESS"), run_coverage=F.lit("OK"), failing_shards=F.lit(fails), last_success=at(hours), poll_minutes=F.lit(60)))
    assert (state(4), state(2), state(None), state(1, 1)) == ("stale", "ok", "never_succeeded", "warning")


def test_liveness(spark):
    page = lambda s, closed=False, robot=False: one(spark, lifecycle.page_state(F.lit(s).cast("int"), F.lit(closed), F.lit(robot)))
    assert [page(None), page(404), page(500, True), page(200), page(200, False, True), page(500)] == ["unknown", "dead", "dead", "live", "unknown", "unknown"]
    assert one(spark, lifecycle.released_age(F.lit("soon"), F.expr("timestamp '2024-01-02'"))) is None
    assert one(spark, lifecycle.released_age(F.lit("2024-01-01T12:00:00Z"), F.expr("timestamp '2024-01-02'"))) == 0


def test_localities(spark):
    names = spark.createDataFrame([("1010", "Wien", 16.37, 48.21, 3), ("1020", "Wien", 16.4, 48.22, 1), ("2700", "Wiener Neustadt", 16.2, 47.8, 5), ("4020", "Linz", 14.3, 48.3, 1), ("4600", "Wels", 14.0, 48.2, 1), ("4400", "Steyr", 14.4, 48.0, 1), ("9999", "Nowhere", None, None, 1)], "postal_code string, name string, lon double, lat double, samples int")
    labels = spark.createDataFrame([(x,) for x in ("Vienna", "Südlich von Wien", "Österreich", "Großraum Linz, Wels", "Großraum Linz, Atlantis", "Oberösterreich Zentralraum", "Linz Umgebung", "Nowhere", "Bezirk Linz", None)], "label string")
    got = {r.label: (round(r.lon, 4), list(r.codes)) for r in locality.resolve(labels, names).collect()}
    assert set(got) == {"Vienna", "Südlich von Wien", "Großraum Linz, Wels", "Oberösterreich Zentralraum", "Linz Umgebung"}
    assert got["Vienna"] == (16.3775, ["1010", "1020"]) and got["Großraum Linz, Wels"] == (14.15, ["4020", "4600"])


def test_json_totals_keep_unknown_apart(spark):
    rows = spark.createDataFrame([('{"a":"3"}',), ("{}",), ('{"a":"x"}',)], "p string")
    r = rollups.json_totals(rows, "p", ["a", "b"]).first()
    assert (r.a, r.b) == (3, 0)
    r = rollups.json_totals(rows.filter("p = '{}'"), "p", ["a", "b"]).first()
    assert (r.a, r.b) == (None, None)


def test_journal(spark, tmp_path):
    events = spark.range(1, 30).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "other").otherwise("jobs").alias("topic"), F.when(F.col("id") % 7 == 0, " ").otherwise("changed").alias("kind"))
    assert journal.valid(events).count() == 20
    assert [r.event_id for r in journal.replay(events, -4, 0).collect()] == [1] and journal.replay(events, 10, 900).count() == 19
    assert (journal.start_cursor(None, 9), journal.start_cursor(50, 9), journal.start_cursor(-1, 9)) == (9, 9, 0)
    path = str(tmp_path / "in")
    events.filter("event_id <= 10").write.parquet(path)
    apply = journal.ingest(str(tmp_path / "out"), lambda b: b, ["topic"], ["event_id"])
    for _ in range(2):  # the second run has nothing new
        journal.run_once(journal.follow(spark, path, events.schema), str(tmp_path / "cursor"), apply)
    assert {(r.topic, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("jobs", 9), ("other", 10)}
    events.filter("event_id > 10").write.mode("append").parquet(path)
    journal.run_once(journal.follow(spark, path, events.schema), str(tmp_path / "cursor"), apply)
    assert spark.read.parquet(str(tmp_path / "out")).filter("event_id > 10").count() == 2


def test_job_feeds(spark):
    def rows(parse, payload, **more):
        data = spark.range(1).select(F.lit(payload).alias("payload"), *(F.lit(v).alias(k) for k, v in more.items()))
        return parse(data).collect()

    lever = '[{"id":"1","text":"A","hostedUrl":"https://x/1","country":"AT","categories":{"location":"Linz","allLocations":["Linz","Wien","Linz"]},"salaryRange":{"min":50000,"max":60000,"currency":"EUR","interval":"per-year-salary"}},{"id":"2","text":"B","hostedUrl":"https://x/2","country":"DE","categories":{"location":"Berlin"}},{"text":"C","country":"AT"}]'
    got = rows(jobs.lever, lever, company="c")
    assert [(r.listing_key, r.period, [p.city for p in r.locations]) for r in got] == [("1", "year", ["Linz", "Wien"])]
    green = '{"jobs":[{"id":5,"title":"T","absolute_url":"https://g/5","content":"x","location":{"name":"Vienna, Austria"},"pay_input_ranges":[{"min_cents":5000000,"max_cents":6000000,"currency_type":"EUR","title":"Austria annual salary"},{"min_cents":1,"max_cents":2,"currency_type":"EUR","title":"Germany"}]}]}'
    assert [(r.salary_min, r.salary_max, r.period) for r in rows(jobs.greenhouse, green, company="c")] == [(50000, 60000, "year")]
    smart = '{"content":[{"id":"9","name":"N","ref":"https://s/9","jobAdId":"77","company":{"identifier":"k","name":"K"},"location":{"country":"at","city":"Graz","postalCode":"8010"}}]}'
    assert [(r.identity, r.locations[0].postal_code) for r in rows(jobs.smartrecruiters, smart)] == [("smartrecruiters:k:jobad:77", "8010")]
    work = '{"jobPostingInfo":{"title":"W","location":"2 Locations","additionalLocations":["Wien","Linz","Wien"],"externalUrl":"https://w/job/X_R-12","jobDescription":"d"}}'
    assert [(r.listing_key, [p.city for p in r.locations]) for r in rows(jobs.workday, work, company="c", tenant="t", site="s")] == [("R-12", ["Wien", "Linz"])]
    adz = '{"results":[{"id":"1","title":"A","redirect_url":"https://a/1","location":{"display_name":"Wien"},"salary_min":1000,"salary_is_predicted":"1"},{"id":"2","title":"B","redirect_url":"https://a/2"}]}'
    assert [(r.provenance, r.confidence, r.period) for r in rows(jobs.adzuna, adz)] == [("ESTIMATED", 0.5, None), (None, None, None)]
    joo = '{"jobs":[{"id":"1","title":"A","link":"https://j/1","location":"4020 Linz","snippet":"s","salary":"3.000 EUR"}]}'
    assert [(r.locations[0].city, r.locations[0].postal_code) for r in rows(jobs.jooble, joo)] == [("Linz", "4020")]
    feed = "<w><position><id>3</id><name>Dev</name><office>Wien, Graz</office><jobDescriptions><jobDescription><value>Hallo</value></jobDescription></jobDescriptions></position></w>"
    assert [(r.url, [p.city for p in r.locations], r.description) for r in rows(lambda raw: jobs.personio(raw, spark.createDataFrame([("Wien",), ("Graz",)], "name string")), feed, tenant="t", company="c", base_url="https://p", language="de")] == [("https://p/job/3?language=de", ["graz", "wien"], "Hallo")]
    assert rows(jobs.lever, "broken", company="c") == []
    page = '<a href="/job/engineer-77?x"><h2>Engineer</h2><p>Acme</p><p>Linz</p></a><a href="/x">more</a>'
    assert [(r.listing_key, r.title, r.company, r.url) for r in rows(lambda d: jobs.cards(d, "https://c"), page)] == [("engineer-77", "Engineer", "Acme", "https://c/job/engineer-77?x")]


def test_json_ld(spark):
    page = '<script type="application/ld+json">{"@graph":[{"x":[{"@type":"JobPosting","title":"A &amp; B","hiringOrganization":{"name":"K"},"jobLocation":{"address":{"addressLocality":"Linz","postalCode":"4020"}},"baseSalary":{"currency":"EUR","value":{"minValue":"3000","unitText":"MONTH"}}}]}]}</script>'
    rows = spark.createDataFrame([(page,), (None,), ('<script type="application/ld+json">{bad</script>',)], "h string").select(jobs.json_ld_posting("h").alias("p")).select("p.*").collect()
    assert (rows[0].title, rows[0].company, rows[0].period, rows[0].salary_min, rows[0].locations[0].postal_code) == ("A & B", "K", "month", 3000.0, "4020")
    assert rows[1].title is None and rows[2].title is None


def test_home_feeds(spark, tmp_path):
    item = "<immobilie><objektkategorie><vermarktungsart KAUF='{k}'/><objektart><{a}/></objektart></objektkategorie><geo><plz>4020</plz><ort>Linz</ort></geo><preise><kaufpreis>250.000,50</kaufpreis></preise><flaechen><wohnflaeche>120.5</wohnflaeche></flaechen><verwaltung_techn><objektnr_intern>{n}</objektnr_intern></verwaltung_techn></immobilie>"
    xml = "<o:openimmo xmlns:o='u'><uebertragung umfang='VOLL'/><anbieter>" + item.format(k="ja", a="haus", n=1) + item.format(k="false", a="haus", n=2) + item.format(k="1", a="wohnung", n=3) + "</anbieter></o:openimmo>"
    rows = homes.openimmo(spark.createDataFrame([(xml,), ("broken",)], "payload string")).collect()
    assert [(r.full, r.listing_key, r.title, r.price, r.living) for r in rows] == [(True, "1", "Haus 1", Decimal("250000.50"), Decimal("120.50"))]
    html = "<h3>Helles Haus A</h3><a href='x'>no</a><a href=\"https://m/1\">Helles Haus A</a><p>€ 199.000 4020 Linz / 101 m²</p><h3>Helles Haus B</h3><p>€ 1.000 € 299.000 4600 Wels / 1.200,5 m²</p>"
    got = {r.title: r for r in homes.search_cards(spark.createDataFrame([(1, html.replace("<a href='x'>no</a>", ""))], "page int, payload string")).collect()}
    assert (got["Helles Haus A"].listing_key, got["Helles Haus A"].price, got["Helles Haus A"].city, got["Helles Haus A"].identity_stable) == ("https://m/1", 199000, "Linz", True)
    assert (got["Helles Haus B"].price, got["Helles Haus B"].area, got["Helles Haus B"].identity_stable, len(got["Helles Haus B"].listing_key)) == (299000, Decimal("1200.50"), False, 32)
    names = '{"data":[{"plz":"1010","ort":"Wien","adressierbar":"Ja"},{"plz":"1010","ort":"Wien 1","adressierbar":"ja"},{"plz":"99","ort":"X","adressierbar":"nein"}]}'
    assert [tuple(r) for r in homes.postal_names(spark.createDataFrame([(names,)], "payload string")).collect()] == [("1010", "Wien 1")]
    path = tmp_path / "a.csv"
    path.write_text("PLZ;RW;HW;EPSG\n1010;2000,5;340000;31256\n1020;#;1;31256\n", encoding="utf-8-sig")
    rows = homes.address_register(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("postal_code").collect()] == [("1010", 2000.5, 340000.0, 31256), ("1020", None, 1.0, 31256)]
    path.write_text("PLZ;RW;HW\n1;2;3\n")
    with pytest.raises(ValueError):
        homes.address_register(spark, str(path))


@pytest.mark.parametrize("few", [0, 3, None])
def test_components(spark, few):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (101, 100)], "a long, b long")
    got = {r.v: r.root for r in components(edges, few).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(edges.filter("false"), few).count() == 0


def test_salaries_in_sentences():
    told = lambda t: (lambda r: r and (float(r[0]), r[1] and float(r[1]), r[3], r[4], r[5]))(salary.parse(t))
    assert told("Gehalt 2.500 Euro, dazu ein Monatsticket.") is None
    assert told("Bezahlung 45.000 EUR. 25 Tage Jahresurlaub.") is None
    assert told("Monatsgehalt von 2.500 EUR bis 3.500 EUR, 14 Gehälter") == (2500, 3500, "month", 14, False)
    assert told("Entgelt: € 60.000 bis € 50.000 pro Jahr") == (50000, 60000, "year", None, False)
    assert told("Entgelt: EUR 2.000 bis EUR 900.000 monatlich, mindestens") == (2000, None, "month", None, True)
    assert told("brutto 40 Std./Woche 2.000 EUR") is None
    assert told("annual salary from EUR 55,000.00") == (55000, None, "year", None, True)


def test_salary_texts_without_an_amount_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([("Gehalt 2.500 € monatlich",), ("€3.000 pro Monat Lohn",), ("Gehalt nach Vereinbarung",), (None,), ("Europa 2030",)], "t string")
    got = [r.m and float(r.m) for r in rows.select(salary.salary_of(F.col("t"))["minimum"].alias("m")).collect()]
    assert got == [2500, 3000, None, None, None]


def test_grid_points(spark):
    # St. Stephen's cathedral in Vienna: 16.3731 E, 48.2085 N is about 2,960 m east and 341,000 m north of the zone's origin (EPSG 31256).
    row = geo.grid_to_wgs84(spark.createDataFrame([(2956.0, 340_870.0, 31256)], "e double, n double, epsg int"), "e", "n", "epsg").first()
    assert abs(row.lon - 16.3731) < 0.01 and abs(row.lat - 48.2085) < 0.01


def test_labels_that_are_no_point(spark):
    labels = ["Kaernten", "Südösterreich", "austria wide", "Großraum Linz", "", "Linz", "Großraum Linz, Wels"]
    rows = spark.createDataFrame(list(enumerate(labels)), "i int, x string").select("i", locality.components_of(F.col("x")).alias("c"), locality.is_scope(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.c for r in rows] == [None, None, None, None, None, ["linz"], ["linz", "wels"]]
    assert [r.s for r in rows] == [True, True, True, False, False, False, False]


def test_runs_are_due_to_the_microsecond(spark):
    """An interval that lacks a part of a second hasn't passed."""
    at = lambda x: F.expr(f"timestamp_ntz '{x}'")
    now, none = F.expr("timestamp '2024-01-31'"), F.lit(None).cast("timestamp_ntz")

    def kind(rec, attempt):
        return one(spark, lifecycle.run_kind(now, interval_hours=F.lit(48), poll_minutes=F.lit(360), last_attempt=attempt, last_reconciliation=rec, last_incremental=none))

    assert kind(at("2024-01-29 00:00:00.000001"), none) == "incremental"
    assert kind(at("2024-01-29"), none) == "reconciliation"
    assert kind(at("2024-01-29"), at("2024-01-30 21:00:00.5")) == "incremental"
    assert one(spark, lifecycle.released_age(F.lit("2024-01-30 00:00:00.5"), now)) == 0


def test_shown_rows_are_never_broadcast(spark):
    """Rows shown to cells are several times what Spark estimates them at; a broadcast of them goes through the driver."""
    spots = spark.range(50).select(F.col("id").alias("home_id"), (F.lit(14.0) + F.col("id") / 10).alias("lon"), F.lit(48.0).alias("lat"))
    jobs = spots.select(F.col("home_id").alias("location_id"), F.col("lon").alias("job_lon"), F.col("lat").alias("job_lat"))
    centres = spots.select(F.col("lon").alias("centre_lon"), F.col("lat").alias("centre_lat"), F.lit(5.0).alias("radius_km"))
    for pairs in (radius.radius_join(spots, jobs, 25), radius.radius_join(spots, jobs, 25, shown_side="left"), radius.within_each(spots, centres)):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()



def test_road_nearest_is_road_ranked_of_all_pairs(spark):
    """Inner circles settle the jobs that they can, the others go on; the quickest way may be far away."""
    k = F.col("id")
    spots = spark.range(300).select(k.alias("home_id"), (14 + (k * 37 % 101) / 200).alias("lon"), (48 + (k * 53 % 97) / 300).alias("lat"))
    jobs = spark.range(60).select(k.alias("location_id"), (k % 12).alias("job_id"), (14 + (k * 29 % 103) / F.when(k % 12 > 9, 20).otherwise(200)).alias("job_lon"), (48 + (k * 31 % 89) / 300).alias("job_lat"))
    estimated = lambda pairs: pairs.withColumns({"road_km": F.col("km") * 1.3, "minutes": F.when((F.col("home_id") + F.col("location_id")) % 3 > 0, F.round(F.col("km") * (1 + F.col("home_id") % 4), 3))})
    rows = estimated(radius.radius_join(spots, jobs, 25))
    all_pairs = radius.road_ranked(rows.drop("minutes", "road_km"), rows.select("home_id", "location_id", "minutes", "road_km"), 25, 3)
    got = radius.road_nearest(spots, jobs, estimated, 25, 3, minutes_a_km=0.99)
    columns = ["job_id", "rank", "home_id", "location_id", "minutes"]
    want = sorted(map(tuple, all_pairs.select(*columns).collect()))
    assert want and sorted(map(tuple, got.select(*columns).collect())) == want


def test_nearest_location_meets_few_pairs(spark):
    k = F.col("id")
    spots = spark.range(200).select(k.alias("home_id"), (14 + (k * 37 % 101) / 200).alias("lon"), (48 + (k * 53 % 97) / 300).alias("lat")).unionByName(spark.createDataFrame([(900, None, 48.0), (901, 0.0, 0.0)], "home_id long, lon double, lat double"))
    jobs = spark.range(50).select(k.alias("location_id"), (14 + (k / 2).cast("int") * 29 % 103 / 200).alias("job_lon"), (48 + (k / 2).cast("int") * 31 % 89 / 300).alias("job_lat"))
    want = radius.first_of_each(radius.radius_join(spots, jobs, 25), ["home_id"], [F.col("km"), F.col("location_id")])
    got = radius.nearest_location(spots, jobs, 25)
    rows = lambda df: sorted(map(tuple, df.select("home_id", "location_id", "km").collect()))
    assert rows(want) and rows(got) == rows(want)


def test_equal_circles_are_counted_once(spark):
    points = spark.createDataFrame([(14.0, 48.0), (14.01, 48.0), (15.0, 48.0)], "lon double, lat double")
    centres = spark.createDataFrame([(i, 14.0, 48.0, 5) for i in range(6)] + [(8, None, None, 5), (9, 0.0, 0.0, 5), (10, 14.0, 48.0, 0)], "filter_id int, centre_lon double, centre_lat double, radius_km int")
    counted = radius.within_counts(points, centres)
    assert {r.filter_id: r.n for r in counted.collect()} == {**dict.fromkeys(range(6), 2), 8: None, 9: None, 10: None}


def test_company_pages_are_read_after_they_are_dealt(spark):
    """A filter on what a page says isn't evaluated before the rows are dealt over tasks."""
    from brickyard.sources import boards

    raw = spark.range(4).select(F.col("id").cast("string").alias("job_id"), F.lit("<h1>Join us</h1><p>Linz, Austria</p><h3>Tasks</h3><p>Draw</p><h3>Offer</h3>").alias("payload")).repartition(8, "job_id")
    rows = boards.company_pages(raw, site="a", title="join us", starts=("tasks",), stops=("offer",))
    before = rows._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "Filter" not in before and rows.filter("city = 'Linz'").count() == 4


def test_compact_tables_are_dealt_over_tasks(spark):
    from brickyard.plans import QUERIES

    d, least = "/root/testdata/sf0.001", 4 * spark.sparkContext.defaultParallelism
    for name in ("stepstone_cards", "willhaben_cards", "openimmo_homes", "archived_exports"):
        assert QUERIES[name](spark, d).rdd.getNumPartitions() >= least, name


def test_a_key_of_many_stored_rows_meets_each_incoming_row_once(spark):
    stored = spark.range(500).select(F.col("id").alias("listing_id"), (F.col("id") + 1000).alias("entity_id"), F.lit(1).alias("source_id"), F.col("id").alias("listing_key"), F.lit(7).alias("identity"), F.lit("u").alias("url"))
    incoming = spark.range(40).select(F.col("id").alias("row_id"), F.lit(1).alias("source_id"), (F.col("id") + 480).alias("listing_key"), F.lit(7).alias("identity"), F.lit("u").alias("url"))
    found = identity.resolved(incoming, stored)
    assert {(r.row_id, r.entity_id, r.by) for r in found.collect()} == {(i, i + 1480, "listing") if i < 20 else (i, 1000, "identity") for i in range(40)}
    # Each rule gives an incoming row one row at most: no join in the plan meets stored rows that aren't reduced first.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") >= len(identity.JOB_RULES)
