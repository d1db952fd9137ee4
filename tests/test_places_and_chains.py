"""Places that the ladder leaves, offices in free text, chains inside a batch, distances anywhere on earth, and alike titles: against plain loops and traps."""

from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickyard.functions import geo, text
from brickyard.operators import dedupe, fallback, identity, locality, radius, rollups
from brickyard.sources import boards, jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- page text ---


def test_references_are_read_after_tags(spark):
    shown = lambda t: one(spark, text.visible_text(F.lit(t)))
    assert shown("Geh&auml;lter ab&nbsp;3.000 &euro; &#8211; &#x41; brutto") == "Gehälter ab 3.000 € – A brutto"
    assert shown("<p>a &lt;b&gt; c</p>&amp;lt;i&amp;gt;") == "a <b> c <i>"
    assert shown('<a title="1 > 0">x</a> 5 < 6 &unknown; &') == "x 5 < 6 &unknown; &"
    assert shown("a<script>b</script >c<style>d") == "a c"
    assert shown("<!-- <b>x</b> -->y<noscript>z</noscript>") == "y"
    assert shown("") == "" and shown(None) is None
    assert one(spark, boards.text_nodes(F.lit("<p>a&lt;b&gt;</p>&ouml;<br>  x   y"))) == ["a<b>", "ö", "x y"]


def test_code_beside_a_locality_column(spark):
    rows = [("A-4820 Bad  Ischl und 4820 Bad Ischl", "Bad Ischl", "4820"), ("4020 Linz 4030 Linz", "Linz", None), ("4020 Linzer Gasse", "Linz", None), ("A – 6380 St. Johann (Tirol),", "St. Johann (Tirol)", "6380"), ("14820 Linz", "Linz", None), ("4020 Linz", "", None), ("4020 Linz", None, None), (None, "Linz", None), ("4020 Ort\\Ebene", "Ort\\Ebene", "4020")]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, t string, l string").select("i", text.postal_beside(F.col("t"), F.col("l")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c for *_, c in rows]


def test_locality_words_keep_every_letter(spark):
    words = lambda t: one(spark, text.locality_words(F.lit(t)))
    assert words("Železna Kapla – Bad") == "železna kapla bad" and words("Großraum: Linz/Wels_2") == "grossraum linz wels_2" and words(None) == ""


# --- places ---


POSTAL = [
    ("4300", "St. Valentin", 14.5, 48.0, 100), ("2700", "St. Valentinberg", 1.0, 1.0, 1), ("5020", "Salzburg", 13.0, 48.0, 100), ("5023", "Salzburg-Gnigl", 14.0, 48.0, 300), ("1010", "Wien", 16.37, 48.2, 0),
    ("2701", "Wiener Neustadt", 16.2, 47.8, 9), ("6342", "Niederndorf", 12.2, 47.6, None), ("4202", "Kirchschlag", 14.0, 48.4, 1), ("2860", "Kirchschlag in der Buckligen Welt", 16.0, 47.5, 1),
    ("8055", "Graz", 15.4, 47.0, 4), ("5280", "Braunau", 13.0, 48.2, 1), ("5282", "Anderswo", 13.4, 48.6, 3), ("9065", "Nirgends", None, None, 5), ("9135", "Železna Kapla", 14.6, 46.5, 2),
]


def _postal(spark):
    return spark.createDataFrame(POSTAL, "postal_code string, name string, lon double, lat double, samples int")


def test_fallback_resolves_exact_names_only(spark):
    labels = ["St. Valentin", "SANKT Valentin", "Salzburg Stadt", "Wien 3. Bezirk (Landstraße)", "Wien 23.Bezirk", "Niederndorf bei Kufstein", "Kirchschlag bei Linz", "Ranshofen", "Puntigam", "Ebenthal in Kärnten", "Tirol", "Bezirk Perg",
              "Remote Austria", "Sankt Nirgend", "Unort Stadt", "Vienna, Austria", "Železna Kapla", "", None]
    got = {r.label: r for r in fallback.fall_back(spark.createDataFrame([(x,) for x in labels * 2], "label string"), _postal(spark)).collect()}
    assert set(got) == {"St. Valentin", "SANKT Valentin", "Salzburg Stadt", "Wien 3. Bezirk (Landstraße)", "Wien 23.Bezirk", "Niederndorf bei Kufstein", "Ranshofen", "Puntigam", "Vienna, Austria", "Železna Kapla"}
    assert got["SANKT Valentin"].codes == ["4300"] and got["SANKT Valentin"].locality == "st valentin"
    assert got["Salzburg Stadt"].codes == ["5020", "5023"] and got["Salzburg Stadt"].lon == pytest.approx(13.75) and got["Salzburg Stadt"].samples == 400
    assert got["Wien 3. Bezirk (Landstraße)"].codes == ["1010"] and got["Wien 23.Bezirk"].locality == "wien"
    assert got["Ranshofen"].codes == ["5280", "5282"] and got["Ranshofen"].method == fallback.OFFICIAL_METHOD and got["Ranshofen"].lon == pytest.approx(13.3)
    assert got["Puntigam"].method == fallback.VERIFIED_METHOD and got["Puntigam"].source == fallback.VERIFIED_SOURCE
    assert fallback.fall_back(spark.createDataFrame([], "label string"), _postal(spark)).collect() == []


def test_fallback_stands_behind_the_ladder(spark):
    labels = spark.createDataFrame([("Salzburg Umgebung",), ("Großraum Graz, Wien",), ("Salzburg Stadt",), ("Südlich von Wien, Austria",), ("Wels-Land",)], "label string")
    got = {r.label: (r.by, r.codes) for r in fallback.resolve_all(labels, _postal(spark)).collect()}
    assert got == {"Salzburg Umgebung": ("ladder", ["5020", "5023"]), "Großraum Graz, Wien": ("ladder", ["1010", "8055"]), "Salzburg Stadt": ("fallback", ["5020", "5023"]), "Südlich von Wien, Austria": ("ladder", ["1010"])}


def test_filter_centres_ask_codes_first(spark):
    filters = spark.createDataFrame([(1, "8055"), (2, "9065"), (3, " wien "), (4, "Tirol"), (5, ""), (6, None)], "id int, place string")
    got = {r.id: (r.centre_lon, r.unknown) for r in locality.filter_centres(filters, _postal(spark)).collect()}
    assert got == {1: (15.4, False), 2: (None, True), 3: (16.37, False), 4: (None, True), 5: (None, False), 6: (None, False)}


def test_offices_in_free_text(spark):
    names = spark.createDataFrame([(n,) for n in ("Wien", "Linz", "Bad Ischl", "Ischl", "St. Valentin", "Graz", "Österreich", "Ried im Innkreis", "Ried")], "name string")
    offices = {
        "Graz": [("graz", None)], "Austria Center Vienna": [("wien", None)], "Zürich 8005": None, "Berlin": None, "Hohenberg, Österreich": [("Hohenberg", None)], "Linz (Austria) 4020": [("linz", "4020")],
        "Büro Bad Ischl - 4820": [("bad ischl", "4820")], "St. Valentin, Linz 4300": [("linz", None), ("st valentin", None)], "Linzer Straße, Köln": None, "Austria": [(None, None)], "Remote (Österreich) - Villach": [("Villach", None)],
        "Ried im Innkreis / Wien": [("ried im innkreis", None), ("wien", None)], "  ": None, "Linz-Urfahr, Linz": [("linz", None)], "A-4020 Oberndorf, Österreich": [("A- Oberndorf", "4020")],
    }
    got = {r.office: [(p.city, p.postal_code) for p in r.places] for r in jobs.office_places(spark.createDataFrame([(o,) for o in [*offices, *offices, None]], "office string"), names).collect()}
    assert got == {k: v for k, v in offices.items() if v is not None}


def test_personio_languages(spark):
    def feed(*positions):
        return "<w>" + "".join(f"<position><id>{i}</id><name>{n}</name><office>{o}</office><jobDescriptions>{d}</jobDescriptions></position>" for i, n, o, d in positions) + "</w>"

    block = lambda t, h="H": f"<jobDescription><name>{h}</name><value><![CDATA[{t}]]></value></jobDescription>"
    rows = [
        ("t", "Co", None, "en", feed(("1", "E1", "Wien", block("<p>english</p>")), ("2", "E2", "Wien", block("two")), ("3", "E3", "Wien", ""), ("4", "E4", "Berlin", "x"))),
        ("t", "Co", None, "de", feed(("1", "D1", "Wien", block("deu&amp;ouml;tsch")), ("2", "D2", "Wien", ""), ("3", "D3", "Wien", ""), ("5", "", "Wien", ""))),
        ("t", "Co", None, "de", "<broken"), ("u", "Co2", "https://u.example/", "en", feed(("1", "U1", "Wien", ""))),
    ]
    raw = spark.createDataFrame(rows, "tenant string, company string, base_url string, language string, payload string")
    got = {r.listing_key: r for r in jobs.personio(raw.unionByName(raw), spark.createDataFrame([("Wien",)], "name string")).collect()}
    assert set(got) == {"t:1", "t:2", "t:3", "u:1"}
    assert (got["t:1"].title, got["t:1"].description, got["t:1"].extra_texts, got["t:1"].languages, got["t:1"].described) == ("D1", "H\ndeuötsch", ["H\nenglish"], ["de", "en"], ["de", "en"])
    assert (got["t:2"].title, got["t:2"].url, got["t:2"].described) == ("E2", "https://t.jobs.personio.com/job/2?language=en", ["en"])
    assert (got["t:3"].title, got["t:3"].description) == ("D3", None) and got["u:1"].url == "https://u.example/job/1?language=en"


# --- chains ---


def _plain_chains(rows):
    of = {r[0]: r[0] for r in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for key in ((1, 2), (3,)):
        first = {}
        for r in rows:
            k = tuple(r[i] for i in key)
            if None not in k:
                a, b = sorted((root(r[0]), root(first.setdefault(k, r[0]))))
                of[b] = a
    return {r[0]: root(r[0]) for r in rows}


def test_chains_of_any_length(spark):
    rng = random.Random(5)
    chain = [(50 - i, 1, f"i{(i + 1) // 2}", f"u{i // 2}") for i in range(40)]
    rows = chain + [(100 + i, rng.randrange(3), rng.choice([None, *(f"x{j}" for j in range(60))]), rng.choice([None, *(f"y{j}" for j in range(90))])) for i in range(150)] + [(500 + i, 1, None, "hot") for i in range(200)]
    data = spark.createDataFrame(rows, "row_id long, source_id int, identity string, url string")
    got = {r.row_id: r.chain for r in identity.chains(data, identity.BATCH_KEYS).collect()}
    assert got == _plain_chains(rows) and got[50] == 11
    keys = identity.new_keys(data.withColumn("entity_id", F.lit(None).cast("long")))
    assert {r.row_id: r.new_key for r in keys.collect()} == got


def test_a_batch_settles_on_stored_entities(spark):
    rows = [(1, 1, "k1", None, "u1"), (2, 1, "k2", "i", "u1"), (3, 1, "k3", "i", "u2"), (4, 1, "k4", None, "u3"), (5, 1, "k5", None, "u3"), (6, 2, "k6", "i", None)]
    stored = [(9, 77, 1, "k3", None, None)]
    data = spark.createDataFrame(rows, "row_id long, source_id int, listing_key string, identity string, url string")
    old = spark.createDataFrame(stored, "listing_id long, entity_id long, source_id int, listing_key string, identity string, url string")
    got = {r.row_id: (r.entity, r.new_key, r.via) for r in identity.batch_entities(identity.resolved(data, old)).collect()}
    assert got == {1: (77, None, "batch"), 2: (77, None, "batch"), 3: (77, None, "stored"), 4: (None, 4, "new"), 5: (None, 4, "new"), 6: (None, 6, "new")}
    assert identity.batch_entities(identity.resolved(data.limit(0), old)).collect() == []


# --- distances ---


def _km(a, b, c, d):
    r = math.radians
    h = math.sin(r(d - b) / 2) ** 2 + math.cos(r(b)) * math.cos(r(d)) * math.sin(r(c - a) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


AREAS = {"north": ((20, 24), (69.5, 70.5)), "date line": ((178, 182), (-1, 1)), "pole": ((-180, 180), (89, 90)), "south pole": ((-180, 180), (-90, -89.3)), "dense": ((13, 13.4), (47, 47.3))}


@pytest.mark.parametrize("name", AREAS)
def test_distance_joins_lose_no_pair(spark, name):
    rng = random.Random(name)
    lon, lat = AREAS[name]
    point = lambda: ((rng.uniform(*lon) + 180) % 360 - 180, rng.uniform(*lat))
    hot = point()
    homes = [(i, *point()) for i in range(150)] + [(1000 + i, *hot) for i in range(20)] + [(2000, None, 1.0), (2001, float("nan"), 1.0)]
    places = [(i, i % 30, *point()) for i in range(150)] + [(900 + i, 31, *hot) for i in range(5)] + [(990, 32, 1.0, None)]
    h = spark.createDataFrame(homes, "home_id long, lon double, lat double")
    p = spark.createDataFrame(places, "location_id long, job_id long, job_lon double, job_lat double")
    near = {(x[0], y[0]): _km(*x[1:], *y[2:]) for x in homes if x[1] is not None and x[1] == x[1] for y in places if y[3] is not None}
    want = {k for k, km in near.items() if km <= 25}
    for side in ("left", "right"):
        got = [(r.home_id, r.location_id) for r in radius.radius_join(h, p, 25, shown_side=side).collect()]
        assert len(got) == len(want) and set(got) == want
    best = {}
    job = {y[0]: y[1] for y in places}
    for (home, place), km in near.items():
        if km <= 25:
            key = (job[place], home)
            best[key] = min(best.get(key, (1e9,)), (round(km, 9), place))
    ranks = {}
    for (j, home), (km, _) in sorted(best.items(), key=lambda x: (x[0][0], x[1][0], x[0][1])):
        ranks.setdefault(j, []).append(home)
    got = {}
    for r in radius.nearest_homes(h, p, 25, 5).orderBy("job_id", "rank").collect():
        got.setdefault(r.job_id, []).append(r.home_id)
    assert got == {j: v[:5] for j, v in ranks.items()}


@pytest.mark.parametrize("name", AREAS)
def test_counts_within_a_radius_make_no_pairs_of_inner_cells(spark, name, monkeypatch):
    """Equal to a plain loop anywhere, jobs at hand inside, on the edge and unnamed; a cell inside a circle is counted at once."""
    rng = random.Random(name)
    lon, lat = AREAS[name]
    point = lambda: ((rng.uniform(*lon) + 180) % 360 - 180, rng.uniform(*lat))
    hot = point()
    homes = [(i, *point()) for i in range(150)] + [(1000 + i, *hot) for i in range(20)] + [(2000, None, 1.0), (2001, float("nan"), 1.0)]
    places = [(i, i % 30, *point()) for i in range(150)] + [(900 + i, 31, *hot) for i in range(25)] + [(940, None, *hot), (990, 32, 1.0, None)]
    h = spark.createDataFrame(homes, "home_id long, lon double, lat double")
    p = spark.createDataFrame(places, "location_id long, job_id long, job_lon double, job_lat double")
    want = {}
    for i, *a in homes[:-2]:
        near = [(j, km) for _, j, *b in places[:-1] if (km := _km(*a, *b)) <= 25]
        if near:
            want[i] = (len(near), len({j for j, _ in near if j is not None}), round(min(km for _, km in near), 6))
    met, exact = [], radius._near
    monkeypatch.setattr(radius, "_near", lambda *a: met.append(a) or exact(*a))
    monkeypatch.setattr(radius, "radius_join", None)
    for parts in (2, 8):
        got = {r.home_id: (r.n_pairs, r.n_jobs, round(r.km, 6)) for r in radius.radius_counts(h, p, 25, parts).collect()}
        assert got == want
    assert len(met) == 2
    runs = radius._runs(p.filter("location_id between 900 and 924"), "job_lon", "job_lat", 25, 25 / 8).agg(F.sum(F.col("_in_last") - F.col("_in_first") + 1).alias("n"), F.sum(F.col("_last") - F.col("_first") + 1).alias("all")).first()
    # Near a pole a column is no square, so a cell may be crossed there that would lie inside elsewhere.
    assert runs.n > 0 and runs.n <= runs.all


def test_no_side_goes_out_ninefold(spark):
    h = spark.createDataFrame([(i, 13 + i % 50 / 40, 47 + i // 50 / 40) for i in range(2500)], "home_id long, lon double, lat double")
    p = spark.createDataFrame([(i, i, 13 + i / 50, 47.5) for i in range(40)], "location_id long, job_id long, job_lon double, job_lat double")
    plan = radius.radius_join(h, p, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "job_lon" in plan.split("Generate explode")[-1]


def test_circles_of_their_own(spark):
    h = spark.createDataFrame([(i, -179.9 + i / 100, 0.0) for i in range(40)], "home_id long, lon double, lat double")
    c = spark.createDataFrame([(1, 179.95, 0.0, 30.0), (2, -179.9, 0.0, 0.0), (3, None, 0.0, 9.0), (4, -179.6, 0.0, 400.0)], "id int, centre_lon double, centre_lat double, radius_km double")
    got = {}
    for r in radius.within_each(h, c).collect():
        got[r.id] = got.get(r.id, 0) + 1
    assert got == {1: sum(_km(-179.9 + i / 100, 0, 179.95, 0) <= 30 for i in range(40)), 4: 40}


def _on_grid(lon, lat, meridian):
    """Easting and northing of a WGS84 point: back through the shift, then the transverse Mercator series forward."""
    a, f, w = geo.BESSEL_AXIS, geo.BESSEL_FLATTENING, geo.FLATTENING
    e2, w2 = f * (2 - f), w * (2 - w)
    p, q = math.radians(lat), math.radians(lon)
    n = geo.AXIS_M / math.sqrt(1 - w2 * math.sin(p) ** 2)
    point = [n * math.cos(p) * math.cos(q), n * math.cos(p) * math.sin(q), n * (1 - w2) * math.sin(p)]
    dx, dy, dz, *turn, ppm = geo.SHIFT
    rx, ry, rz = (math.radians(x / 3600) for x in turn)
    k = 1 + ppm * 1e-6
    m = np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]) * k
    x, y, z = np.linalg.solve(m, np.array(point) - [dx, dy, dz])
    lam, d = math.atan2(y, x), math.hypot(x, y)
    phi = math.atan2(z, d * (1 - e2))
    for _ in range(20):
        n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        phi = math.atan2(z + e2 * n * math.sin(phi), d)
    n, ep2 = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), e2 / (1 - e2)
    t, c, al = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, (lam - math.radians(meridian)) * math.cos(phi)
    arc = sum(v * math.sin(2 * i * phi) if i else v * phi for i, v in enumerate((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072))) * a
    east = n * (al + (1 - t + c) * al**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * al**5 / 120)
    north = arc + n * math.tan(phi) * (al**2 / 2 + (5 - t + 9 * c + 4 * c * c) * al**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * al**6 / 720)
    return east, north + geo.FALSE_NORTHING


def test_grid_points_come_back(spark):
    points = [(lon, lat, code, *_on_grid(lon, lat, geo.ZONES[code])) for lon, lat, code in ((9.7, 47.2, 31254), (11.4, 47.27, 31254), (13.04, 47.8, 31255), (14.29, 48.3, 31255), (16.37, 48.21, 31256), (15.44, 47.07, 31256))]
    rows = spark.createDataFrame(points, "lon double, lat double, epsg int, e double, n double")
    for r in geo.grid_to_wgs84(rows, "e", "n", "epsg", "x", "y").collect():
        assert abs(r.x - r.lon) < 2e-7 and abs(r.y - r.lat) < 2e-7


# --- titles ---


def test_alike_titles_lose_no_pair(spark):
    rng = random.Random(8)
    words = ["senior", "junior", "engineer", "engineers", "maschinenbau", "linz", "wels", "cad", "projektleiter", "projektleitung", "a", "b2", "konstrukteur", "konstrukteurin"]
    titles = {(c, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for c in ("x", "y") for _ in range(220)}
    for c, t in list(titles)[:120]:
        at = rng.randrange(len(t))
        titles |= {(c, (t[:at] + rng.choice("xyz ") + t[at + 1 :]).strip()), (c, (t[:at] + t[at + 2 :]).strip() or "q")}
    titles |= {("x", "a"), ("x", "b"), ("x", "ab"), ("x", "aaaaaaaaaaaaaaaaaa"), ("x", "aaaaaaaaaaaaaaaa")}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(c, a, b) for c, a in titles for d, b in titles if c == d and a < b and max(ratio(a, b), ratio(b, a)) >= 0.88}
    got = dedupe.similar_titles(spark.createDataFrame(sorted(titles), "company string, title string")).collect()
    assert {(r.company, r.a, r.b) for r in got} == want and len(got) == len(want) > 100
    assert all(r.ab == ratio(r.a, r.b) and r.ba == ratio(r.b, r.a) for r in got)


def test_alike_titles_of_a_hot_company_meet_few(spark):
    rng = random.Random(9)
    titles = [("hot", " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4))) for _ in range(1500)]
    met = []

    def counted(a, b):
        met.append(1)
        return dedupe.title_ratio(a, b)

    rows = dedupe.similar_titles(spark.createDataFrame(titles, "company string, title string"), check=counted)
    assert rows.count() == 0 and len(met) == 2


def test_twins_of_groups(spark):
    long = "Schönes Haus mit Garten und Terrasse"
    rows = [(1, "a", "4020", 1.0, long, 100.0, None), (2, "b", "4020", 1.0, long, 100.5, None), (3, "a", "4021", 1.0, long, 100.0, None), (4, "b", "4021", 1.0, long, 120.0, None), (5, "a", "4022", 1.0, long, 1.0, None), (6, "a", "4022", 1.0, long, 1.0, None),
            *[(10 + i, f"s{i}", "4023", 1.0, long, 1.0, None) for i in range(30)], (50, "a", "4024", 2.0, long, None, 5.0), (51, "b", "4024", 2.0, long, 7.0, 5.0), (51, "c", "4024", 2.0, long, 7.0, 5.0)]
    got = dedupe.twin_homes(spark.createDataFrame(rows, "home_id long, source string, postal_code string, price double, title string, living double, plot double")).collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 2)]


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [3.0] * 9 + [1.0], [float(x) for x in range(101)], [7.0, 7.0, 1.0, 9.0]])
def test_median_by_ranges(spark, values):
    import statistics

    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = rollups.distribution(rows, "x").first()
    assert got.n == len(values) + 1 and got.x_median == (statistics.median(values) if values else None)


def test_many_geodesics_are_those_of_single_pairs(spark):
    """What depends on one point is computed before pairs are made; equal points, poles and the date line included."""
    rng = random.Random(5)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(40)] + [(13.0, 47.0), (13.0, 47.00001), (180.0, 0.0), (-179.99, 0.01), (5.0, 90.0), (5.0, -90.0)]
    a = spark.createDataFrame(points, "x1 double, y1 double")
    b = spark.createDataFrame(points, "x2 double, y2 double")
    of = lambda rows, n: rows.withColumn(f"lon{n}", F.col(f"x{n}")).withColumn(f"b{n}", geo.reduced_latitude(F.col(f"y{n}"))).withColumn(f"cos{n}", F.cos(f"b{n}"))
    rows = geo.with_geodesic_m(of(a, 1).crossJoin(of(b, 2))).withColumn("want", geo.geodesic_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).collect()
    near = [r for r in rows if r.want is not None and r.want < 19_000_000]
    assert len(near) > 1800 and all(abs(r.metres - r.want) < 1e-5 for r in near)
    assert all(r.metres == 0 for r in rows if (r.x1, r.y1) == (r.x2, r.y2))


def test_equal_jobs_are_compared_once(spark):
    """Copies of a job are one class; pairs of jobs come from pairs of classes, in either order of ids."""
    rows = [(i, ("Senior Planer Linz", "Senior Planer in Linz")[i % 2], "Acme GmbH", " ".join(f"w{j}" for j in range(14)), [], ["Linz"], [f"s{i % 4 // 2}"]) for i in range(40)]
    rows += [(50, "Senior Planer Linz", None, None, [], ["Linz"], ["s0"]), (51, "Senior Planer Linz", "", None, [], ["Linz"], ["s0"]), (60, "Koch", "Acme", "", ["4020"], [], [])]
    data = spark.createDataFrame(rows, "job_id long, title string, company string, description string, postal array<string>, cities array<string>, sources array<string>")
    one, members = dedupe.classes(dedupe.prepared(data))
    assert one.count() == 6 and members.count() == 43
    # Classes of Acme meet each other and themselves; so do the one without a company and the one of its own.
    assert dedupe.class_evidence(one).count() == 4 * 4 + 1 + 1
    got = {(r.left_id, r.right_id): r.confidence for r in dedupe.evidence(data).collect()}
    assert set(got) == {(a, b) for a in range(40) for b in range(a + 1, 40)} | {(50, 51)}
    assert got[(50, 51)] == "medium" and got[(0, 4)] == "high"


def test_rows_go_narrow_through_the_shuffle_of_a_radius_join(spark):
    """What is computed of a row, unit vectors too, comes after the shuffle; a shown row is some three copies there."""
    h = spark.createDataFrame([(i, 13 + i % 50 / 40, 47 + i // 50 / 40) for i in range(500)], "home_id long, lon double, lat double")
    p = spark.createDataFrame([(i, 13 + i / 50, 47.5) for i in range(40)], "location_id long, job_lon double, job_lat double")
    pairs = radius.radius_join(h, p, 10, left_adds={"twice": F.col("lon") * 2}, right_adds={"half": F.col("job_lat") / 2})
    assert all((r.twice, r.half) == (r.lon * 2, r.job_lat / 2) for r in pairs.collect())

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    sent = [{n.output().apply(i).name() for i in range(n.output().size())} for n in nodes(geo.with_geodesic_m(_with_points(pairs))._jdf.queryExecution().executedPlan().initialPlan()) if n.nodeName() == "Exchange"]
    assert sorted(sent, key=sorted) == sorted(({"home_id", "lon", "lat", "_band", "_column"}, {"location_id", "job_lon", "job_lat", "_band", "_column"}), key=sorted)
    size = F.lit(10.0 * radius.WIDTH)
    assert radius.shown(h, "lon", "lat", F.lit(10.0), size).count() < 3.2 * h.count()


def _with_points(pairs):
    return pairs.withColumns(geo.geodesic_point(F.col("lon"), F.col("lat"), 1) | geo.geodesic_point(F.col("job_lon"), F.col("job_lat"), 2))


@pytest.mark.parametrize("name", AREAS)
def test_pages_of_shown_rows_lose_no_pair(spark, name, monkeypatch):
    """Pages are bounded, even those of many rows at one point, and whatever their size the pairs are the same."""
    rng = random.Random(name)
    lon, lat = AREAS[name]
    point = lambda: ((rng.uniform(*lon) + 180) % 360 - 180, rng.uniform(*lat))
    hot = point()
    homes = [(i, *point()) for i in range(120)] + [(1000 + i, *hot) for i in range(30)] + [(2000, None, 1.0), (2001, float("nan"), 1.0)]
    places = [(i, *point()) for i in range(120)] + [(900 + i, *hot) for i in range(30)] + [(990, 1.0, None)]
    h = spark.createDataFrame(homes, "home_id long, lon double, lat double")
    p = spark.createDataFrame(places, "location_id long, job_lon double, job_lat double")
    want = {(x[0], y[0]) for x in homes[:-2] for y in places[:-1] if _km(*x[1:], *y[1:]) <= 25}
    monkeypatch.setattr(radius, "PAGE", 7)
    for parts, side in ((1, "left"), (4, "right")):
        monkeypatch.setattr(radius, "PARTS", parts)
        got = [(r.home_id, r.location_id) for r in radius.radius_join(h, p, 25, shown_side=side).collect()]
        assert len(got) == len(want) and set(got) == want
    rows = radius._unit(radius.shown(h.filter("home_id < 2000"), "lon", "lat", F.lit(25.0), F.lit(75.0)), "lon", "lat", "_b")
    sizes = [len(r._rows) for r in radius._pages(rows, "lon", "lat", 6.25).collect()]
    assert sum(sizes) == rows.count() and max(sizes) == 7


def test_short_lines_by_series_are_those_by_sines(spark):
    """On both sides of where series end, down to less than a metre and to equal points."""
    rng = random.Random(8)
    rows = [(x, y, x + rng.choice((-1, 1)) * d * rng.random(), y + d * rng.random()) for d in (1e-6, 1e-4, 1e-2, 0.1, 0.5, 0.57, 0.6, 1.0, 1.2, 3.0) for x, y in [(rng.uniform(9, 17), rng.uniform(46, 49)) for _ in range(30)]] + [(14.0, 48.0, 14.0, 48.0)]
    pairs = _with_points(spark.createDataFrame(rows, "lon double, lat double, job_lon double, job_lat double"))
    got = geo.with_geodesic_m(pairs).withColumn("want", geo.geodesic_m(F.col("lon"), F.col("lat"), F.col("job_lon"), F.col("job_lat"))).collect()
    assert len(got) == len(rows) and all(abs(r.metres - r.want) < 1e-7 for r in got) and got[-1].metres == 0
