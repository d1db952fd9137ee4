"""The numbered journal, last sightings with expiry, members of archives, and kept tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from io import BytesIO
from pathlib import Path
from zipfile import ZipFile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard import checkpoints
from brickyard.sources import archives, homes
from brickyard.streaming import journal, lastseen

EVENT = "topic string, kind string, at int"
STORED = T.StructType([T.StructField("topic", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("event_id", T.LongType())])


def _ids(spark, path):
    return [(r.event_id, r.at) for r in journal.stored(spark, path, STORED).orderBy("event_id").collect()]


def test_journal_numbers_have_no_gaps(spark, tmp_path):
    path = str(tmp_path / "journal")
    apply = journal.append(path, [F.col("at")])
    batch = lambda *at: spark.createDataFrame([("jobs" if a % 5 else "?", "k", a) for a in at], EVENT)
    assert _ids(spark, path) == [] and journal.high_water(spark, path) == 0
    apply(batch(9, 3, 7, 5), 0)
    apply(batch(5, 10), 1)  # nothing valid
    apply(batch(1, 2), 2)
    want = [(1, 3), (2, 7), (3, 9), (4, 1), (5, 2)]
    assert _ids(spark, path) == want and journal.high_water(spark, path) == 5
    apply(batch(9, 3, 7, 5), 0)  # a repeated batch
    assert _ids(spark, path) == want
    ranges = {r.batch: (r.first_id, r.last_id, r.n) for r in journal.commits(spark, path).collect()}
    assert ranges == {0: (1, 3, 3), 1: (4, 3, 0), 2: (4, 5, 2)}


def test_a_lost_batch_is_replaced(spark, tmp_path):
    path = str(tmp_path / "journal")
    apply = journal.append(path, [F.col("at")])
    rows = lambda *at: spark.createDataFrame([("jobs", "k", a) for a in at], EVENT)
    apply(rows(1, 2), 0)
    # Rows of a batch that died before its commit are neither seen nor counted.
    rows(100, 101, 102).withColumn("event_id", F.lit(3).cast("long")).write.parquet(f"{path}/rows/batch=1")
    assert _ids(spark, path) == [(1, 1), (2, 2)]
    apply(rows(8, 6), 1)
    assert _ids(spark, path) == [(1, 1), (2, 2), (3, 6), (4, 8)]


def test_following_a_journal_is_bounded(spark, tmp_path):
    path = str(tmp_path / "journal")
    journal.append(path, [F.col("at")])(spark.createDataFrame([("jobs", "k", a) for a in range(7)], EVENT), 0)
    looks = list(journal.polled(spark, path, STORED, 1, limit=4, wait=0, rounds=4))
    assert [[r.event_id for r in x] for x in looks] == [[2, 3, 4, 5], [6, 7]]
    assert list(journal.polled(spark, path, STORED, None, wait=0, rounds=2)) == []


def test_last_seen_expires_and_comes_back(spark, tmp_path):
    raw, out, cursor = (str(tmp_path / x) for x in ("raw", "out", "cursor"))
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, lastseen.STORE)
    try:
        def take(*rows):
            data = spark.createDataFrame(list(rows), "who string, ts timestamp")
            data.coalesce(1).write.mode("append").parquet(raw)
            stream = spark.readStream.schema(data.schema).parquet(raw)
            journal.run_once(lastseen.last_seen(stream, entity="who", delay="1 day", expiry_days=5), cursor, lastseen.into(out), mode="update")
            return {r.entity: (r.status, r.first_seen_at.day, r.last_seen_at.day, r.n) for r in lastseen.current(spark.read.parquet(out)).collect()}

        assert take(("a", day(0)), ("b", day(1)), ("a", day(2)), (None, day(2)), ("c", None)) == {"a": ("ACTIVE", 1, 3, 2), "b": ("ACTIVE", 2, 2, 1)}
        # The watermark is at 6.5 days: b is due at 6, a at 7.
        assert take(("c", day(7.5))) == {"a": ("ACTIVE", 1, 3, 2), "b": ("INACTIVE", 2, 2, 1), "c": ("ACTIVE", 8, 8, 1)}
        assert take(("b", day(9)), ("c", day(8.5))) == {"a": ("INACTIVE", 1, 3, 2), "b": ("ACTIVE", 2, 10, 2), "c": ("ACTIVE", 8, 9, 2)}
    finally:
        spark.conf.set(key, before)


def _zip(**members):
    box = BytesIO()
    with ZipFile(box, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return box.getvalue()


TABLE = "﻿ADRCD;PLZ;RW;HW;EPSG\r\n1;4020;1,5;2.5;31254\r\n2; 4020 ;#;2;31254\r\n"


def _files(spark, *contents):
    return spark.createDataFrame([(f"f{i}.zip", c) for i, c in enumerate(contents)], "path string, content binary")


def test_registers_in_archives(spark):
    flat = _zip(data__Adresse_DOT_CSV=TABLE, other_DOT_csv="x")
    nested = _zip(readme_DOT_txt="x", snapshot_DOT_zip=flat)
    got = homes.archived_register(_files(spark, flat, nested, TABLE.encode(), None)).collect()
    assert sorted((r.postal_code, r.easting, r.northing, r.epsg) for r in got if r.easting) == [("4020", 1.5, 2.5, 31254)] * 3 and len(got) == 6
    for bad, why in ((_zip(a_DOT_csv="x"), "0 members"), (_zip(a__adresse_DOT_csv=TABLE, b__ADRESSE_DOT_csv=TABLE), "2 members"), (_zip(adresse_DOT_csv="PLZ;RW\n1;2\n"), "lacks HW, EPSG"), (b"PKxx", "no valid archive")):
        with pytest.raises(PythonException, match=why):
            homes.archived_register(_files(spark, bad)).collect()


def test_exports_in_archives(spark, tmp_path):
    xml = '<openimmo><uebertragung umfang="VOLL"/><immobilie><vermarktungsart KAUF="1"/><objektart><haus/></objektart><objektnr_extern>7</objektnr_extern><objekttitel>T&#228;</objekttitel></immobilie></openimmo>'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(_zip(z_DOT_xml="<x/>", long_openimmo_DOT_XML=xml))
    (tmp_path / "in" / "b.xml").write_bytes(xml.encode())
    got = homes.archived_homes(archives.archives(spark, str(tmp_path / "in"))).collect()
    assert [(r.listing_key, r.title, r.full) for r in got] == [("7", "Tä", True)] * 2
    with pytest.raises(PythonException, match="no .xml member"):
        homes.archived_homes(_files(spark, _zip(a_DOT_txt="x"))).collect()


def test_kept_tables_can_be_removed(spark):
    with checkpoints.scope(spark):
        inside = checkpoints.kept(spark.range(5))
        assert inside.count() == 5
        folder = Path(inside._kept_in.removeprefix("file:"))
        assert folder.exists()
    assert not folder.exists()
    other = checkpoints.kept(spark.range(3))
    folder = Path(other._kept_in.removeprefix("file:"))
    checkpoints.released(other)
    checkpoints.released(spark.range(3))
    assert not folder.exists()
