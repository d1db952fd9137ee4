"""Queries over whole tables: no id is left out before the work begins."""

from __future__ import annotations

import pytest

from brickyard import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: plans.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def keys(spark):
    return lambda name, column: {r[0] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(column).collect()}


def test_merge_groups_span_the_table(rows, keys):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    customers = keys("customer", "c_custkey")
    for c in customers:
        if c % 7 < 3 and c // 7 % 50 < 49:
            a, b = sorted((find(c), find(c + 7)))
            root[b] = a
    got = {r.job_id: r.group_id for r in rows("merge_groups")}
    assert got == {x: find(x) for x in root} and max(got) > max(customers) - 7


def test_every_line_keeps_its_place(rows, keys):
    codes = {r.location_id for r in rows("propagated_codes")}
    assert {x // 10 for x in codes} == keys("lineitem", "l_orderkey")
    assert {r.location_id // 10 % 5 for r in rows("pruned_country_codes")} == set(range(5))


def test_pairs_come_from_all_ids(rows):
    twins, on = rows("twin_homes"), rows("continued_listings")
    assert {r.left_id // 10 % 3 for r in twins} == {0, 1, 2}
    assert on and all(r.prev_token // 10 % 2 == 1 and r.cur_token // 10 % 2 == 0 for r in on)
    assert len({r.prev_token // 10 % 40 for r in on}) > 2 and len({r.strategy for r in on}) == 2


def test_every_job_is_ranked(rows):
    assert max(r.job_id for r in rows("road_refined_topk")) >= 20


def test_all_jobs_have_a_position(rows, keys):
    for name in ("job_salary_sort", "live_fit_order"):
        got = rows(name)
        assert sorted(r.position for r in got) == list(range(1, len(got) + 1))
        assert {r.job_id for r in got} == keys("part", "p_partkey")


def test_positions_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from brickyard.operators import catalog

    # 1999 of 2000 rows share their first key.
    table = spark.range(2000, numPartitions=7).withColumn("k", (F.col("id") == 1234).cast("int"))
    got = {r.id: r.position for r in catalog.positions(table, [F.col("k").desc(), F.col("id").desc()]).collect()}
    want = sorted(range(2000), key=lambda i: (i != 1234, -i))
    assert got == {x: n for n, x in enumerate(want, 1)}
    assert catalog.positions(table.filter("false"), [F.col("id")]).count() == 0
