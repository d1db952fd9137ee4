"""Plans that would hold at a thousand times the data: no nested loops, narrow scans, filters at the scan, partial aggregates."""

from __future__ import annotations

import pytest

from brickyard import plans

SF = "/root/testdata/sf0.001"
NAMES = (
    "nearest_location_topk", "radius_join_counts", "jobs_near_home", "usable_area_filter", "visible_homes", "curation_views", "eligible_jobs", "display_areas", "locality_ladder", "concept_evidence", "fit_scores",
    "duplicate_pairs", "duplicate_pairs_fuzzy", "twin_homes", "resolved_identities", "new_entity_keys", "continued_listings", "second_previous_ok", "missing_listings", "orphaned_homes", "tenant_prefixes",
    "source_contributions", "merge_survivors", "salary_texts", "promotable_runs", "synced_shards", "all_localities", "batch_entities", "place_filters", "source_stats", "location_coverage",
)


@pytest.fixture(scope="module")
def texts(spark):
    return {n: plans.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in NAMES}


def test_no_nested_loops(texts):
    assert not [n for n, t in texts.items() if "CartesianProduct" in t or "BroadcastNestedLoopJoin" in t]


def test_scans_are_narrow(texts):
    text = texts["source_contributions"]
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>" in text
    assert "EqualTo(l_returnflag,R)" in text and "partial_count" in text


def test_ranks_are_cut_before_the_shuffle(texts):
    assert "WindowGroupLimit" in texts["merge_survivors"]


def test_python_runs_only_where_it_must(texts):
    users = {n for n, t in texts.items() if any(k in t for k in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow"))}
    assert users == {"salary_texts", "duplicate_pairs", "duplicate_pairs_fuzzy"}
