"""Every registered query of the timed-text operators equals its SQL."""

import pytest

from tests.oracle import rows_of_query, rows_of_sql
from timedtext.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


#: Held against plain versions in other tests, as SQL cannot say them briefly.
WITHOUT_SQL = {"split_cues", "balance_events", "build_aliases", "caption_sync"}


def test_all_others_have_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    got = rows_of_query(QUERIES[name](spark, DATA))
    assert got == rows_of_sql(ORACLE_SQL[name], DATA)


def test_entry_needs_no_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


def test_joins_have_no_nested_loops(spark, capsys):
    for name in ("overlap_pairs", "nearest_cue", "align_tracks", "timeline_score", "overlapping_regions", "attach_dialogue"):
        QUERIES[name](spark, DATA).explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["token_overlap", "repeats_previous"])
def test_tokens_are_found_once_before_the_window(spark, capsys, name):
    QUERIES[name](spark, DATA).explain()
    above = capsys.readouterr().out.split("Window")[0]
    assert "regexp_extract_all" not in above


@pytest.mark.parametrize("name,step", [("term_weights", "Window"), ("group_cues", "Join"), ("merge_cues", "Join")])
def test_plans_without_the_costly_step(spark, capsys, name, step):
    QUERIES[name](spark, DATA).explain()
    assert step not in capsys.readouterr().out
