"""Roster as a table: the join path equals the IN-list path, whichever join Spark picks, in one scan."""

from __future__ import annotations

import pytest

from tricklens.model import COMPASS_ROSTER
from tricklens.operators.aggregates import person_totals
from tricklens.operators.filters import complete_rounds
from tricklens.operators.roster_join import SALTS, bucketed_roster, bucketed_roster_rounds, roster_mapping
from tricklens.operators.seats import first_seat_only, seat_table
from tricklens.plans.queries import roster_table, rounds
from tricklens.plans.summary import summarize, summarize_table, totals_by_person, totals_by_person_table

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_join_path_equals_in_list_path(spark, threshold):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        r = rounds(spark, SF)
        got = totals_by_person_table(r, roster_table(spark))
        assert _rows(got) == _rows(totals_by_person(r, COMPASS_ROSTER))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold != "-1")
    finally:
        spark.conf.set(key, before)


def test_one_row_summary_through_the_join(spark):
    r = rounds(spark, SF)
    a = summarize(r, COMPASS_ROSTER).first().asDict()
    b = summarize_table(r, roster_table(spark), COMPASS_ROSTER.names).first().asDict()
    assert a == b


def test_rounds_are_scanned_once(spark):
    plan = totals_by_person_table(rounds(spark, SF), roster_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_mapping_drops_repeats_and_rejects_shared_aliases(spark):
    extra = spark.createDataFrame([("nobody", "x"), ("north", "north"), (None, "x")], "alias string, person string")
    mapping = roster_mapping(roster_table(spark).union(extra))
    assert sorted(m.alias for m in mapping.collect()) == ["east", "n", "nobody", "north", "south", "west"]
    clash = spark.createDataFrame([("north", "someone else")], "alias string, person string")
    with pytest.raises(ValueError):
        roster_mapping(roster_table(spark).union(clash))


def test_one_bucketed_join_serves_all_seats(spark, tmp_path):
    """The same rows as four joins; the roster is not shuffled, and a hot player's rounds meet it in several tasks."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        r = complete_rounds(rounds(spark, SF))
        roster = bucketed_roster(roster_table(spark), "bucketed_test", str(tmp_path / "roster"), 8)
        kept = bucketed_roster_rounds(r, roster)
        got = person_totals(first_seat_only(seat_table(kept, None)))
        assert _rows(got) == _rows(totals_by_person_table(rounds(spark, SF), roster_table(spark)))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 1 and plan.count("Exchange") == 2 and plan.count("Scan parquet spark_catalog") == 1
        assert roster.where("alias = 'north'").count() == SALTS
        assert bucketed_roster_rounds(r.limit(0), roster).count() == 0
    finally:
        spark.conf.set(key, before)
        spark.sql("DROP TABLE IF EXISTS bucketed_test")
