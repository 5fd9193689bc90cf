"""Generated methods stay under the JIT's limit in a session with default settings."""

from __future__ import annotations

import os

import pytest

from tricklens.model import COMPASS_ROSTER, Roster, Rules
from tricklens.plans.queries import registry, roster_table, rounds
from tricklens.plans.summary import summarize, totals_by_person, totals_by_person_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
JIT_LIMIT = 8000  # bytes of one method; HotSpot never compiles longer ones


def largest_method(df) -> int:
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max((stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())), default=0)


@pytest.fixture()
def plain_plans(spark):
    """Without adaptive execution the whole plan, with its generated code, is there before it runs."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_the_session_sets_no_codegen_limit(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"


def test_summary_methods_are_compiled(spark, plain_plans):
    made = rounds(spark, SF)
    many = Roster.of({f"p{i}": [f"p{i}", f"other{i}", f"third{i}"] for i in range(60)})
    plans = {
        "summary": summarize(made, COMPASS_ROSTER),
        "strict": totals_by_person(made, COMPASS_ROSTER, Rules(strict=True)),
        "a roster of 180 aliases": totals_by_person(made, many),
        "a roster table": totals_by_person_table(made, roster_table(spark)),
    }
    sizes = {name: largest_method(df) for name, df in plans.items()}
    assert 0 < min(sizes.values()) and max(sizes.values()) < JIT_LIMIT, sizes


@pytest.mark.parametrize("name", [n for n in registry() if not n.startswith("summary_") and n != "rounds_source"])
def test_query_methods_are_compiled(spark, plain_plans, name):
    assert largest_method(registry()[name](spark, SF)) < JIT_LIMIT
