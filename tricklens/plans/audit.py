"""The summary with an account of the lines that were not used, in one scan and one job.

Lines that are no round record (cut off, no JSON, no object, a value of a wrong
type) are kept by the reader in a column of their own and travel beside the
rounds. The one job writes them to a side folder; the summary's sums and the
number of lines of each kind are observed on the way, so nothing is read twice
and no row is shuffled. The job's result stage observes each task once, so lost
executors and repeated tasks count nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricklens.functions.tokens import sql_string
from tricklens.model import METRICS, SEATS, TOTAL_ROUNDS, Roster, Rules, player_col, summary_columns
from tricklens.operators.filters import all_in_sql, sum_equals_sql
from tricklens.operators.seats import seat_table
from tricklens.sources.rounds import BAD_LINE

KINDS = ("truncated", "malformed", "not_an_object", "wrong_type")


def kind_of(line: str) -> str:
    """SQL: what is wrong with a line that is no round record (null for none)."""
    shape = f"schema_of_variant(try_parse_json({line}))"
    return (
        f"CASE WHEN {line} IS NULL THEN NULL WHEN {shape} LIKE 'OBJECT%' THEN 'wrong_type' WHEN {shape} IS NOT NULL THEN 'not_an_object' "
        f"WHEN ltrim({line}) LIKE '{{%' AND rtrim({line}) NOT LIKE '%}}' THEN 'truncated' ELSE 'malformed' END"
    )


def summarize_with_account(
    rounds: DataFrame, roster: Roster, side_folder: str, rules: Rules = Rules(), column_order: Sequence[str] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """(the one-row summary, records and bad lines by kind); the bad lines are written to ``side_folder`` as JSON lines.

    ``rounds`` are read with ``bad_lines=True``. Runs at once. A line of a
    wrong type still counts as a round where the other fields say so, as ever.
    """
    complete = sum_equals_sql(["team_1_score", "team_2_score"], rules.tricks_per_round)
    seated = all_in_sql([player_col(s) for s in SEATS], roster.aliases)
    marked = rounds.selectExpr("*", f"coalesce({complete} AND {seated}, false) AS _kept", f"{kind_of(BAD_LINE)} AS _kind")
    read = Observation("records")
    marked = marked.observe(read, F.expr("count(1) AS records"))
    carry = (BAD_LINE, "_kept", "_kind")
    seats = seat_table(marked.where("_kept OR _kind IS NOT NULL"), roster, rules, carry=carry)
    cells = [f"coalesce(count_if(_kept AND seat = 1), 0) AS {TOTAL_ROUNDS}"]
    for metric in METRICS:
        for person in roster.names:
            cells.append(f"sum(CASE WHEN _kept AND is_first_seat AND person = {sql_string(person)} THEN {metric} END) AS `{person}_{metric}`")
    bad = [f"coalesce(count_if(seat = 1 AND _kind = '{k}'), 0) AS _{k}" for k in KINDS]
    sums = Observation("sums")
    # Read before the filter, so that every seat row passes it; after it only bad lines are left to write.
    observed = seats.observe(sums, *[F.expr(c) for c in (*cells, *bad)])
    observed.where("seat = 1 AND _kind IS NOT NULL").selectExpr("_kind AS kind", "round_id", f"{BAD_LINE} AS line").write.mode("overwrite").json(side_folder)
    got = sums.get
    columns = summary_columns(roster, column_order)
    schema = T.StructType([T.StructField(c, T.LongType(), True) for c in columns])
    summary = rounds.sparkSession.createDataFrame([tuple(got[c] for c in columns)], schema)
    return summary, {"records": read.get["records"], **{k: got[f"_{k}"] for k in KINDS}}
