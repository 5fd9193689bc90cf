"""Registered queries over the driver's tables: the round summary and its building blocks.

Card rounds are derived from ``orders`` (see ``sources.derived``); the
general forms run the same operators over other tables with other
parameters. Each query takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole input.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricklens.functions.hand import trump_picker
from tricklens.functions.tokens import first_match, token_groups_over, weighted_tokens
from tricklens.model import COMPASS_ROSTER, METRICS, Rules, summary_columns
from tricklens.operators.aggregates import career_summary, person_partials, person_totals, sum_all_with_count, wide_totals
from tricklens.operators.attribution import attribution
from tricklens.operators.filters import all_in, complete_rounds, sum_equals
from tricklens.operators.roster_join import bucketed_roster, bucketed_roster_rounds
from tricklens.operators.seats import first_seat_only, round_errors, seat_table
from tricklens.operators.tally import token_totals
from tricklens.plans.audit import KINDS as BAD_KINDS
from tricklens.plans.increments import updated_totals
from tricklens.plans.job import main as job_main
from tricklens.plans.job import read_manifest
from tricklens.plans.job import run as run_job
from tricklens.plans.job import write_summary
from tricklens.plans.results import put
from tricklens.plans.summary import kept_rounds, roster_seats, totals_by_person_table
from tricklens.sources.derived import derive_rounds
from tricklens.sources.rounds import inferred_types, read_rounds, write_rounds
from tricklens.sources.scratch import fresh_path
from tricklens.sources.tables import table
from tricklens.streaming.summary_stream import ANY_AGE, start_summary_query

ROSTER = COMPASS_ROSTER
RULES = Rules()

# Fixed parameters of the general-form queries (the oracle SQL uses the same).
WORDS = ("the", "and", "de", "la", "der", "und", "el", "qui")
PUNCTUATION_WEIGHTS = {".": 1, ",": 2, "?": 3, "!": 4}
WORD_GROUPS = (("the", "The"), ("and", "And"), ("de", "De"), ("la", "La"), ("en", "En"))
WORD_GROUPS_OVER = 5
EVENT_TYPES_KEPT = ("purchase", "signup")
EVENT_TYPES_WIDE = ("signup", "purchase", "error", "view", "click", "refund")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card rounds derived from ``orders``, row by row."""
    return derive_rounds(table(spark, sf_dir, "orders").select("o_orderkey"))


# --- sources -------------------------------------------------------------

def q_rounds_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-lines round records, written to the shared folder and read back with the declared schema."""
    path = fresh_path(spark, "rounds-json")
    write_rounds(rounds(spark, sf_dir), path, "json")
    return read_rounds(spark, path, "json")


# --- filters -------------------------------------------------------------

def q_complete_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_rounds(rounds(spark, sf_dir), RULES)


def q_roster_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_rounds(rounds(spark, sf_dir), ROSTER, RULES)


# --- seat features -------------------------------------------------------

def q_seat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster_seats(rounds(spark, sf_dir), ROSTER, RULES)


def _metric_query(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Every seat of every derived round, before any filter.
        return seat_table(rounds(spark, sf_dir), None, RULES, [metric]).select("round_id", "seat", metric)

    run.__name__ = f"q_m_{metric}"
    return run


def q_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution(q_seat_features(spark, sf_dir))


# --- aggregates ----------------------------------------------------------

def q_person_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return person_totals(first_seat_only(q_seat_features(spark, sf_dir)))


def roster_table(spark: SparkSession) -> DataFrame:
    """The roster parameter as an ``alias, person`` table (the join path of large rosters)."""
    pairs = [(alias, person) for person, aliases in ROSTER.people for alias in aliases]
    return spark.createDataFrame(pa.table({"alias": [a for a, _ in pairs], "person": [p for _, p in pairs]}))


def q_person_totals_roster_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``person_totals`` with seats resolved by joins to a roster table."""
    return totals_by_person_table(rounds(spark, sf_dir), roster_table(spark), RULES)


def q_person_totals_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``person_totals`` with one join to a roster bucketed on its aliases, for all four seats at once."""
    path = fresh_path(spark, "bucketed-roster")
    roster = bucketed_roster(roster_table(spark), f"roster_{path.rsplit('-', 1)[-1]}", path, 8)
    kept = bucketed_roster_rounds(complete_rounds(rounds(spark, sf_dir), RULES), roster)
    return person_totals(first_seat_only(seat_table(kept, None, RULES)))


def q_career_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career_summary(person_partials(first_seat_only(q_seat_features(spark, sf_dir))), ROSTER)


def q_summary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written as a single JSON file and read back with its own schema."""
    summary = q_career_summary(spark, sf_dir)
    path = fresh_path(spark, "summary-json")
    write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


def q_summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as a Structured Streaming job over ``orders`` read as a file stream, run to completion.

    Same plan as ``career_summary`` on ``readStream``: the per-person partial
    sums are the state, each micro-batch rewrites the one-row result; the
    written row is read back.
    """
    orders = table(spark, sf_dir, "orders")
    # A file stream reads a folder or a glob; the driver's table may be either one file or a folder of
    # files, and this glob of exactly its name covers both.
    keys = spark.readStream.schema(orders.schema).option("maxFileAge", ANY_AGE).parquet(f"{sf_dir.rstrip('/')}/orders.parque[t]")
    out = fresh_path(spark, "summary-stream")
    query = start_summary_query(
        derive_rounds(keys.select("o_orderkey")),
        out,
        ROSTER,
        RULES,
        checkpoint_location=fresh_path(spark, "summary-stream-checkpoint"),
        available_now=True,
        source=f"orders of {sf_dir}",
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    schema = T.StructType([T.StructField(c, T.LongType(), True) for c in summary_columns(ROSTER)])
    return spark.read.schema(schema).json(out)


MALFORMED = ('{"team_1_score": 7, "team_2_sc', "not json at all", "", '["a list"]')


def q_summary_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: JSON-lines rounds (with malformed and truncated lines among them) in, one JSON row out and read back.

    The round copy and the result stay in the session's shared folder, whose
    owner cleans it; each call takes fresh names.
    """
    source, out = fresh_path(spark, "job-rounds"), fresh_path(spark, "job-summary")
    lines = rounds(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    # A bad line follows every hundredth record.
    bad = F.element_at(F.array(*[F.lit(x) for x in MALFORMED]), (F.col("id") % len(MALFORMED) + 1).cast("int"))
    ids = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("id"))
    lines.unionByName(ids.select(bad.alias("value"))).write.text(source)
    run_job(spark, source, out, ROSTER, rules=RULES)
    schema = T.StructType([T.StructField(c, T.LongType(), True) for c in summary_columns(ROSTER)])
    return spark.read.schema(schema).json(out)


# --- the job's other ways in and out ----------------------------------------

def _summary_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType(), True) for c in summary_columns(ROSTER)])


WRONG_LINES = (*MALFORMED, '{"round_id": "abc", "team_1_score": 7}')


def q_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no round records, by kind: as counted by the job that summarizes, and as found in its side folder."""
    source, out, side = (fresh_path(spark, f"account-{x}") for x in ("rounds", "summary", "bad-lines"))
    lines = rounds(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    bad = F.element_at(F.array(*[F.lit(x) for x in WRONG_LINES]), (F.col("o_orderkey") % len(WRONG_LINES) + 1).cast("int"))
    wrong = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0 OR o_orderkey % 7 = 0").select(bad.alias("value"))
    lines.unionByName(wrong).write.text(source)
    run_job(spark, source, out, ROSTER, rules=RULES, bad_lines=side)
    account = read_manifest(spark, out)
    counted = spark.createDataFrame([(k, account[k]) for k in BAD_KINDS if account[k]], "kind string, n_lines long")
    written = spark.read.schema("kind string, line string").json(side).groupBy(F.col("kind").alias("k")).agg(F.count("*").alias("n_written"))
    return counted.join(written, F.col("kind") == F.col("k"), "full").select(F.coalesce("kind", "k").alias("kind"), "n_lines", "n_written")


def q_round_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metrics could not read, as data: one row per kept round, seat and metric, with the reason."""
    return round_errors(seat_table(kept_rounds(rounds(spark, sf_dir), ROSTER, RULES), ROSTER, RULES, errors=True))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round records as JSON text whose scores are numbers or text, by turns."""
    made = rounds(spark, sf_dir)
    plain = lambda c: f"CASE WHEN round_id % 3 = 0 OR try_cast({c} AS DOUBLE) IS NULL THEN concat('\"', {c}, '\"') ELSE {c} END"
    others = [c for c in made.columns if c not in ("team_1_score", "team_2_score")]
    rest = f"substring(to_json(struct({', '.join(others)})), 2)"
    return made.selectExpr(f"concat('{{\"team_1_score\":', {plain('team_1_score')}, ',\"team_2_score\":', {plain('team_2_score')}, ',', {rest}) AS value")


def q_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inferred_types(mixed_lines(spark, sf_dir))


def q_summary_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job as its command line runs it: roster from a file, inferred types, preview printed (and caught here)."""
    source, out, roster = (fresh_path(spark, f"cli-{x}") for x in ("rounds", "summary", "roster"))
    mixed_lines(spark, sf_dir).write.text(source)
    put(spark, f"{roster}/roster.json", json.dumps({person: list(aliases) for person, aliases in ROSTER.people}))
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        job_main(["--input", source, "--output", out, "--roster", f"{roster}/roster.json", "--infer-schema", "--preview"])
    if "total_rounds_played: long" not in shown.getvalue():
        raise RuntimeError("the preview did not show the result's schema")
    return spark.read.schema(_summary_schema()).json(out)


def q_totals_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-person totals from stored sums per input folder, after a second run that found one folder more."""
    source, store = fresh_path(spark, "folders"), fresh_path(spark, "folder-sums")
    made = rounds(spark, sf_dir)
    for day in range(3):
        write_rounds(made.where(F.col("round_id") % 3 == day), f"{source}/day={day}", "json")
        if day:
            totals, read = updated_totals(spark, source, store, ROSTER, RULES)
    if read != ["day=2"]:
        raise RuntimeError(f"the second run read {read}")
    return totals


# --- general forms on other tables ----------------------------------------

def q_x_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{trump_picker('props')} AS picker")


def q_x_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_totals(docs, ["lang"], "text", WORDS)


def q_x_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    scored = turns.selectExpr("role", f"{weighted_tokens('text', PUNCTUATION_WEIGHTS)} AS score")
    return scored.groupBy("role").agg(F.expr("sum(score) AS score"))


def q_x_threshold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr("doc_id", f"{token_groups_over('text', WORD_GROUPS, WORD_GROUPS_OVER)} AS groups_over")


def q_x_roster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return all_in(events, ["event_type"], EVENT_TYPES_KEPT)


def q_x_sum_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sum_equals(items, ["l_linenumber", "l_quantity"], 13)


def q_x_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = first_match([("l_returnflag = 'A'", "l_partkey"), ("l_linestatus = 'F'", "l_suppkey")])
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{picked} AS picked")


def q_x_wide_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("event_type", "CAST(floor(value * 100) AS BIGINT) AS cents")
    return wide_totals(events, "event_type", EVENT_TYPES_WIDE, "cents", prefix="cents_")


def q_x_sum_all_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return sum_all_with_count(items, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    reg: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "rounds_source": q_rounds_source,
        "complete_rounds": q_complete_rounds,
        "roster_rounds": q_roster_rounds,
        "seat_features": q_seat_features,
    }
    for metric in METRICS:
        reg[f"m_{metric}"] = _metric_query(metric)
    reg.update(
        {
            "attribution": q_attribution,
            "person_totals": q_person_totals,
            "person_totals_roster_join": q_person_totals_roster_join,
            "person_totals_bucketed": q_person_totals_bucketed,
            "career_summary": q_career_summary,
            "summary_roundtrip": q_summary_roundtrip,
            "summary_stream": q_summary_stream,
            "summary_job": q_summary_job,
            "summary_cli": q_summary_cli,
            "bad_lines": q_bad_lines,
            "round_errors": q_round_errors,
            "inferred_types": q_inferred_types,
            "totals_by_folder": q_totals_by_folder,
            "x_picker": q_x_picker,
            "x_token_count": q_x_token_count,
            "x_weighted_score": q_x_weighted_score,
            "x_threshold_groups": q_x_threshold_groups,
            "x_roster_filter": q_x_roster_filter,
            "x_sum_invariant": q_x_sum_invariant,
            "x_first_match": q_x_first_match,
            "x_wide_totals": q_x_wide_totals,
            "x_sum_all_with_count": q_x_sum_all_with_count,
        }
    )
    return reg

