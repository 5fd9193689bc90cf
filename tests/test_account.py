"""Bad lines, types, errors as data, manifest, increments and many tokens at once."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from hands import V1, V3, V4, bids
from tricklens.functions.tokens import count_token
from tricklens.model import METRICS, ROUNDS_SCHEMA, Roster, Rules
from tricklens.operators.aggregates import person_totals
from tricklens.operators.seats import first_seat_only, round_errors, seat_table
from tricklens.operators.tally import overlaps_itself, token_totals
from tricklens.plans import increments, job, queries
from tricklens.plans.increments import updated_totals
from tricklens.plans.summary import kept_rounds, summarize, totals_by_person
from tricklens.sources.rounds import inferred_types, read_rounds, variant_rounds

ROSTER = Roster.of({"ann": ["ann", "annie"], "bo": "bo", "cy": "cy", "di": "di"})


def record(i, **other):
    rec = {"round_id": i, "team_1_score": 7, "team_2_score": 6, "tarnib": "diamonds", "bids_data": bids(i % 4)}
    for s, (p, h) in enumerate(zip(("ann", "bo", "cy", "di"), (V1, V3, V4, V1)), start=1):
        rec |= {f"player_{s}": p, f"player_{s}_cards": h}
    return rec | other


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


BAD = {
    "truncated": ['{"team_1_score": 7, "team_2_sc', "{", '{"round_id":9,"tarnib":"s"'],
    "malformed": ["not json at all", "{]}", "}{"],
    "not_an_object": ['["a list"]', "5", "null", '"text"'],
    "wrong_type": ['{"round_id":"abc","team_1_score":1}', json.dumps(record(1.5))],
}


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bad_lines_are_counted_and_kept_by_the_one_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [record(i) for i in range(5)] + [record(7, player_1="nobody"), record(8, team_1_score=1)]
    write(tmp_path / "in" / "a.json", [*good[:3], *sum(BAD.values(), []), "", "  "])
    write(tmp_path / "in" / "b.json", good[3:])
    where = [str(tmp_path / x) for x in ("in", "out", "bad")]
    spark.sparkContext.setJobGroup("account", "account")
    summary = job.run(spark, where[0], where[1], ROSTER, bad_lines=where[2])
    n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("account"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n_jobs <= 2  # the scan that sums, counts and writes; the one row's own
    assert as_rows(summary) == as_rows(summarize(read_rounds(spark, where[0]), ROSTER))
    assert summary.first().total_rounds_played == 6  # a wrong round_id does not undo a round
    manifest = job.read_manifest(spark, where[1])
    assert {k: manifest[k] for k in BAD} == {k: len(v) for k, v in BAD.items()} and manifest["records"] == len(good) + sum(map(len, BAD.values()))
    got = {(r.kind, r.line) for r in spark.read.json(where[2]).collect()}
    assert got == {(k, x) for k, v in BAD.items() for x in v}


def test_no_bad_lines_and_no_lines(spark, tmp_path):
    for name, lines in (("good", [record(0)]), ("empty", [])):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "a.json", lines)
        summary = job.run(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), ROSTER, bad_lines=str(tmp_path / f"{name}-bad"))
        assert as_rows(summary) == as_rows(summarize(read_rounds(spark, str(tmp_path / name)), ROSTER))
        assert job.read_manifest(spark, str(tmp_path / f"{name}-out"))["malformed"] == 0
    parquet = str(tmp_path / "p")
    read_rounds(spark, str(tmp_path / "good")).write.parquet(parquet)
    job.run(spark, parquet, str(tmp_path / "p-out"), ROSTER, fmt="parquet", bad_lines=str(tmp_path / "p-bad"))
    assert spark.read.json(str(tmp_path / "p-out")).first().total_rounds_played == 1


def test_manifest_and_row_agree_while_files_arrive(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(3):
        write(src / f"{i}.json", [record(i)])
    real = job.write_summary

    def late(summary, path):
        write(src / "late.json", [record(90), record(91)])
        real(summary, path)

    monkeypatch.setattr(job, "write_summary", late)
    job.run(spark, str(src), out, ROSTER)
    files = job.read_manifest(spark, out)["files"]
    assert sorted(os.path.basename(f) for f in files) == ["0.json", "1.json", "2.json"]
    assert spark.read.json(out).first().total_rounds_played == 3
    again = summarize(read_rounds(spark, files), ROSTER).first().asDict()
    assert {k: v for k, v in again.items() if v is not None} == spark.read.json(out).first().asDict()


def test_types_of_any_kind_are_read_in_one_pass(spark, tmp_path):
    lines = [record(0), record(1, team_1_score="7"), record(2, team_1_score=7.0, team_2_score="6.0"), record(3, player_1_cards=["14_of_spades", "2_of_clubs"])]
    lines += [record(4, team_1_score=None), record(5, team_1_score=[7]), "no json", "[1]", record(6, extra={"a": 1})]
    write(tmp_path / "a.json", lines)
    text = spark.read.text(str(tmp_path / "a.json"))
    got = summarize(read_rounds(spark, str(tmp_path / "a.json"), infer_schema=True), ROSTER).first()
    assert got.total_rounds_played == 5 and got.ann_figures_count is not None
    plan = variant_rounds(text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan
    types = {r.field: r for r in inferred_types(text).collect()}
    assert (types["team_1_score"].n_integer, types["team_1_score"].n_fraction, types["team_1_score"].n_text, types["team_1_score"].n_other) == (3, 1, 1, 1)
    assert types["team_1_score"].inferred == "mixed" and types["round_id"].inferred == "integer" and types["tarnib"].inferred == "text"
    assert types["extra"].n_other == 1 and types["team_2_score"].inferred == "mixed"
    assert inferred_types(text.limit(0)).count() == 0


def test_errors_as_data_leave_totals_alone(spark):
    rows = [record(0), record(1, player_2_cards=None), record(2, bids_data="x"), record(3, tarnib=None, bids_data=bids(1)), record(4, bids_data=None, player_1_cards=None)]
    names = list(ROUNDS_SCHEMA.names)
    df = spark.createDataFrame([tuple(None if r.get(c) is None else (r[c] if c == "round_id" else str(r[c])) for c in names) for r in rows], ROUNDS_SCHEMA)
    seats = seat_table(kept_rounds(df, ROSTER), ROSTER, errors=True)
    assert as_rows(person_totals(first_seat_only(seats))) == as_rows(totals_by_person(df, ROSTER))
    found = {(r.round_id, r.seat, r.metric, r.reason) for r in round_errors(seats).collect()}
    null_metric = {
        (r.round_id, r.seat, m) for r in first_seat_only(seats).collect() for m in METRICS if r[m] is None
    }
    assert {x[:3] for x in found} == null_metric and (1, 4, "team_figures_count", "missing partner hand") in found
    assert (4, 1, "over_3_enemy_tarnib_count", "unreadable bid") in found and not any(x[0] == 0 for x in found)
    with pytest.raises(Exception, match="missing hand"):
        totals_by_person(df.where("round_id = 1"), ROSTER, Rules(strict=True)).collect()


def test_increments_read_only_new_folders(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "in", str(tmp_path / "store")
    seen = []
    real = increments.read_rounds
    monkeypatch.setattr(increments, "read_rounds", lambda spark, path, fmt: (seen.append(os.path.basename(path)), real(spark, path, fmt))[1])

    def folder(name, ids):
        (src / name).mkdir(parents=True, exist_ok=True)
        write(src / name / f"{len(ids)}-{ids[0]}.json", [record(i) for i in ids])

    def totals(roster=ROSTER, rules=Rules()):
        seen.clear()
        return as_rows(updated_totals(spark, str(src), store, roster, rules)[0]), list(seen)

    full = lambda roster=ROSTER, rules=Rules(): as_rows(totals_by_person(read_rounds(spark, [str(src / d) for d in os.listdir(src) if d[0] != "_"]), roster, rules))
    folder("d1", [1, 2])
    folder("_tmp", [50])
    assert totals() == (full(), ["d1"])
    folder("d2", [3])
    assert totals() == (full(), ["d2"])
    folder("d3", [4, 5, 6])
    assert totals() == (full(), ["d3"]) and totals()[1] == []
    folder("d2", [7, 8])  # a file more in a known folder
    assert totals() == (full(), ["d2"])
    corrected = Rules(topology="corrected")
    assert totals(rules=corrected) == (full(rules=corrected), ["d1", "d2", "d3"]) and totals() == (full(), [])


def test_an_empty_source_has_no_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df, read = updated_totals(spark, str(tmp_path / "in"), str(tmp_path / "store"), ROSTER)
    assert df.count() == 0 and read == []


def test_many_tokens_in_one_pass(spark):
    rng = random.Random(4)
    tokens = ["a", "ab", "abc", "b", "cab", "aa", "abab", "", "é", "a.b", "(", "\\", "zz9", "d", "ca"]
    texts = [None, "", "aaa", "ababab", "a.b(\\"] + ["".join(rng.choices(["a", "b", "c", "é", ".", "(", "\\", "\n"], k=rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)] + [(99, None)], "g int, t string")
    assert [t for t in tokens if overlaps_itself(t)] == ["aa", "abab"]
    got = {r.g: tuple(r)[1:] for r in token_totals(df, ["g"], "t", tokens).collect()}
    want = df.groupBy("g").agg(*[F.expr(f"sum({count_token('t', t)}) AS n") for t in tokens]).collect()
    assert got == {r.g: tuple(r)[1:] for r in want} and got[99] == (None,) * len(tokens)


def test_one_text_function_for_all_words(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    plan = queries.q_x_token_count(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "replace(" not in plan
