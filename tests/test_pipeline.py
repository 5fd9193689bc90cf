"""Round filters, seat attribution, the summary, JSON source/sink and plan shape."""

from __future__ import annotations

import json
import os

import pytest

from hands import V1, V3, V4, bids
from tricklens.model import METRICS, ROUNDS_SCHEMA, Roster, Rules, summary_columns
from tricklens.operators.aggregates import career_summary, person_partials
from tricklens.operators.seats import first_seat_only, seat_table
from tricklens.plans.job import run, write_summary
from tricklens.plans.summary import kept_rounds, summarize, totals_by_person
from tricklens.sources.rounds import read_rounds

ROSTER = Roster.of({"ann": ["ann", "annie"], "bo": "bo", "cy": "cy", "di": "di"})


def rnd(rid, players, hands=(V1, V3, V4, V1), t1=7, t2=6, tarnib="diamonds", bid=None):
    return {
        "round_id": rid,
        "team_1_score": str(t1) if t1 is not None else None,
        "team_2_score": str(t2) if t2 is not None else None,
        **{f"player_{i + 1}": p for i, p in enumerate(players)},
        **{f"player_{i + 1}_cards": h for i, h in enumerate(hands)},
        "tarnib": tarnib,
        "bids_data": bid if bid is not None else bids(2),
    }


def frame(spark, records):
    cols = [f.name for f in ROUNDS_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in records], ROUNDS_SCHEMA)


def test_complete_round_filter(spark):
    recs = [
        rnd(1, ["ann", "bo", "cy", "di"]),
        rnd(2, ["ann", "bo", "cy", "di"], t1=7, t2=5),
        rnd(3, ["ann", "bo", "cy", "di"], t1=None),
        rnd(4, ["ann", "bo", "cy", "di"], t1="6.5", t2="6.5"),
        rnd(5, ["ann", "bo", "cy", "di"], t1="x", t2=13),
    ]
    kept = kept_rounds(frame(spark, recs), ROSTER).select("round_id").collect()
    assert sorted(r[0] for r in kept) == [1, 4]


def test_roster_filter_is_case_insensitive_and_needs_all_four(spark):
    recs = [
        rnd(1, ["ANN", "Bo", "cy", "di"]),
        rnd(2, ["ann", "bo", "cy", "guest"]),
        rnd(3, ["ann", "bo", None, "di"]),
        rnd(4, ["annie", "bo", "cy", "di"]),
        rnd(5, [" ann", "bo", "cy", "di"]),  # no trimming
    ]
    kept = kept_rounds(frame(spark, recs), ROSTER).select("round_id").collect()
    assert sorted(r[0] for r in kept) == [1, 4]


def test_person_in_two_seats_counts_once_from_lower_seat(spark):
    # ann sits in seats 1 and 3 (two aliases); bo in 2 and 4
    recs = [rnd(1, ["ann", "bo", "Annie", "bo"], hands=(V1, V3, V4, V1))]
    seats = seat_table(frame(spark, recs), ROSTER)
    rows = {(r.seat, r.person, r.is_first_seat) for r in seats.collect()}
    assert rows == {(1, "ann", True), (2, "bo", True), (3, "ann", False), (4, "bo", False)}
    s = summarize(frame(spark, recs), ROSTER).first().asDict()
    assert s["total_rounds_played"] == 1
    assert s["ann_figures_count"] == 5  # V1 from seat 1, not V4 from seat 3
    assert s["bo_figures_count"] == 8  # V3 from seat 2
    assert s["cy_figures_count"] is None and s["di_figures_count"] is None


def test_summary_columns_and_nulls(spark):
    recs = [rnd(1, ["ann", "bo", "cy", "ann"]), rnd(2, ["bo", "ann", "cy", "bo"])]
    s = summarize(frame(spark, recs), ROSTER)
    assert s.columns == summary_columns(ROSTER)
    row = s.first().asDict()
    assert row["total_rounds_played"] == 2
    assert row["di_figures_count"] is None  # absent person: null, not 0
    assert row["ann_figures_count"] == 5 + 8  # seat 1 (V1) in round 1, seat 2 (V3) in round 2


def test_empty_input_counts_zero_rounds(spark):
    s = summarize(frame(spark, [rnd(1, ["x", "y", "z", "w"])]), ROSTER).first().asDict()
    assert s["total_rounds_played"] == 0
    assert all(v is None for k, v in s.items() if k != "total_rounds_played")


def test_column_order_parameter(spark):
    order = ["total_rounds_played"] + [f"{p}_{m}" for m in reversed(METRICS) for p in ROSTER.names]
    s = summarize(frame(spark, [rnd(1, ["ann", "bo", "cy", "di"])]), ROSTER, column_order=order)
    assert s.columns == order


def test_team_count_uses_partner_hand(spark):
    recs = [rnd(1, ["ann", "bo", "cy", "di"], hands=(V1, V3, V4, V1))]
    by_seat = {r.seat: r for r in seat_table(frame(spark, recs), ROSTER).collect()}
    fig = {1: 5, 2: 8, 3: 1, 4: 5}
    for seat, partner in {1: 3, 2: 4, 3: 1, 4: 2}.items():
        assert by_seat[seat].team_figures_count == fig[seat] + fig[partner]


def test_person_totals_match_summary(spark):
    recs = [rnd(i, ["ann", "bo", "cy", "di"][i % 4:] + ["ann", "bo", "cy", "di"][: i % 4], bid=bids(i % 4)) for i in range(8)]
    df = frame(spark, recs)
    totals = {r.person: r.asDict() for r in totals_by_person(df, ROSTER).collect()}
    s = summarize(df, ROSTER).first().asDict()
    for person, t in totals.items():
        assert t["rounds_played"] == 8
        for m in METRICS:
            assert s[f"{person}_{m}"] == t[m]


def test_legal_deal_invariant(spark):
    # For rounds with 13 legal cards per seat, the four hands hold 16 figures worth 40 points.
    from tricklens.plans.queries import rounds
    from tricklens.sources.derived import QUIRKS

    plain = " AND ".join(f"round_id % {m} != {r}" for m, r in (QUIRKS[q] for q in ("missing_comma", "ten_cards", "fourteen_cards", "null_hand")))
    seats = seat_table(rounds(spark, "/root/testdata/sf0.001").where(plain), None)
    bad = (
        seats.groupBy("round_id")
        .agg({"figures_count": "sum", "figures_score": "sum"})
        .filter("`sum(figures_count)` != 16 OR `sum(figures_score)` != 40")
    )
    assert bad.count() == 0


JSON_LINES = [
    # numbers as JSON numbers, text and float; nested hand as a real JSON array
    {"team_1_score": 7, "team_2_score": 6, "player_1": "ann", "player_2": "bo", "player_3": "cy", "player_4": "di"},
    {"team_1_score": "7", "team_2_score": 6.0, "player_1": "Bo", "player_2": "ann", "player_3": "di", "player_4": "cy"},
    {"team_1_score": 7, "team_2_score": 5, "player_1": "ann", "player_2": "bo", "player_3": "cy", "player_4": "di"},
]


def _write_jsonl(path, extra_nested=True):
    lines = []
    for i, rec in enumerate(JSON_LINES):
        rec = dict(rec)
        for s in range(1, 5):
            rec[f"player_{s}_cards"] = V1
        rec["tarnib"] = "diamonds"
        rec["bids_data"] = bids(2)
        if extra_nested and i == 1:
            rec["player_1_cards"] = ["14_of_spades", "13_of_spades", "14_of_diamonds"]
        lines.append(json.dumps(rec))
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_json_source_reads_scores_of_any_type_and_nested_hands(spark, tmp_path):
    path = str(tmp_path / "rounds.jsonl")
    _write_jsonl(path)
    df = read_rounds(spark, path)
    assert [f.name for f in df.schema.fields] == [f.name for f in ROUNDS_SCHEMA.fields]
    s = summarize(df, ROSTER).first().asDict()
    assert s["total_rounds_played"] == 2
    # round 2: bo sits in seat 1 with the nested (raw text) hand of 3 figures
    assert s["bo_figures_count"] == 5 + 3


def test_job_writes_one_json_row(spark, tmp_path):
    src = str(tmp_path / "rounds.jsonl")
    _write_jsonl(src, extra_nested=False)
    out = str(tmp_path / "summary")
    roster_file = tmp_path / "roster.json"
    roster_file.write_text(json.dumps({p: list(a) for p, a in ROSTER.people}))
    run(spark, src, out, Roster.of(json.loads(roster_file.read_text())))
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    assert len(files) == 1
    rows = [json.loads(line) for line in open(os.path.join(out, files[0]))]
    assert len(rows) == 1 and rows[0]["total_rounds_played"] == 2
    assert list(rows[0])[0] == "total_rounds_played"


def test_plan_is_one_scan_native_and_two_small_exchanges(spark, tmp_path):
    path = str(tmp_path / "rounds.jsonl")
    _write_jsonl(path)
    s = summarize(read_rounds(spark, path), ROSTER)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert plan.count("FileScan") == 1 or plan.count("Scan json") == 1
    assert plan.count("Exchange") == 2


def test_roster_rejects_shared_alias():
    with pytest.raises(ValueError):
        Roster.of({"a": ["x"], "b": ["x"]})


def test_write_summary_overwrites(spark, tmp_path):
    out = str(tmp_path / "s")
    df = summarize(frame(spark, [rnd(1, ["ann", "bo", "cy", "di"])]), ROSTER)
    write_summary(df, out)
    write_summary(df, out)
    assert spark.read.json(out).count() == 1


def test_corrected_topology_changes_only_seat_four(spark):
    # bidder 0 -> seat 1 picked: counts for seat 4 only under the original topology
    df = frame(spark, [rnd(1, ["ann", "bo", "cy", "di"], bid=bids(0))])
    a = summarize(df, ROSTER).first().asDict()
    b = summarize(df, ROSTER, Rules(topology="corrected")).first().asDict()
    diff = {k for k in a if a[k] != b[k]}
    assert diff <= {"di_has_partner_picked_tarnib_count", "di_over_3_partner_tarnib_count"}
    assert "di_has_partner_picked_tarnib_count" in diff


def test_partials_keep_round_count_with_duplicates(spark):
    recs = [rnd(1, ["ann", "ann", "ann", "ann"]), rnd(2, ["bo", "cy", "di", "ann"])]
    s = career_summary(person_partials(first_seat_only(seat_table(frame(spark, recs), ROSTER))), ROSTER)
    assert s.first()["total_rounds_played"] == 2


def test_inferred_schema_gives_same_summary(spark, tmp_path):
    path = str(tmp_path / "rounds.jsonl")
    _write_jsonl(path, extra_nested=False)
    declared = summarize(read_rounds(spark, path), ROSTER).first().asDict()
    inferred = summarize(read_rounds(spark, path, infer_schema=True), ROSTER).first().asDict()
    assert declared == inferred


def test_preview_reads_written_row(spark, tmp_path, capsys):
    src = str(tmp_path / "rounds.jsonl")
    _write_jsonl(src, extra_nested=False)
    run(spark, src, str(tmp_path / "out"), ROSTER, preview=True)
    assert "total_rounds_played" in capsys.readouterr().out


def test_command_line(spark, tmp_path):
    from tricklens.plans.job import main

    src = str(tmp_path / "rounds.jsonl")
    _write_jsonl(src, extra_nested=False)
    out = str(tmp_path / "cli")
    roster = json.dumps({p: list(a) for p, a in ROSTER.people})
    main(["--input", src, "--output", out, "--roster", roster, "--topology", "corrected"])
    row = spark.read.json(out).first().asDict()
    assert row["total_rounds_played"] == 2


def test_job_starts_as_its_own_process(tmp_path):
    """The launcher of a fresh checkout, from another folder, with the roster on storage and other options."""
    import subprocess
    import sys

    src, out, roster = str(tmp_path / "rounds.jsonl"), str(tmp_path / "out"), tmp_path / "roster.json"
    _write_jsonl(src, extra_nested=False)
    roster.write_text(json.dumps({p: list(a) for p, a in ROSTER.people}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    order = summary_columns(ROSTER)[::-1]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false pyspark-shell"}
    args = ["--input", src, "--output", out, "--roster", "file://" + str(roster), "--infer-schema", "--column-order", ",".join(order), "--rules", '{"aces_over": 0}']
    done = subprocess.run([sys.executable, f"{root}/submit_summary.py", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    [part] = [f for f in os.listdir(out) if f.endswith(".json")]
    row = json.loads(open(os.path.join(out, part)).read())
    assert row["total_rounds_played"] == 2 and list(row) == [c for c in order if c in row]


def test_column_order_must_be_a_permutation(spark, tmp_path):
    columns = summary_columns(ROSTER)
    assert len(columns) == 49
    for bad in (columns[:-1], [*columns, columns[0]], [*columns[:-1], "other"]):
        with pytest.raises(ValueError):
            summary_columns(ROSTER, bad)
    src = str(tmp_path / "rounds.jsonl")
    _write_jsonl(src, extra_nested=False)
    out = str(tmp_path / "ordered")
    run(spark, src, out, ROSTER, column_order=columns[::-1])
    [part] = [f for f in os.listdir(out) if f.endswith(".json")]
    row = json.loads(open(os.path.join(out, part)).read())
    assert list(row) == [c for c in columns[::-1] if c in row]


def test_malformed_and_truncated_lines_are_dropped(spark, tmp_path):
    src = str(tmp_path / "rounds.jsonl")
    _write_jsonl(src, extra_nested=False)
    want = summarize(read_rounds(spark, src), ROSTER).first()
    with open(src, "a") as fh:
        fh.write('{"team_1_score": 7, "team_2_sc\nnot json\n\n["a list"]\n')
    assert summarize(read_rounds(spark, src), ROSTER).first() == want


def test_plan_shape_does_not_depend_on_the_number_of_files(spark, tmp_path):
    import re

    recs = [rnd(i, ["ann", "bo", "cy", "di"], bid=bids(i % 4)) for i in range(64)]
    shapes = []
    for files in (1, 16):
        path = str(tmp_path / f"rounds-{files}")
        frame(spark, recs).repartition(files).write.parquet(path)
        plan = summarize(read_rounds(spark, path, "parquet"), ROSTER)._jdf.queryExecution().executedPlan().toString()
        shapes.append(re.findall(r"(Exchange|HashAggregate|Generate|Filter|Project|FileScan)", plan))
    assert shapes[0] == shapes[1]


def test_parquet_plan_prunes_pushes_and_combines_map_side(spark, tmp_path):
    path = str(tmp_path / "rounds.parquet")
    recs = [rnd(i, ["ann", "bo", "cy", "di"], bid=bids(i % 4)) for i in range(20)]
    frame(spark, recs).repartition(4).write.parquet(path)
    s = summarize(read_rounds(spark, path, "parquet"), ROSTER)
    previous = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        formatted = s._jdf.queryExecution().explainString(mode)
        plan = s._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", previous)
    scan = formatted.split("Scan parquet", 2)[2].split("\n\n")[0]
    read_schema = next(line for line in scan.splitlines() if line.startswith("ReadSchema"))
    pushed = next(line for line in scan.splitlines() if line.startswith("PushedFilters"))
    assert "round_id" not in read_schema  # not needed by the summary
    assert "IsNotNull(team_1_score)" in pushed and "IsNotNull(player_1)" in pushed
    # partial aggregation happens map side, below the first exchange
    lines = plan.splitlines()
    first_exchange = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning(person" in line)
    assert any("HashAggregate(keys=[person" in line and "partial_" in line for line in lines[first_exchange:])
    assert s.first()["total_rounds_played"] == 20


def test_names_and_aliases_with_spaces(spark):
    roster = Roster.of({"ann b": ["ann b", "ab"], "bo": "bo", "cy": "cy", "di": "di"})
    s = summarize(frame(spark, [rnd(1, ["Ann B", "bo", "cy", "di"])]), roster)
    row = s.first().asDict()
    assert row["ann b_figures_count"] == 5 and row["total_rounds_played"] == 1
