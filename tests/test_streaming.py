"""The incremental summary equals the batch summary after each new file."""

from __future__ import annotations

import json
import os
import time

import pytest

from hands import V1, V3, V4, bids
from tricklens.model import Roster, Rules, summary_columns
from tricklens.plans.summary import summarize
from tricklens.sources.rounds import read_rounds
from tricklens.streaming.summary_stream import start_summary_stream

ROSTER = Roster.of({"ann": "ann", "bo": "bo", "cy": "cy", "di": "di"})


def _round(i, players):
    rec = {"team_1_score": 7, "team_2_score": 6, "tarnib": "diamonds", "bids_data": bids(i % 4)}
    for s, (p, h) in enumerate(zip(players, (V1, V3, V4, V1)), start=1):
        rec[f"player_{s}"] = p
        rec[f"player_{s}_cards"] = h
    return rec


def _write(path, recs):
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs) + "\n")


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out = str(tmp_path / "summary")
    ckpt = str(tmp_path / "ckpt")
    _write(src / "a.json", [_round(0, ["ann", "bo", "cy", "di"]), _round(1, ["bo", "cy", "di", "ann"])])

    def run_once():
        q = start_summary_stream(spark, str(src), out, ROSTER, checkpoint_location=ckpt, available_now=True)
        q.awaitTermination(120)
        return spark.read.json(out).first().asDict()

    got = run_once()
    want = summarize(read_rounds(spark, str(src)), ROSTER).first().asDict()
    assert got == {k: v for k, v in want.items() if v is not None}

    _write(src / "b.json", [_round(2, ["cy", "di", "ann", "bo"]), _round(3, ["ann", "x", "cy", "di"])])
    got = run_once()
    want = summarize(read_rounds(spark, str(src)), ROSTER).first().asDict()
    assert got["total_rounds_played"] == 3
    assert got == {k: v for k, v in want.items() if v is not None}
    assert os.path.isdir(ckpt)


def _start(spark, tmp_path, roster=ROSTER, rules=Rules(), **more):
    return start_summary_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "summary"), roster, rules, checkpoint_location=str(tmp_path / "ckpt"), available_now=True, **more
    )


def test_late_files_with_old_dates_count(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src / "a.json", [_round(0, ["ann", "bo", "cy", "di"])])
    _start(spark, tmp_path).awaitTermination(120)
    _write(src / "b.json", [_round(1, ["bo", "cy", "di", "ann"])])
    old = time.time() - 10 * 86400
    os.utime(src / "b.json", (old, old))
    _start(spark, tmp_path).awaitTermination(120)
    got = spark.read.json(str(tmp_path / "summary")).first().asDict()
    want = summarize(read_rounds(spark, str(src)), ROSTER).first().asDict()
    assert got["total_rounds_played"] == 2 and got == {k: v for k, v in want.items() if v is not None}


def test_a_checkpoint_is_bound_to_roster_rules_and_source(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src / "a.json", [_round(0, ["ann", "bo", "cy", "di"])])
    _start(spark, tmp_path).awaitTermination(120)
    wider = Roster.of({"ann": ["ann", "x"], "bo": "bo", "cy": "cy", "di": "di"})
    with pytest.raises(ValueError, match="checkpoint"):
        _start(spark, tmp_path, roster=wider)
    with pytest.raises(ValueError, match="checkpoint"):
        _start(spark, tmp_path, rules=Rules(aces_over=1))
    with pytest.raises(ValueError, match="checkpoint"):
        _start(spark, tmp_path, fmt="parquet")
    _start(spark, tmp_path).awaitTermination(120)


def test_column_order_of_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "a.json", [_round(0, ["ann", "bo", "cy", "di"])])
    order = summary_columns(ROSTER)[::-1]
    with pytest.raises(ValueError):
        _start(spark, tmp_path, column_order=order[1:])
    _start(spark, tmp_path, column_order=order).awaitTermination(120)
    [part] = [f for f in os.listdir(tmp_path / "summary") if f.endswith(".json")]
    assert list(json.loads((tmp_path / "summary" / part).read_text())) == order


def test_the_registered_stream_does_not_repartition(spark):
    from tricklens.plans import queries

    plan = queries.derive_rounds(
        spark.readStream.schema("o_orderkey long").parquet("/root/testdata/sf0.001/orders.parque[t]")
    )._jdf.queryExecution().toString()
    assert "Repartition" not in plan and "repartition(" not in open(queries.__file__).read()
