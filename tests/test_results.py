"""Readers find results whole while they are replaced; a crash between writes leaves nothing half made."""

from __future__ import annotations

import glob
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from hands import V1, V3, V4, bids
from tricklens.model import Roster, Rules
from tricklens.plans import results
from tricklens.plans.job import write_summary
from tricklens.streaming import summary_stream
from tricklens.streaming.summary_stream import definition_text, start_summary_stream

ROSTER = Roster.of({"ann": "ann", "bo": "bo", "cy": "cy", "di": "di"})


def _write_round(path, i):
    rec = {"team_1_score": 7, "team_2_score": 6, "tarnib": "diamonds", "bids_data": bids(i % 4)}
    for s, (p, h) in enumerate(zip(("ann", "bo", "cy", "di"), (V1, V3, V4, V1)), start=1):
        rec |= {f"player_{s}": p, f"player_{s}_cards": h}
    path.write_text(json.dumps(rec) + "\n")


class Polling(threading.Thread):
    """Reads the folder's JSON files over and over, as any reader would."""

    def __init__(self, folder):
        super().__init__(daemon=True)
        self.folder, self.seen, self.stopped = folder, [], threading.Event()

    def run(self):
        while not self.stopped.is_set():
            lines = []
            for f in glob.glob(f"{self.folder}/[!_.]*"):
                with open(f) as handle:
                    lines += handle.read().splitlines()
            self.seen.append([json.loads(x)["total_rounds_played"] for x in lines])


def test_a_polling_reader_always_sees_one_row(spark, tmp_path):
    """20 batches of one file each: the row is replaced in one step every time."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def batch(i):
        _write_round(src / f"{i}.json", i)
        start_summary_stream(spark, str(src), out, ROSTER, checkpoint_location=str(tmp_path / "ckpt"), available_now=True).awaitTermination(120)

    batch(0)
    reader = Polling(out)
    reader.start()
    spark_rows = []
    for i in range(1, 20):
        batch(i)
        spark_rows.append(spark.read.json(out).select("total_rounds_played").collect())
    reader.stopped.set()
    reader.join()
    assert [[r[0] for r in rows] for rows in spark_rows] == [[i + 1] for i in range(1, 20)]
    assert len(reader.seen) > 20 and all(len(x) == 1 for x in reader.seen)
    counts = [x[0] for x in reader.seen]
    assert counts == sorted(counts) and len(set(counts)) > 5


def test_an_older_folder_layout_is_taken_over(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(3).coalesce(1).write.json(out)
    write_summary(spark.range(1).select(F.lit(5).alias("total_rounds_played"), F.lit(None).cast("long").alias("gone")), out)
    assert [r.asDict() for r in spark.read.json(out).collect()] == [{"total_rounds_played": 5}]
    write_summary(spark.range(1).select(F.lit(6).alias("total_rounds_played")), out)
    assert [f for f in os.listdir(out) if not f.startswith(("_", "."))] == [results.ROWS_FILE]


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "totals")
    assert results.read_published(spark, folder) is None
    results.publish(spark.range(4), folder)
    open_reader = results.read_published(spark, folder)
    results.publish(spark.range(100), folder)
    assert open_reader.count() == 4 and results.read_published(spark, folder).count() == 100
    results.publish(spark.range(7), folder)
    assert results.read_published(spark, folder).count() == 7
    assert len(glob.glob(f"{folder}/version-*")) == 2


def test_a_failed_version_stays_unseen(spark, tmp_path):
    folder = str(tmp_path / "totals")
    results.publish(spark.range(4), folder)
    with pytest.raises(Exception, match="on purpose"):
        results.publish(spark.range(4).select(F.raise_error(F.lit("on purpose")).cast("long").alias("id")), folder)
    assert results.read_published(spark, folder).count() == 4


def test_a_crash_between_definition_and_checkpoint(spark, tmp_path, monkeypatch):
    """A definition is written in one step; a checkpoint without one is refused, an empty folder is not."""
    at = str(tmp_path / "ckpt")
    definition = definition_text(ROSTER, Rules(), "json x")
    real = os.replace
    monkeypatch.setattr(os, "replace", lambda a, b: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        summary_stream.bind_checkpoint(spark, at, definition)
    monkeypatch.setattr(os, "replace", real)
    assert not os.path.exists(at + ".definition")
    summary_stream.bind_checkpoint(spark, at, definition)
    summary_stream.bind_checkpoint(spark, at, definition)
    with pytest.raises(ValueError, match="another roster"):
        summary_stream.bind_checkpoint(spark, at, definition + " ")
    os.remove(at + ".definition")
    os.makedirs(at + "/offsets")
    with pytest.raises(ValueError, match="does not say"):
        summary_stream.bind_checkpoint(spark, at, definition)
