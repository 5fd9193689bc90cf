"""Per-person totals kept up to date folder by folder: only new rounds are read.

Rounds often arrive as one folder a day. Each input folder's per-person sums are
stored once, as a few rows; the totals are the sum of these over all folders. A run
lists the folders, computes those that are new or whose files have changed, and
adds up. Sums are mergeable, so the result equals a run over all rounds.

Every folder's sums are published in one step under a name made of the folder,
its files and the definition (roster and rules): a crash leaves the folder to be
computed again, never half, and sums made under another roster never mix in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tricklens.model import METRICS, Roster, Rules
from tricklens.operators.aggregates import person_partials
from tricklens.operators.seats import first_seat_only
from tricklens.plans.results import hadoop, publish, published_path
from tricklens.plans.summary import roster_seats
from tricklens.sources.rounds import read_rounds


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]


def folders_of(spark: SparkSession, source: str) -> dict[str, str]:
    """{subfolder of ``source``: digest of its files' names, lengths and times}."""
    _, root, fs = hadoop(spark, source)
    out = {}
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if folder.isDirectory() and not name.startswith(("_", ".")):
            files = [f for f in fs.listStatus(folder.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            if files:
                out[name] = _digest(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    return out


def updated_totals(
    spark: SparkSession, source: str, store: str, roster: Roster, rules: Rules = Rules(), fmt: str = "json"
) -> tuple[DataFrame, list[str]]:
    """(person, rounds_played and the twelve totals over all folders; the folders that had to be read now)."""
    fields = {k: dict(v) if isinstance(v, Mapping) else v for k, v in vars(rules).items()}
    definition = _digest(roster.people, fields, fmt)
    source, store = source.rstrip("/"), store.rstrip("/")
    read, places = [], []
    for name, files in sorted(folders_of(spark, source).items()):
        place = f"{store}/{definition}/{_digest(name)}-{files}"
        if published_path(spark, place) is None:
            rounds = read_rounds(spark, f"{source}/{name}", fmt)
            publish(person_partials(first_seat_only(roster_seats(rounds, roster, rules))), place)
            read.append(name)
        places.append(published_path(spark, place))
    sums = ["rounds_played", *METRICS]
    schema = "person string, _seat_1_rows long, " + ", ".join(f"{c} long" for c in sums)
    # One read of all the folders' rows, however many folders there are.
    partials = spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
    return partials.groupBy("person").agg(*[F.expr(f"sum({c}) AS {c}") for c in sums]), read
