"""The same summary kept up to date as round files arrive (Structured Streaming).

The batch job re-reads every round on each run. When rounds land as new
files in a folder, this runs the identical plan incrementally: the file
source picks up only new files, the per-person partial sums are the
streaming state (one row per person, whatever the input volume), and each
micro-batch replaces the one-row summary, in one step, from that state. Rewriting a
complete result is idempotent, so a replayed batch after a failure writes the
same row again.

No operator is added: it is the batch plan over ``readStream`` instead of
``read``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tricklens.model import ROUNDS_SCHEMA, Roster, Rules, summary_columns
from tricklens.operators.aggregates import career_summary, person_partials
from tricklens.operators.seats import first_seat_only
from tricklens.plans.job import write_summary
from tricklens.plans.results import get, put
from tricklens.plans.summary import roster_seats
from tricklens.sources.scratch import shared_dir


# The file source skips files older than this against the newest one seen (Spark's own default is 7 days).
# Every record under the path counts, so nothing is ever too old.
ANY_AGE = "36500d"


def stream_rounds(
    spark: SparkSession, source_dir: str, fmt: str = "json", max_files_per_trigger: int | None = None, max_file_age: str = ANY_AGE
) -> DataFrame:
    """Round files as they arrive. A shorter ``max_file_age`` drops files that arrive with older dates."""
    reader = spark.readStream.schema(ROUNDS_SCHEMA).format(fmt).option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def running_partials(rounds: DataFrame, roster: Roster, rules: Rules = Rules()) -> DataFrame:
    """Streaming per-person partial sums (the state of the summary)."""
    return person_partials(first_seat_only(roster_seats(rounds, roster, rules)))


def start_summary_stream(
    spark: SparkSession,
    source_dir: str,
    output_path: str,
    roster: Roster,
    rules: Rules = Rules(),
    fmt: str = "json",
    checkpoint_location: str | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
    column_order: Sequence[str] | None = None,
    max_file_age: str = ANY_AGE,
) -> StreamingQuery:
    """Start the incremental summary; ``available_now`` processes what is there and stops.

    The checkpoint defaults to a folder under the session's shared
    checkpoint directory, named after the output, so a restarted job resumes
    where it left off. The state adds up what roster, rules and source made
    of the rounds so far, so a checkpoint resumes under the same ones only.
    """
    rounds = stream_rounds(spark, source_dir, fmt, max_file_age=max_file_age)
    return start_summary_query(
        rounds, output_path, roster, rules, checkpoint_location, available_now, processing_time, column_order, f"{fmt} {source_dir}"
    )


def definition_text(roster: Roster, rules: Rules, source: str) -> str:
    """What the state depends on, as text."""
    fields = {k: dict(v) if isinstance(v, Mapping) else v for k, v in vars(rules).items()}
    return json.dumps({"roster": roster.people, "rules": fields, "source": source}, sort_keys=True)


def bind_checkpoint(spark: SparkSession, checkpoint_location: str, definition: str) -> None:
    """Writes the definition beside a new checkpoint; refuses to resume one that was made under another."""
    location = checkpoint_location.rstrip("/")
    stored = get(spark, location + ".definition")
    if stored is None and _holds_files(spark, location):
        raise ValueError(f"the checkpoint {location} does not say under which roster, rules and source it was made; start a new one")
    if stored is not None and stored != definition:
        raise ValueError(
            f"the checkpoint {location} holds sums under another roster, rules or source; "
            "start a new checkpoint (and read all rounds again) for the changed ones"
        )
    if stored is None:
        # In one step, so that a crash leaves no empty definition behind.
        put(spark, location + ".definition", definition)


def _holds_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and len(fs.listStatus(path)) > 0


def start_summary_query(
    rounds: DataFrame,
    output_path: str,
    roster: Roster,
    rules: Rules = Rules(),
    checkpoint_location: str | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
    column_order: Sequence[str] | None = None,
    source: str = "",
) -> StreamingQuery:
    """Start the incremental summary over any streaming DataFrame of round records.

    The state is one row per person, in the session's shuffle partitions at
    the first start. ``source`` names where the rounds come from; with roster
    and rules it is bound to the checkpoint.
    """
    summary_columns(roster, column_order)  # fails on a bad order before anything starts
    if checkpoint_location is None:
        tag = hashlib.sha1(output_path.encode()).hexdigest()[:16]
        checkpoint_location = f"{shared_dir(rounds.sparkSession)}/summary-stream-{tag}"
    bind_checkpoint(rounds.sparkSession, checkpoint_location, definition_text(roster, rules, source))
    partials = running_partials(rounds, roster, rules)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        write_summary(career_summary(batch, roster, column_order), output_path)

    writer = (
        partials.writeStream.outputMode("complete")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
