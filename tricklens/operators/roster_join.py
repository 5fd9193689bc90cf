"""Roster given as a table: seat -> person by join, for rosters too large for an IN list.

The roster table has columns ``alias`` (lower-case, as players are matched
after ``lower``) and ``person``. It is validated on its own (one small
aggregation over the roster), then each seat's lower-cased player joins it:
the rounds are scanned once. Spark picks the join by the roster's size in
bytes; where it shuffles, adaptive execution splits the partition of a player
who sits in a third of all rounds (``spark.sql.adaptive.skewJoin.enabled``,
on by default).

The result carries ``_person_1`` .. ``_person_4`` for ``seat_table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricklens.model import SEATS, player_col

SALTS = 16  # copies of each alias in a bucketed roster


def roster_mapping(roster: DataFrame) -> DataFrame:
    """``alias, person`` without repeats and null aliases; fails if an alias has two persons."""
    mapping = roster.select("alias", "person").where("alias IS NOT NULL").distinct()
    if not mapping.groupBy("alias").count().where("count > 1").isEmpty():
        raise ValueError("an alias in the roster table belongs to two persons")
    return mapping


def resolve_persons(rounds: DataFrame, roster: DataFrame) -> DataFrame:
    """``rounds`` plus ``_person_1`` .. ``_person_4`` (null for a player not on the roster)."""
    mapping = roster_mapping(roster)
    out = rounds
    for seat in SEATS:
        side = mapping.selectExpr(f"alias AS _alias_{seat}", f"person AS _person_{seat}")
        out = out.join(side, F.expr(f"lower({player_col(seat)}) = _alias_{seat}"), "left").drop(f"_alias_{seat}")
    return out


def roster_table_rounds(rounds: DataFrame, roster: DataFrame) -> DataFrame:
    """Rounds whose four seats are all on the roster table, with the persons resolved."""
    resolved = resolve_persons(rounds, roster)
    return resolved.filter(" AND ".join(f"_person_{s} IS NOT NULL" for s in SEATS))


def bucketed_roster(roster: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The roster written once as a table bucketed on (alias, salt), for ``bucketed_roster_rounds``; ``path`` is a new shared folder.

    Joins then leave the roster where it lies, however large it is. Every alias
    is there ``SALTS`` times, in different buckets, so that the rounds of a
    player who sits in a third of them meet it in as many tasks (adaptive
    execution splits no partition of a bucketed join).
    """
    salted = roster_mapping(roster).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.repartition(buckets, "alias", "salt")
    salted.write.option("path", path).bucketBy(buckets, "alias", "salt").sortBy("alias", "salt").saveAsTable(name)
    return roster.sparkSession.table(name)


def bucketed_roster_rounds(rounds: DataFrame, roster: DataFrame) -> DataFrame:
    """``roster_table_rounds`` with one join for all four seats, against a ``bucketed_roster``.

    Rounds go seat-long, (round, seat, alias) with the record itself on seat 1's
    row alone; rows meet the roster once, and rounds of which all four rows
    found a person are put together again. A record moves twice, to its first player's
    bucket and to its round, instead of once for every seat. Rounds are numbered
    as they are read, so a recomputed task numbers them alike over files.
    """
    numbered = rounds.withColumn("_round", F.monotonically_increasing_id())
    record = F.struct(*[F.col(c) for c in rounds.columns])
    seats = [
        F.struct(
            F.lit(s).alias("_seat"),
            F.lower(player_col(s)).alias("_alias"),
            (record if s == SEATS[0] else F.lit(None).cast(rounds.schema)).alias("_record"),
        )
        for s in SEATS
    ]
    long = numbered.select("_round", F.inline(F.array(*seats))).where("_alias IS NOT NULL")
    long = long.withColumn("_salt", F.pmod(F.xxhash64("_round"), F.lit(SALTS)).cast("int"))
    known = roster.select(F.col("alias").alias("_roster_alias"), F.col("salt").alias("_roster_salt"), F.col("person").alias("_person"))
    met = long.join(known, (F.col("_alias") == F.col("_roster_alias")) & (F.col("_salt") == F.col("_roster_salt")))
    persons = [F.max(F.when(F.col("_seat") == s, F.col("_person"))).alias(f"_person_{s}") for s in SEATS]
    again = met.groupBy("_round").agg(F.first("_record", ignorenulls=True).alias("_record"), *persons)
    whole = again.where(" AND ".join(f"_person_{s} IS NOT NULL" for s in SEATS))
    return whole.select("_record.*", *[f"_person_{s}" for s in SEATS])
