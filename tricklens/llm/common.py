"""Helpers shared by the operators: tables, written intermediate results, words and match positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tricklens.sources.scratch import fresh_path

# The white space that separates words (space and U+0009 to U+000D).
SPACE_CLASS = r"[\x20\x09-\x0D]"
NOT_SPACE_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and reread.

    Cuts the lineage, survives lost executors, and gives Spark the true size
    of the result for the joins that follow.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text in order (null or empty text: an empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not once for each use inside ``body``."""
    return F.transform(F.array(value), body)[0]


def worker_state() -> dict:
    """What a Python worker keeps between its tasks: a place for models and bounded memos, never for results."""
    import sys
    import types

    return vars(sys.modules.setdefault("_tricklens_worker", types.ModuleType("_tricklens_worker")))


RUN = 256  # elements summed in one go by running_sums


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of longs, in blocks so that long arrays stay near linear."""

    def within(block: Column, start: Column) -> Column:
        first = F.array(start.cast("long"))
        sums = F.aggregate(block, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 2, F.greatest(F.size(block), F.lit(1)))

    def blocked(a: Column) -> Column:
        n_blocks = F.ceil(F.size(a) / F.lit(RUN)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(a, b * RUN + 1, RUN))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
        starts = F.aggregate(
            totals, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, n_blocks), within))

    empty = F.array().cast("array<long>")
    return F.when(F.size(numbers) == 0, empty).otherwise(let(numbers, blocked))


def matches(text: Column, pattern: str, may: Column, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (s, e, value), in code points, end exclusive.

    ``may`` is a cheap necessary condition; texts without it skip the search.
    The text between the matches comes from ``split`` with the same pattern,
    so positions are sums of lengths. ``value`` is the given group.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(parts: Column) -> Column:
        gap_lengths = F.transform(parts["gaps"], lambda g: F.length(g).cast("long"))
        hit_lengths = F.transform(parts["hits"], lambda h: F.length(h).cast("long"))
        steps = F.zip_with(F.slice(gap_lengths, 1, F.size(hit_lengths)), hit_lengths, lambda g, h: g + h)
        return F.zip_with(
            F.arrays_zip(running_sums(steps).alias("e"), hit_lengths.alias("n")),
            parts["values"],
            lambda p, v: F.struct((p["e"] - p["n"]).alias("s"), p["e"].alias("e"), v.alias("value")),
        )

    none = F.array().cast("array<struct<s:bigint,e:bigint,value:string>>")
    parts = F.struct(F.split(text, pattern).alias("gaps"), hits.alias("hits"), values.alias("values"))
    found = let(parts, lambda p: F.when(F.size(p["hits"]) == 0, none).otherwise(placed(p)))
    return F.when(F.coalesce(may, F.lit(False)), found).otherwise(none)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def kinded(kind: str, rank: int, spans: Column) -> Column:
    """Spans of ``matches`` marked with their kind and the kind's rank."""
    return F.transform(
        spans, lambda x: F.struct(F.lit(rank).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["value"].alias("value"))
    )
