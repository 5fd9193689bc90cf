"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share ``total_share`` times the corpus; a target stops at ``cap`` times its
source's size and the excess is reshared by weight among the others.

Documents of a source are dealt to shards of bounded size, put in a seeded
order and laid end to end; each shard is cut into blocks of ``block`` tokens.
Blocks are allocated to sources, and within a source to its shards, by the
highest Sainte-Lague quotients votes / (2 seats + 1): integer quotas. A shard
with quota Q over n blocks takes every block floor(Q / n) times and a seeded,
evenly spread choice of Q mod n blocks once more. Which blocks those are is
arithmetic on positions, so no block table exists and nothing large moves:
one narrow shuffle of (document, size) to its shard.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own; rows with the same id and text share their
place in order and count each on its own; an empty table gives an empty
result. All order comes from MD5 of the seed and the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tricklens.llm.common import SPACE_CLASS, private_names, words

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CAP = 2
BLOCK = 64  # tokens
SHARD_DOCS = 2_000  # documents a shard holds on average: bounds the sort of one task
SEED = "mix"


def seeded(seed: str, *parts: Column) -> Column:
    """A long of 60 bits drawn from MD5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, cap=CAP) -> DataFrame:
    """(source, n_docs, source_size, weight, target), one row per source. Its windows run over sources, not documents."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    # Sources reach their cap in the order of cap x size / weight: find how many do.
    by_ratio = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    per = per.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    # The rate if all before this source are capped and it is not; true once it fits under this source's cap.
    rate = (F.lit(total_share) * F.col("all_size") - cap * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("rate", rate).withColumn("free", F.col("rate") * F.col("weight") <= cap * F.col("source_size"))
    first_free = F.min(F.when(F.col("free"), F.struct("size_before", "rate"))).over(everything)["rate"]
    capped = (cap * F.col("source_size")).cast("double")
    target = F.coalesce(F.least(capped, first_free * F.col("weight")), capped)
    return per.withColumn("target", target).select("source", "n_docs", "source_size", "weight", "target")


def quotas(votes: DataFrame, within: list[str], seats: Column) -> DataFrame:
    """Sainte-Lague: ``seats`` dealt among the rows of each group in proportion to ``votes`` (a column), by highest quotients.

    Adds ``quota``. Seats that proportion alone settles, round(share), are given
    at once; only the few quotients around each row's boundary are ranked.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    whole = votes.withColumn("seats", seats).withColumn("all_votes", F.sum("votes").over(group)).withColumn("n_rows", F.count("*").over(group))
    share = F.when(F.col("all_votes") > 0, F.col("seats") * F.col("votes") / F.col("all_votes")).otherwise(0.0)
    whole = whole.withColumn("share", share)
    # The divisor moves by at most n_rows / 2 seats in all, so a row's boundary moves by its part of that and one.
    slack = F.when(F.col("seats") > 0, F.ceil(F.col("share") * F.col("n_rows") / F.col("seats"))).otherwise(0) + 2
    whole = whole.withColumn("sure", F.greatest(F.floor(F.col("share")) - slack, F.lit(0)).cast("long")).withColumn("slack", slack.cast("long"))
    ranked = whole.withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("slack") + 1)))
    keys = [c for c in votes.columns if c != "votes"]
    by_quotient = group.orderBy((F.col("votes") / (2 * F.col("seat") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in keys])
    sure_total = whole.groupBy(*within).agg(F.sum("sure").alias("all_sure"), F.max("seats").alias("to_deal"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_quotient))
    same = F.lit(True)
    for k in within:
        same = same & ranked[k].eqNullSafe(sure_total[k])
    won = ranked.join(sure_total.select(*[sure_total[k] for k in within], "all_sure", "to_deal"), same).where(
        (F.col("rank") <= F.col("to_deal") - F.col("all_sure")) & (F.col("votes") > 0)
    )
    return won.select(*[ranked[k] for k in keys], "seat").groupBy(*keys).agg((F.max("seat") + 1).alias("quota"))


def mixed(docs: DataFrame, text: str = "text", block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED, store=None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, and the block arithmetic) of every row of ``docs``."""
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sizes = docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"), digest.alias("digest"))
    sizes = store(sizes) if store else sizes
    goal = targets(sizes)
    goal = store(goal) if store else goal
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(shard_docs))).cast("long")
    dealt = sizes.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    dealt = dealt.withColumn("draw", seeded(seed, F.col("doc_id"))).withColumn("shard", F.col("draw") % n_shards)
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
    )
    shards = store(shards) if store else shards
    # Seats of each source, then of each shard within its source.
    all_seats = F.round(F.sum("votes").over(W.partitionBy(F.lit(0))) / block).cast("long")
    source_quota = quotas(goal.select("source", F.col("target").alias("votes")), [], all_seats).withColumnsRenamed(
        {"source": "q_source", "quota": "source_quota"}
    )
    sized = shards.join(source_quota, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    shard_votes = sized.select("source", "shard", "source_quota", F.col("shard_size").cast("double").alias("votes"))
    shard_quota = quotas(shard_votes, ["source"], F.col("source_quota"))
    quota = shards.withColumnsRenamed({"source": "s_source", "shard": "s_shard"}).join(
        shard_quota, F.col("s_source").eqNullSafe(F.col("source")) & (F.col("s_shard") == F.col("shard")), "left"
    )
    blocks = F.ceil(F.col("shard_size") / F.lit(block)).cast("long")
    # A block may be taken ``CAP`` times at most, so no document exceeds CAP times its size.
    quota = quota.select("s_source", "s_shard", blocks.alias("blocks"), F.least(F.coalesce("quota", F.lit(0)), CAP * blocks).alias("quota"))
    place = W.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", "digest").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(place)).withColumn("begin", F.col("end") - F.col("size"))
    placed = placed.join(quota, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard"))).drop("s_source", "s_shard")
    n = F.col("blocks")
    placed = placed.withColumn("times", F.when(n > 0, F.floor(F.col("quota") / n)).otherwise(0).cast("long"))
    placed = placed.withColumn("extra", F.col("quota") - F.col("times") * n)
    placed = placed.withColumn("turn", F.when(n > 0, seeded(seed + "-turn", F.col("source"), F.col("shard")) % n).otherwise(0))
    once_more = extra_words(F.col("end"), block) - extra_words(F.col("begin"), block)
    placed = placed.withColumn("taken", F.when(n > 0, F.col("times") * F.col("size") + once_more).otherwise(0).cast("long"))
    return placed.select("doc_id", "source", "digest", "size", "source_size", "target", "taken", "times", "begin", "end", "blocks", "extra", "turn")


def chosen_before(k: Column, field=F.col) -> Column:
    """How many of a shard's first ``k`` blocks are taken once more: evenly spread, from a seeded turn."""
    return F.floor((k * field("extra") + field("turn")) / field("blocks")).cast("long")


def extra_words(position: Column, block: int) -> Column:
    """Words of the blocks taken once more that lie before a position of the shard."""
    k = F.floor(position / F.lit(block)).cast("long")
    chosen = chosen_before(k)
    return chosen * block + (chosen_before(k + 1) - chosen) * (position - k * block)


def mix(docs: DataFrame, text: str = "text", block: int = BLOCK, seed: str = SEED, store=None) -> DataFrame:
    """The mix itself: every document as often as its blocks are taken, whole, and the parts in blocks taken once more.

    Columns are those of ``docs``. The texts stay in place: the decisions, a
    few longs a document, are joined to them by id, source and a digest of the
    text, so rows that share an id alone keep decisions of their own. Rows that
    repeat all three share one, the first in order (drop copies first).
    """
    taken = mixed(docs, text, block=block, seed=seed, store=store)
    plan, key, of, sign, parts, copy = private_names(docs, "mix_plan", "mix_id", "mix_source", "mix_digest", "mix_parts", "mix_copy")
    decision = F.struct("begin", "end", "size", "times", "blocks", "extra", "turn")
    taken = taken.groupBy(F.col("doc_id").alias(key), F.col("source").alias(of), F.col("digest").alias(sign)).agg(F.min(decision).alias(plan))
    same = docs["doc_id"].eqNullSafe(F.col(key)) & docs["source"].eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(sign))
    rows = docs.join(taken, same).drop(key, of, sign)
    rows = rows.withColumn(parts, F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS[1:-1]}]+{SPACE_CLASS}*"), F.lit(0)))
    field = lambda name: F.col(plan)[name]
    begin, end = field("begin"), field("end")
    ks = F.sequence(F.floor(begin / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    again = F.filter(ks, lambda k: chosen_before(k + 1, field) > chosen_before(k, field))

    def cut(k: Column) -> Column:
        first, last = F.greatest(k * block, begin) - begin, F.least((k + 1) * block, end) - begin
        return F.array_join(F.slice(F.col(parts), (first + 1).cast("int"), (last - first).cast("int")), "")

    part = F.array_join(F.transform(again, cut), "")
    whole = F.array_repeat(F.col(text), field("times").cast("int"))
    copies = F.when(field("size") > 0, F.concat(whole, F.filter(F.array(part), lambda x: x != "")))
    rows = rows.withColumn(copy, F.explode(copies))
    return rows.select(*[F.col(copy).alias(c) if c == text else F.col(c) for c in docs.columns])
