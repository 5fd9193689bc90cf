"""Spelling variants by asymmetric q-chunks: the shorter word gives chunks, the other its positional grams.

Two words are near if one inserted, deleted or replaced code point makes them
equal. A word of length L is cut into two disjoint chunks, its halves. One edit
touches at most one of them, so against a near word of length L or L + 1 a
chunk survives: the first half at its own place, or the second half moved by
the difference of the lengths (a shift of at most one). The other word
therefore posts its positional grams where a chunk may have survived (a gram
elsewhere cannot be the chunk), and an equi-join on (L, place, gram) finds
every near pair. Halves alone are shared by very many words, so the half that
was touched is cut in two again by the same argument: of its quarters one
survives as well, at its place from the word's start or end. A posting is thus
(L, slot, half and quarter that survive), four slots a word and length; it says
"the code points outside quarter ``slot`` are equal". Every candidate is
verified by its edit distance; pairs that meet in several slots count in the first.

Keys held by more than ``BLOCK`` words on either side are dealt out in blocks
of both sides, so that a stem of very many words fills many tasks. Counts of
words are summed on the map side before any shuffle; no text and no list of a
word's partners ever moves.

A word's form is its most frequent near word if that is at least ``RATIO``
times as frequent (ties: smallest in code-point order). Frequencies at least
double from form to form, so chains end; roots come by pointer doubling.

Defined results: a null or empty text has no runs; repeated rows count each; a
null id reads as the empty text in the garbling of ``word_counts``; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = r"[a-zÀ-ÿ]"  # once A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 5, 3
RATIO = 2
BLOCK = 1024
SLOTS = 4


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", garble: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased, of at least MIN_LENGTH code points and MIN_COUNT occurrences.

    With ``garble`` a run loses the code point h % length where ``garble``
    divides h, the CRC-32 of ``<doc_id>:<run>`` (made misspellings to find again).
    """
    # Shorter runs make no word, whether garbled or not.
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN + f"{{{MIN_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("of"), F.explode(runs).alias("word"))
    if garble is not None:
        h = F.crc32(F.concat_ws(":", "of", "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        each = each.withColumn("h", h).select(F.when(F.col("h") % garble == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = each.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LENGTH))


def kept_ends(length: Column) -> list[tuple[Column, Column]]:
    """Per slot, how many code points at the start and at the end survive an edit in that slot's quarter."""
    half = F.floor(length / 2).cast("int")
    early, late = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
    none = F.lit(0)
    return [(late, none), (half, length - late), (early, length - half), (none, length - early)]


def ends(word: Column, kept: tuple[Column, Column]) -> Column:
    """The surviving code points at the start and at the end of a word, as one struct."""
    head, tail = kept
    return F.struct(F.substring(word, F.lit(1), head).alias("head"), F.substring(word, F.length(word) - tail + 1, tail).alias("tail"))


def postings(words: DataFrame, longer: int) -> DataFrame:
    """(key, slot, word, n): the keys under which a word meets those that are ``longer`` code points shorter."""
    length = F.length("word") - longer
    keys = [F.struct(F.lit(s).alias("slot"), F.xxhash64(length, F.lit(s), ends(F.col("word"), k)).alias("key")) for s, k in enumerate(kept_ends(length))]
    return words.select("word", "n", F.inline(F.array(*keys)))


def blocked(chunks: DataFrame, grams: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``cell``: keys of many words meet in cells of about BLOCK x BLOCK rows."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.count("*").alias(name)).where(F.col(name) > BLOCK)

    many = tally(chunks, "n_c").join(tally(grams, "n_g"), "key", "full")
    parts = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(1)) / BLOCK).cast("int")
    many = store(many.select(F.col("key").alias("hot"), parts("n_c").alias("rows"), parts("n_g").alias("columns")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        met = df.join(many, F.col("key") == F.col("hot"), "left")
        mine = F.pmod(F.xxhash64("word"), F.coalesce(F.col(own), F.lit(1)))
        met = met.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        cell = (F.col("mine"), F.col("theirs").cast("long")) if own == "rows" else (F.col("theirs").cast("long"), F.col("mine"))
        return met.select("key", "slot", "word", "n", F.struct(cell[0].alias("r"), cell[1].alias("c")).alias("cell"))

    return dealt(chunks, "rows", "columns"), dealt(grams, "columns", "rows")


def near_pairs(words: DataFrame, store) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once, a the shorter one (or the smaller of two equally long)."""
    chunks = postings(words, 0)
    grams = chunks.unionByName(postings(words.where(F.length("word") > MIN_LENGTH), 1))
    chunks, grams = blocked(chunks, grams, store)
    names = {"word": "b", "n": "n_b", "slot": "slot_b", "key": "key_b", "cell": "cell_b"}
    met = chunks.withColumnsRenamed({"word": "a", "n": "n_a"}).join(
        grams.withColumnsRenamed(names),
        (F.col("key") == F.col("key_b"))
        & (F.col("cell") == F.col("cell_b"))
        & (F.col("slot") == F.col("slot_b"))
        & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))),
    )
    # A hash says nothing alone: the pair counts in the first slot in which its ends are truly equal.
    equal = [ends(F.col("a"), k) == ends(F.col("b"), k) for k in kept_ends(F.length("a"))]
    first = reduce(lambda rest, s: F.when(equal[s], s).otherwise(rest), reversed(range(SLOTS)), F.lit(SLOTS))
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return met.where(near & (first == F.col("slot"))).select("a", "n_a", "b", "n_b")


def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    of = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), best).withColumnRenamed("word", "of")
    met = words.join(of, F.col("word") == F.col("of"), "left")
    n = -F.col("best.minus")
    better = n >= RATIO * F.col("n")
    return met.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best.near")).alias("form"), F.when(better, n).alias("form_n"),
    )


def with_roots(formed: DataFrame, store) -> DataFrame:
    """``formed`` (stored) with ``root``: where following the forms ends. Each round doubles the steps taken."""
    hops = store(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = hops.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = store(hops.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    roots = hops.withColumnsRenamed({"word": "of", "root": "found"})
    return formed.join(roots, F.col("word") == F.col("of"), "left").select(*formed.columns, F.coalesce("found", "word").alias("root"))


def variants(words: DataFrame, store) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n); ``store`` writes and rereads a table."""
    words = store(words)
    formed = store(with_forms(words, near_pairs(words, store)))
    return with_roots(formed, store).select("word", "form", "root", "n", "n_near", "form_n")
