"""Personal data by patterns, and terms that disclose it by corpus co-occurrence.

Base spans (e-mail, IP, card, phone) name the protected entities. A term of the
documents that hold an entity discloses it when the corpus says so: with n
documents in all, the term's pointwise mutual information with the
entity, log(n n_te / (n_t n_e)), reaches the share ``ALPHA`` of the entity's
own information log(n / n_e), on at least ``SUPPORT`` documents. Wherever such a
term stands in those documents, however far from the entity, it is a span of kind "term"; sanitising
generalises it (a number, a name) or removes it, as it masks the base spans.

The corpus counts cover all documents and whole texts: distinct terms per document are summed
on the map side, and only then meet the candidate terms. Texts are kept for the
second look only where they hold personal data.

Defined results: a null or empty text has no spans; repeated rows get the same
spans; rows are matched back by id and content, so equal ids with other texts
stay apart; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricklens.llm.common import kinded, let, matches, private_names

# The base patterns. Possessive steps and \G give the same matches as the plain
# patterns, without rescanning long runs of characters that cannot match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_VALID = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
BASE_KINDS = ("email", "ip", "card", "phone")

TERM = r"[\p{L}\p{N}]+"
NOT_TERM = r"[^\p{L}\p{N}]+"
ALPHA = 0.75
SUPPORT = 2

SPANS = "array<struct<rank:int,s:bigint,e:bigint,kind:string,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans by kind, then start: array of (rank, s, e, kind, value)."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]+", "")
    ips = F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: x["value"].rlike(IP_VALID))
    may_card = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    cards = F.filter(
        matches(text, CARD, may_card), lambda x: let(digits(x), lambda d: F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19)))
    )
    phones = F.filter(matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(digits(x)).between(9, 15))
    return F.concat(
        kinded("email", 0, matches(text, EMAIL, text.contains("@"))), kinded("ip", 1, ips), kinded("card", 2, cards), kinded("phone", 3, phones)
    )


def entity(span: Column) -> Column:
    """What makes two mentions the same entity: lower-cased e-mail, else the digits (and dots)."""
    return F.concat_ws(
        ":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9.]+", ""))
    )


def term_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_t): documents that hold each term, over all documents and whole texts."""
    terms = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_TERM))
    return docs.select(F.explode(terms).alias("term")).where(F.col("term") != "").groupBy("term").agg(F.count("*").alias("n_t"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced; overlapping spans become one, named after the first."""

    def mark(x: Column) -> Column:
        term = F.when(x["value"].rlike(r"^\p{N}+$"), "[NUMBER]").when(x["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.when(x["kind"] == "term", term).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(state: Column, x: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (x["s"] - state["at"]).cast("int"))
        return F.when(x["s"] >= state["at"], F.struct(x["e"].alias("at"), F.concat(state["out"], F.array(gap, mark(x))).alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], x["e"]).alias("at"), state["out"].alias("out"))
        )

    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"), x["value"].alias("value"))))
    rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start, start, put, rest))


def outside(terms: Column, base: Column) -> Column:
    """The terms that touch no base span (those within one are covered by it)."""
    return F.filter(terms, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))


def disclosures(docs: DataFrame, text: str, store, n: int | None = None, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(doc_id, sha, t, spans) of the different rows with base spans: these, then every mention of a term that
    discloses an entity of the row, by kind and start; ``t`` is the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    spanned = docs.select("doc_id", t.alias("t")).withColumn("base", base_spans(F.col("t"))).where(F.size("base") > 0)
    terms = F.array_distinct(F.transform(outside(matches(F.col("t"), TERM, F.lit(True)), F.col("base")), lambda x: F.lower(x["value"])))
    entities = F.array_distinct(F.transform("base", entity))
    found = spanned.select("doc_id", F.sha2("t", 256).alias("sha"), "t", "base", entities.alias("entities"), terms.alias("terms"))
    found = store(found.dropDuplicates(["doc_id", "sha"]))
    n = docs.count() if n is None else n
    information = F.log(F.lit(float(n)) / F.col("n_e"))
    n_e = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # An entity on fewer documents than the support, or on all, has no disclosing term.
    n_e = store(n_e.where((F.col("n_e") >= support) & (information > 0)))
    held = found.select("doc_id", "sha", F.explode("entities").alias("entity"), "terms").join(n_e.select("entity"), "entity", "left_semi")
    each = held.select("doc_id", "sha", "entity", F.explode("terms").alias("term"))
    together = each.groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    pmi = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    scored = together.join(n_e, "entity").join(term_documents(docs, text), "term")
    pairs = store(scored.where(pmi >= alpha * information).select("entity", "term"))
    hits = each.join(pairs, ["entity", "term"], "left_semi").groupBy("doc_id", "sha").agg(F.collect_set("term").alias("disclosing"))
    hits = store(hits).withColumnsRenamed({"doc_id": "hit_id", "sha": "hit_sha"})
    both = found.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sha") == F.col("hit_sha")), "left")
    told = F.col("disclosing")
    mentioned = F.filter(matches(F.col("t"), TERM, told.isNotNull()), lambda x: F.array_contains(told, F.lower(x["value"])))
    spans = F.concat("base", kinded("term", len(BASE_KINDS), outside(mentioned, F.col("base")))).cast(SPANS)
    return both.select("doc_id", "sha", "t", spans.alias("spans"))


def spans_of(docs: DataFrame, text: str, store, n: int | None = None) -> DataFrame:
    """(doc_id, sha, spans) of every row: base spans, then term spans, by kind and start."""
    found = disclosures(docs, text, store, n).select(F.col("doc_id").alias("hit_id"), F.col("sha").alias("hit_sha"), "spans")
    rows = docs.select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sha") == F.col("hit_sha")), "left")
    return met.select("doc_id", "sha", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def sanitised(docs: DataFrame, text: str, store) -> DataFrame:
    """``docs``, all rows and columns, with personal data and disclosing terms replaced in the texts."""
    i, h, new = private_names(docs, "span_id", "span_sha", "masked")
    found = store(disclosures(docs, text, store).select(F.col("doc_id").alias(i), F.col("sha").alias(h), masked(F.col("t"), F.col("spans")).alias(new)))
    sha = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    rows = docs.join(found, docs["doc_id"].eqNullSafe(F.col(i)) & (sha == F.col(h)), "left")
    return rows.select(*[F.coalesce(F.col(new), docs[text]).alias(c) if c == text else docs[c] for c in docs.columns])
