"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every file is a row; its blob is the SHA-256 of its content.
The ledger holds the findings of each (blob, rule version) ever scanned. A run
scans only pairs that the ledger lacks, each distinct blob once, appends
them, and joins findings back to every path (row) that holds the blob. The
texts move once, to meet the list of blobs to scan; all else is narrow.

Defined results: a null text is an empty blob; copies share one scan; repeated
rows each get the findings; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tricklens.llm.common import kinded, matches

# The base kinds and their patterns, and the least length of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Further kinds, added to the base ones.
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
HOST_TOKEN = r"gh[oprsu]_[A-Za-z0-9]{36,}"
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "1"
SALTS = 32  # tasks that the rows of one blob are spread over when findings come back to them

LEDGER_SCHEMA = (
    "blob string, rule_version string, found array<struct<rank:int,s:bigint,e:bigint,kind:string,value:string>>"
)


def scan(text: Column) -> Column:
    """All spans of one text by start, then kind: array of (rank, s, e, kind, value)."""
    low = F.lower(text)
    said = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    assigned = F.filter(matches(text, ASSIGN, said, group=2), lambda x: F.length(x["value"]) >= ASSIGN_MIN)
    every = F.concat(
        kinded("assign", 0, assigned),
        kinded("access", 1, matches(text, ACCESS, text.contains("AKIA"))),
        kinded("hex", 2, matches(text, HEX, text.rlike(HEX))),
        kinded("private_key", 3, matches(text, PRIVATE_KEY, text.contains("PRIVATE KEY-----"))),
        kinded("web_token", 4, matches(text, WEB_TOKEN, text.contains("eyJ"))),
        kinded("host_token", 5, matches(text, HOST_TOKEN, text.rlike("gh[oprsu]_"))),
    )
    by_start = F.sort_array(F.transform(every, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"), x["value"].alias("value"))))
    return F.transform(by_start, lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["value"].alias("value")))


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger so far; a path that does not exist yet is an empty ledger."""
    if path is not None:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_versions(versions: DataFrame, path: Column, text: Column, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, found) for every row of ``versions``, after scanning what the ledger lacks.

    ``found`` is empty for a clean blob. ``path`` identifies the row (a file
    at a commit, a document id); it need not be unique.
    """
    spark = versions.sparkSession
    rows = versions.select(path.alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text"), 256))
    narrow = rows.select("path", "blob")
    known = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).select("blob")
    # One row stands for each blob that is new under these rules.
    fresh = narrow.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    fresh = fresh.withColumnsRenamed({"blob": "fresh_blob", "path": "fresh_path"})
    first = rows.join(fresh.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("fresh_path")) & (F.col("blob") == F.col("fresh_blob")), "left_semi")
    scanned = first.select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("text")).alias("found"))
    scanned.write.mode("append").parquet(ledger_path)
    # Rows that repeat path and blob, or a retried run, may have entered a blob twice: same findings.
    ledger = read_ledger(spark, ledger_path).where((F.col("rule_version") == rule_version) & (F.size("found") > 0))
    findings = ledger.select("blob", "found").dropDuplicates(["blob"])
    none = F.array().cast("array<struct<rank:int,s:bigint,e:bigint,kind:string,value:string>>")
    # A blob in very many places (a licence, an empty file) is dealt over SALTS tasks; its few findings go to each.
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    findings = findings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(findings, ["blob", "salt"], "left").select("path", "blob", F.coalesce("found", none).alias("found"))
