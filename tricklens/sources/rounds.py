"""Reading and writing round records.

Round records are JSON lines, one object per round (or any table with the
same columns, e.g. Parquet). The reader declares the schema: that saves the
inference pass over the input, and reading scores as text (cast later with
``try_cast``) keeps rounds whose scores are written as ``7``, ``"7"`` or
``7.0``. Hands and bids are read as text; a nested JSON value in those
fields arrives as its raw text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricklens.model import ROUND_COLUMNS, ROUNDS_SCHEMA

BAD_LINE = "_bad_line"  # a line that is no round record, as it stands


def read_rounds(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "json", infer_schema: bool = False, bad_lines: bool = False
) -> DataFrame:
    """Round records from ``path`` (or several).

    ``fmt`` is any Spark file format. ``json`` takes the explicit round schema,
    with ``bad_lines`` also a column ``BAD_LINE`` that holds each line that does
    not fit it. ``infer_schema`` takes every value in the type it has
    (``variant_rounds``); neither scans the input twice.
    """
    if fmt == "json" and infer_schema:
        return variant_rounds(spark.read.text(path))
    reader = spark.read.format(fmt)
    if fmt == "json":
        schema = T.StructType([*ROUNDS_SCHEMA.fields, T.StructField(BAD_LINE, T.StringType())]) if bad_lines else ROUNDS_SCHEMA
        reader = reader.schema(schema).option("columnNameOfCorruptRecord", BAD_LINE)
    rounds = reader.load(path)
    return rounds.withColumn(BAD_LINE, F.lit(None).cast("string")) if bad_lines and fmt != "json" else rounds


def variant_rounds(lines: DataFrame) -> DataFrame:
    """Round records from lines of JSON text (column ``value``), whatever types their values have.

    Each line is parsed once into a variant; its values come out as text, as the
    round columns are: 7, 7.0 and "7" alike, lists and objects as JSON text. Lines
    that are no JSON objects are left out.
    """
    parsed = lines.selectExpr("try_parse_json(value) AS v").where("schema_of_variant(v) LIKE 'OBJECT%'")
    texts = [f"try_variant_get(v, '$.{c}', 'string') AS {c}" for c in ROUND_COLUMNS]
    return parsed.selectExpr("try_variant_get(v, '$.round_id', 'bigint') AS round_id", *texts)


def inferred_types(lines: DataFrame) -> DataFrame:
    """(field, n_integer, n_fraction, n_text, n_other, inferred) over lines of JSON objects, in one pass.

    ``inferred`` is the type that takes all values of the field: integer,
    number, text, or mixed where no plain type does.
    """
    spark = lines.sparkSession
    parsed = lines.selectExpr("try_parse_json(value) AS v").where("schema_of_variant(v) LIKE 'OBJECT%'")
    values = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).selectExpr("key AS field", "value", "schema_of_variant(value) AS type")
    kinds = {
        "integer": "type = 'BIGINT'",
        "fraction": "type LIKE 'DECIMAL%' OR type IN ('DOUBLE', 'FLOAT')",
        "text": "type = 'STRING'",
    }
    counts = [f"count_if({test}) AS n_{k}" for k, test in kinds.items()]
    counts.append(f"count_if(NOT ({' OR '.join(f'({t})' for t in kinds.values())}) AND type <> 'VOID') AS n_other")
    merged = values.groupBy("field").agg(*[F.expr(c) for c in counts], F.expr("schema_of_variant_agg(value) AS merged"))
    return merged.selectExpr(
        "field", "n_integer", "n_fraction", "n_text", "n_other",
        "CASE WHEN merged = 'BIGINT' THEN 'integer' WHEN merged LIKE 'DECIMAL%' OR merged = 'DOUBLE' THEN 'number' "
        "WHEN merged = 'STRING' THEN 'text' ELSE 'mixed' END AS inferred",
    )


def write_rounds(rounds: DataFrame, path: str, fmt: str = "json") -> None:
    """Write rounds as-is (one file per task; overwrite)."""
    rounds.write.mode("overwrite").format(fmt).save(path)
