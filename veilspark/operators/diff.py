"""Redaction statistics. Only sizes and counters are joined; the texts stay where they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import line_count, reduction_pct
from veilspark.operators.context import body_markers, redact_file
from veilspark.operators.files import route_files
from veilspark.operators.text_tables import KEY

# Fixed value: how the statistics recognise a table declaration, from the start of its own line.
JS_TABLE = r"(?m)^[^\S\n]*+(?:const|let|var)\s+([A-Z_][A-Z0-9_]*)\s*=\s*[\{\[]"

COUNTERS = ("function_bodies_redacted", "tables_redacted", "docstrings_stripped", "enum_classes_aliased")


def _js_tables(text):
    names = F.regexp_extract_all(text, F.lit(JS_TABLE), F.lit(1))
    return F.size(F.filter(names, lambda n: F.replace(n, F.lit("_"), F.lit("")) != "")).cast("bigint")


def js_table_count(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(key, tables)``: upper-case collection declarations of JS/TS texts, by a line pattern."""
    return route_files(corpus).where("route = 'js'").select(*key, _js_tables(F.col("text")).alias("tables"))


def marker_counts(redacted: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(key, bodies)`` of redacted JS/TS texts: all markers less the value markers."""
    return redacted.select(*key, body_markers().alias("bodies"))


def _sized(df: DataFrame, key: Sequence[str], side: str) -> DataFrame:
    return df.select(
        *key,
        F.octet_length("text").cast("bigint").alias(f"bytes_{side}"),
        line_count("text").alias(f"lines_{side}"),
    )


def diff_files(before: DataFrame, after: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Bytes and lines before and after, deltas, and the reduction in percent."""
    joined = _sized(before, key, "before").join(_sized(after, key, "after"), list(key), "left")
    return _deltas(joined)


def _deltas(df: DataFrame) -> DataFrame:
    b, a = F.col("bytes_before"), F.col("bytes_after")
    return (
        df.fillna(0, ["bytes_before", "bytes_after", "lines_before", "lines_after"])
        .withColumn("bytes_delta", a - b)
        .withColumn("lines_delta", F.col("lines_after") - F.col("lines_before"))
        .withColumn("reduction_pct", reduction_pct(b, a))
    )


def diff_counts(corpus: DataFrame, strict: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """Per supported file: bodies, tables, docstrings and enum classes that the view redacts."""
    view = redact_file(corpus, strict, key=key).where("route <> 'unsupported'")
    js = js_table_count(corpus, key).withColumnRenamed("tables", "js_tables")
    # The counts grow with the corpus: they are merged, not sent through the driver.
    joined = view.drop("text").join(js.hint("merge"), list(key), "left")
    tables = F.when(F.col("route") == "js", F.coalesce(F.col("js_tables"), F.lit(0))).otherwise(F.col("tables"))
    return joined.select(
        *key,
        "language",
        F.col("bodies").alias(COUNTERS[0]),
        tables.cast("bigint").alias(COUNTERS[1]),
        F.col("docstrings").alias(COUNTERS[2]),
        F.col("enums").alias(COUNTERS[3]),
        "error",
    )


def diff_context(corpus: DataFrame, strict: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """The whole per-file report: sizes, deltas, counters and errors of the redacted view.

    The texts are redacted once; the sizes before and the table counts travel as numbers.
    """
    k = list(key)
    view = redact_file(corpus, strict, key=key).where("route <> 'unsupported'")
    after = view.select(
        *k,
        "language",
        "error",
        F.col("bodies").alias(COUNTERS[0]),
        F.when(F.col("route") == "js", F.lit(None)).otherwise(F.col("tables")).alias("py_tables"),
        F.col("docstrings").alias(COUNTERS[2]),
        F.col("enums").alias(COUNTERS[3]),
        F.octet_length("text").cast("bigint").alias("bytes_after"),
        line_count("text").alias("lines_after"),
    )
    before = route_files(corpus).where("route <> 'unsupported'").select(
        *k,
        F.octet_length("text").cast("bigint").alias("bytes_before"),
        line_count("text").alias("lines_before"),
        _js_tables(F.col("text")).alias("js_tables"),
    )
    joined = after.join(before.hint("merge"), k, "left")
    tables = F.coalesce("py_tables", "js_tables", F.lit(0)).cast("bigint")
    return _deltas(joined.withColumn(COUNTERS[1], tables)).select(
        *k,
        "language",
        "bytes_before",
        "bytes_after",
        "bytes_delta",
        "lines_before",
        "lines_after",
        "lines_delta",
        *COUNTERS,
        "reduction_pct",
        "error",
    )


def diff_totals(diff: DataFrame) -> DataFrame:
    """One row of sums. The reduction comes from the summed bytes; files with an error are only counted."""
    ok = F.col("error").isNull()

    def total(c: str):
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint").alias(c)

    sums = diff.agg(
        F.count("*").alias("files"),
        F.count_if(~ok).alias("files_with_error"),
        total("bytes_before"),
        total("bytes_after"),
        *[total(c) for c in COUNTERS],
    )
    return sums.withColumn("reduction_pct", reduction_pct(F.col("bytes_before"), F.col("bytes_after")))
