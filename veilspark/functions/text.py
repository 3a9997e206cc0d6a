"""Column functions: predicates, previews, entropy and sizes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.patterns import CONSTANT_NAME, LINE_BREAK


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def constant_table_name(name: Column | str) -> Column:
    """True for UPPER_SNAKE names (leading underscores allowed, one letter at least)."""
    return _col(name).rlike(CONSTANT_NAME)


def private_name(name: Column | str, language: Column | str) -> Column:
    """True for ``_name`` but not ``__name``; a lone ``_`` counts in Python only."""
    name, language = _col(name), _col(language)
    return name.rlike("^_[^_]") | ((name == "_") & (language == "python"))


def redact_preview(value: Column | str) -> Column:
    """Masked preview: up to 8 characters all stars, longer values keep four at each end."""
    v = _col(value)
    n = F.length(v)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(v, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(v, F.lit(4)))
    )


PREVIEW_SQL_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION redact_preview(v STRING) RETURNS STRING
RETURN CASE WHEN length(v) <= 8 THEN repeat('*', length(v))
            ELSE concat(left(v, 4), repeat('*', length(v) - 8), right(v, 4)) END
"""


def register_sql_functions(spark) -> None:
    """Expose ``redact_preview`` to SQL users; Catalyst inlines the body, no UDF call remains."""
    spark.sql(PREVIEW_SQL_FUNCTION)


def shannon_entropy(value: Column | str) -> Column:
    """Bits per character of a string, computed inside the row (no shuffle).

    The fold runs over the distinct characters only; each count is a length difference.
    """
    v = _col(value)
    n = F.length(v).cast("double")

    def add(acc: Column, ch: Column) -> Column:
        p = (F.length(v) - F.length(F.replace(v, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    chars = F.filter(F.array_distinct(F.split(v, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0).cast("double"), add)


def line_count(text: Column | str) -> Column:
    """Newlines, plus one for an unterminated last line."""
    t = _col(text)
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    tail = F.when((t == "") | t.endswith("\n"), 0).otherwise(1)
    return (newlines + tail).cast("bigint")


def split_lines(text: Column | str) -> Column:
    """Array of line bodies; a terminator at the end does not open another line."""
    t = _col(text)
    inner = F.regexp_replace(t, "(?:" + LINE_BREAK + r")\z", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(inner, LINE_BREAK, -1))


def reduction_pct(before: Column, after: Column) -> Column:
    """max(0, (1 - after/before) * 100), 0 for an empty input, rounded half-even to one decimal."""
    pct = F.when(before == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (F.lit(1.0) - after / before) * 100.0)
    )
    return F.bround(pct, 1)
