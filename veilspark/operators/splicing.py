"""Rewriting a text by unit positions: the edits are a table, the cutting happens inside the row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import JS_HEAD, JS_UNIT, PY_HEAD, PY_UNIT
from veilspark.operators.text_tables import KEY


@dataclass(frozen=True)
class Lexer:
    """A unit regex (a significant token with the blanks after it) and the regex of the token alone."""

    unit: str
    token: str

    def units(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.unit), F.lit(0))

    def head(self, unit: Column) -> Column:
        return F.regexp_extract(unit, self.token, 0)


JS_LEXER = Lexer(JS_UNIT, JS_HEAD)
PY_LEXER = Lexer(PY_UNIT, PY_HEAD)


def by_key(corpus: DataFrame, key: Sequence[str] = KEY, clustered: bool = False) -> DataFrame:
    """Place each text by its key before it is cut up: the shuffle moves the text once, not its tokens.

    ``clustered`` is for a corpus that already is partitioned so (a bucketed table, an earlier ``by_key``).
    The key is made non-null, which lets both branches of a plan share this exchange. The partition count is
    the session's, given explicitly: adaptive execution would merge partitions by their compressed text,
    which says little about the token rows that come out of it.
    """
    keyed = corpus.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in key})
    if clustered:
        return keyed
    return keyed.repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


#: Tells rows with the same key apart, so that no window ever meets two texts.
ROW = "__row"


def by_row(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``by_key`` with a column ``ROW`` that numbers the rows of a key in the order of their texts' hashes.

    A key should name one text. Where it doesn't, its rows are numbered and rewritten each for itself; rows that
    are equal in all are interchangeable, so a task that runs again gives the same table. The numbering sorts
    within the placement by key and moves nothing.
    """
    own = Window.partitionBy(*key).orderBy(F.xxhash64("text"), "text")
    return by_key(corpus, key).withColumn(ROW, F.row_number().over(own).cast("string"))


def splice(units: Column, edits: Column, lexer: Lexer) -> Column:
    """Replace unit ranges: ``edits`` is a sorted array of ``(a, b, with)``; the blanks after ``b`` stay."""
    n = F.size(units)

    def piece(e: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.element_at(edits, F.greatest(i, F.lit(1)))["b"] + 1)
        last = F.element_at(units, F.least(e["b"] + 1, n))
        after = F.substring(last, F.length(lexer.head(last)) + 1, F.length(last))
        gap = F.slice(units, start + 1, F.greatest(e["a"] - start, F.lit(0)))
        return F.concat(F.array_join(gap, ""), e["with"], after)

    last_b = F.element_at(edits, -1)["b"]
    tail = F.slice(units, F.least(last_b + 2, n + 1), F.greatest(n - last_b - 1, F.lit(0)))
    return F.concat(F.array_join(F.transform(edits, piece), ""), F.array_join(tail, ""))


def apply_edits(base: DataFrame, edits: DataFrame, lexer: Lexer, key: Sequence[str] = KEY) -> DataFrame:
    """Splice edits ``(key, a, b, with)`` into the texts of ``base``; texts without edits are not touched.

    The edits grow with the corpus, of which its file's size tells little: they are merged, not sent through the driver. Where
    the key holds ``ROW`` both sides are dealt once more for that.
    """
    k = list(key)
    grouped = edits.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("a", "b", "with"))).alias("edits"))
    edited = F.col("edits").isNotNull()
    joined = base.join(grouped.hint("merge"), k, "left").withColumn("units", F.when(edited, lexer.units(F.col("text"))))
    text = F.when(edited, splice(F.col("units"), F.col("edits"), lexer)).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop("units", "edits")
