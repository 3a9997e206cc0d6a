"""Lines, tokens, nesting and definitions: the relational views of a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.paths import language
from veilspark.functions.patterns import JS_BRACKET, JS_TOKEN, PY_BRACKET, PY_TOKEN
from veilspark.functions.text import split_lines

OPENERS = ("(", "[", "{")
CLOSERS = (")", "]", "}")
KEY = ("path",)


def lines(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, ln, line)`` with 1-based line numbers, cut at every line boundary Python knows."""
    return corpus.select(*key, F.posexplode(split_lines("text")).alias("ln", "line")).select(
        *key, (F.col("ln") + 1).cast("bigint").alias("ln"), "line"
    )


def _by_language(text: Column, path: Column, python: str, other: str) -> Column:
    return F.when(language(path) == "python", F.regexp_extract_all(text, F.lit(python), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(other), F.lit(0))
    )


def tokens(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, pos, tok)``: concatenating the tokens of a path in order gives its text."""
    toks = _by_language(F.col("text"), F.col("path"), PY_TOKEN, JS_TOKEN)
    return corpus.select(*key, F.posexplode(toks).alias("pos", "tok")).select(
        *key, F.col("pos").cast("bigint").alias("pos"), "tok"
    )


def nesting(toks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Add ``depth`` and ``close_pos`` to tokens.

    An opener and its closer carry the depth inside the pair; other tokens the number of pairs around them.
    ``close_pos`` of an opener is the position of its closer. The next closer is found on a descending
    order: a frame that grows backwards is evaluated once per row.
    """
    step = F.when(F.col("tok").isin(*OPENERS), 1).when(F.col("tok").isin(*CLOSERS), -1).otherwise(0)
    by_pos = Window.partitionBy(*key).orderBy("pos")
    run = F.sum(step).over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    depth = run + F.when(F.col("tok").isin(*CLOSERS), 1).otherwise(0)
    leveled = toks.withColumn("depth", depth.cast("bigint"))
    back = Window.partitionBy(*key, "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    closer = F.last(F.when(F.col("tok").isin(*CLOSERS), F.col("pos")), ignorenulls=True).over(back)
    return leveled.withColumn("close_pos", F.when(F.col("tok").isin(*OPENERS), closer))


def _fold_brackets(text: Column, is_python: bool, finish) -> Column:
    """Run over the brackets of a text, inside the row, keeping the lowest and the last depth."""
    pattern = PY_BRACKET if is_python else JS_BRACKET
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, t: Column) -> Column:
        # Strings and comments are matched as well and leave the depth as it is.
        last = acc["last"] + F.when(t.isin(*OPENERS), 1).when(t.isin(*CLOSERS), -1).otherwise(0)
        return F.struct(F.least(acc["low"], last).alias("low"), last.alias("last"))

    return F.aggregate(found, F.struct(F.lit(0).alias("low"), F.lit(0).alias("last")), step, finish)


def bracket_balance(text: Column, is_python: bool) -> Column:
    """Struct of the lowest and the last bracket depth."""
    return _fold_brackets(text, is_python, lambda acc: acc)


def bracket_error(text: Column, is_python: bool) -> Column:
    """'unbalanced brackets', or null. A null text has no error."""
    return _fold_brackets(
        text,
        is_python,
        lambda acc: F.when((acc["low"] < 0) | (acc["last"] != 0), F.lit("unbalanced brackets")),
    )


def unbalanced_files(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, low, last, error)`` of the texts whose brackets do not match. No shuffle."""
    text = F.col("text")
    both = F.when(language(F.col("path")) == "python", bracket_balance(text, True)).otherwise(
        bracket_balance(text, False)
    )
    balance = corpus.select(*key, both.alias("b"))
    return balance.where("b.low < 0 OR b.last <> 0").select(
        *key,
        F.col("b.low").cast("bigint").alias("low"),
        F.col("b.last").cast("bigint").alias("last"),
        F.lit("unbalanced brackets").alias("error"),
    )
