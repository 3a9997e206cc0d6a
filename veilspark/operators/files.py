"""Row-local operators on paths: ignore rules, language, routing, relative paths, sensitive paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.paths import DEFAULT_IGNORES, glob_regex, ignored, language, relative_to


def exclude_paths(df: DataFrame, extra: Iterable[str] = (), path: str = "path") -> DataFrame:
    """Drop rows whose path is ignored by the default globs and the ``extra`` lines (last match wins)."""
    return df.where(~ignored(F.col(path), [*DEFAULT_IGNORES, *extra]))


def with_language(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``language``. A column of that name is kept: a corpus stored by language stays prunable."""
    return df if "language" in df.columns else df.withColumn("language", language(F.col(path)))


def route_files(df: DataFrame) -> DataFrame:
    """Add ``route``: python, js or unsupported."""
    df = with_language(df)
    lang = F.col("language")
    route = F.when(lang == "python", "python").when(lang.isNotNull(), "js").otherwise("unsupported")
    return df.withColumn("route", route)


def relative_path(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Replace the path by its part below ``root``; other paths stay."""
    return df.withColumn(path, relative_to(F.col(path), root))


def tag_sensitive_paths(df: DataFrame, globs: Iterable[str], path: str = "path") -> DataFrame:
    """Add ``sensitive``: does any glob match the path?"""
    regexes = [f"(?:{glob_regex(g)})" for g in globs]
    hit = F.col(path).rlike("|".join(regexes)) if regexes else F.lit(False)
    return df.withColumn("sensitive", hit)
