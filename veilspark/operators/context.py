"""Redacted views of source files: per-construct operators, the composed view and the context document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.paths import language
from veilspark.functions.patterns import MARKER, VALUE_MARKER
from veilspark.operators import js_code, python_code
from veilspark.operators.files import route_files
from veilspark.operators.python_syntax import python_error
from veilspark.operators.splicing import ROW, by_row
from veilspark.operators.text_tables import KEY
from veilspark.session import ensure_checkpoint_dir, once

ENGINE = "veilspark 0.1.0"

Rewrite = Callable[[DataFrame, Sequence[str]], DataFrame]


def _routed(corpus: DataFrame, key: Sequence[str], python: Rewrite | None, js: Rewrite | None) -> DataFrame:
    """Rewrite the rows of each language and pass the others through: ``(key, text)`` for every row.

    Each branch reads the rows of its language; a corpus stored by language is read once in all.
    """
    k = list(key)
    routed = route_files(corpus).select(*k, "text", "route")
    readable = F.col("text").isNotNull()
    out, done = None, F.lit(False)
    for name, rewrite in (("python", python), ("js", js)):
        if rewrite is None:
            continue
        mine = (F.col("route") == name) & readable
        part = rewrite(by_row(routed.where(mine).select(*k, "text"), key), [*k, ROW]).select(*k, "text")
        out = part if out is None else out.unionByName(part)
        done = done | mine
    return out.unionByName(routed.where(~done).select(*k, "text"))


def redact_indented_bodies(corpus: DataFrame, keep_docstrings: bool = True, key: Sequence[str] = KEY) -> DataFrame:
    """Python function and method bodies become an optional docstring and ``...``."""
    docs = "keep" if keep_docstrings else "strip"

    def rewrite(df: DataFrame, own: Sequence[str]) -> DataFrame:
        return python_code.render(df, own, bodies=True, docstrings=docs)

    return _routed(corpus, key, rewrite, None)


def redact_brace_bodies(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """JS/TS bodies become ``{ marker }``, arrow expressions ``marker null``; all else is byte-identical."""
    return _routed(corpus, key, None, lambda df, own: js_code.render(df, own, bodies=True))


def redact_constant_tables(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """UPPER_SNAKE collections: ``NAME = ...`` in Python, ``NAME = marker null`` in JS/TS."""
    return _routed(
        corpus,
        key,
        lambda df, own: python_code.render(df, own, tables=True),
        lambda df, own: js_code.render(df, own, tables=True),
    )


def strip_docstrings(corpus: DataFrame, empty: str = "pass", key: Sequence[str] = KEY) -> DataFrame:
    """Drop module, class and function docstrings; an emptied body becomes ``empty``."""
    return _routed(corpus, key, lambda df, own: python_code.render(df, own, docstrings="strip", empty=empty), None)


def alias_enums(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Members of enum classes become ``VALUE_i = 'Vi'``."""
    return _routed(corpus, key, lambda df, own: python_code.render(df, own, enums=True), None)


def redact_file(
    corpus: DataFrame,
    strict: bool = False,
    keep_docstrings: bool = True,
    alias_enums: bool = False,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """The redacted view of every file.

    Columns: key, ``language``, ``route``, ``text`` (null where there is no view), ``error``, and the
    counters ``bodies, tables, docstrings, enums``. Python comments are removed from what stays. ``strict``
    drops docstrings and aliases enums. A Python file with a syntax error is reported, never fatal.
    """
    k = list(key)
    docs = "keep" if keep_docstrings and not strict else "strip"
    enums = alias_enums or strict
    routed = route_files(corpus)
    rows = routed.select(*k, "text", "language", "route")
    readable = F.col("text").isNotNull()

    # A file with an error goes the way of the others, without a text: so errors are looked for once.
    sound = F.col("error").isNull()
    checked = rows.where((F.col("route") == "python") & readable).select(*k, "text", once(python_error(F.col("text"))).alias("error"))
    uncommented = checked.withColumn("text", F.when(sound, python_code.strip_comments(F.col("text"))))
    own = [*k, ROW]
    py = python_code.render(by_row(uncommented, key), [*own, "error"], True, True, docs, enums).select(
        *k,
        F.lit("python").alias("language"),
        F.lit("python").alias("route"),
        F.when(sound, F.col("text")).alias("text"),
        "error",
        "bodies",
        "tables",
        "docstrings",
        "enums",
    )
    js_rows = by_row(rows.where((F.col("route") == "js") & readable).select(*k, "text"), key)
    js_view = js_code.render(js_rows, own, bodies=True, tables=True)
    zero = F.lit(0).cast("bigint")
    js = js_view.select(
        *k,
        language(F.col("path")).alias("language"),
        F.lit("js").alias("route"),
        "text",
        F.lit(None).cast("string").alias("error"),
        body_markers().alias("bodies"),
        _value_markers().alias("tables"),
        zero.alias("docstrings"),
        zero.alias("enums"),
    )
    others = rows.where((F.col("route") == "unsupported") | ~readable).select(
        *k,
        "language",
        "route",
        F.lit(None).cast("string").alias("text"),
        F.when(F.col("route") != "unsupported", "unreadable").alias("error"),
        zero.alias("bodies"),
        zero.alias("tables"),
        zero.alias("docstrings"),
        zero.alias("enums"),
    )
    return py.unionByName(js).unionByName(others)


def _occurrences(marker: str):
    t = F.col("text")
    gone = F.replace(t, F.lit(marker), F.lit(""))
    return ((F.length(t) - F.length(gone)) / len(marker)).cast("bigint")


def _value_markers():
    return _occurrences(VALUE_MARKER)


def body_markers():
    """Markers that stand for a body: all markers but those of values."""
    return F.greatest(F.lit(0).cast("bigint"), _occurrences(MARKER) - _value_markers())


def file_tree(corpus: DataFrame, by: str | None = None, ordered: bool = True) -> DataFrame:
    """Distinct paths (per ``by``), in order. A row per path: a tree of any size stays distributed."""
    cols = ([by] if by else []) + ["path"]
    tree = corpus.select(*cols).distinct()
    return tree.orderBy(*cols) if ordered else tree


# The title and the headings of the context document, and what stands for an empty list.
TITLE, FILES, NOT_PARSED, NONE = "# Safe context", "## Files", "## Files not parsed", "_(none)_"


def _header_text(strict: bool, policy: str) -> str:
    note = "\n\nStrict view: enum values are aliased and docstrings removed." if strict else ""
    return (
        f"<!-- generated by {ENGINE}; policy: {policy}; strict: {str(strict).lower()} -->\n"
        f"{TITLE}\n\n"
        f"What is left out stands as `...` (Python) or `{MARKER}` (JavaScript, TypeScript): what functions and methods do, "
        f"and what collections in upper case hold. All else is as it was written, comments in Python aside.{note}"
    )


def context_document(
    redacted: DataFrame,
    by: str | None = None,
    strict: bool = False,
    policy: str = "defaults",
    listing: DataFrame | None = None,
) -> DataFrame:
    """The context document as ordered parts ``(by, rank, path, seq, text)``.

    ``listing`` is the corpus the view was made from: the tree, the headers and the list of unsupported files
    come from its paths alone, and the view is computed for the sections only. Without it they come from
    ``redacted``, which should then be a stored table.

    The document is the ``text`` of the parts in (rank, path, seq) order, one per line. Parts stay rows, so a
    repository that holds a third of all files is no single task's or cell's burden; ``write_context`` writes
    them in order and ``document_text`` assembles those that fit a bound.
    """
    group = [by] if by else []
    supported = F.col("route") != "unsupported"
    found = (redacted if listing is None else route_files(listing)).select(*group, "path", "route")
    tree = found.select(*group, "path").distinct().select(*group, F.lit(2).alias("rank"), "path", F.col("path").alias("text"))

    fence = F.when(F.col("route") == "python", "python").otherwise(F.col("language"))
    shown = F.when(F.col("route") == "python", F.rtrim(F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    title = F.concat(F.lit("\n## `"), F.col("path"), F.lit("`\n\n"))
    view = F.concat(title, F.lit("```"), fence, F.lit("\n"), shown, F.lit("\n```"))
    problem = F.concat(
        title,
        F.lit("_("),
        F.when(F.col("error") == "unreadable", F.lit("")).otherwise(F.lit("parse error: ")),
        F.col("error"),
        F.lit(")_"),
    )
    section = F.when(F.col("error").isNotNull(), problem).otherwise(view)
    sections = redacted.where(supported).select(
        *group, F.when(F.col("route") == "python", 4).otherwise(5).alias("rank"), "path", section.alias("text")
    )
    items = found.where(~supported).select(
        *group, F.lit(7).alias("rank"), "path", F.concat(F.lit("- `"), F.col("path"), F.lit("`")).alias("text")
    )
    frames = found.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(~supported).alias("n_other"))
    empty = F.col("n") == 0
    pieces = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit(_header_text(strict, policy)).alias("text")),
        F.struct(
            F.lit(1).alias("rank"),
            F.when(empty, F.lit(f"\n{FILES}\n\n{NONE}")).otherwise(F.lit(f"\n{FILES}\n\n```")).alias("text"),
        ),
        F.struct(F.lit(3).alias("rank"), F.when(~empty, F.lit("```")).alias("text")),
        F.struct(
            F.lit(6).alias("rank"),
            F.when(
                F.col("n_other") > 0,
                F.lit(f"\n{NOT_PARSED}\n\nThese files were found but are not supported:\n"),
            ).alias("text"),
        ),
    )
    fixed = frames.select(*group, F.explode(pieces).alias("p")).where(F.col("p.text").isNotNull()).select(
        *group, "p.rank", F.lit("").alias("path"), "p.text"
    )
    parts = fixed.unionByName(tree).unionByName(sections).unionByName(items)
    return parts.withColumn("seq", F.lit(0).cast("bigint")).select(*group, F.col("rank").cast("bigint").alias("rank"), "path", "seq", "text")


def document_text(parts: DataFrame, by: str, chunk_bytes: int = 64 << 20) -> DataFrame:
    """``(by, chunk, bytes, document)``: each document whole, in numbered chunks of about ``chunk_bytes``.

    Concatenating the chunks of a document in order gives the document; one under the bound is chunk 0 alone. A
    part stands in the chunk in which it begins. Where the chunks are cut is known from sizes alone: the running
    sum sees keys and lengths, never texts. The parts are needed twice (sizes, then texts), so they are
    checkpointed rather than computed again.
    """
    ensure_checkpoint_dir(parts.sparkSession)
    parts = parts.checkpoint()
    place = ["rank", "path", "seq"]
    size = F.octet_length("text").cast("bigint") + 1
    # Equal places hold one part each; should one repeat, its copies stay together in one chunk.
    sizes = parts.groupBy(by, *place).agg(F.sum(size).alias("bytes"))
    before = Window.partitionBy(by).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / chunk_bytes)
    placed = sizes.select(F.col(by).alias("__by"), *[F.col(c).alias(f"__{c}") for c in place], chunk.cast("bigint").alias("chunk"))
    same = [F.col(by).eqNullSafe(F.col("__by")), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]]
    cut = parts.join(placed, same).select(by, *place, "text", "chunk")
    ordered = F.array_sort(F.collect_list(F.struct(*place, "text")))
    return cut.groupBy(by, "chunk").agg(
        F.sum(size).alias("bytes"),
        F.concat(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), F.lit("\n")).alias("document"),
    )


def context_status(corpus: DataFrame, strict: bool = False, policy: str | None = None, version: int = 1) -> DataFrame:
    """One row: files found, policy source and version, strict, status."""
    return corpus.agg(F.count("*").alias("files_discovered")).select(
        F.lit("context").alias("command"),
        F.lit("ok").alias("status"),
        "files_discovered",
        F.lit(policy).cast("string").alias("policy_loaded_from"),
        F.lit(version).cast("bigint").alias("policy_version"),
        F.lit(strict).alias("strict"),
    )
