"""Python source as a table of statements, and the redactions on it.

A text is cut into physical lines (strings and continuations kept whole), the lines are joined to logical
statements by bracket depth, and every question about blocks is a window over statements. The corpus is
shuffled once, by its key, *before* it is cut into lines; all windows and groupings reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import (
    ENUM_BASES,
    PY_BLANKED,
    PY_BLANKED_WITH,
    PY_CHUNK,
    PY_COMMENT,
    PY_STRING,
    PY_UNCOMMENT,
)
from veilspark.functions.text import constant_table_name
from veilspark.operators.text_tables import CLOSERS, KEY, OPENERS

_DEF = r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
_CLASS = r"^[ \t]*class[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
_ASSIGN = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=(?!=)"
_COMPOUND = r"^(?:if|elif|else|for|while|with|try|except|finally|match|case|async|def|class)\b(?!\s*=)"
_ANNOTATED = r"^([A-Za-z_][A-Za-z0-9_]*)\s*:"
_STRING_EXPR = r"^\s*[rRuU]?[\"'](?:\s*[rRuU]?[\"'])*\s*$"
_ENUM_CLASS = (
    r"^[ \t]*class\s+[A-Za-z0-9_]+\s*\((?:[\s\S]*,)?\s*(?:[A-Za-z0-9_.]+\.)?(?:"
    + "|".join(ENUM_BASES)
    + r")\s*[,)]"
)
_CONSTANT = r"(?:[rRuUbB]{0,2}[\"'](?:\s*[rRuUbB]{0,2}[\"'])*|[0-9][A-Za-z0-9_.]*|True|False|None|\.\.\.)"
_ENUM_MEMBER = r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*" + _CONSTANT + r"\s*$"
_HEADER_PIECE = PY_STRING + "|" + PY_COMMENT + r"|[()\[\]{}:]|[^\"'#()\[\]{}:]++|[\s\S]"
_END = 2**62


def strip_comments(text: Column) -> Column:
    """Remove Python comments; comment-only lines disappear. Strings are untouched."""
    return F.regexp_replace(text, F.lit(PY_UNCOMMENT), F.lit("$1"))


def _blanked(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(PY_BLANKED), F.lit(PY_BLANKED_WITH))


def _is_literal_table(code: Column) -> Column:
    """Is the assigned value a whole dict, list, set or tuple display? A fold with a fixed-size state."""
    value = F.regexp_replace(code, r"^[^=]*=\s*", "")
    pieces = F.regexp_extract_all(value, F.lit(r"[A-Za-z_][A-Za-z0-9_]*|\S"), F.lit(0))
    start = F.struct(
        F.lit(0).alias("d"),
        F.lit(0).alias("n"),
        F.lit("").alias("first"),
        F.lit(False).alias("closed"),
        F.lit(False).alias("after"),
        F.lit(False).alias("comma0"),
        F.lit(False).alias("comma1"),
        F.lit(False).alias("comp"),
    )

    def step(a: Column, t: Column) -> Column:
        d = a["d"] + F.when(t.isin(*OPENERS), 1).when(t.isin(*CLOSERS), -1).otherwise(0)
        return F.struct(
            d.alias("d"),
            (a["n"] + 1).alias("n"),
            F.when(a["n"] == 0, t).otherwise(a["first"]).alias("first"),
            (a["closed"] | (t.isin(*CLOSERS) & (d == 0))).alias("closed"),
            (a["after"] | a["closed"]).alias("after"),
            (a["comma0"] | ((t == ",") & (a["d"] == 0))).alias("comma0"),
            (a["comma1"] | ((t == ",") & (a["d"] == 1))).alias("comma1"),
            (a["comp"] | ((t == "for") & (a["d"] == 1))).alias("comp"),
        )

    s = F.aggregate(pieces, start, step)
    display = ~s["after"] & ~s["comp"] & (
        s["first"].isin("{", "[") | ((s["first"] == "(") & (s["comma1"] | (s["n"] == 2)))
    )
    return s["comma0"] | display


def _header(text: Column) -> Column:
    """Text of a ``def`` up to and including the colon that ends its signature."""
    pieces = F.regexp_extract_all(text, F.lit(_HEADER_PIECE), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def step(a: Column, t: Column) -> Column:
        d = a["d"] + F.when(t.isin(*OPENERS), 1).when(t.isin(*CLOSERS), -1).otherwise(0)
        return F.struct(
            d.alias("d"),
            (a["done"] | ((t == ":") & (a["d"] == 0))).alias("done"),
            F.when(a["done"], a["out"]).otherwise(F.concat(a["out"], t)).alias("out"),
        )

    return F.aggregate(pieces, start, step)["out"]


def logical_lines(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per logical statement: ``sid, ln, text, code, indent, is_def, is_class, is_string``.

    ``sid`` counts statements from 1 (0 holds leading blank and comment lines); blank and comment lines
    belong to the statement before them. ``code`` has comments removed and strings reduced to a quote.
    """
    k = list(key)
    chunks = corpus.select(
        *k, F.posexplode_outer(F.regexp_extract_all("text", F.lit(PY_CHUNK), F.lit(0))).alias("pos", "chunk")
    ).select(*k, "pos", "chunk", _blanked(F.col("chunk")).alias("code"))
    by_pos = Window.partitionBy(*k).orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    net = F.regexp_count("code", F.lit(r"[(\[{]")) - F.regexp_count("code", F.lit(r"[)\]}]"))
    newlines = F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"), F.lit("")))
    rows = chunks.withColumn("depth", F.coalesce(F.sum(net).over(before), F.lit(0))).withColumn(
        "ln", F.coalesce(F.sum(newlines).over(before), F.lit(0)) + 1
    )
    starts = (F.regexp_replace("code", r"\s+", "") != "") & (F.col("depth") <= 0)
    rows = rows.withColumn("sid", F.sum(F.when(starts, 1).otherwise(0)).over(upto).cast("bigint"))

    parts = F.array_sort(F.collect_list(F.struct("pos", "chunk", "code")))
    stmts = rows.groupBy(*k, "sid").agg(F.min("ln").cast("bigint").alias("ln"), parts.alias("parts")).select(
        *k,
        "sid",
        "ln",
        F.array_join(F.transform("parts", lambda p: p["chunk"]), "").alias("text"),
        F.array_join(F.transform("parts", lambda p: p["code"]), "").alias("code"),
    )
    blank = F.regexp_replace(F.regexp_extract("code", r"^[ \t]*", 0), "\t", " " * 8)
    real = F.col("sid") > 0
    return stmts.withColumns(
        {
            "indent": F.when(real, F.length(blank)),
            "is_def": real & F.col("code").rlike(_DEF),
            "is_class": real & F.col("code").rlike(_CLASS),
            "is_string": real & F.col("code").rlike(_STRING_EXPR),
        }
    )


def statements(corpus: DataFrame, key: Sequence[str] = KEY, enums: bool = False) -> DataFrame:
    """Logical statements with their block relations.

    ``end_sid`` of a ``def`` or ``class`` is the first statement after its block. A statement that dedents
    closes the header levels it passes, so each level sees its own closings in order and the end of a block
    is the next row of its level.
    """
    k = list(key)
    stmts = logical_lines(corpus, key)
    by_sid = Window.partitionBy(*k).orderBy("sid")
    earlier = by_sid.rowsBetween(Window.unboundedPreceding, -1)
    header = F.col("is_def") | F.col("is_class")
    levels = F.collect_set(F.when(header, F.col("indent"))).over(Window.partitionBy(*k))
    stmts = stmts.withColumns(
        {
            "prev_indent": F.lag("indent").over(by_sid),
            "next_indent": F.lead("indent").over(by_sid),
            "prev_def": F.coalesce(F.lag("is_def").over(by_sid), F.lit(False)),
            "prev_class": F.coalesce(F.lag("is_class").over(by_sid), F.lit(False)),
            "levels": levels,
        }
    )
    passed = F.filter("levels", lambda v: (v >= F.col("indent")) & (v <= F.col("prev_indent")))
    own = F.when(header, F.array("indent")).otherwise(F.expr("array()").cast("array<int>"))
    stmts = stmts.withColumn("closes", F.array_union(passed, own)).withColumn(
        "level", F.explode_outer("closes")
    )
    by_level = Window.partitionBy(*k, "level").orderBy("sid")
    stmts = stmts.withColumn("end_sid", F.coalesce(F.lead("sid").over(by_level), F.lit(_END))).where(
        F.col("level").isNull()
        | (F.col("level") == F.when(header, F.col("indent")).otherwise(F.array_min("closes")))
    )
    stmts = stmts.withColumn("end_sid", F.when(header, F.col("end_sid"))).drop("levels", "closes", "level")

    def_end = F.max(F.when(F.col("is_def"), F.col("end_sid"))).over(earlier)
    stmts = stmts.withColumn("in_body", F.coalesce(def_end > F.col("sid"), F.lit(False))).withColumn(
        "first_body",
        F.col("in_body") & F.col("prev_def") & ~F.coalesce(F.lag("in_body").over(by_sid), F.lit(False)),
    )
    under_header = (F.col("prev_def") | F.col("prev_class")) & (F.col("indent") > F.col("prev_indent"))
    doc = F.col("is_string") & ((F.col("sid") == 1) | F.coalesce(under_header, F.lit(False)))
    table_name = F.regexp_extract("code", _ASSIGN, 1)
    table = (
        (F.col("indent") == 0)
        & constant_table_name(table_name)
        & F.when(constant_table_name(table_name), _is_literal_table(F.col("code"))).otherwise(False)
    )
    stmts = stmts.withColumn("is_doc", doc).withColumn("is_table", F.coalesce(table, F.lit(False)))
    if enums:
        stmts = _enum_members(stmts, k, earlier)
    return stmts


def _enum_members(stmts: DataFrame, k: list[str], earlier) -> DataFrame:
    """Add ``is_enum``, ``enum_index`` (members of the class body only, counted from 0) and ``enum_n``.

    Several members may stand on one line: ``enum_index`` is the first, ``enum_n`` their number.
    """
    is_enum = F.col("is_class") & F.col("code").rlike(_ENUM_CLASS)
    last = F.last(F.when(F.col("is_enum"), F.struct("sid", "end_sid")), ignorenulls=True).over(earlier)
    stmts = stmts.withColumn("is_enum", is_enum).withColumn("enum", last)
    inside = F.coalesce(F.col("enum.end_sid") > F.col("sid"), F.lit(False))
    stmts = stmts.withColumn("enum_sid", F.when(inside, F.col("enum.sid"))).drop("enum")
    group = Window.partitionBy(*k, "enum_sid")
    body_indent = F.min("indent").over(group)
    members = F.size(F.filter(F.split("code", ";"), lambda p: p.rlike(_ENUM_MEMBER)))
    here = F.col("enum_sid").isNotNull() & (F.col("indent") == F.col("body_indent"))
    stmts = stmts.withColumn("body_indent", body_indent)
    stmts = stmts.withColumn("enum_n", F.when(F.coalesce(here, F.lit(False)), members).otherwise(0))
    counter = F.sum("enum_n").over(group.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    index = F.when(F.col("enum_n") > 0, counter - F.col("enum_n"))
    return stmts.withColumn("enum_index", index.cast("int")).drop("body_indent")


def render(
    corpus: DataFrame,
    key: Sequence[str] = KEY,
    bodies: bool = False,
    tables: bool = False,
    docstrings: str = "keep",
    enums: bool = False,
    empty: str = "pass",
) -> DataFrame:
    """Rewrite Python texts: ``(key, text, bodies, tables, docstrings, enums)``.

    ``docstrings`` is 'keep' or 'strip'; ``empty`` stands for a class or module body left without statements.
    The counters say how many of each were redacted.
    """
    k = list(key)
    strip = docstrings == "strip"
    s = statements(corpus, key, enums)
    text, code = F.col("text"), F.col("code")
    space = F.regexp_extract("text", r"^[ \t]*", 0)
    solid = F.rtrim(text, F.lit(" \t\n\r\f"))
    tail = F.substring(text, F.length(solid) + 1, F.length(text))
    line_end = F.when(tail.contains("\n"), F.lit("\n")).otherwise(F.lit(""))
    emptied = F.coalesce(F.col("next_indent"), F.lit(-1)) < F.col("indent")

    out = F.when(F.lit(False), text)
    if bodies:
        s = s.withColumn("signature", F.when(F.col("is_def") & ~F.col("in_body"), _header(text)))
        signature = F.col("signature")
        rest = _blanked(F.substring(text, F.length(signature) + 1, F.length(text)))
        one_line = F.regexp_replace(rest, r"\s+", "") != ""
        dots = F.concat(space, F.lit("..."), line_end)
        keep_doc = F.concat(solid, F.lit("\n"), dots)
        out = (
            out.when(F.col("first_body"), dots if strip else F.when(F.col("is_doc"), keep_doc).otherwise(dots))
            .when(F.col("in_body"), F.lit(None).cast("string"))
            .when(
                F.col("is_def"),
                F.concat(signature, F.when(one_line, F.lit(" ...")).otherwise(F.lit("")), F.lit("\n")),
            )
        )
    if tables:
        name = F.regexp_extract("code", _ASSIGN, 1)
        out = out.when(F.col("is_table"), F.concat(name, F.lit(" = ..."), tail))
    if strip:
        # A module is left without a placeholder unless the caller rewrites whole modules ('pass').
        placeholder = F.concat(space, F.lit(empty), line_end)
        fill = emptied & (F.lit(not bodies) | (F.col("sid") > 1))
        out = out.when(F.col("is_doc"), F.when(fill, placeholder))
    if enums:
        # Names and values go; the position within the class stays.
        last_index = F.col("enum_index") + F.greatest(F.col("enum_n"), F.lit(1)) - 1
        one = lambda i: F.concat(F.lit("VALUE_"), i.cast("string"), F.lit(" = 'V"), i.cast("string"), F.lit("'"))
        alias = F.concat(space, F.array_join(F.transform(F.sequence("enum_index", last_index), one), "; "), tail)
        out = out.when(F.col("enum_index").isNotNull(), alias)
    out = out.otherwise(text)

    visible = ~F.col("in_body") if bodies else F.lit(True)
    doc_seen = F.col("is_doc") & (visible | F.col("first_body"))
    kept = F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("sid", "out"))))
    done = s.withColumn("out", out).groupBy(*k).agg(
        kept.alias("kept"),
        F.count_if(F.lit(bodies) & F.col("is_def") & ~F.col("in_body")).alias("bodies"),
        F.count_if(F.lit(tables) & F.col("is_table")).alias("tables"),
        F.count_if(F.lit(strip) & doc_seen).alias("docstrings"),
        F.count_if(F.lit(enums) & F.col("is_enum") & visible if enums else F.lit(False)).alias("enums"),
    )
    return done.withColumn("text", F.array_join(F.transform("kept", lambda p: p["out"]), "")).select(
        *k, "text", "bodies", "tables", "docstrings", "enums"
    )


def python_definitions(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(key, ln, pos, nth, kind, name, depth)`` of functions, classes and module-level assignments.

    ``pos`` is the statement number, ``nth`` the place within a chained assignment, ``depth`` the indent.
    """
    s = logical_lines(corpus, key)
    code = F.col("code")

    def assigned(part: Column) -> Column:
        """The names that one simple statement assigns."""
        annotated = F.regexp_extract(part, _ANNOTATED, 1)
        chained = F.filter(
            F.split(F.regexp_extract(part, r"^((?:[A-Za-z_][A-Za-z0-9_]*\s*=(?!=)\s*)+)", 1), r"\s*=\s*"),
            lambda n: n != "",
        )
        plain = F.regexp_extract(part, _ASSIGN, 1) != ""
        typed = (annotated != "") & ~annotated.isin("else", "try", "finally")
        return F.when(plain, chained).when(typed, F.array(annotated)).otherwise(F.array().cast("array<string>"))

    # Simple statements on one line are cut at semicolons; those behind the colon of a block belong to it.
    parts = F.when(code.rlike(_COMPOUND), F.array(code)).otherwise(
        F.transform(F.split(code, ";"), lambda p: F.regexp_replace(p, r"^\s+", ""))
    )
    top = F.col("indent") == 0
    names = (
        F.when(F.col("is_def"), F.array(F.regexp_extract("code", _DEF, 1)))
        .when(F.col("is_class"), F.array(F.regexp_extract("code", _CLASS, 1)))
        .when(top, F.flatten(F.transform(parts, assigned)))
    )
    kind = F.when(F.col("is_def"), "function").when(F.col("is_class"), "class").otherwise("constant")
    return s.withColumn("kind", kind).select(
        *key,
        "ln",
        F.col("sid").alias("pos"),
        F.posexplode(names).alias("nth", "name"),
        "kind",
        F.col("indent").cast("bigint").alias("depth"),
    ).select(*key, "ln", "pos", F.col("nth").cast("bigint").alias("nth"), "kind", "name", "depth")
