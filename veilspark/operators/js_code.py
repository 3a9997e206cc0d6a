"""JavaScript/TypeScript source as a table of units, and the redactions on it.

A unit is one significant token with the blanks and comments after it. Windows over units give bracket depth,
partners and the end of expressions; the result is a short list of spans per file, spliced into the text by
slices of its unit array. The corpus is shuffled once, by its key, before it is cut into units, and only the
units that can start or end a span go through the later windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.paths import language
from veilspark.functions.patterns import (
    BODY_MARKER,
    JS_FUNCTION,
    JS_TEMPLATE_CODE,
    JS_TEMPLATE_PIECE,
    JS_TEMPLATE_REST,
    TEMPLATE_MARKER,
    VALUE_MARKER,
)
from veilspark.functions.text import constant_table_name
from veilspark.operators.splicing import JS_LEXER, apply_edits
from veilspark.operators.text_tables import CLOSERS, KEY, OPENERS
from veilspark.session import once

# The language's words and operators that matter for telling one construct from another.
DECLARATORS = ("const", "let", "var")
NOT_CALLABLE = (
    "if", "for", "while", "switch", "catch", "with", "return", "typeof", "case", "in", "of", "new", "await",
    "else", "do", "void", "delete", "throw", "instanceof", "yield", "extends", "import", "super",
)
STATEMENT_WORDS = (
    "class", "interface", "enum", "namespace", "module", "if", "else", "for", "while", "do", "try", "finally",
    "catch", "switch", "return", "const", "let", "var", "function", "import", "export", "throw", "static",
)
OPEN_ENDED = (
    "=>", "+", "-", "*", "/", "%", "=", "==", "===", "!=", "!==", "&&", "||", "??", "&", "|", "^", "<", ">",
    "<=", ">=", "?", ":", ",", "(", "[", "{", ".", "?.", "!", "~", "...", "+=", "-=", "*=", "/=", "%=", "&=",
    "|=", "^=", "&&=", "||=", "??=", "return", "typeof", "new", "await", "in", "of", "instanceof",
    "delete", "extends", "yield",
)
CONTINUES = (
    ".", "?.", "?", ":", "+", "-", "*", "/", "%", "=", "==", "===", "!=", "!==", "&&", "||", "??", "&", "|",
    "^", "<", ">", "<=", ">=", ",", ")", "]", "}", ";", "(", "[", "=>", "in", "instanceof", "as", "satisfies",
)
VALUE_BEFORE_BRACE = (
    "=", "(", ",", ":", "[", "?", "return", "&&", "||", "??", "const", "let", "var", "in", "of", "default",
    "!", "+", "<", "|", "&", "...",
)


def one_of(column: str, *values: str) -> Column:
    """``column IN (...)`` as one SQL expression."""
    return F.expr(f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")")


def _struct_before(cond: Column, value: Column, window) -> Column:
    return F.last(F.when(cond, value), ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, -1)
    )


def template_parts(sig: Column) -> Column:
    """A template literal cut at ``${``: an array of ``(code, rest)``, where code is what is evaluated.

    A literal that follows a nested one begins inside the outer substitution: its code runs to the brace.
    """
    return F.transform(
        F.transform(
            F.split(sig, r"\$\{"),
            lambda p, i: F.struct(
                F.when(i == 0, F.regexp_extract(p, JS_TEMPLATE_REST, 0)).otherwise(F.regexp_extract(p, JS_TEMPLATE_CODE, 0)).alias("code"),
                p.alias("part"),
            ),
        ),
        lambda x: F.struct(x["code"].alias("code"), F.substring(x["part"], F.length(x["code"]) + 1, F.length(x["part"])).alias("rest")),
    )


def _computes(sig: Column) -> Column:
    """Is this a template literal with a function in one of its substitutions?"""
    return sig.startswith("`") & sig.rlike(JS_FUNCTION) & F.exists(template_parts(sig), lambda p: p["code"].rlike(JS_FUNCTION))


def structure(corpus: DataFrame, key: Sequence[str] = KEY, names: Column | None = None) -> DataFrame:
    """The structural units of each text, with partners and context.

    ``names`` is a predicate on ``sig`` for further units to keep (identifiers of interest). Columns:
    ``pos, ln, sig, prev, prev2, prev3, next, next2, outer`` (depth around the unit), ``encl`` (the opener around
    it, or the opener of a closer), ``close`` (the closer of an opener), ``stop`` (last position of an
    expression that starts after this unit), ``mark`` (the last statement word at its depth).
    """
    k = list(key)
    lang = F.coalesce(language(F.col("path")), F.lit("javascript"))
    # The language is told per file, not per unit.
    files = corpus.select(*k, "text", lang.isin("typescript", "tsx").alias("ts"))
    cut = files.select(*k, "ts", F.posexplode(JS_LEXER.units(F.col("text"))).alias("pos", "unit"))
    by_pos = Window.partitionBy(*k).orderBy("pos")
    breaks = F.length("unit") - F.length(F.replace("unit", F.lit("\n"), F.lit("")))
    ln = F.coalesce(F.sum(breaks).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    cut = cut.select("*", ln.cast("bigint").alias("ln"), once(JS_LEXER.head(F.col("unit"))).alias("sig")).where("sig <> ''")
    rest = F.substring(F.col("unit"), F.length("sig") + 1, F.length("unit"))
    is_open, is_close = one_of("sig", *OPENERS), one_of("sig", *CLOSERS)
    run = F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(
        by_pos.rowsBetween(Window.unboundedPreceding, 0)
    )
    u = cut.select(
        *k,
        "ts",
        "pos",
        "ln",
        "sig",
        rest.contains("\n").alias("nl"),
        (F.length(rest) > 0).alias("gap"),
        F.lag("sig", 1, "").over(by_pos).alias("prev"),
        F.lag("sig", 2, "").over(by_pos).alias("prev2"),
        F.lag("sig", 3, "").over(by_pos).alias("prev3"),
        F.lead("sig", 1, "").over(by_pos).alias("next"),
        F.lead("sig", 2, "").over(by_pos).alias("next2"),
        _struct_before(
            one_of("sig", "class", "interface", ";", "{", "}", ")", "=>", "=", "return"), F.col("sig"), by_pos
        ).alias("decl"),
        run.alias("run"),
    )
    ends_here = (F.col("next") == "") | (
        F.col("nl") & ~one_of("sig", *OPEN_ENDED) & ~one_of("next", *CONTINUES) & ~F.col("next").startswith("`")
    )
    u = u.withColumns(
        {
            "is_open": is_open,
            "is_close": is_close,
            "inner": F.col("run") + F.when(is_close, 1).otherwise(0),
            "outer": F.col("run") - F.when(is_open, 1).otherwise(0),
            "asi": ends_here,
        }
    )
    keep = (
        F.col("is_open")
        | F.col("is_close")
        | F.col("asi")
        | one_of("sig", "=>", ";", ",", *STATEMENT_WORDS)
        | F.col("sig").startswith("`")
        | (F.col("ts") & one_of("sig", "type", ":"))
    )
    u = u.where(keep if names is None else keep | names)

    # Partners: an opener and its closer meet in the partition of the depth between them.
    inner = Window.partitionBy(*k, "inner")
    name_like = (
        F.col("prev").rlike(r"^[#A-Za-z_$\u0080-￿\"'0-9]")
        & ~one_of("prev", *NOT_CALLABLE)
        & ~one_of("prev2", ".", "?.", "extends", "new")
    ) | one_of("prev", "*", "]", ">")
    callee = F.when(F.col("sig") == "(", name_like).otherwise(False)
    kind = (
        F.when(F.col("sig") != "{", F.lit(None).cast("string"))
        .when(one_of("prev", "import", "export") | (F.col("prev3") == "import"), "specifiers")
        .when(one_of("decl", "class", "interface"), "class")
        .when(one_of("prev", *VALUE_BEFORE_BRACE), "object")
        .otherwise("block")
    )
    opener = F.struct(
        "pos", "sig", callee.alias("callee"), kind.alias("kind"), "prev", "prev2", "prev3"
    )
    u = u.withColumn("encl", _struct_before(F.col("is_open"), opener, inner.orderBy("pos")))
    back = inner.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    closer = F.struct("pos", "next", "asi", "gap")
    u = u.withColumn("close", F.last(F.when(F.col("is_close"), closer), ignorenulls=True).over(back))

    # Expression ends: a separator at the same depth, the end of a line that closes it, or the closer around.
    outer = Window.partitionBy(*k, "outer")
    ahead = outer.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    sep = F.when(one_of("sig", ";", ","), F.col("pos") - 1).when(F.col("asi"), F.col("pos"))
    starts_next = one_of("sig", "function", "class", "interface", "export", *DECLARATORS)
    semi = F.when((F.col("sig") == ";") | starts_next, F.col("pos") - 1).when(F.col("asi"), F.col("pos"))
    u = u.withColumn("stop_sep", F.last(sep, ignorenulls=True).over(ahead)).withColumn(
        "stop_semi", F.last(semi, ignorenulls=True).over(ahead)
    )
    around = F.when(~F.col("is_open") & ~F.col("is_close"), F.col("close.pos") - 1)
    u = u.withColumn("stop", F.least(F.when(F.col("sig") == "type", F.col("stop_semi")).otherwise(F.col("stop_sep")), around))

    # The last statement word or closing parenthesis at the depth of the unit.
    returns = (F.col("sig") == ")") & (F.col("next") == ":") & F.col("encl.callee")
    word = (
        F.when(one_of("sig", *STATEMENT_WORDS, ";"), F.col("sig"))
        .when(returns, "returns")
        .when(F.col("sig") == ")", ")")
        .when(F.col("asi"), ";")
    )
    mark = F.struct(word.alias("word"), "pos", "next", "next2")
    u = u.withColumn("mark", _struct_before(word.isNotNull(), mark, outer.orderBy("pos")))
    return u.withColumn("mark_pos", F.col("mark.pos")).withColumn("prev_callee", F.coalesce(F.lag("encl.callee").over(by_pos), F.lit(False))).withColumn(
        "prev_open", F.lag("encl").over(by_pos)
    )


def spans(u: DataFrame, key: Sequence[str] = KEY, bodies: bool = True, tables: bool = True) -> DataFrame:
    """Outermost redactions ``(key, a, b, kind)`` by unit position.

    A body runs from its brace to the partner (kind 'body'); an arrow expression or a table is a 'value'. A
    template literal with a function in a substitution goes as a whole (kind 'template').
    """
    k = list(key)
    by_pos = Window.partitionBy(*k).orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    sig, prev = F.col("sig"), F.col("prev")

    # Interfaces and type aliases are shapes: nothing inside them is code.
    shape = F.when((sig == "{") & (F.col("decl") == "interface"), F.col("close.pos")).when(
        F.col("ts") & (sig == "type") & one_of("next2", "=", "<"), F.col("stop")
    )
    u = u.withColumn("shape", F.coalesce(F.max(shape).over(before) >= F.col("pos"), F.lit(False)))

    end = F.coalesce(F.col("close.pos"), F.lit(2**31 - 2))
    # ``(a: T) => U`` as the type of a parameter or variable is a shape too.
    type_arrow = (
        F.col("ts")
        & (prev == ")")
        & (F.col("prev_open.prev") == ":")
        & (
            one_of("prev_open.prev3", "(", *DECLARATORS, "private", "public", "protected", "readonly")
            | (F.col("prev_open.prev2") == "?")
        )
    )
    returns = (
        F.col("ts")
        & (F.col("mark.word") == "returns")
        & ~one_of("prev", *VALUE_BEFORE_BRACE)
        & ~one_of("prev", ")", "=>", ">=")
    )
    opens_body = (sig == "{") & ((prev == "=>") | ((prev == ")") & F.col("prev_callee")) | returns)
    body = opens_body & ((end > F.col("pos") + 1) | F.col("gap"))
    expression = (sig == "=>") & (F.col("next") != "{") & (F.col("next") != "") & ~F.coalesce(type_arrow, F.lit(False))

    declared = one_of("prev3", *DECLARATORS) | ((F.col("prev3") == ",") & one_of("mark.word", *DECLARATORS))
    plain_name = declared & constant_table_name(F.col("prev2"))
    typed_name = (
        F.col("ts")
        & one_of("mark.word", *DECLARATORS)
        & (F.col("mark.next2") == ":")
        & constant_table_name(F.col("mark.next"))
    )
    whole = one_of("close.next", ";", ",", ")", "}", "") | F.col("close.asi")
    table = one_of("sig", "{", "[") & (prev == "=") & (plain_name | typed_name) & whole

    a = F.lit(None).cast("struct<a:int,b:int,kind:string>")
    if tables:
        a = F.when(table, F.struct(F.col("pos").alias("a"), end.alias("b"), F.lit("value").alias("kind"))).otherwise(a)
    if bodies:
        a = (
            F.when(body, F.struct(F.col("pos").alias("a"), end.alias("b"), F.lit("body").alias("kind")))
            .when(
                expression,
                F.struct(
                    (F.col("pos") + 1).alias("a"),
                    F.coalesce(F.col("stop"), F.lit(2**31 - 2)).alias("b"),
                    F.lit("value").alias("kind"),
                ),
            )
            .when(_computes(sig), F.struct(F.col("pos").alias("a"), F.col("pos").alias("b"), F.lit("template").alias("kind")))
            .otherwise(a)
        )
    found = u.where(~F.col("shape")).select(*k, "pos", a.alias("s")).where("s IS NOT NULL").select(*k, "pos", "s.*")
    covered = F.coalesce(F.max("b").over(before) >= F.col("a"), F.lit(False))
    return found.withColumn("covered", covered).where(~F.col("covered")).select(
        *k, F.col("a").cast("int"), F.col("b").cast("int"), "kind"
    )


def render(corpus: DataFrame, key: Sequence[str] = KEY, bodies: bool = False, tables: bool = False) -> DataFrame:
    """Rewrite JS/TS texts: bodies become ``{ marker }``, arrow values and tables ``marker null``, templates with
    functions a template of the marker."""
    k = list(key)
    base = corpus.select(*k, "text")
    marked = F.when(F.col("kind") == "body", F.lit("{" + BODY_MARKER + "}"))
    marked = marked.when(F.col("kind") == "template", F.lit(TEMPLATE_MARKER)).otherwise(F.lit(VALUE_MARKER))
    found = spans(structure(base, key), key, bodies, tables).withColumn("with", marked)
    return apply_edits(base, found, JS_LEXER, key)


def js_definitions(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(key, ln, pos, nth, kind, name, depth)`` of functions, classes and variables at any depth."""
    k = list(key)
    is_name = F.col("sig").rlike(r"^[A-Za-z_$\u0080-\uffff]")
    introduced = one_of("prev", "function", "class", *DECLARATORS, ",") | (
        (F.col("prev") == "*") & (F.col("prev2") == "function")
    )
    u = structure(corpus.select(*k, "text"), key, names=is_name & introduced).where(is_name & introduced)
    more = (
        (F.col("prev") == ",")
        & one_of("mark.word", *DECLARATORS)
        & one_of("next", "=", ",", ";", "", ":")
        & (F.coalesce(F.col("encl.pos"), F.lit(-1)) < F.col("mark_pos"))
    )
    kind = (
        F.when(F.col("prev") == "class", "class")
        .when(one_of("prev", "function", "*"), "function")
        .when(one_of("prev", *DECLARATORS) | more, "constant")
    )
    return u.withColumn("kind", kind).where("kind IS NOT NULL").select(
        *k,
        "ln",
        F.col("pos").cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("nth"),
        "kind",
        F.col("sig").alias("name"),
        F.col("outer").cast("bigint").alias("depth"),
    )


def reference_units(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Positions of identifiers that start with ``_`` and may be renamed: ``(key, pos, sig, name)``.

    A template literal is one unit with a row per name in its substitutions. Left alone: members after a dot, object keys and shorthands, destructured names, class member names.
    """
    k = list(key)
    sig, prev, nxt = F.col("sig"), F.col("prev"), F.col("next")
    template = sig.startswith("`") & sig.contains("_")
    private = sig.startswith("_") | template
    u = structure(corpus.select(*k, "text"), key, names=private).where(private)
    kind = F.col("encl.kind")
    in_object = F.coalesce(kind == "object", F.lit(False)) & one_of("prev", "{", ",", "get", "set", "async", "*")
    in_class = F.coalesce(kind == "class", F.lit(False)) & ~one_of("prev", "=", "(", "[", "extends", "new", "?", "+", "-", "&&", "||", "??", "!", ":", "<", "|", "&", "implements", "...") & one_of("next", "(", "=", ":", ";", "?", "!", "}", "")
    keep = one_of("prev", ".", "?.") | in_object | in_class
    found = F.transform(
        template_parts(sig), lambda p: F.regexp_extract_all(p["code"], F.lit(JS_TEMPLATE_PIECE), F.lit(0))
    )
    inside = F.filter(F.array_distinct(F.flatten(found)), lambda n: n.startswith("_"))
    names = F.when(template, inside).otherwise(F.array(sig))
    return u.where(template | ~keep).select(*k, "pos", "sig", F.explode(names).alias("name"))
