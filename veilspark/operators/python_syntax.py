"""Syntax errors of Python texts, found inside the row: no parser, no Python worker.

A text is reduced in a few passes of regular expressions: comments go, strings, numbers and operators become one
character each, a bracket takes its lines together. What is left are logical lines. The tokens of a line are checked against
a table of what may follow what; the lines against a pushdown automaton whose stack holds the open indents,
each with the last header at it. Its transitions are one fold over the lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.paths import language
from veilspark.functions.patterns import PY_STRING, PY_UNCOMMENT
from veilspark.operators.text_tables import KEY, bracket_error
from veilspark.session import once

# One character for each kind of token that takes many: a string, an operator between two operands, a number.
_OPERAND, _BINARY, _DIGITS = "\u0001", "\u0002", "\u0003"
_FIELD = r"\{(?:[^{}\n]|\{[^{}\n]*+\})*+\}"
# A formatted string may hold its own quotes inside its fields.
_FORMATTED = r"(?:[rR]?[fFtT][rR]?)(?:" + "|".join(rf"{q}(?!{q}{q})(?:[^{q}\\\n{{]++|\\[\s\S]|\{{\{{|{_FIELD})*+{q}" for q in "\"'") + ")"
_STRING = rf"(?<![A-Za-z0-9_])(?:{_FORMATTED}|(?:[rRbBuUfFtT]{{1,2}})?+{PY_STRING})|{PY_STRING}"
_NUMBER = r"(?<![A-Za-z0-9_)\]}" + _OPERAND + r"])(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[A-Za-z0-9_]*+(?<!(?:if|or|in|is|and|else|for)(?<=[0-9]{1,9}[a-z]{2,4}))"
_BETWEEN = r"\*\*=|//=?|<<=?|>>=?|[-+*/%@&|^<>=!:]=|->"
#: Depth of brackets up to which their lines are taken together; deeper texts have no error found.
_DEPTH = 24
_BALANCED = r"[(\[{][^()\[\]{}]*+[)\]}]"
for _ in range(_DEPTH):
    _BALANCED = r"[(\[{](?:[^()\[\]{}]++|" + _BALANCED + r")*+[)\]}]"
_LINE = rf"(?:[^()\[\]{{}}\n]++|{_BALANCED})++"
_SHUT = r"\([^()\[\]{}]*+[\]}]|\[[^()\[\]{}]*+[)}]|\{[^()\[\]{}]*+[)\]]"

# The words of the language that are no operands, those that need something behind them, and the headers.
_WORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield"
).split()
_OPEN_WORDS = "and as assert class def del elif else for from global if import in is lambda nonlocal not or while with".split()
_HEADERS = "if elif else for while try except finally with def class".split()
#: What a header may follow at its indent.
_AFTER = {
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "try", "except"), "except": ("try", "except"), "finally": ("try", "except", "else"),
}

_WORD = "(?:" + "|".join(_WORDS) + r")(?![A-Za-z0-9_])"
_NAME = r"[A-Za-z_\u0080-\uffff][A-Za-z0-9_\u0080-\uffff]*+"
_END = r"\s*(?:$|;)"
_VALUE = rf"(?:(?!{_WORD}){_NAME}|{_DIGITS})"
# A name, number, string or bracket, then another that no word of the language parts; strings in a row are one.
_TWO = (
    rf"(?:(?<![A-Za-z0-9_.\u0080-\uffff])(?!{_WORD}){_NAME}|\.\s*(?!{_WORD}){_NAME}|{_DIGITS}|[)\]}}])(?:\s++(?:{_VALUE}|{_OPERAND})|(?<=[)\]}}])(?:{_VALUE}|{_OPERAND}))"
    rf"|{_OPERAND}\s*+{_VALUE}"
)
# The table of what may not follow what, for one logical line: kind of error and pattern.
_FAULTS = (
    # Two operands without anything between them: a name, number, string or bracket, then one that is no word of the language.
    ("two values without an operator", _TWO),
    ("dangling operator", rf"(?:[=<>/%&|^+*~@{_BINARY}-]|(?<!\.)(?<![\s.]|from)\.){_END}"),
    ("dangling operator", rf"(?<![A-Za-z0-9_.])(?:{'|'.join(_OPEN_WORDS)}){_END}"),
    ("dangling operator", rf"[=<>%&|^+~{_BINARY}-]\s*[)\]}},]|(?<![(,\s])\s*[/*]\s*[)\]}},]"),
    ("two operators", rf"[=<>/%&|^+*~{_BINARY}-]\s*[=<>/%&|^{_BINARY}]"),
    ("dangling operator", r"^(?!\s*from(?![A-Za-z0-9_]))[\s\S]*?\.\s*\."),
    ("a lambda without a colon", r"(?<![A-Za-z0-9_.])lambda(?![A-Za-z0-9_])[^:()\[\]{}]*(?:[)\]}]|$)"),
    ("two commas", r",\s*,|[(\[{]\s*,"),
    ("nothing before an operator", rf"(?:^|;)\s*[=<>/%&|^,.:{_BINARY}]"),
    ("a function without name and brackets", r"(?:^|;)\s*(?:async\s+)?def(?![A-Za-z0-9_])(?!\s+[A-Za-z_\u0080-\uffff][A-Za-z0-9_\u0080-\uffff]*\s*[(\[])"),
    ("a class without name", r"(?:^|;)\s*class(?![A-Za-z0-9_])(?!\s+[A-Za-z_\u0080-\uffff][A-Za-z0-9_\u0080-\uffff]*\s*[(:\[])"),
    ("a sign outside the language", r"[?$!]|`"),
)


def _reduced(text: Column) -> Column:
    """The text without comments, with a character for each string, number and operator of several signs."""
    t = F.regexp_replace(F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n")), F.lit("^\ufeff"), F.lit(""))
    t = F.regexp_replace(t, F.lit(PY_UNCOMMENT), F.lit("$1"))
    t = F.regexp_replace(t, F.lit(_STRING), F.lit(_OPERAND))
    t = F.regexp_replace(t, F.lit(r"\\\n"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(r"\.\.\.(?!\.)(?<!from \.\.\.|from\.\.\.)"), F.lit(_OPERAND))
    t = F.regexp_replace(t, F.lit(_NUMBER), F.lit(_DIGITS))
    t = F.regexp_replace(t, F.lit(_BETWEEN), F.lit(_BINARY))
    return F.regexp_replace(t, F.lit(r"\*\*"), F.lit("*"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _fault(line: Column) -> Column:
    """What is wrong inside a logical line, or null."""

    def first(bodies: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(_FAULTS):
            # A star alone imports or parts parameters.
            body = bodies["unstarred"] if "operator" in name else bodies["line"]
            out = F.when(body.rlike(pattern), name).otherwise(out)
        return out

    # Words that are names elsewhere.
    plain = F.regexp_replace(line, F.lit(r"^\s*(?:(?:match|case)\s+(?=[\s\S]*:\s*$)|type\s+(?=[A-Za-z_]))"), F.lit(""))
    both = lambda x: F.struct(x.alias("line"), F.regexp_replace(x, F.lit(r"import\s*\*"), F.lit("import x")).alias("unstarred"))
    return _let(_let(plain, both), first)


def _traits(line: Column) -> Column:
    """What a transition needs of a logical line: its indent, first word, whether it is a header, ends with a colon or holds one, and its fault."""
    lead = F.regexp_extract(line, r"^[ \t\f]*", 0)
    width = F.length(F.regexp_replace(F.regexp_replace(lead, F.lit("^.*\f"), F.lit("")), F.lit(" {0,7}\t"), F.lit(" " * 8)))
    word = F.regexp_extract(line, r"^\s*(?:async\s+)?([A-Za-z_]\w*)", 1)
    flat = F.regexp_replace(F.regexp_replace(line, F.lit(_BALANCED), F.lit("()")), F.lit(r"lambda[^:]*:"), F.lit("lambda "))
    colons = _let(flat, lambda x: F.struct(x.contains(":").alias("colon"), x.rlike(r":\s*$").alias("ends")))

    def told(x: Column) -> Column:
        header = x["word"].isin(*_HEADERS) & line.rlike(r"^\s*(?:async\s+)?[a-z]+(?![\w.])(?!\s*(?:[=.,)\]]|\u0002))")
        header = header | (x["word"].isin("match", "case") & x["at"]["ends"])
        return F.struct(
            width.alias("width"), x["word"].alias("word"), header.alias("header"), x["at"]["ends"].alias("ends"), x["at"]["colon"].alias("colon"), _fault(line).alias("fault")
        )

    return _let(F.struct(word.alias("word"), colons.alias("at")), told)


def _step(state: Column, line: Column) -> Column:
    """One transition: the stack of open indents, the last header at each, whether a body must follow, and the first error.

    ``line`` is a line's traits. Behind the first error nothing changes.
    """
    width, word, header = line["width"], line["word"], line["header"]
    stack, kinds, opened = state["stack"], state["kinds"], state["body"]
    deeper = width > F.element_at(stack, -1)

    def moved(kept: Column) -> Column:
        last = F.when(opened, F.lit("")).otherwise(F.element_at(F.slice(kinds, 1, F.size(kept)), -1))
        unmatched = F.lit(False)
        for name, before in _AFTER.items():
            unmatched = unmatched | ((word == name) & header & ~last.isin(*before))
        error = (
            F.when(opened & ~deeper, "a header without a body")
            .when(~opened & deeper, "an unexpected indent")
            .when(~opened & (F.element_at(kept, -1) != width), "a dedent to no level")
            .when(header & ~line["colon"], "a header without a colon")
            .when(~header & line["ends"], "a colon without a header")
            .when(unmatched, "a part without its header")
            .otherwise(line["fault"])
        )
        next_stack = F.when(opened & deeper, F.concat(stack, F.array(width))).otherwise(kept)
        held = F.when(opened & deeper, kinds).otherwise(F.slice(kinds, 1, F.size(kept) - 1))
        next_kinds = F.concat(held, F.array(F.when(header, word).otherwise("")))
        return F.struct(next_stack.alias("stack"), next_kinds.alias("kinds"), (header & line["ends"]).alias("body"), error.alias("error"))

    return F.when(state["error"].isNull(), _let(F.filter(stack, lambda x: x <= width), moved)).otherwise(state)


def python_error(text: Column) -> Column:
    """The first syntax error of a Python text, or null: brackets, strings, indents, headers, and the order of tokens in a line.

    Errors of meaning (an assignment to a call, a return outside a function) are none. A null text has no error.
    """

    def of_lines(reduced: Column) -> Column:
        lines = F.filter(F.regexp_extract_all(reduced, F.lit(_LINE), F.lit(0)), lambda x: ~x.rlike(r"^\s*$"))
        start = F.struct(
            F.array(F.lit(0)).alias("stack"), F.array(F.lit("")).alias("kinds"), F.lit(False).alias("body"), F.lit(None).cast("string").alias("error")
        )
        folded = F.aggregate(F.transform(lines, _traits), start, _step, lambda s: F.coalesce(s["error"], F.when(s["body"], "a header without a body")))
        return F.coalesce(
            F.when(reduced.rlike(_SHUT), "unbalanced brackets"),
            F.when(reduced.rlike("[\"']"), "an open string"),
            F.when(reduced.rlike(rf"[(\[{{](?:(?:[^()\[\]{{}}]++|{_BALANCED})*+[(\[{{])"), None).otherwise(folded),
        )

    return F.coalesce(bracket_error(text, True), _let(_reduced(text), of_lines))


def syntax_errors(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, error)`` of the files with an error: of Python files the first syntax error, of JS/TS files brackets. No shuffle."""
    text, lang = F.col("text"), language(F.col("path"))
    error = F.when(lang == "python", python_error(text)).when(lang.isNotNull(), bracket_error(text, False))
    return corpus.select(*key, once(error).alias("error")).where("error is not null")
