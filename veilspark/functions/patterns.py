"""Regular expressions shared by the text operators.

Every pattern is a plain Java regex evaluated by Spark's own ``regexp_*`` functions. Repeated groups are
possessive: Java runs those as a loop, so a long string literal cannot exhaust the stack.
"""

# One line terminator. The boundaries at which Python's str.splitlines() cuts.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"

# A line body followed by its terminator, or an unterminated last line.
LINE_WITH_BREAK = (
    r"[^\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]*+(?:" + LINE_BREAK + r")"
    r"|[^\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]++"
)

_TRIPLE_DOUBLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
_DOUBLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"'
_SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'"
_TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"

PY_STRING = "(?:" + "|".join([_TRIPLE_DOUBLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE]) + ")"
PY_COMMENT = r"#[^\n]*+"
# A physical line in which multi-line strings and backslash continuations count as one.
PY_CHUNK = (
    r"(?:[^\n\"'#\\]++|" + PY_STRING + "|" + PY_COMMENT + r"|\\[\s\S]|[\"'\\])++\n?|\n"
)

JS_STRING = "(?:" + "|".join([_DOUBLE, _SINGLE, _TEMPLATE]) + ")"
JS_COMMENT = r"(?://[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)"

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+"
_NUMBER = r"[0-9][A-Za-z0-9_.]*+"

# The plain lexers behind ``tokens``: comments, strings, names, numbers, arrows, blanks, single characters.
# Matches are adjacent, so concatenating the tokens gives the text back.
PY_TOKEN = "|".join([PY_COMMENT, PY_STRING, _NAME, _NUMBER, r"\s++", r"[\s\S]"])
JS_TOKEN = "|".join([JS_COMMENT, JS_STRING, _NAME, _NUMBER, r"=>", r"\s++", r"[\s\S]"])

# Brackets, with strings and comments matched first so that brackets inside them do not count.
PY_BRACKET = PY_COMMENT + "|" + PY_STRING + r"|[()\[\]{}]"
JS_BRACKET = JS_COMMENT + "|" + JS_STRING + r"|[()\[\]{}]"

# A string keeps only its opening quote and a comment vanishes when this is replaced by ``$1$2$3$4``.
PY_BLANKED = "|".join(
    [
        r'(")""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""',
        r"(')''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''",
        r'(")(?:[^"\\\n]++|\\[\s\S])*+"',
        r"(')(?:[^'\\\n]++|\\[\s\S])*+'",
        PY_COMMENT,
    ]
)
PY_BLANKED_WITH = "$1$2$3$4"
# Comment removal: strings and other blanks are kept, comment-only lines go with their line end.
PY_UNCOMMENT = "(" + PY_STRING + r"|[ \t]++(?!#))|(?m:^[ \t]*+" + PY_COMMENT + r"(?:\n|\z))|[ \t]*+" + PY_COMMENT

# JavaScript/TypeScript lexing for redaction: one significant token plus the blanks and comments after it,
# so row counts follow significant tokens only. A slash after an operator opens a regex literal.
JS_TRIVIA = r"(?:\s++|" + JS_COMMENT + ")"
_REGEX_BODY = r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
# A slash opens a regex literal after an operator or one of these words, after a closing parenthesis if a method of
# regexes is called on it, and at the start of the text. A look-behind has a bound: behind more blanks than it spans,
# what can be a literal is taken as one, so that quotes inside it never open a string.
_REGEX_IN_TEXT = (
    r"(?=/(?![/*]))(?:(?<=[(,=:\[!&|?{};+~^%*<>-]\s{0,32}|^|\s{33}"
    r"|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|yield|await|new)\s{1,32})/" + _REGEX_BODY
    + r"|(?<=\)\s{0,32})/" + _REGEX_BODY + r"(?=\s*+\.\s*+(?:test|exec|source|flags)\b))"
)
_REGEX_AT_START = r"/(?![/*=\s])" + _REGEX_BODY
_JS_PLAIN = "|".join(
    [
        JS_STRING,
        r"#?[A-Za-z_$\u0080-\uffff][A-Za-z0-9_$\u0080-\uffff]*+",
        _NUMBER,
        r"=>",
        r"\.\.\.",
        r"\?\.(?![0-9])",
        r"\?\?=?|&&=?|\|\|=?",
        r"[=!]==?|[<>]=",
        r"[-+*/%&|^]=",
        r"\+\+|--",
        r"[\s\S]",
    ]
)
JS_UNIT = (
    "(?:" + JS_TRIVIA + ")++|(?:" + _REGEX_IN_TEXT + "|" + _JS_PLAIN + ")(?:" + JS_TRIVIA + ")*+"
)
# The significant part of one unit ('' for the blanks that may open a text).
JS_HEAD = r"^(?!\s|//|/\*)(?:" + _REGEX_AT_START + "|" + _JS_PLAIN + ")"

# Template literals with substitutions: the code behind ``${`` up to its brace (to the end if braces nest deeper than
# is told apart here), or before the brace that ends an outer substitution; and the pieces of such code.
_BRACES = r"\{[^{}]*+\}"
for _ in range(3):
    _BRACES = r"\{(?:[^{}]++|" + _BRACES + r")*+\}"
JS_TEMPLATE_CODE = r"^(?:[^{}]++|" + _BRACES + r")*+(?:\{[\s\S]*+)?+"
JS_TEMPLATE_REST = r"^[^{}]*+\}"
JS_TEMPLATE_PIECE = (
    _DOUBLE + "|" + _SINGLE + r"|(?<![A-Za-z0-9_$.\u0080-\uffff])_[A-Za-z0-9_$\u0080-\uffff]*+|[^_\"']++|[\s\S]"
)
# Signs of a function in such code.
JS_FUNCTION = r"=>|\bfunction\b|\)\s*+\{"

# The same for Python: strings carry their prefix.
PY_TRIVIA = r"(?:\s++|\\\n|" + PY_COMMENT + ")"
_PY_PLAIN = "|".join([r"(?:[rRbBuUfFtT]{1,2})?+" + PY_STRING, _NAME, _NUMBER, r"[=!<>:]=", r"[\s\S]"])
PY_UNIT = "(?:" + PY_TRIVIA + ")++|(?:" + _PY_PLAIN + ")(?:" + PY_TRIVIA + ")*+"
PY_HEAD = r"^(?!\s|#|\\\n)(?:" + _PY_PLAIN + ")"
# Private names outside attribute access, and everything between them.
PRIVATE_REFERENCE = r"(?<![A-Za-z0-9_$.])_[A-Za-z0-9_]*+"

# Names. ASCII, as in the survey.
CONSTANT_NAME = r"^_*[A-Z0-9_]*[A-Z][A-Z0-9_]*$"

# Base classes whose members are aliased in strict mode.
ENUM_BASES = ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")

# Neutral redaction markers.
MARKER = "/* [REDACTED] */"
BODY_MARKER = " /* [REDACTED] */ "
VALUE_MARKER = "/* [REDACTED] */ null"
TEMPLATE_MARKER = "`/* [REDACTED] */`"
