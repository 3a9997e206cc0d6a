"""Syntax errors of Python files, with Python's own parser as the oracle."""

from __future__ import annotations

import ast
import glob
import random
import sysconfig

from pyspark.sql import functions as F

from veilspark.operators.context import redact_file
from veilspark.operators.diff import diff_context, diff_totals
from veilspark.operators.python_syntax import python_error, syntax_errors
from veilspark.operators.rename import passthrough, private_definitions
from veilspark.plans import flows

BROKEN = {
    "def f(x)\n    return 1\n": "a header without a colon", "x = = 3\n": "two operators", "class A\n    pass\n": "a header without a colon",
    "if x:\n    y = 1\n  z = 2\n": "a dedent to no level", "x = 3 +\n": "dangling operator", "def f():\nx = 1\n": "a header without a body",
    "  x = 1\n": "an unexpected indent", "print 'x'\n": "two values without an operator", "x = 'abc\n": "an open string", "for i in\n    pass\n": "a header without a colon",
    "x = (1 + ) * 2\n": "dangling operator", "a b\n": "two values without an operator", "while True\n  pass\n": "a header without a colon",
    "else:\n    x\n": "a part without its header", "try:\n    x\nfoo()\nexcept E:\n    y\n": "a part without its header", "x = [1,,2]\n": "two commas",
    "f(,1)\n": "two commas", "def (x):\n  pass\n": "a function without name and brackets", "x = {1: 2]\n": "unbalanced brackets", "if x == 1: \n": "a header without a body",
    "x = y if\n": "dangling operator", "import\n": "dangling operator", "x = 1 2\n": "two values without an operator", "foo(a b)\n": "two values without an operator",
    "x:\n  y\n": "a colon without a header", "def f(x):\n    return x *\n\n\nz = 1\n": "dangling operator", "x ?= 1\n": "a sign outside the language",
    "f(lambda x)\n": "a lambda without a colon", 'x = "a" b\n': "two values without an operator", "x..y\n": "dangling operator", "class A(B:\n  pass\n": "unbalanced brackets",
    "x = 5 if y else\n": "dangling operator", "from x import\n": "dangling operator", "x = \"\"\"abc\n": "an open string", "x = 1\n\ty = 2\n": "an unexpected indent",
}
SOUND = [
    "", "\n\n", "# only\n", "x = 1", "def f(a, /, b, *, c=1, **k) -> int:\n    return -a ** +b if c else ~b\n", "from . import x\nfrom .. import *\nfrom ...a import (b, c,)\n",
    "x = [*a, *b]\ny = {**a, 'b': 1}\nz = x[..., 1:2, ::3]\n", "match x:\n    case [1, *rest] if rest:\n        pass\n    case _:\n        pass\nmatch = 3\nprint(match [0])\n",
    "type X = int\ntype = 3\n", "if a: b = 1; c = 2\nelif d: pass\nelse: pass\n", "try:\n\tx\nexcept* E as e:\n\ty\nelse:\n\tz\nfinally:\n\tw\n",
    "x = 'a' \"b\" f'{x[\"a\"]!r:>{w}}'\ny = rb'c'\n", "lambda *a, **k: (yield)\nasync def f():\n    async with a as b, c as d:\n        await x\n", "x = 0x1f + 1_000.5e-3j + .5 + 5.\n",
    "@a.b(c)\n@d\nclass A(B, metaclass=C): x: int = 3\n", "for i, in x: continue\nwhile (n := f()) != 3: break\n", "x = (\n  1,\n# c\n      2\n)\nif (a and\n  b): pass\n", "a = b = c\na += b; a //= c; a >>= 2; a @= d\n",
    "x = 1 \\\n  + 2\n", "def f():\n    '''doc'''\n\n# c\n  # d\n    return not a is not b not in c\n", "print(*a, sep='')\nx = not y\nassert x, y\nraise A from B\n", "if x:\n        y\n\nelse:\n  z\n", "x = a if b else c if d else e\nglobal_ = in_ = 1\n",
]


def errors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: r.e for r in df.select("k", python_error(F.col("text")).alias("e")).collect()}


def accepted(text):
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def test_broken_texts_have_their_error(spark):
    assert not any(map(accepted, BROKEN))
    found = errors(spark, list(BROKEN))
    assert {t: found[k] for k, t in enumerate(BROKEN)} == BROKEN


def test_sound_texts_have_none(spark):
    assert all(map(accepted, SOUND))
    assert {SOUND[k]: e for k, e in errors(spark, SOUND).items() if e} == {}
    assert errors(spark, [None])[0] is None


def test_python_sources_have_none(spark):
    """Hundreds of files that Python itself parses."""
    root = sysconfig.get_paths()["stdlib"]
    texts = []
    for path in sorted(glob.glob(f"{root}/*.py") + glob.glob(f"{root}/[a-j]*/*.py"))[:300]:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        if len(text) < 40_000 and accepted(text):
            texts.append(text)
    assert len(texts) > 150
    assert {k: e for k, e in errors(spark, texts).items() if e} == {}


def test_damaged_sources_are_mostly_found(spark):
    """A line of a sound text loses its colon, an operand or its indent; what Python refuses is found nine times in ten, what it accepts never."""
    rng = random.Random(4)
    lines = "def f(a, b):\n    if a == b:\n        x = a + b * 2\n    for i in range(3):\n        x = [a, b, i]\n    while a < b:\n        a += 1\n    return x\nclass A(B):\n    y = 3\n    def g(self):\n        return self.y - 1\n".splitlines()
    texts = []
    for _ in range(400):
        k, own = rng.randrange(len(lines)), list(lines)
        kind = rng.randrange(4)
        own[k] = [own[k].replace(":", ""), own[k][:-1], " " + own[k], own[k].replace(" ", "  = ", 1) if own[k][0] != " " else own[k].replace(" = ", " = = ")][kind]
        texts.append("\n".join(own) + "\n")
    found = errors(spark, texts)
    refused = [k for k, t in enumerate(texts) if not accepted(t)]
    assert len(refused) > 200
    assert sum(found[k] is not None for k in refused) >= 0.9 * len(refused)
    assert not [texts[k] for k, e in found.items() if e and k not in refused]


def test_broken_files_are_not_shown_and_counted(spark, corpus):
    df = corpus(a__py="def f(x)\n    return secret_rate\n", b__py="def g(x):\n    return 1\n", c__js="f(", d__py="_x = = 3\n", e__md="def f(x)\n")
    view = {r.path: (r.error, r.text) for r in redact_file(df).collect()}
    assert view["a.py"] == ("a header without a colon", None) and view["d.py"] == ("two operators", None) and view["b.py"][0] is None
    assert {r.path: r.error for r in syntax_errors(df).collect()} == {"a.py": "a header without a colon", "c.js": "unbalanced brackets", "d.py": "two operators"}
    assert diff_totals(diff_context(df)).first().files_with_error == 2
    # Renaming copies them as they are.
    assert private_definitions(df).count() == 0
    done = flows.obfuscate(df)
    assert {r.path: r.text for r in done.corpus.collect()}["d.py"] == "_x = = 3\n"
    assert passthrough(df, df.limit(0)).count() == 5
