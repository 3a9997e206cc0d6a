"""Redacted views, statistics, renaming and manifests on the contract's small inputs."""

import ast
import re


from veilspark.functions.patterns import MARKER
from veilspark.operators import context as ctx
from veilspark.operators import diff, manifest, rename
from veilspark.plans import flows
from veilspark.rules import Rule
from veilspark.sources import corpus as src

HARBOUR = '''"Harbour dues. Internal."

from enum import Enum
import dataclasses


@dataclasses.dataclass
class Ship:
    name: str
    berth: int


class Cargo(Enum):
    GRAIN = "gr"
    TIMBER = "tm"  # planks

    def weight(self):
        return "hidden weight"


_DUES = {
    "gr": 0.25,  # quiet
    "tm": 0.75,
}
CUBES = [k ** 3 for k in range(4)]
BOTH = 3, 88
ONE = 9


class Office:
    "Collects dues."

    def charge(
        self,
        ship: Ship,  # whose
        extra: dict = {"b": (3, 4)},
    ) -> tuple[str, int]:
        # said inside
        """Work out what a ship owes.

Flush left line.
        """
        base = 987654321
        def inner_step():
            return base
        return ship.name, base // 2


if True:
    async def nightly(q): return q - 5151
'''

DIFF_PY = '''"Tide tables of a harbour."

from math import sin

_AMPLITUDES = (1.2, 0.4)
MOON_DAYS = {
    "new": 0,
    "full": 14,
}


class Gauge:
    "Reads one gauge."

    def level(self, hour):
        return sin(hour) * _AMPLITUDES[0]


def spring_tide(day):
    "Whether the tide is high."
    return day in MOON_DAYS.values()
'''

DIFF_JS = '''const _DEPTHS = [3.5, 7.25, 12];
const BUOYS = { north: "N7", harbour: "H2" };

function sound(line) {
  return line.map((knot) => knot * 1.83);
}

class Lamp {
  flash(times) {
    for (let k = 0; k < times; k++) { this.on(); this.off(); }
  }
}
'''


def test_python_view(spark, corpus, texts):
    df = corpus(harbour__py=HARBOUR)
    plain = texts(ctx.redact_file(df))["harbour.py"]
    ast.parse(plain)
    for gone in ("987654321", "0.75", "hidden weight", "inner_step", "5151", "quiet", "# whose", "said inside", "88"):
        assert gone not in plain
    for kept in ("-> tuple[str, int]:", "Work out what a ship owes.", "_DUES = ...", 'GRAIN = "gr"',
                 "BOTH = ...", "ONE = 9", "CUBES = [k ** 3", "Harbour dues. Internal.", "@dataclasses.dataclass"):
        assert kept in plain
    strict = texts(ctx.redact_file(df, strict=True))["harbour.py"]
    ast.parse(strict)
    for gone in ("GRAIN", '"gr"', "Internal", "Collects dues.", "Work out what", "hidden weight"):
        assert gone not in strict
    assert "VALUE_0 = 'V0'" in strict and "VALUE_1 = 'V1'" in strict


def test_constructs_one_by_one(spark, corpus, texts):
    df = corpus(a__py=DIFF_PY, b__toml="x = 1", c__py="", d__py="class A:\n    '''only'''\n")
    assert texts(ctx.redact_indented_bodies(df, keep_docstrings=False))["a.py"].count("...\n") == 2
    stripped = texts(ctx.strip_docstrings(df))
    assert "Tide" not in stripped["a.py"] and "Reads" not in stripped["a.py"] and stripped["d.py"] == "class A:\n    pass\n"
    assert stripped["b.toml"] == "x = 1" and stripped["c.py"] == ""
    assert texts(ctx.strip_docstrings(corpus(m__py="'doc'\n")))["m.py"] == "pass\n"
    tables = texts(ctx.redact_constant_tables(df))["a.py"]
    assert "_AMPLITUDES = ...\n" in tables and "MOON_DAYS = ...\n" in tables and "return sin(hour)" in tables


JS = {
    "fn__js": ("function helper(x) { return x * 2; }", "function helper(x) { M }"),
    "meth__js": (
        "class E {\n  constructor(c) { this.c = c; }\n  calc(c) { return c; }\n}\n",
        "class E {\n  constructor(c) { M }\n  calc(c) { M }\n}\n",
    ),
    "arrow__js": ("const f = (a, b) => { return a + b; };", "const f = (a, b) => { M };"),
    "expr__js": ("const f = (n) => n * 7;", "const f = (n) => M null;"),
    "table__js": (
        "const _TIERS = { low: 0.0 };\nconst data = { foo: 1 };\n",
        "const _TIERS = M null;\nconst data = { foo: 1 };\n",
    ),
    "array__js": ("const _R = [['a',0.04], ['c',0.07]];", "const _R = M null;"),
    "nested__js": ("function o() {\n  function i() { return 42; }\n  return i();\n}\n", "function o() { M }\n"),
    "same__js": ("const x = 1;\nconst y = 2;\n", None),
    "empty__js": ("function e() {}\nconst g = () => {};\n", None),
    "control__js": ("if (a) { b(); }\nfor (const x of y) { z(x); }\ntry { a() } catch (e) { b() }\n", None),
    "text__js": ("// function no() { x }\nconst s = 'function q() { r }';\n", None),
    "mixin__js": ("class A extends mixin(B) { m() { return 1 } }\n", "class A extends mixin(B) { m() { M } }\n"),
    "many__js": (
        "const A = 1, TAB = [1,2], C = {};\nfoo(function () { return 2; }, x => x + 1, () => ({a: 1}));\n",
        "const A = 1, TAB = M null, C = M null;\nfoo(function () { M }, x => M null, () => M null);\n",
    ),
    "chain__js": (
        "const r = list\n  .map(x => x * 2)\n  .filter(y =>\n    y > 3)\nconst f = x => y => x + y\nconst g = 1\n",
        "const r = list\n  .map(x => M null)\n  .filter(y =>\n    M null)\nconst f = x => M null\nconst g = 1\n",
    ),
    "regex__js": ("const c = s.replace(/[{(]/g, '');\nfunction f() { return /}/; }\n", "const c = s.replace(/[{(]/g, '');\nfunction f() { M }\n"),
    "shape__ts": (
        "export interface C { id: string; cb: (x) => void }\nexport type R = { ok: boolean };\n"
        "type F = (x: number) => void\nexport function check(c: C): boolean { return c.id; }\n"
        "function g(): { ok: boolean } { return {ok: true}; }\nconst T: Record<string, number> = { a: 1 };\n"
        "class B { private f(x: Array<{a: 1}>): Promise<Map<string, {x: 1}>> {\n return 1 }\n}\n"
        "function h(cb: (x: number) => void): void { cb(1) }\n",
        "export interface C { id: string; cb: (x) => void }\nexport type R = { ok: boolean };\n"
        "type F = (x: number) => void\nexport function check(c: C): boolean { M }\n"
        "function g(): { ok: boolean } { M }\nconst T: Record<string, number> = M null;\n"
        "class B { private f(x: Array<{a: 1}>): Promise<Map<string, {x: 1}>> { M }\n}\n"
        "function h(cb: (x: number) => void): void { M }\n",
    ),
    "ret__ts": ("export const id = (o: Order): string => o.id.toUpperCase();\n", "export const id = (o: Order): string => M null;\n"),
}


def test_js_constructs(spark, corpus, texts):
    df = corpus(**{k: v[0] for k, v in JS.items()}, broken__js="function broken( {{{")
    out = texts(ctx.redact_file(df))
    for name, (source, want) in JS.items():
        assert out[name.replace("__", ".")] == (source if want is None else re.sub(r"\bM\b", MARKER, want)), name
    bodies = texts(ctx.redact_brace_bodies(df))
    assert bodies["table.js"] == JS["table__js"][0] and bodies["same.js"] == JS["same__js"][0]


def test_statistics(spark, corpus):
    df = corpus(tides__py=DIFF_PY, client__js=DIFF_JS, bad__py="def broken(:::\n", notes__md="x")
    rows = {r.path: r for r in diff.diff_context(df).collect()}
    assert set(rows) == {"tides.py", "client.js", "bad.py"}
    py, js, bad = rows["tides.py"], rows["client.js"], rows["bad.py"]
    assert (py.function_bodies_redacted, py.tables_redacted, py.docstrings_stripped) == (2, 2, 0)
    assert (js.function_bodies_redacted, js.tables_redacted) == (2, 2)
    assert py.bytes_after < py.bytes_before and js.bytes_after < js.bytes_before and py.reduction_pct > 0
    assert bad.error and bad.bytes_after == 0
    strict = {r.path: r for r in diff.diff_counts(df, strict=True).collect()}
    assert strict["tides.py"].docstrings_stripped == 3
    totals = diff.diff_totals(diff.diff_context(df)).head()
    assert totals.files == 3 and totals.files_with_error == 1
    assert totals.bytes_before == py.bytes_before + js.bytes_before


def test_document_in_one_string_and_as_files(spark, tmp_path):
    rows = [("r", "main.py", "def f(): return 1\n"), ("r", "lib.js", "function b(x) { return x; }"),
            ("r", "config.toml", "x = 1\n"), ("r", "bad.py", "def broken(:::\n"), ("s", "t.ts", "export const n = 1;\n")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    parts = flows.context(df, "repo")
    docs = {r.repo: r.document for r in ctx.document_text(parts, "repo").collect()}
    md = docs["r"]
    assert md.startswith("<!-- generated by") and "strict: false" in md
    assert "## Files\n\n```\nbad.py\nconfig.toml\nlib.js\nmain.py\n```\n\n## `bad.py`\n\n_(parse error: " in md
    assert "## `main.py`\n\n```python\ndef f(): ...\n```" in md and "```javascript\nfunction b(x) {" in md
    assert md.endswith("are not supported:\n\n- `config.toml`\n")
    assert "```typescript\n" in docs["s"] and "not supported" not in docs["s"]
    out = tmp_path / "doc"
    src.write_context(parts, str(out), "repo", partitions=3)
    for repo, text in docs.items():
        written = "".join(p.read_text() for p in sorted((out / f"repo={repo}").glob("part-*")))
        assert written == text
    cut = ctx.document_text(parts, "repo", chunk_bytes=60).orderBy("chunk").collect()
    assert len(cut) > 6 and all(r.bytes == len(r.document.encode()) for r in cut)
    for repo, text in docs.items():
        assert "".join(r.document for r in cut if r.repo == repo) == text


def test_status_and_empty_document(spark, corpus):
    df = corpus(a__py="x = 1").where("path = 'none'")
    assert ctx.context_status(df, strict=True).head().files_discovered == 0
    assert "_(none)_" in "\n".join(r.text for r in flows.context(df).orderBy("rank").collect())


CALC = 'def report(knots):\n    "Speed of a ship."\n    return [_to_km(k) for k in knots]\n\n\ndef _to_km(knot):\n    return knot * 1.852  # fixed\n'
RENAME = {
    "lib__py": (
        "_x = _y = 1\nclass _Internal:\n    pass\n_RATE: float = 2.0\ndef pub(a):\n    obj._x = f\"{_x} _x {a!r}\"\n    return _Internal(_x=_y), __name, _RATE\n",
        {"_x": "_a000", "_y": "_a001", "_Internal": "_a002", "_RATE": "_a003"},
        "_a000 = _a001 = 1\nclass _a002:\n    pass\n_a003: float = 2.0\ndef pub(a):\n    obj._x = f\"{_a000} _x {a!r}\"\n    return _a002(_x=_a001), __name, _a003\n",
    ),
    "dunder__py": ("class Foo:\n    def __init__(self):\n        self.x = 1\n", {}, None),
    "prop__js": (
        "function _helper(x) { return x * 2; }\nconst obj = { _helper: 'else' };\nexport function go() {\n  return _helper(obj._helper);\n}\n",
        {"_helper": "_a000"},
        "function _a000(x) { return x * 2; }\nconst obj = { _helper: 'else' };\nexport function go() {\n  return _a000(obj._helper);\n}\n",
    ),
    "kinds__js": (
        "const __v = '1';\nexport const _util = (x) => x * 2;\nclass _I { _m() { return new _I(); } }\nconst { _d } = o, _e = 1;\nconst s = { _e, k: _e };\nf(a, _e, b);\n",
        {"_util": "_a000", "_I": "_a001", "_e": "_a002"},
        "const __v = '1';\nexport const _a000 = (x) => x * 2;\nclass _a001 { _m() { return new _a001(); } }\nconst { _d } = o, _a002 = 1;\nconst s = { _e, k: _a002 };\nf(a, _a002, b);\n",
    ),
    "type__ts": ("type _T = { x: number };\nexport function make(): _T { return { x: 1 }; }\n", {}, None),
    "none__js": ("export function pub(x) { return x; }\n", {}, None),
    "inner__js": ("if (go) { function _h() { return 1; } }\n", {}, None),
    "config__toml": ("_x = 1\n", {}, None),
    "bad__py": ("def _broken(:::\n", {}, None),
}


def test_renaming(spark, corpus):
    df = corpus(**{k: v[0] for k, v in RENAME.items()})
    result = flows.obfuscate(df)
    out = {r.path: r.text for r in result.corpus.collect()}
    maps = {}
    for r in result.renames.collect():
        maps.setdefault(r.path, {})[r.original] = r.renamed
    for name, (source, names, want) in RENAME.items():
        path = name.replace("__", ".")
        assert maps.get(path, {}) == names, path
        assert out[path] == (source if want is None else want), path
    counts = rename.transform_counts(df, result.renames).head()
    assert (counts.files_transformed, counts.files_copied, counts.renames) == (7, 2, 8)


CODE_SHAPES = {
    "shape__js": (
        "const _k = 1;\nconst s = `_k ${_k + \"_k\"} ${ {a: {b: _k}}.a } ${w ? `in ${_k}` : _k}`;\n",
        "const _a000 = 1;\nconst s = `_k ${_a000 + \"_k\"} ${ {a: {b: _a000}}.a } ${w ? `in ${_a000}` : _a000}`;\n",
    ),
    "shape__py": (
        "from m import (a,\n    _z)\nimport _q; _q2 = 3; _w: int = 4\n_z = 5\nif a: from n import _z\ndef g():\n    yield from _z\n    return _q2, _w\n",
        "from m import (a,\n    _z)\nimport _q; _a000 = 3; _a001: int = 4\n_a002 = 5\nif a: from n import _z\ndef g():\n    yield from _a002\n    return _a000, _a001\n",
    ),
}


def test_renaming_in_templates_imports_and_after_semicolons(spark, corpus, texts):
    df = corpus(**{k: v[0] for k, v in CODE_SHAPES.items()})
    done = flows.obfuscate(df)
    assert texts(done.corpus) == {k.replace("__", "."): v[1] for k, v in CODE_SHAPES.items()}
    checks = {r.check: r.failures for r in manifest.verify_output(df, done.corpus, done.renames).collect()}
    assert checks["no_private_name"] == 0
    raw = {r.check: r.failures for r in manifest.verify_output(df, df, done.renames).collect()}
    assert raw["no_private_name"] > 0


def test_no_body_hides_behind_templates_or_regex_literals(spark, corpus, texts):
    shown = texts(ctx.redact_brace_bodies(corpus(
        a__js="const t = `${xs.map(x => { return secret1; })}`;\n",
        b__js="const r =          /`/;\nfunction g(a) { return secret2; }\nconst e = `x`;\n",
        c__js="if (x) /`/.test(y);\nfunction g(a) { return secret3; }\nconst e = `x`;\n",
        d__js="const r = " + " " * 90 + "/`/;\nfunction g(a) { return secret4; }\nconst e = `x`;\n",
        e__js="const t = `${ {a: {b: {c: {d: {e: {f: 1}}}}}} , function () { return secret5; } }`;\n",
        f__js="const t = `${a} => ${b}`; const q = (a) / b / c;\n",
    )))
    assert not [p for p, s in shown.items() if "secret" in s]
    assert shown["a.js"] == "const t = `/* [REDACTED] */`;\n"
    assert shown["f.js"] == "const t = `${a} => ${b}`; const q = (a) / b / c;\n"


def test_enum_members_on_one_line(spark, corpus, texts):
    shown = texts(ctx.alias_enums(corpus(e__py="from enum import Enum\nclass C(Enum):\n    A = 11; B = 'x;y'\n    D = 33\n")))["e.py"]
    assert shown == "from enum import Enum\nclass C(Enum):\n    VALUE_0 = 'V0'; VALUE_1 = 'V1'\n    VALUE_2 = 'V2'\n"


def test_pseudonyms_of_rules_that_look_around(spark, corpus, texts):
    rules = [
        Rule("id", r"(?<=id=)\d+"), Rule("tok", r"^TOKEN \w+"), Rule("twice", r"(?P<the_word>[a-z]{3})-(?P=the_word)"),
        Rule("again", r"([A-Z])\1{3}"), Rule("bad", "([A-Z"), Rule("none", "q*"),
    ]
    df = corpus(a="id=123 x\r\nTOKEN aB9 id=7\nabc-abc abc-abd XXXX id=123", b="no entity", c="")
    out, names = rename.pseudonymize(df, rules)
    assert texts(out) == {
        "a": "id=ID_000 x\r\nTOK_000 id=ID_001\nTWICE_000 abc-abd AGAIN_000 id=ID_000", "b": "no entity", "c": "",
    }
    assert {(r.rule_id, r.original) for r in names.collect()} == {("id", "123"), ("id", "7"), ("tok", "TOKEN aB9"), ("twice", "abc-abc"), ("again", "XXXX")}
    # Overlapping matches are one entity: nothing of either stays.
    out, names = rename.pseudonymize(corpus(a="say 12 34 56 on"), [Rule("left", "12 34"), Rule("right", "34 56")])
    assert texts(out) == {"a": "say LEFT_000 on"} and names.head().original == "12 34 56"


def test_keep_list_docstrings_and_comments(spark, corpus):
    df = corpus(a__py='"""Module doc."""\n\ndef _internal_api():\n    """Function doc."""\n\ndef _ns_a(): return 1\n', calc__py=CALC)
    result = flows.obfuscate(df, keep=["_internal_api", "_ns*"], drop_docstrings=True)
    out = {r.path: r.text for r in result.corpus.collect()}
    assert "_internal_api" in out["a.py"] and "_ns_a" in out["a.py"] and "doc." not in out["a.py"]
    assert "_to_km" not in out["calc.py"] and "fixed" not in out["calc.py"]
    assert {(r.entry, r.renamed) for r in rename.rename_entries(result.renames).collect()} == {("calc.py:_to_km", "_a000")}
    for text in out.values():
        ast.parse(text)


def test_manifest_and_gate(spark, corpus):
    df = corpus(calc__py=CALC, note__txt="CUST-ABC-123456")
    done = flows.obfuscate(df)
    checks = manifest.verify_output(df, done.corpus, done.renames, [Rule("c", r"CUST-[A-Z]{3}-\d{6}")])
    assert {r.check: (r.failures, r.passed) for r in checks.collect()} == {
        "rows_preserved": (0, True), "no_private_name": (0, True), "no_secret": (1, False), "brackets_balanced": (0, True),
    }
    untouched = manifest.verify_output(df, df.where("path = 'calc.py'"), done.renames)
    assert {r.check: r.failures for r in untouched.collect()} == {
        "rows_preserved": 1, "no_private_name": 2, "no_secret": 0, "brackets_balanced": 0,
    }
    record = manifest.manifest(df, done.corpus, done.renames, "version: 1", checks=checks)
    rows = {(r.section, r.name): r.value for r in record.collect()}
    assert rows["rename_map", "calc.py:_to_km"] == "_a000"
    assert re.fullmatch("[0-9a-f]{64}", rows["source_files", "calc.py"])
    assert rows["source_files", "note.txt"] == rows["output_files", "note.txt"]
    assert rows["meta", "policy_snapshot"] == "version: 1" and rows["checks", "no_secret"] == "false"
    later = done.corpus.where("path = 'calc.py'").unionByName(corpus(new__txt="n"))
    status = {r.path: r.status for r in manifest.verify_manifest(record, later).collect()}
    assert status == {"calc.py": "ok", "note.txt": "missing", "new.txt": "extra"}
    assert {r.status for r in manifest.verify_manifest(record, df).collect()} == {"ok", "changed"}


def test_pseudonyms(spark, corpus, texts):
    rules = [Rule("email", r"[a-z]+@[a-z]+\.[a-z]+"), Rule("ip", r"\d+\.\d+\.\d+\.\d+")]
    df = corpus(a="b@x.org and a@x.org, b@x.org, ok@x.org, 1.2.3.4", b="none", c="a@x.org")
    out, names = rename.pseudonymize(df, rules, keep=["ok@x.org"])
    assert texts(out) == {
        "a": "EMAIL_000 and EMAIL_001, EMAIL_000, ok@x.org, IP_000", "b": "none", "c": "EMAIL_000",
    }
    got = {(r.path, r.original): r.renamed for r in names.collect()}
    assert got == {("a", "b@x.org"): "EMAIL_000", ("a", "a@x.org"): "EMAIL_001", ("a", "1.2.3.4"): "IP_000", ("c", "a@x.org"): "EMAIL_000"}
    assert texts(rename.passthrough(df, out.where("path = 'c'")))["a"].startswith("b@x.org")


def test_one_large_file(spark):
    """A file of many definitions goes through the windows whole and in order."""
    n = 3000
    text = "".join(f"def _f{i}(x):\n    return {i} + _f{i - 1 if i else 0}(x)\n\n" for i in range(n))
    df = spark.createDataFrame([("big.py", text)], "path string, text string")
    view = ctx.redact_file(df).head()
    assert view.bodies == n and view.text.count("    ...\n") == n and "return" not in view.text
    done = flows.obfuscate(df)
    out = done.corpus.head().text
    assert "_f" not in out and f"def _a{n - 1}(x):\n    return {n - 1} + _a{n - 2}(x)" in out


def test_plans_move_each_text_once(spark, corpus):
    """One exchange by file before the text is cut up; windows and groupings add none."""
    df = corpus(a__py=DIFF_PY)
    plan = ctx.redact_indented_bodies(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan.replace("python", "")


def test_rows_that_share_a_key(spark):
    js = ["function f() { return 1; }\n", "function g(a) { return secret; }\n", "function f() { return 1; }\n"]
    py = ["def a():\n    return 1\n", "class B:\n    def b(self):\n        return hidden\n"]
    rows = [("a.js", t) for t in js] + [("b.py", t) for t in py]
    df = spark.createDataFrame(rows, "path string, text string")
    want = sorted([f"function f() {{ {MARKER} }}\n"] * 2 + [f"function g(a) {{ {MARKER} }}\n", "def a():\n    ...\n", "class B:\n    def b(self):\n        ...\n"])
    assert sorted(r.text for r in ctx.redact_file(df).collect()) == want
    bodies = sorted(r.text for r in ctx.redact_brace_bodies(df).collect())
    assert bodies == sorted([t for t in want if t.startswith("function")] + py)


def test_release_runs_to_the_gate(spark, corpus, texts, tmp_path):
    df = corpus(
        a__py="def _hidden(x):\n    return x\n\ny = _hidden(1)\n",
        b__js="const _limit = 3;\nshow(_limit);\n",
        c__py="def broken(:\n",
        d__txt="plain\n",
    )
    done = flows.release(df, str(tmp_path / "out"), policy_text="version: 1")
    after = texts(done.corpus)
    assert set(after) == {"a.py", "b.js", "c.py", "d.txt"} and "_hidden" not in after["a.py"] and "_limit" not in after["b.js"]
    assert after["d.txt"] == "plain\n"
    assert {r.check: r.passed for r in done.checks.collect()} == dict.fromkeys(
        ("rows_preserved", "brackets_balanced", "no_secret", "no_private_name"), True
    )
    counts = done.counts.first()
    assert counts.passed and counts[[c for c in done.counts.columns if "renam" in c or "symbol" in c][0]] == 2
    names = {(r.section, r.name) for r in done.manifest.collect()}
    assert {("output_files", "a.py"), ("source_files", "d.txt"), ("rename_map", "a.py:_hidden")} <= names
